"""Intermediate tables in the folder that all executors share.

``spark.checkpoint.dir`` names that folder. Only a session whose executors all run on this machine (``local[...]``: tests, a
laptop) may do without it: a temporary folder is then made and set once per session. On a cluster its absence is an error.
Intermediate results that several jobs read again are written there as Parquet: the lineage ends at the files, so a lost
executor costs a re-read and not a recomputation.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_kept: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The shared scratch folder of this session; sets one only where none is configured and all runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, label: str, keep: bool = False) -> str:
    """A new path in the shared folder; ``release`` removes it, with ``keep`` only the end of the process."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    (_kept if keep else _written).append((spark, path))
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back, so that later jobs start from files."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder stands at ``path``, on any file system that Spark reads."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def changed_at(spark: SparkSession, path: str) -> int:
    """When the newest file at ``path`` was changed, as a number; 0 where there is none."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    return max((s.getModificationTime() for s in where.getFileSystem(conf).listStatus(where)), default=0)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores: for work that is slow per row over few large files."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)


def release(spark: SparkSession) -> None:
    """Delete the intermediate tables that this process wrote for ``spark``."""
    for owner, path in [x for x in _written if x[0] is spark]:
        jvm = owner.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(owner.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        _written.remove((owner, path))


@atexit.register
def _release_all() -> None:
    _written.extend(_kept)
    for owner in {id(x[0]): x[0] for x in _written}.values():
        try:
            release(owner)
        except Exception:  # noqa: BLE001 - the session is gone already
            return
