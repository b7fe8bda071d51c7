"""Crawl logs and document batches as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loam.operators.logs import FILE_MARKS, classified
from loam.operators.store import batch_status, latest, upsert

_SCHEMA = "run_id long, line_no int, line string, status string, file_name string, url string"


def _with_last_url(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Lines of one run in order, with the last address named so far; that address is the state."""
    rows = pd.concat(list(batches)).sort_values("line_no")
    last = state.get[0] if state.exists else ""
    urls = []
    for status, own in zip(rows["status"], rows["own_url"]):
        last = own if isinstance(own, str) else last
        urls.append(last if status in FILE_MARKS else own if isinstance(own, str) else "")
    state.update((last,))
    yield rows.drop(columns="own_url").assign(url=urls)


def parsed_stream(lines: DataFrame) -> DataFrame:
    """As ``logs.parsed`` over a stream of lines; lines of a run must arrive in order, micro-batch by micro-batch.

    State is one address a run.
    """
    out = lines.select("run_id", "line_no", "line", *[c.alias(k) for k, c in classified(F.col("line")).items()])
    return out.groupBy("run_id").applyInPandasWithState(_with_last_url, _SCHEMA, "last string", "append", GroupStateTimeout.NoTimeout)


def file_stream(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A stream over a Parquet table of a folder, a file or a directory of files, a few files a micro-batch."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{table}")
    reader = spark.readStream.schema(spark.read.parquet(f"{folder}/{table}").schema).option("maxFilesPerTrigger", 8)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.parquet(f"{folder}/{table}")
    return reader.option("pathGlobFilter", table).parquet(folder)


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Work off what a stream holds now, micro-batch by micro-batch, and return; a restart goes on after the last one."""
    query = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def appended(stream: DataFrame, folder: str, name: str) -> DataFrame:
    """What an append-mode stream gives, as a table in ``folder``; written exactly once a micro-batch."""
    path = f"{folder}/{name}"
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}-state").option("path", path).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def incremental_store(spark: SparkSession, batches: DataFrame, root: str) -> DataFrame:
    """A stream of file rows (site, file_key, md5, entry_id) merged into an index below ``root``, batch after batch.

    Gives the statuses that the batches met: batch, status, files. Within a batch the last row of a key holds; a batch
    that is worked off again after a failure replaces its own version.
    """
    def version(batch: int) -> str:
        return f"{root}/index/v{batch}"

    def merge(rows: DataFrame, batch: int) -> None:
        own = latest(rows, ["site", "file_key"], [F.col("entry_id")]).select("site", "file_key", "md5")
        empty = own.where("false")
        index = spark.read.schema(own.schema).parquet(version(batch - 1)) if batch else empty
        status = batch_status(own, index).groupBy("status").agg(F.count(F.lit(1)).alias("files"))
        status.select(F.lit(batch).cast("long").alias("batch"), "status", "files").write.mode("overwrite").parquet(f"{root}/statuses/batch={batch}-")
        upsert(index, own).write.mode("overwrite").parquet(version(batch))

    run_available(batches, merge, f"{root}/state")
    return spark.read.schema("batch long, status string, files long").option("recursiveFileLookup", "true").parquet(f"{root}/statuses")
