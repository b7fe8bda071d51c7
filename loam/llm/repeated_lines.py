"""Lines that a site repeats across its documents.

Line counts are kept per site as tables that grow by deltas: a new partition of documents adds its counts, lines that
cross the threshold (either way, as a site's total grows too) are found by comparing the counts before and after, and
only documents that hold a line which crossed are rebuilt.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.sources.scratch import exists, scratch_path, stored

MIN_DOCS = 5
MIN_SHARE = 0.05
#: White space of any kind: Unicode's, and the zero-width space and byte order mark.
WHITE = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"
#: Up to so many repeated lines (8 bytes each) are sent to every task; beyond it the join is shuffled and salted.
BROADCAST_LINES = 500_000
#: What identifies a line.
LINE = ["site_hash", "line_hash"]
#: Folders into which the postings of a delta are divided by line.
BUCKETS = 8
#: Parts of one line's occurrences in the shuffled join.
SALTS = 16


def line_form(line: Column) -> Column:
    """What counts as one line: no white space, one letter case, every ASCII digit run as 0."""
    bare = F.regexp_replace(line, WHITE, "")
    return F.regexp_replace(F.lower(F.upper(bare)), "[0-9]+", "0")


def lines_of(docs: DataFrame) -> DataFrame:
    """Every line that holds a letter: stored_id, line_no (from 1, empty lines count), site_hash, line_hash.

    Null content and null ids give no lines. The line hash covers the site and is compared together with the site's hash,
    so that only lines of one site could be taken for one another; a null site is a site of its own.
    """
    site = F.coalesce("site", F.lit(""))
    return (
        docs.where("stored_id is not null").select("stored_id", F.xxhash64(site).alias("site_hash"), F.posexplode(F.split("content", "\n", -1)).alias("pos", "line"))
        .select("stored_id", (F.col("pos") + 1).alias("line_no"), "site_hash", line_form(F.col("line")).alias("form"))
        .where(F.col("form").rlike(r"\p{L}"))
        .select("stored_id", "line_no", "site_hash", F.xxhash64("site_hash", "form").alias("line_hash"))
    )


@dataclass
class LineCounts:
    """The state: documents a line, documents a site, and the documents counted so far."""

    lines: DataFrame  # site_hash, line_hash, docs
    sites: DataFrame  # site_hash, docs
    seen: DataFrame  # stored_id

    @classmethod
    def empty(cls, spark: SparkSession) -> LineCounts:
        return cls(
            spark.createDataFrame([], "site_hash long, line_hash long, docs long"),
            spark.createDataFrame([], "site_hash long, docs long"),
            spark.createDataFrame([], "stored_id long"),
        )

    def repeated(self, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
        """The lines at or over both thresholds: line_hash, site_hash."""
        return (
            self.lines.where(F.col("docs") >= min_docs)
            .join(self.sites.withColumnRenamed("docs", "of"), "site_hash")
            .where(F.col("docs") >= F.lit(min_share) * F.col("of") - F.lit(1e-9))
            .select("line_hash", "site_hash")
        )

    def merge(self, delta: DataFrame, lines: DataFrame | None = None) -> LineCounts:
        """The counts with a delta of documents added; documents counted before are left out.

        ``lines``: ``lines_of(delta)`` where it exists already. Each stored_id counts once a line, however often its row
        is repeated, and documents without content count for their site.
        """
        lines = lines_of(delta) if lines is None else lines
        fresh = delta.select("stored_id", F.xxhash64(F.coalesce("site", F.lit(""))).alias("site_hash")).where("stored_id is not null")
        fresh = fresh.join(self.seen, "stored_id", "left_anti").distinct()
        more = lines.join(self.seen, "stored_id", "left_anti").select("site_hash", "line_hash", "stored_id").distinct()
        counted = more.groupBy("site_hash", "line_hash").agg(F.count(F.lit(1)).alias("docs"))
        total = fresh.groupBy("site_hash").agg(F.count(F.lit(1)).alias("docs"))
        return LineCounts(
            stored(self.lines.unionByName(counted).groupBy("site_hash", "line_hash").agg(F.sum("docs").alias("docs")), "line-counts"),
            stored(self.sites.unionByName(total).groupBy("site_hash").agg(F.sum("docs").alias("docs")), "site-counts"),
            stored(self.seen.unionByName(fresh.select("stored_id")), "seen-documents"),
        )


def crossed_lines(before: LineCounts, after: LineCounts) -> DataFrame:
    """Lines that are repeated in one state and not in the other: site_hash, line_hash, now_repeated."""
    was = before.repeated().withColumn("was", F.lit(True))
    now = after.repeated().withColumn("now", F.lit(True))
    return (
        was.join(now, LINE, "full")
        .where(F.col("was").isNull() | F.col("now").isNull())
        .select(*LINE, F.col("now").isNotNull().alias("now_repeated"))
    )


def occurrences(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``lines`` whose line is in ``wanted`` (site_hash, line_hash): every column of ``lines``.

    How many lines can be repeated is bounded by the threshold: 1 / MIN_SHARE times the lines of a mean document, a
    site. Their number is checked before they are broadcast; otherwise both sides are salted by document, so that a line
    which stands in a third of all documents is spread over SALTS tasks.
    """
    wanted = stored(wanted.select(*LINE).distinct(), "wanted-lines")
    if wanted.count() <= BROADCAST_LINES:
        return lines.join(F.broadcast(wanted), LINE, "left_semi")
    salted = wanted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return lines.withColumn("salt", F.pmod("stored_id", F.lit(SALTS)).cast("int")).join(salted, [*LINE, "salt"], "left_semi").drop("salt")


@dataclass
class Delta:
    """What one delta changed: lines that crossed, and documents to rebuild (the new ones and those with such lines)."""

    crossed: DataFrame  # site_hash, line_hash, now_repeated
    touched: DataFrame  # stored_id


class LineStore:
    """The repeated lines of a growing corpus as tables in a folder.

    A version holds the counts (lines, sites, seen), the postings of its own delta (in buckets by line) and the found
    occurrences. A delta writes the next version: postings of older deltas are looked up for crossed lines alone. A
    version counts once its last table is written, so that a lost job leaves the one before it in force.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self.version = spark, folder.rstrip("/"), 0
        while exists(spark, f"{self._path(self.version + 1, 'found')}/_SUCCESS"):
            self.version += 1

    def _path(self, version: int, table: str) -> str:
        return f"{self.folder}/v{version:05}/{table}"

    def _write(self, df: DataFrame, version: int, table: str, *by: str) -> None:
        df.write.mode("overwrite").partitionBy(*by).option("compression", "zstd").parquet(self._path(version, table))

    def _read(self, version: int, table: str) -> DataFrame:
        return self.spark.read.schema(_TABLES[table]).parquet(self._path(version, table))

    def counts(self, version: int | None = None) -> LineCounts:
        version = self.version if version is None else version
        if not version:
            return LineCounts.empty(self.spark)
        return LineCounts(*(self._read(version, table) for table in ("lines", "sites", "seen")))

    def found(self) -> DataFrame:
        """Occurrences of repeated lines: site_hash, line_hash, stored_id, line_no."""
        return self._read(self.version, "found") if self.version else self.spark.createDataFrame([], _TABLES["found"])

    def merge(self, docs: DataFrame) -> Delta:
        """Adds a delta of documents (stored_id, site, content); those counted before are left out."""
        before, old, new = self.counts(), self.version, self.version + 1
        docs = docs.select("stored_id", "site", "content").where("stored_id is not null")
        fresh = docs.join(before.seen, "stored_id", "left_anti") if old else docs
        bucket = F.pmod("line_hash", F.lit(BUCKETS)).cast("int").alias("bucket")
        self._write(lines_of(fresh).select(*LINE, "stored_id", "line_no", bucket), new, "postings", "bucket")
        lines = self._read(new, "postings")
        after = before.merge(fresh, lines)
        for table, df in (("lines", after.lines), ("sites", after.sites), ("seen", after.seen)):
            self._write(df, new, table)
        after = self.counts(new)
        self._write(crossed_lines(before, after), new, "crossed")
        crossed = self._read(new, "crossed")
        found = occurrences(lines, after.repeated()).select(*LINE, "stored_id", "line_no")
        touched = fresh.select("stored_id")
        if old:
            up, down = crossed.where("now_repeated"), crossed.where("not now_repeated")
            gone = occurrences(self.found(), down)
            postings = self._read(1, "postings")
            for version in range(2, new):
                postings = postings.unionByName(self._read(version, "postings"))
            came = occurrences(postings, up).select(*LINE, "stored_id", "line_no")
            kept = self.found().join(F.broadcast(down.select(*LINE)), LINE, "left_anti")
            touched = touched.unionByName(came.select("stored_id")).unionByName(gone.select("stored_id"))
            found = found.unionByName(came).unionByName(kept)
        self._write(touched.distinct(), new, "touched")
        self._write(found.distinct(), new, "found")
        self.version = new
        return Delta(crossed, self._read(new, "touched"))

    def rebuilt(self, docs: DataFrame, delta: Delta) -> DataFrame:
        """The documents of ``docs`` that a delta changes, as ``without_lines`` gives them."""
        return without_lines(docs.join(delta.touched, "stored_id", "left_semi"), self.found().join(delta.touched, "stored_id", "left_semi"))


_TABLES = {
    "lines": "site_hash long, line_hash long, docs long",
    "sites": "site_hash long, docs long",
    "seen": "stored_id long",
    "postings": "site_hash long, line_hash long, stored_id long, line_no int, bucket int",
    "crossed": "site_hash long, line_hash long, now_repeated boolean",
    "touched": "stored_id long",
    "found": "site_hash long, line_hash long, stored_id long, line_no int",
}


def repeated_line_occurrences(docs: DataFrame, deltas: int = 2, folder: str | None = None) -> DataFrame:
    """Every occurrence of a line that its site repeats: stored_id, line_no, once each.

    ``docs`` needs stored_id, site and content; other columns are ignored. The documents are merged into a store in
    ``folder`` (a new one in the shared scratch folder where none is given) as ``deltas`` deltas by the hash of their id:
    after the first, occurrences in older documents come from their postings for lines that cross the threshold. An empty
    table gives no rows.
    """
    store = LineStore(docs.sparkSession, folder or scratch_path(docs.sparkSession, "line-store"))
    part = F.pmod(F.xxhash64("stored_id"), F.lit(deltas))
    for k in range(deltas):
        store.merge(docs.where(part == k) if deltas > 1 else docs)
    return store.found().select("stored_id", "line_no").distinct()


def without_lines(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with the found lines taken out of content: every column of ``docs``, and removed_lines.

    Documents without such lines come out unchanged; a document of nothing else comes out empty, null stays null. A
    column of ``docs`` that is called removed_lines or _drop is replaced.
    """
    docs = docs.drop("_drop", "removed_lines")
    drop = found.groupBy("stored_id").agg(F.array_sort(F.collect_set("line_no")).alias("_drop"))
    kept = F.filter(F.split("content", "\n", -1), lambda _, i: ~F.array_contains("_drop", i + 1))
    return (
        docs.join(drop, "stored_id", "left")
        .withColumn("content", F.when(F.col("_drop").isNull(), F.col("content")).otherwise(F.array_join(kept, "\n")))
        .withColumn("removed_lines", F.coalesce(F.size("_drop"), F.lit(0)))
        .drop("_drop")
    )


def rebuild_after_delta(before: LineCounts, after: LineCounts, docs: DataFrame) -> DataFrame:
    """The documents of ``docs`` that a delta changes: those new to the state, and those with a line that crossed.

    They come out as ``without_lines`` gives them under the new counts.
    """
    lines = stored(lines_of(docs), "lines")
    touched = occurrences(lines, crossed_lines(before, after)).select("stored_id")
    fresh = docs.select("stored_id").join(before.seen, "stored_id", "left_anti")
    todo = touched.unionByName(fresh).distinct()
    found = occurrences(lines.join(todo, "stored_id", "left_semi"), after.repeated())
    return without_lines(docs.join(todo, "stored_id", "left_semi"), found)
