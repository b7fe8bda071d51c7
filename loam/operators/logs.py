"""Crawl logs: what each line says, and the address that a status line belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Marks of the lines that report a file.
FILE_MARKS = {"new": "-> New:", "updated": "-> Updated:", "unchanged": "-> Unchanged:"}


def classified(line: Column) -> dict[str, Column]:
    """status, file_name and own_url of a log line. ``own_url`` is the address that the line itself names, else null."""
    after = lambda mark: F.trim(F.regexp_extract(line, rf"^[\s\S]*{mark}([\s\S]*)$", 1))
    status, name = F.when(F.contains(line, F.lit("-> Error:")), "error").when(~F.contains(line, F.lit("Crawling:")) & F.contains(line, F.lit("[skip]")), "skip").otherwise("info"), F.lit("")
    for kind, mark in reversed(FILE_MARKS.items()):
        hit = F.contains(line, F.lit(mark))
        status, name = F.when(hit, kind).otherwise(status), F.when(hit, after(mark)).otherwise(name)
    url = F.when(F.contains(line, F.lit("Crawling:")), after("Crawling:")).when(F.contains(line, F.lit("[skip]")), F.trim(F.element_at(F.split(line, ": ", -1), -1)))
    return {"status": status, "file_name": name, "own_url": url}


def parsed(lines: DataFrame) -> DataFrame:
    """Log lines (run_id, line_no, line) with status, file_name and url.

    A line that reports a file gets the last address named before it in its run; skipped and crawled lines their own; all
    others none (an empty string).
    """
    out = lines.select("run_id", "line_no", "line", *[c.alias(k) for k, c in classified(F.col("line")).items()])
    last = F.last("own_url", ignorenulls=True).over(Window.partitionBy("run_id").orderBy("line_no"))
    url = F.when(F.col("status").isin(*FILE_MARKS), last).otherwise(F.col("own_url"))
    return out.withColumn("url", F.coalesce(url, F.lit(""))).drop("own_url")


def discovery(lines: DataFrame) -> DataFrame:
    """Lines of a discovery run, ``[pre-crawl] depth=D found=N (doc) URL``: run_id, line_no, depth, found, is_doc, url."""
    line = F.col("line")
    number = lambda key: F.coalesce(F.regexp_extract(line, rf"{key}=(-?\d+)(?:\s|$)", 1).try_cast("int"), F.lit(0))
    last = F.regexp_extract(line, r"(\S+)\s*$", 1)
    return lines.where(F.contains(line, F.lit("[pre-crawl]"))).select(
        "run_id", "line_no", number("depth").alias("depth"), number("found").alias("found"), F.contains(line, F.lit("(doc)")).alias("is_doc"), F.when(last.startswith("http"), last).otherwise("").alias("url")
    )


def run_log(reports: DataFrame) -> DataFrame:
    """The log that crawl runs (run_id, new_files, updated_files, success) must have written: run_id, line_no, line."""
    n = F.coalesce(F.size("new_files"), F.lit(0))
    files = F.concat(F.coalesce("new_files", F.array().cast("array<string>")), F.coalesce("updated_files", F.array().cast("array<string>")))
    crawl = lambda f, i: F.concat(F.lit("[0] ("), (i + 1).cast("string"), F.lit("/10000) Crawling: https://"), f)
    said = lambda f, i: F.concat(F.when(i < n, "  -> New: ").otherwise("  -> Updated: "), f)
    each = F.flatten(F.transform(files, lambda f, i: F.array(crawl(f, i), said(f, i))))
    tail = F.when(F.col("success"), F.array().cast("array<string>")).otherwise(F.array(F.lit("  -> Error: timeout"), F.lit("  -> [skip] URL year 2019 < 2024: https://old.example/2019")))
    return reports.select("run_id", F.posexplode(F.concat(each, tail)).alias("line_no", "line"))


def progress(done: DataFrame, total: Column) -> DataFrame:
    """Done items (run, at) with their number, percent (99 at most), rate a second and seconds left, by time in a run.

    ``total`` is how many the run expects. The rate is null while no time has passed.
    """
    by_time = Window.partitionBy("run").orderBy("at", "item")
    number = F.row_number().over(by_time)
    elapsed = F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.min("at").over(Window.partitionBy("run")).cast("timestamp"))
    out = done.withColumn("total", total).withColumn("number", number).withColumn("_s", elapsed / 1e6)
    rate = F.when(F.col("_s") > 0, F.col("number") / F.col("_s"))
    return out.select(
        "run", "item", "number", F.least(F.lit(99), F.floor(100 * F.col("number") / F.col("total") + 0.5)).cast("int").alias("percent"),
        F.round(rate, 6).alias("rate"), F.floor((F.col("total") - F.col("number")) / rate + 0.5).alias("seconds_left"),
    )
