"""Files as rows: folders of documents, site folders as a crawler leaves them, and office documents as Markdown."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.functions.urls import KNOWN

FILE_META = T.StructType([T.StructField(n, T.StringType()) for n in ("md5", "fetch_date", "source_url", "title")] + [T.StructField("file_size", T.LongType()), T.StructField("content_type", T.StringType())])
SITE_INDEX = T.StructType(
    [T.StructField("last_updated", T.StringType()), T.StructField("total_files", T.LongType())]
    + [T.StructField(n, T.ArrayType(T.StringType())) for n in ("new_files", "updated_files", "deleted_files")]
    + [T.StructField("file_tree", T.MapType(T.StringType(), FILE_META))]
)


def local_files(spark: SparkSession, folder: str, extensions: tuple[str, ...] = ()) -> DataFrame:
    """The files below a folder with one of the extensions (else any known one): path, extension, content, in no order.

    Files without any content are no rows.
    """
    wanted = [e.lower() for e in extensions or (*KNOWN, ".html", ".htm")]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    extension = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    return files.select("path", extension.alias("extension"), "content").where(F.col("extension").isin(wanted))


def local_paths(spark: SparkSession, folder: str, extensions: tuple[str, ...] = ()) -> DataFrame:
    """The paths of ``local_files`` in order: path, extension. No content is read for it."""
    return local_files(spark, folder, extensions).select("path", "extension").orderBy("path")


def site_indexes(spark: SparkSession, root: str) -> DataFrame:
    """The entries of every site's index.json below ``root``: site, file_key (site, slash, name) and the file's metadata.

    A file that is no index gives no entries; missing fields are null.
    """
    read = spark.read.schema(SITE_INDEX).option("multiLine", "true").option("mode", "PERMISSIVE").json(f"{root}/*/index.json")
    site = F.regexp_extract(F.input_file_name(), r"([^/]+)/index\.json$", 1)
    entries = read.select(F.url_decode(site).alias("site"), "last_updated", F.explode("file_tree").alias("name", "meta"))
    return entries.select("site", F.concat("site", F.lit("/"), "name").alias("file_key"), "last_updated", "meta.*")


def site_metadata(spark: SparkSession, root: str) -> DataFrame:
    """As ``site_indexes`` from the single files meta/*.json, for sites without an index."""
    read = spark.read.schema(FILE_META).option("multiLine", "true").json(f"{root}/*/meta/*.json")
    path = F.url_decode(F.input_file_name())
    site = F.regexp_extract(path, r"([^/]+)/meta/[^/]+$", 1)
    return read.select(site.alias("site"), F.concat(site, F.lit("/"), F.regexp_extract(path, r"([^/]+)\.json$", 1)).alias("file_key"), *FILE_META.names)


def export_site_indexes(index: DataFrame, root: str) -> None:
    """One JSON object a site as text files below ``root``, as ``site_indexes`` describes them."""
    name = F.regexp_replace("file_key", "^[^/]*/", "")
    meta = F.struct(*[(F.col(c).cast(T.StringType()) if c != "file_size" else F.col(c)).alias(c) for c in FILE_META.names])
    each = index.groupBy("site").agg(F.map_from_entries(F.collect_list(F.struct(name, meta))).alias("file_tree"), F.count(F.lit(1)).alias("total_files"))
    each.select("site", F.to_json(F.struct("total_files", "file_tree")).alias("value")).write.partitionBy("site").text(root)


# --- office documents -------------------------------------------------------------------------------------------------

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"


def _table(rows: list[list[str]]) -> str:
    width = max(map(len, rows), default=0)
    full = [[c.replace("|", "\\|").replace("\n", "<br>") for c in r] + [""] * (width - len(r)) for r in rows]
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(full[0]), line(["---"] * width), *map(line, full[1:])]) if full and width else ""


def _xml(archive: zipfile.ZipFile, name: str) -> ElementTree.Element:
    raw = archive.read(name)
    if b"<!DOCTYPE" in raw[:1000] or b"<!ENTITY" in raw[:1000]:
        raise ValueError("a document type declaration is not expected here")
    return ElementTree.fromstring(raw)


def docx_markdown(data: bytes) -> str:
    """Headings to level 4, list items and paragraphs, then all tables."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        body = _xml(archive, "word/document.xml").find(f"{_W}body")
    out, text = [], lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    for p in body.findall(f"{_W}p"):
        style = p.find(f"{_W}pPr/{_W}pStyle")
        name, content = (style.get(f"{_W}val") or "" if style is not None else ""), text(p).strip()
        level = re.fullmatch(r"[Hh]eading ?([1-4])", name)
        if content:
            out.append("#" * int(level[1]) + f" {content}" if level else f"- {content}" if "List" in name or p.find(f"{_W}pPr/{_W}numPr") is not None else content)
    for table in body.iter(f"{_W}tbl"):
        out.append(_table([["\n".join(filter(None, (text(p).strip() for p in c.iter(f"{_W}p")))) for c in r.findall(f"{_W}tc")] for r in table.findall(f"{_W}tr")]))
    return "\n\n".join(filter(None, out))


def xlsx_markdown(data: bytes) -> str:
    """A heading and a table a sheet; empty rows go, and a row with one or two of many cells is a heading in bold."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        names = archive.namelist()
        shared = ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in _xml(archive, "xl/sharedStrings.xml").findall(f"{_S}si")] if "xl/sharedStrings.xml" in names else []
        titles = [s.get("name") or "" for s in _xml(archive, "xl/workbook.xml").iter(f"{_S}sheet")]
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        for title, name in zip(titles, sheets):
            out.append(f"## {title}")
            rows: list[list[str]] = []
            for row in _xml(archive, name).iter(f"{_S}row"):
                cells: list[str] = []
                for c in row.findall(f"{_S}c"):
                    at = _column(c.get("r") or "") if c.get("r") else len(cells)
                    cells += [""] * (at - len(cells)) + [_cell_value(c, shared)]
                if any(cells):
                    rows.append(cells)
            plain: list[list[str]] = []
            for cells in rows:
                filled = [c for c in cells if c]
                if len(cells) > 4 and len(filled) <= 2:
                    out += [_table(plain)] if plain else []
                    out.append("**" + " ".join(filled) + "**")
                    plain = []
                else:
                    plain.append(cells)
            out += [_table(plain)] if plain else []
    return "\n\n".join(out)


def _column(reference: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]*", reference)[0]:
        n = n * 26 + ord(ch) - 64
    return max(0, n - 1)


def _cell_value(cell: ElementTree.Element, shared: list[str]) -> str:
    value = cell.find(f"{_S}v")
    if cell.get("t") == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{_S}t")).strip()
    text = (value.text or "") if value is not None else ""
    if cell.get("t") == "s" and text.isdigit():
        return shared[int(text)].strip() if int(text) < len(shared) else ""
    return re.sub(r"\.0$", "", text).strip()


def pptx_markdown(data: bytes) -> str:
    """A heading a slide, then its paragraphs and tables."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        slides = sorted((n for n in archive.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        for k, name in enumerate(slides, 1):
            out.append(f"## Slide {k}")
            root = _xml(archive, name)
            in_table = {p for t in root.iter(f"{_A}tbl") for p in t.iter(f"{_A}p")}
            text = lambda e: "".join(t.text or "" for t in e.iter(f"{_A}t")).strip()
            out += [text(p) for p in root.iter(f"{_A}p") if p not in in_table and text(p)]
            out += [_table([[text(c) for c in r.findall(f"{_A}tc")] for r in t.findall(f"{_A}tr")]) for t in root.iter(f"{_A}tbl")]
    return "\n\n".join(filter(None, out))


#: Converters by extension; others (PDF, old Office formats) can be added by a caller that has a library for them.
CONVERTERS: dict[str, Callable[[bytes], str]] = {".docx": docx_markdown, ".xlsx": xlsx_markdown, ".pptx": pptx_markdown}


def converted(files: DataFrame, converters: dict[str, Callable[[bytes], str]] = CONVERTERS) -> DataFrame:
    """Files (path, extension, content) as Markdown: path, markdown, error. A file that fails has an error and no text."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, extension, content in zip(batch["path"], batch["extension"], batch["content"]):
                try:
                    out.append((path, converters[extension](bytes(content)), None))
                except Exception as error:  # noqa: BLE001 - one bad file must not end the job
                    out.append((path, None, f"{type(error).__name__}: {error}"[:200]))
            yield pd.DataFrame(out, columns=["path", "markdown", "error"])

    return files.select("path", "extension", "content").mapInPandas(rows, "path string, markdown string, error string")
