"""Filling containers of fixed capacity with texts: shortest-pack-first over the length histogram.

Only the histogram of lengths goes to the driver: at most ``capacity`` rows. There lengths are placed from the longest
down, each group of equal ones into the shortest packs so far, that is the packing patterns with the most room (or into
new ones where none has room), and pattern counts are updated. The patterns, as ranges of ranks within a length, are joined back to the ranked documents.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.llm.textbytes import column
from loam.sources.scratch import spread, stored

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Parts into which the documents of one length are spread while they are ranked.
RANK_PARTS = 64


@cache
def _tokenizer_files(path: str) -> tuple[str, bytes]:
    """The split pattern, which stands beside the files, and the rank file; read by the driver."""
    import importlib.util

    where = Path(path)
    module = importlib.util.spec_from_file_location("tokenizer_files", where.parent / "__init__.py")
    files = importlib.util.module_from_spec(module)
    module.loader.exec_module(files)
    return files.PATTERN, where.read_bytes()


@cache
def _encoder(pattern: str, ranks: bytes):
    """The tokenizer, made once a process."""
    import tiktoken

    known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=known, special_tokens={})


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id and n_tokens of each text; special tokens' strings are ordinary text, null counts 0.

    The driver reads the tokenizer's files and sends them with the job (under 2 MB).
    """
    files = docs.sparkSession.sparkContext.broadcast(_tokenizer_files(tokenizer))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(*files.value).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in column(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return spread(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(rows, "doc_id long, n_tokens long")


def pieces_within(counts: DataFrame, capacity: int) -> DataFrame:
    """Texts (doc_id, n_tokens) as pieces that fit: doc_id, piece_no (from 0), token_start, length.

    A text is cut only where it exceeds the capacity: into full pieces and a rest. A text of no tokens is a piece of
    length 0.
    """
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n_tokens") - 1, F.lit(0).cast("long")), F.lit(capacity).cast("long"))
    return counts.select("doc_id", "n_tokens", F.posexplode(starts).alias("piece_no", "token_start")).select(
        "doc_id", "piece_no", "token_start", F.least(F.lit(capacity).cast("long"), F.col("n_tokens") - F.col("token_start")).cast("int").alias("length")
    )


def packing_patterns(histogram: dict[int, int], capacity: int, shortest_first: bool = True) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Patterns as ((length, times), ...) with the number of containers packed so, longest lengths first.

    Of all patterns with room for a length, the shortest packs are filled first (the longest ones where
    ``shortest_first`` is off), one of the length each; what finds no room opens new containers.
    """
    open_by_room: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = defaultdict(list)
    rooms = np.zeros(capacity + 1, dtype=bool)
    for length in sorted((k for k in histogram if k > 0), reverse=True):
        left = histogram[length]
        while left:
            fitting = np.flatnonzero(rooms[length:])
            room = length + int(fitting[-1 if shortest_first else 0]) if len(fitting) else capacity
            if len(fitting):
                pattern, count = open_by_room[room].pop()
                rooms[room] = bool(open_by_room[room])
            else:
                # nothing is open: as many containers as the length would fill
                pattern, count = (), -(-left // (capacity // length))
            used = min(count, left)
            if used < count and pattern:
                open_by_room[room].append((pattern, count - used))
                rooms[room] = True
            rest = room - length
            if pattern and pattern[-1][0] == length:
                pattern = (*pattern[:-1], (length, pattern[-1][1] + 1))
            else:
                pattern = (*pattern, (length, 1))
            open_by_room[rest].append((pattern, used))
            rooms[rest] = True
            left -= used
    return [x for room in sorted(open_by_room) for x in open_by_room[room]]


def pattern_ranges(patterns: list[tuple[tuple[tuple[int, int], ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank, first container, times): ranks of a length in a row fill containers in a row."""
    next_rank: dict[int, int] = defaultdict(int)
    out, container = [], 0
    for pattern, count in patterns:
        for length, times in pattern:
            out.append((length, next_rank[length], next_rank[length] + count * times - 1, container, times))
            next_rank[length] += count * times
        container += count
    return out


def rank_buckets(ranges: list[tuple[int, int, int, int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int, int, int]]]:
    """(length, width) of the buckets of each length, and the ranges by bucket: (length, bucket, low, high, container, times).

    A length with many ranges has as many buckets, so that a rank meets a few ranges rather than all of its length.
    """
    by_length: dict[int, list[tuple[int, int, int, int, int]]] = defaultdict(list)
    for r in ranges:
        by_length[r[0]].append(r)
    widths, out = [], []
    for length, own in by_length.items():
        width = -(-(own[-1][2] + 1) // len(own))
        widths.append((length, width))
        out += [(length, bucket, *r[1:]) for r in own for bucket in range(r[1] // width, r[2] // width + 1)]
    return widths, out


def ranked(pieces: DataFrame) -> DataFrame:
    """``pieces`` with the rank within their length (from 0), by doc_id and piece_no within hashed parts of a length.

    A length that a third of all pieces share is ranked in RANK_PARTS tasks: each part counts on from the parts before it.
    """
    parted = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(RANK_PARTS)).cast("int"))
    sizes = parted.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece_no")) - 1
    return parted.withColumn("within", within).join(offsets, ["length", "part"]).withColumn("rank", F.col("within") + F.col("before")).drop("part", "within", "before")


def pack(counts: DataFrame, capacity: int) -> DataFrame:
    """Each text assigned to a container of ``capacity`` tokens.

    Output: doc_id, piece_no, token_start, length, container_id (from 0). Every text comes out once, or in pieces where
    it exceeds the capacity; texts without tokens take no room and go to container 0. Rows repeated in ``counts`` are
    texts of their own. An empty table gives no rows.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    spark = counts.sparkSession
    pieces = stored(pieces_within(counts, capacity), "pack-pieces")
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    ranges = pattern_ranges(packing_patterns(histogram, capacity))
    widths, by_bucket = rank_buckets(ranges)
    # both tables are bounded by the capacity, not by the documents
    width = spark.createDataFrame(widths, "length int, width long")
    table = spark.createDataFrame(by_bucket, "length int, bucket long, low long, high long, first_container long, times long")
    placed = ranked(pieces.where("length > 0")).join(F.broadcast(width), "length").withColumn("bucket", F.floor(F.col("rank") / F.col("width")))
    placed = placed.join(F.broadcast(table), ["length", "bucket"]).where("rank between low and high")
    container = F.col("first_container") + F.floor((F.col("rank") - F.col("low")) / F.col("times"))
    full = placed.select("doc_id", "piece_no", "token_start", "length", container.cast("long").alias("container_id"))
    none = pieces.where("length = 0").select("doc_id", "piece_no", "token_start", "length", F.lit(0).cast("long").alias("container_id"))
    return full.unionByName(none)
