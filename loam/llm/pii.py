"""Personal data in free text: found, and replaced with typed placeholders."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.pii_model import FREQUENT, PRIOR, SpanModel, fitted, shares
from loam.llm.pii_spans import TYPES, Span, capitalised, described
from loam.llm.textbytes import chunks, code_points, column
from loam.sources.scratch import spread

#: What a text shows in place of personal data.
PLACEHOLDER = "[{}]"


def _selected(proposed: list[Span], scores: np.ndarray) -> list[Span]:
    """Of overlapping spans one, the likeliest first; in the order of the text."""
    starts: list[int] = []
    out: list[Span] = []
    for k in np.argsort(-scores, kind="stable"):
        s = proposed[k]
        at = bisect_left(starts, s.start)  # the chosen do not overlap, so only the neighbours can
        if (at == len(out) or s.end <= out[at].start) and (not at or out[at - 1].end <= s.start):
            starts.insert(at, s.start)
            out.insert(at, s)
    return out


def found_spans(texts: list[str | None], model: SpanModel, frequent: Mapping[str, float] | None = None) -> Iterator[tuple[int, list[Span]]]:
    """(index, personal data) of each text that holds any. ``frequent``: of the texts' corpus, as ``frequent_parts`` has it."""
    cut = np.array(model.cut)
    for first, run in chunks(texts):
        doc, proposed, x = described(run, frequent or {})
        scores = model.score(x, proposed[:, 0])
        over = np.flatnonzero(scores >= cut[proposed[:, 0]])
        doc, proposed, scores = doc[over], proposed[over], scores[over]
        ends = np.flatnonzero(np.diff(doc, append=-1)) + 1
        for start, end in zip([0, *ends[:-1].tolist()], ends.tolist()):
            yield first + int(doc[start]), _selected([Span(*s) for s in proposed[start:end].tolist()], scores[start:end])


def frequent_parts(docs: DataFrame) -> dict[str, float]:
    """Pairs of Han signs and capitalised words that stand in many of the texts (doc_id, text), with the per cent of the texts.

    All texts are counted. Each task sends one count a pair or word; what reaches the driver is bounded by the least share.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = column(batch, "text")
            for _, run in chunks(texts):
                chars, offsets = code_points(run)
                han = (chars >= _FIRST) & (chars < _FIRST + _HAN)
                both = han[:-1] & han[1:]
                at = np.flatnonzero(both)
                doc = np.searchsorted(offsets, at, side="right") - 1
                same = at + 1 < offsets[doc + 1]
                pair = (chars[at[same]].astype(np.int64) - _FIRST) * _HAN + chars[at[same] + 1] - _FIRST
                own = np.sort(doc[same] * _HAN * _HAN + pair)  # np.unique makes a table of them instead, which takes longer
                new = np.ones(len(own), dtype=bool)
                new[1:] = own[1:] != own[:-1]
                pairs, n = np.unique(own[new] % (_HAN * _HAN), return_counts=True)
                words = Counter(word for text in run for word in capitalised(text))
                parts = [chr(_FIRST + x // _HAN) + chr(_FIRST + x % _HAN) for x in pairs.tolist()] + list(words)
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.string()), pa.array(n.tolist() + list(words.values()), pa.int64())], names=["part", "n"])

    texts = docs.select("text").where("text is not null")
    total = texts.count()
    counted = spread(texts).mapInArrow(rows, "part string, n long").groupBy("part").agg(F.sum("n").alias("n"))
    kept = counted.where(F.col("n") >= FREQUENT * (total + PRIOR)).collect()
    return shares({x.part: x.n for x in kept}, total)


#: Han signs: the first one, and how many there are.
_FIRST, _HAN = 0x4E00, 0x9FFF - 0x4E00 + 1


def personal_data(docs: DataFrame, model: SpanModel | None = None) -> DataFrame:
    """Every piece of personal data in the texts (doc_id, text): doc_id, pii_type, pii_text, start, end.

    Positions are in code points. Null and empty texts give nothing, other columns are ignored, and an empty table gives
    no rows; a repeated row gives its findings again. ``model`` is fitted where none is given.
    """
    model = model or fitted(docs.sparkSession)
    frequent = frequent_parts(docs)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, out = column(batch, "doc_id"), column(batch, "text"), []
            for i, chosen in found_spans(texts, model, frequent):
                out += [(ids[i], TYPES[s.kind], texts[i][s.start : s.end], s.start, s.end) for s in chosen]
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names=["doc_id", "pii_type", "pii_text", "start", "end"])

    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")).mapInArrow(rows, "doc_id long, pii_type string, pii_text string, start int, end int")


def redacted(docs: DataFrame, model: SpanModel | None = None) -> DataFrame:
    """The texts with placeholders for personal data and all else unchanged: doc_id, text, replaced (their number)."""
    model = model or fitted(docs.sparkSession)
    frequent = frequent_parts(docs)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = column(batch, "text"), [0] * batch.num_rows
            for i, chosen in found_spans(texts, model, frequent):
                parts, last = [], 0
                for s in chosen:
                    parts += [texts[i][last : s.start], PLACEHOLDER.format(TYPES[s.kind].upper())]
                    last = s.end
                counts[i] = len(chosen)
                texts[i] = "".join([*parts, texts[i][last:]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], names=["doc_id", "text", "replaced"])

    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(rows, "doc_id long, text string, replaced int")
