"""Texts of an Arrow batch as one array of code points, for work on all characters at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Characters worked on at a time; a longer text is a chunk of its own.
CHUNK_CHARS = 1_500_000


def chunks(texts: list[str | None], size: int = CHUNK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(index of the first, texts) of runs of texts of about ``size`` characters; null becomes empty."""
    start, run, n = 0, [], 0
    for i, text in enumerate(texts):
        run.append(text or "")
        n += len(run[-1])
        if n >= size:
            yield start, run
            start, run, n = i + 1, [], 0
    if run:
        yield start, run


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All characters in a row as uint32, and the offset at which each text starts (one more than texts)."""
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    joined = "".join(texts).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(joined, dtype=np.uint32), offsets


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()
