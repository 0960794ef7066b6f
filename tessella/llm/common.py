"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(col: Column) -> Column:
    """A-Z only; other letters stay."""
    return F.translate(col, UPPER, LOWER)


def narrow(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id (long) and the text (null becomes empty), under fixed names, so other columns can't clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def rows(batch: pa.RecordBatch) -> dict[str, list]:
    return {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an array of strings without nulls, one after another, and where each begins (and the last ends)."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    texts = texts.cast(pa.large_string())
    _, at, data = texts.buffers()
    begins = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[begins[0] : begins[-1]], begins - begins[0]


def pieces(batches: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[pa.Table]:
    """Tables of whole rows with about `size` bytes of text in the column, over batches; a longer text is a table of its own."""
    held, n = [], 0
    for batch in batches:
        ends = flat(batch.column(column))[1][1:]
        at = 0
        while at < batch.num_rows:
            done = int(ends[at - 1]) if at else 0
            to = int(np.searchsorted(ends, done + size - n, side="right"))
            if to <= at and held:
                yield pa.Table.from_batches(held)
                held, n = [], 0
                continue
            to = max(to, at + 1)
            held.append(batch.slice(at, to - at))
            n += int(ends[to - 1]) - done
            at = to
    if held:
        yield pa.Table.from_batches(held)
