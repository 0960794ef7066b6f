"""Exact deduplication by a content sort.

Each task first collapses the equal texts of a bounded buffer to one row with
their count and extreme ids, so a text that fills a third of the table reaches
the sort as a few rows per task. The rows are range-partitioned by sampled
splitters over the start of the normalised text, with a hash behind it so that
a common start does not make a large partition; equal texts always share both.
An external sort on the whole text then brings equals together, and each row is
compared in full with its neighbour. Only digests and counts are joined back to
the documents.

Texts are equal when identical after lower-casing A-Z only.

Defined cases: a null text counts as empty, so null and empty texts form one
group; a null id never stays while its group has another; repeated rows of the
kept id are all marked as kept, as they are the same document; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, narrow

BUFFER_BYTES = 24_000_000
START = 64


def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for the equal texts in each buffer: text, smallest and largest id, count."""
    held: dict[str, list] = {}
    size = 0

    def flush() -> pa.RecordBatch:
        v = list(held.values())
        out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), *(pa.array([x[i] for x in v], pa.int64()) for i in range(3))], ["text", "lo", "hi", "n"])
        held.clear()
        return out

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x = held.get(text)
            if x is None:
                held[text] = [doc, doc, 1]
                size += len(text)
                if size > BUFFER_BYTES:
                    yield flush()
                    size = 0
            else:
                x[2] += 1
                if doc is not None:
                    x[0], x[1] = doc if x[0] is None else min(x[0], doc), doc if x[1] is None else max(x[1], doc)
    yield flush()


def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by text to one row for each run of equal texts."""
    names, types = ["text_sha256", "lo", "hi", "group_size"], [pa.string(), pa.int64(), pa.int64(), pa.int64()]
    last, lo, hi, n = None, None, None, 0

    def ended(out: list) -> None:
        if last is not None:
            out.append((hashlib.sha256(last.encode()).hexdigest(), lo, hi, n))

    def batch_of(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, types, strict=True)], names)

    for batch in batches:
        out: list = []
        for text, a, b, k in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if text == last:
                n += k
                lo = a if lo is None else lo if a is None else min(lo, a)
                hi = b if hi is None else hi if b is None else max(hi, b)
            else:
                ended(out)
                last, lo, hi, n = text, a, b, k
        yield batch_of(out)
    out = []
    ended(out)
    yield batch_of(out)


def text_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """text_sha256, lo, hi, group_size of each distinct normalised text."""
    norm = narrow(docs, id_col, text_col).select("doc_id", ascii_lower(F.col("text")).alias("text"))
    few = norm.mapInArrow(collapse, "text string, lo long, hi long, n long")
    dealt = few.repartitionByRange(F.substring("text", 1, START), F.xxhash64("text")).sortWithinPartitions("text")
    return dealt.mapInArrow(neighbours, "text_sha256 string, lo long, hi long, group_size long")


def exact_groups(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256. keep: smallest or largest id stays."""
    each = narrow(docs, id_col, text_col).select("doc_id", F.sha2(ascii_lower(F.col("text")), 256).alias("text_sha256"))
    classes = text_classes(docs, id_col, text_col).select("text_sha256", F.col("hi" if keep == "largest" else "lo").alias("keep_id"), "group_size")
    return each.join(classes, "text_sha256").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
