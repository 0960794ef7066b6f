"""Line deduplication with two Bloom filters.

A line's key is the line stripped of ASCII white space, A-Z lower-cased. Keys of
at least MIN_CHARS code points that occur in two documents or more stay only in
the document with the smallest id.

1. Each task turns the keys of its documents into filter bits, two for a key,
   and sends them as sorted 16-bit offsets by segment of 65,536 bits, about two
   bytes a bit. Per segment they merge into the once-seen filter; bits that a
   second fragment sets again, or that one task saw in two documents, form the
   twice-seen filter. It has no false negatives.
2. Keys found in the twice-seen filter are the suspected repeats. Only they are
   shuffled, as 128-bit digests with the document id, and grouped for exact
   confirmation and the choice of the smallest id.
3. Documents join the digests that they lose, and drop those lines.

The filter has BITS_PER_LINE bits for each line, found by a count, up to
MAX_FILTER_BYTES, as it is broadcast; in a larger corpus the filter is fuller,
more keys are suspected and the confirmation shuffles more. The result is the
same at any size of the filter.

Defined cases: a null or empty text is one empty line; rows with a null id keep
all their lines and count for no other document; rows with the same id are the
same document; an empty table gives no rows; other columns are passed through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import narrow

MIN_CHARS = 10
BITS_PER_LINE, MAX_FILTER_BYTES = 16, 64 << 20
BLANK = " \t\n\x0b\x0c\r"
FLUSH = 1 << 20


def keys(text: str) -> list[str]:
    low = text.lower() if text.isascii() else text.encode().lower().decode()
    return [x.strip(BLANK) for x in low.split("\n")]


def digests(text: str, least: int) -> dict[str, int]:
    """128-bit digest of each distinct long key."""
    from xxhash import xxh3_128_intdigest

    return {k: xxh3_128_intdigest(k) for k in keys(text) if len(k) >= least}


def signed(x: int) -> int:
    x &= 0xFFFFFFFFFFFFFFFF
    return x - (1 << 64) if x >> 63 else x


def places(h: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (h >> np.uint64(40)) % np.uint64(segments), (h & np.uint64(0xFFFF)).astype(np.uint16), (h >> np.uint64(16) & np.uint64(0xFFFF)).astype(np.uint16)


def fragments(segments: int, least: int):
    def bits(h: np.ndarray) -> np.ndarray:
        segment, a, b = places(h, segments)
        s = segment << np.uint64(16)
        return np.unique(np.concatenate([s | a, s | b]))

    def flush(chunks: list) -> pa.RecordBatch:
        h = np.array([x for c in chunks for x in c], np.uint64)
        own, count = np.unique(h, return_counts=True)
        once, twice = bits(own), bits(own[count > 1])
        found = np.unique(once >> np.uint64(16))
        cut = lambda x: np.searchsorted(x, np.append(found, found[-1:] + np.uint64(1)) << np.uint64(16))
        cols = []
        for x in (once, twice):
            at, low = cut(x), (x & np.uint64(0xFFFF)).astype("<u2")
            cols.append(pa.array([low[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary()))
        return pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), *cols], ["segment", "once", "twice"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, n = [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if doc is not None and len(text) >= least:
                    chunks.append([x & 0xFFFFFFFFFFFFFFFF for x in digests(text, least).values()])
                    n += len(chunks[-1])
                    if n >= FLUSH:
                        yield flush(chunks)
                        chunks, n = [], 0
        if n:
            yield flush(chunks)

    return run


def merge(key, group):  # without hints: Spark reads them to choose the kind of call
    once = np.bincount(np.frombuffer(b"".join(group["once"].to_pylist()), "<u2"), minlength=1 << 16)
    twice = once > 1
    twice[np.frombuffer(b"".join(group["twice"].to_pylist()), "<u2")] = True
    return pa.table({"segment": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(twice).tobytes()], pa.binary())})


def twice_filter(texts: DataFrame, least: int, max_bytes: int) -> tuple[np.ndarray, int]:
    lines = texts.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    segments = max(1, min(-(-lines * BITS_PER_LINE // (1 << 16)), max_bytes >> 13))
    out = np.zeros(segments << 13, np.uint8)
    parts = texts.mapInArrow(fragments(segments, least), "segment long, once binary, twice binary").groupBy("segment").applyInArrow(merge, "segment long, bits binary")
    for x in parts.toLocalIterator():  # max_bytes at most in all
        out[x.segment << 13 : (x.segment + 1) << 13] = np.frombuffer(x.bits, np.uint8)
    return out, segments


def suspects(shared, segments: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = shared.value
        has = lambda s, p: twice[(s.astype(np.int64) << 13) + (p >> 3)] >> (7 - (p & 7)) & 1
        for batch in batches:
            doc_of, found = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if doc is not None and len(text) >= least:
                    d = digests(text, least).values()
                    found.extend(d)
                    doc_of.extend([doc] * len(d))
            low = np.array([x & 0xFFFFFFFFFFFFFFFF for x in found], np.uint64)
            high = np.array([x >> 64 for x in found], np.uint64)
            segment, a, b = places(low, segments)
            i = np.flatnonzero(has(segment, a) & has(segment, b))
            yield pa.RecordBatch.from_arrays([pa.array(low[i].view(np.int64)), pa.array(high[i].view(np.int64)), pa.array(np.array(doc_of, np.int64)[i])], ["k1", "k2", "doc_id"])

    return run


def dropper(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_intdigest

        for batch in batches:
            texts, lines, dropped = [], [], []
            for text, lost in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = text.split("\n")
                kept = own
                if lost:
                    gone = {(x["k1"], x["k2"]) for x in lost}
                    kept = []
                    for line, k in zip(own, keys(text), strict=True):
                        if len(k) >= least:
                            d = xxh3_128_intdigest(k)
                            if (signed(d), signed(d >> 64)) in gone:
                                continue
                        kept.append(line)
                texts.append("\n".join(kept))
                lines.append(len(own))
                dropped.append(len(own) - len(kept))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), batch.column(2)], ["kept_text", "n_lines", "n_dropped", "rest"])

    return run


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, max_filter_bytes: int = MAX_FILTER_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of docs, with the text replaced by its kept lines, and n_lines and n_dropped in a struct `lines`."""
    spark = docs.sparkSession
    texts = narrow(docs, id_col, text_col)
    twice, segments = twice_filter(texts, min_chars, max_filter_bytes)
    shared = spark.sparkContext.broadcast(twice)
    found = written(texts.mapInArrow(suspects(shared, segments, min_chars), "k1 long, k2 long, doc_id long"), "suspects")
    # written, so that the join shuffles both sides anew and Spark can split a key that a third of all documents hold
    repeated = written(found.groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("k1", "k2", "first"), "repeated")
    lost = found.join(repeated, ["k1", "k2"]).where("doc_id > first").groupBy("doc_id").agg(F.collect_set(F.struct("k1", "k2")).alias("lost")).withColumnRenamed("doc_id", "lost_id")
    rest = [c for c in docs.columns if c != text_col]
    each = docs.select(F.col(id_col).cast("long").alias("own_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("own_text"), F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest"))
    joined = each.join(lost, each.own_id == lost.lost_id, "left").select("own_text", "lost", "rest")
    kind = joined.schema["rest"].dataType.simpleString()
    out = joined.mapInArrow(dropper(min_chars), f"kept_text string, n_lines long, n_dropped long, rest {kind}")
    back = [F.col("kept_text").alias(c) if c == text_col else F.col(f"rest.`{c}`").alias(c) for c in docs.columns]
    return out.select(*back, F.struct("n_lines", "n_dropped").alias("lines"))
