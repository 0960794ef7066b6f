"""Removal of repeated passages by seed and extend.

Words are runs of anything but ASCII white space. A passage counts as repeated
when WINDOW consecutive words occur at two places or more, in one document or
in several; every word under such a window is removed. Windows are judged on
the input.

Seeds. Hashes of GRAM consecutive words are winnowed: each window selects the
smallest hash in it, so equal windows select the same anchor at the same place.
Consecutive windows that select one anchor form its run; an anchor row carries
the anchor's hash and a hash of all words under the run. What decides a removal,
the hash of a run or of a window, has 128 bits.

Join and extend. Anchors are joined by hash. Where all occurrences of an anchor
agree on the whole run, the extension to both sides is settled for each of its
windows at once. Where they differ, one occurrence of each kind is extended word
by word: its windows are hashed and met with those of the other kinds. The
union of the windows found is the set of maximal repeats of WINDOW words or
more. Occurrences are never paired with each other, so a passage in a third of
all documents costs a row for each anchor in it.

Defined cases: a null or empty text has no words; fewer words than a window
are kept; repeated rows repeat each other, as any two documents do; null ids
are documents of their own; an empty table gives no rows; other columns are
passed through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

WINDOW, GRAM = 35, 8
FILTER_BITS = 1 << 26
BASE = 0x9E3779B97F4A7C15 | 1
TAG = 24  # low bits of a slot: hash of the text; above them the run's number


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Spans:
    """Two independent 64-bit hashes of word spans of one text: the same for equal words wherever they stand."""

    powers = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def __init__(self, words: list[bytes]):
        from xxhash import xxh3_128_digest

        n = len(words)
        if len(Spans.powers[0]) < n + 1:
            size = max(4096, 2 * n)
            Spans.powers = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)])) for b in (BASE, pow(BASE, -1, 1 << 64)))
        h = np.frombuffer(b"".join(map(xxh3_128_digest, words)), "<u8").reshape(n, 2).T
        zero = np.zeros(1, np.uint64)
        self.n, self.sums = n, [np.concatenate([zero, np.cumsum(x * Spans.powers[0][:n])]) for x in h]

    def at(self, start: np.ndarray, length, which: int = 0) -> np.ndarray:
        sums = self.sums[which]
        return mix((sums[start + length] - sums[start]) * Spans.powers[1][start])


def runs(spans: Spans, window: int, gram: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """Of each anchor: its hash, both hashes of the words under its run, the run's first and last window."""
    g = spans.at(np.arange(spans.n - gram + 1), gram)
    chosen = np.arange(spans.n - window + 1) + np.lib.stride_tricks.sliding_window_view(g, window - gram + 1).argmin(1)
    lo = np.flatnonzero(np.diff(chosen, prepend=-1))
    hi = np.append(lo[1:], len(chosen)) - 1
    shape = ((chosen[lo] - lo) << 20 | (hi - lo)).astype(np.uint64)
    return g[chosen[lo]], [mix(spans.at(lo, hi - lo + window, k) ^ mix(shape)) for k in range(2)], lo, hi


def tag_of(text: bytes) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(text, 7) & ((1 << TAG) - 1)


def seeds(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list = [[], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = text.encode()
                words = raw.split()
                if len(words) >= window:
                    a, c, lo, _ = runs(Spans(words), window, gram)
                    for x, y in zip(out, (a.view(np.int64), c[0].view(np.int64), c[1].view(np.int64), np.full(len(a), doc, np.int64), np.arange(len(a), dtype=np.int64) << TAG | tag_of(raw)), strict=True):
                        x.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in out], ["a", "c", "e", "doc", "slot"])

    return run


def extended(window: int, gram: int):
    """Windows, as hashes, of the runs listed for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list = [[], [], [], [], []]
            for doc, text, slots in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                raw = text.encode()
                own = tag_of(raw)
                mine = [s for s in slots if s & ((1 << TAG) - 1) == own]
                if mine:
                    spans = Spans(raw.split())
                    _, _, lo, hi = runs(spans, window, gram)
                    for s in mine:
                        start = np.arange(lo[s >> TAG], hi[s >> TAG] + 1)
                        for x, y in zip(out, (spans.at(start, window).view(np.int64), spans.at(start, window, 1).view(np.int64), np.full(len(start), doc, np.int64), np.full(len(start), s, np.int64), start - start[0]), strict=True):
                            x.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)) for x in out], ["w", "v", "doc", "slot", "off"])

    return run


def remover(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, total, gone = [], [], []
            for text, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = text.encode()
                words = raw.split()
                n = len(words)
                own = tag_of(raw)
                mine = [x for x in found or [] if x["slot"] & ((1 << TAG) - 1) == own]
                if mine:
                    _, _, lo, hi = runs(Spans(words), window, gram)
                    edge = np.zeros(n + 1, np.int64)
                    for x in mine:
                        i = x["slot"] >> TAG
                        first, last = (lo[i], hi[i]) if x["off"] < 0 else (lo[i] + x["off"],) * 2
                        edge[first] += 1
                        edge[last + window] -= 1
                    words = [w for w, covered in zip(words, np.cumsum(edge[:-1]).tolist(), strict=True) if not covered]
                texts.append(b" ".join(words))
                total.append(n)
                gone.append(n - len(words))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), batch.column(2)], ["kept_text", "n_words", "n_removed", "rest"])

    return run


def key_filter(keys: DataFrame, col: str, bits: int):
    """A bitmap of hashed keys, bits in all, and a function of a batch that keeps rows whose first column may be in it."""
    place = F.pmod(F.xxhash64(col), F.lit(bits))
    parts = keys.select(place.alias("p")).distinct().select(F.expr("p div 65536").alias("segment"), (F.col("p") % 65536).alias("low"))

    def pack(key, group):
        x = np.zeros(1 << 16, bool)
        x[group["low"].to_numpy()] = True
        return pa.table({"segment": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(x).tobytes()], pa.binary())})

    out = np.zeros(bits >> 3, np.uint8)
    for x in parts.groupBy("segment").applyInArrow(pack, "segment long, bits binary").toLocalIterator():
        out[x.segment << 13 : (x.segment + 1) << 13] = np.frombuffer(x.bits, np.uint8)
    shared = keys.sparkSession.sparkContext.broadcast(out)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column(0).to_numpy()
            yield batch.filter(pa.array((shared.value[p >> 3] >> (7 - (p & 7)) & 1).astype(bool)))

    return place, keep


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of docs, the text replaced by its kept words, and n_words and n_removed in a struct `words`."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    doc = F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text)).alias("doc")
    each = docs.select(doc, text.alias("own_text"))
    found = written(each.mapInArrow(seeds(window, gram), "a long, c long, e long, doc long, slot long"), "anchors")
    # groups are written before they are joined back: both sides are then shuffled anew, and Spark can split a hot anchor
    shared = written(found.groupBy("a").agg(F.count("*").alias("total"), *[f(x).alias(f"{x}{k}") for x in ("c", "e") for k, f in enumerate((F.min, F.max))]).where("total > 1").select("a", F.expr("c0 <> c1 or e0 <> e1").alias("differ")), "shared")
    seeded = written(found.join(shared, "a"), "seeds")
    whole = seeded.where("not differ").select("doc", "slot")
    kinds = written(seeded.where("differ").groupBy("a", "c", "e").agg(F.count("*").alias("n"), F.min(F.struct("doc", "slot")).alias("one")), "kinds")
    whole = whole.union(seeded.where("differ").join(kinds.where("n > 1").select("a", "c", "e"), ["a", "c", "e"], "left_semi").select("doc", "slot"))
    listed = kinds.select("one.doc", "one.slot").groupBy("doc").agg(F.collect_list("slot").alias("slots"))
    place, keep = key_filter(kinds.select("one.doc"), "doc", FILTER_BITS)
    some = each.select(place.alias("p"), "doc", "own_text").mapInArrow(keep, "p long, doc long, own_text string").drop("p")
    windows = written(some.join(listed, "doc").mapInArrow(extended(window, gram), "w long, v long, doc long, slot long, off long"), "windows")
    met = written(windows.groupBy("w", "v").agg(F.count("*").alias("n")).where("n > 1").select("w", "v"), "met")
    part = windows.join(met, ["w", "v"], "left_semi").select("doc", "slot", "off")
    verdict = whole.select("doc", "slot", F.lit(-1).cast("long").alias("off")).union(part).groupBy("doc").agg(F.collect_set(F.struct("slot", "off")).alias("found")).withColumnRenamed("doc", "found_doc")
    rest = [c for c in docs.columns if c != text_col]
    every = docs.select(doc, text.alias("own_text"), F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest"))
    joined = every.join(verdict, every.doc == verdict.found_doc, "left").select("own_text", "found", "rest")
    kind = joined.schema["rest"].dataType.simpleString()
    out = joined.mapInArrow(remover(window, gram), f"kept_text string, n_words long, n_removed long, rest {kind}")
    back = [F.col("kept_text").alias(c) if c == text_col else F.col(f"rest.`{c}`").alias(c) for c in docs.columns]
    return out.select(*back, F.struct("n_words", "n_removed").alias("words"))
