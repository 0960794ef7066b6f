"""Filter interaction audit over sorted posting lists.

Filters are audited in every order of application: how much each removes, what
it repeats of the filters before it, what only it finds, and what good or toxic
documents it costs.

1. `judge` measures each text once (words, distinct words, capitals, symbols)
   and keeps a bit for each filter that it fails, with the SHA-256 of the text.
   A text is a copy if a smaller id holds the same digest.
2. `postings` deals the failing documents into id ranges per part and keeps, for
   each filter, the sorted list of the failing ids of the range (as places in
   the range's ids). A range holds at most RANGE ids, so a part with a third of
   all rows is many ranges, and no part is gathered anywhere.
3. `merged` builds, range by range, the union of the lists for each of the 32
   sets of filters by galloping k-way merges, and for each filter the difference
   of its list and the union of the filters before it. Sizes add up over ranges.
4. The sums, a few dozen rows a part, give every step of every order.

Defined cases: a null text is empty and has no words (it fails the first filter
only, or is a copy of another empty text); a null part is the empty string;
rows that repeat an id are documents each, and never copies of one another; a
row without an id is counted, is no copy and makes none; several labels of an
id count as 1 where any is 1; labels of absent documents are not counted; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import UPPER

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_UPPER = 100, 80, 10  # words, and two percentages
SYMBOLS = b"#$%&*|"
RANGE = 1 << 16
STRIDE = 64
#: A key is crowded if more than one row in CROWDED has it, so fewer than CROWDED keys are.
CROWDED = 1024


def failures(text: str) -> int:
    """Bits of the filters A to D that the text fails."""
    raw = text.encode()
    words = raw.split()  # of bytes: at space and \\t to \\r only
    return (
        (len(words) < MIN_WORDS)
        | (100 * len(set(words)) < MIN_DISTINCT * len(words)) << 1
        | (100 * (len(raw) - len(raw.translate(None, UPPER.encode()))) > MAX_UPPER * len(text)) << 2
        | (len(raw) != len(raw.translate(None, SYMBOLS))) << 3
    )


def looked_up(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left join on key, which is unique in right; keys that crowd left (fewer than CROWDED) are looked up in place, and only the others shuffled."""
    most = left.count() // CROWDED
    crowded = left.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") > most).select(key)
    added = [F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema if f.name != key]
    few = written(right.join(F.broadcast(crowded), key, "left_semi"), "crowded")
    names = written(crowded, "crowded")
    here = left.join(F.broadcast(names), key, "left_semi").join(F.broadcast(few), key, "left")
    others = left.where(F.col(key).isNotNull()).join(F.broadcast(names), key, "left_anti").join(right, key, "left")
    return here.unionByName(others).unionByName(left.where(F.col(key).isNull()).select("*", *added))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """A row per document: doc_id, part, fails (bit i: fails filter i), good and toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(2).to_pylist()]
            fails = pa.array([failures(x) for x in texts], pa.int32())
            digest = pa.array([hashlib.sha256(x.encode()).digest() for x in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fails, digest], ["doc_id", "part", "fails", "digest"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).cast("string").alias("text"))
    each = written(narrow.mapInArrow(run, "doc_id long, part string, fails int, digest binary"), "judged")
    # partial sums first, so a digest that a third of all rows have is shuffled once a task
    firsts = each.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("digest", "first")
    each = looked_up(each, written(firsts, "copied"), "digest")
    fails = F.col("fails") + F.when(F.col("doc_id") > F.col("first"), 16).otherwise(0)
    each = written(each.select("doc_id", "part", fails.alias("fails")), "judged")
    hit = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), "quality", "toxic").where("doc_id is not null and (quality = 1 or toxic = 1)")
    marks = marks.groupBy("doc_id").agg(hit("quality").alias("good"), hit("toxic").alias("toxic"))
    out = looked_up(each, marks, "doc_id")
    return out.select("doc_id", "part", "fails", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def postings(judged: DataFrame, size: int = RANGE) -> DataFrame:
    """Posting lists per part and id range: ids, rows (documents of each entry), and for each filter, good and toxic the sorted places in ids."""
    names = [*FILTERS, "good", "toxic"]

    def lists_of(fails: np.ndarray, marks: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        failing = {f: fails >> i & 1 for i, f in enumerate(FILTERS)}
        return {n: np.flatnonzero(x).astype(np.int32) for n, x in (failing | marks).items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # sorted by part, then id
            parts = batch.column(0)
            heads = np.append(np.flatnonzero(np.array([True, *(np.array(parts[1:]) != np.array(parts[:-1]))])), batch.num_rows) if batch.num_rows else [0]
            out, cuts = [], [0]
            for a, b in zip(heads[:-1], heads[1:], strict=True):
                for i in range(a, b, size):
                    x = batch.slice(i, min(size, b - i))
                    np_of = lambda c: x.column(c).to_numpy(zero_copy_only=False)  # noqa: B023, E731
                    out.append(lists_of(np_of(2), {"good": np_of(3), "toxic": np_of(4)}) | {"part": parts[a].as_py()})
                    cuts.append(i + x.num_rows)
            cuts = pa.array(cuts, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array([x["part"] for x in out], pa.string()), *[pa.ListArray.from_arrays(cuts, batch.column(c)) for c in (1, 5)], *[pa.array([x[n] for x in out], pa.list_(pa.int32())) for n in names]],
                ["part", "ids", "rows", *names],
            )

    entries = judged.where("fails > 0").groupBy("part", "doc_id", "fails", "good", "toxic").agg(F.count("*").alias("rows"))
    dealt = entries.repartitionByRange("part", "doc_id").sortWithinPartitions("part", "doc_id", "fails").select("part", "doc_id", "fails", "good", "toxic", "rows")
    return dealt.mapInArrow(run, "part string, ids array<long>, rows array<long>, " + ", ".join(f"{n} array<int>" for n in names))


def gallop(keys: np.ndarray, into: np.ndarray) -> np.ndarray:
    """Places of sorted keys in a sorted list: strides of keys that fall into one gap of the list are skipped whole."""
    if not len(keys) or not len(into):
        return np.zeros(len(keys), np.int64)
    heads = np.searchsorted(into, keys[::STRIDE])
    ends = np.append(heads[1:], np.searchsorted(into, keys[-1], side="right"))
    place = np.repeat(heads, STRIDE)[: len(keys)]
    open_ = np.repeat(heads != ends, STRIDE)[: len(keys)]
    place[open_] = np.searchsorted(into, keys[open_])
    return place


def within(keys: np.ndarray, into: np.ndarray) -> np.ndarray:
    """Which of the sorted keys are in the sorted list."""
    if not len(into):
        return np.zeros(len(keys), bool)
    return into[np.minimum(gallop(keys, into), len(into) - 1)] == keys


def merge(lists: list[np.ndarray]) -> np.ndarray:
    """Sorted union of sorted lists: the shorter gallop through the longest."""
    lists = sorted(lists, key=len)
    out = lists.pop() if lists else np.zeros(0, np.int32)
    while lists:
        new = lists.pop()
        new = new[~within(new, out)]
        out = np.insert(out, gallop(new, out), new)
    return out


def sizes(lists: list[np.ndarray], rows: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> Iterator[tuple[int, int, int, int, int, int, int]]:
    """For each filter and each set of filters before it (bits): its failures, those not removed before, the good and toxic among these, all removed after it."""
    count = lambda x: int(rows[x].sum())
    unions = [merge([x for i, x in enumerate(lists) if bits >> i & 1]) for bits in range(1 << len(lists))]
    for i, own in enumerate(lists):
        for before, union in enumerate(unions):
            if not before >> i & 1:
                removed = own[~within(own, union)]
                yield i, before, count(own), count(removed), count(removed[within(removed, good)]), count(removed[within(removed, toxic)]), count(unions[before | 1 << i])


def merged(lists: DataFrame) -> DataFrame:
    """Sizes summed over the ranges of each part."""
    columns = ["filter", "before", "failing", "removed", "good_lost", "toxic_lost", "gone"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                np_of = lambda n: batch.column(n)[r].values.to_numpy(zero_copy_only=False)  # noqa: B023, E731
                got = list(sizes([np_of(f) for f in FILTERS], np_of("rows"), np_of("good"), np_of("toxic")))
                cols = [pa.array(c, pa.int64()) for c in zip(*got, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("part")[r].as_py()] * len(got), pa.string()), *cols], ["part", *columns])

    out = lists.mapInArrow(run, "part string, " + ", ".join(f"`{c}` long" for c in columns))
    return out.groupBy("part", "filter", "before").agg(*[F.sum(c).alias(c) for c in columns[2:]])


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """A row per part, order and step: filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    judged = written(judge(docs, labels, id_col, text_col, part_col), "judged")
    sums = written(merged(postings(judged)), "merged")
    k = len(FILTERS)
    weight = [math.factorial(s) * math.factorial(k - 1 - s) for s in range(k)]  # orders in which just these s filters come before
    alone = F.max(F.when(F.expr("bit_count(before)") == k - 1, F.col("removed"))).alias("unique_fails")
    shapley = F.sum(F.col("removed") * F.array(*[F.lit(w) for w in weight])[F.expr("bit_count(before)")]).alias("shapley")
    totals = sums.groupBy("part", "filter").agg(alone, shapley)
    orders = F.explode(F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])).alias("filter_order")
    parts = judged.groupBy("part").agg(F.count("*").alias("documents")).select("part", "documents", orders)
    each = parts.select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"))
    before = sum((F.when(F.locate(f, F.col("filter_order")) < F.col("step"), 1 << i).otherwise(0) for i, f in enumerate(FILTERS)), F.lit(0))
    each = each.select("*", F.expr(f"locate(substring(filter_order, step, 1), '{FILTERS}') - 1").alias("filter"), before.alias("before"))
    out = each.join(sums, ["part", "filter", "before"], "left").join(totals, ["part", "filter"], "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return out.select(
        "part", "filter_order", "step", (F.col("documents") - number("gone")).alias("kept"), number("removed").alias("removed"), (number("failing") - number("removed")).alias("redundant"),
        *[number(c).alias(c) for c in ("unique_fails", "good_lost", "toxic_lost", "shapley")],
    )
