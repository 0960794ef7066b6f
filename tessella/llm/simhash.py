"""SimHash near-duplicates with pivot distance tables.

A fingerprint has 64 bits a lane; a bit is set when over half of the hashes of
a text's word shingles have it. Fingerprints link at max_bits or fewer
differing bits.

Equal fingerprints collapse first, so copies cost nothing further. The distinct
ones meet in groups by parts of their bits. For few differing bits the parts are
blocks: two fingerprints within max_bits agree on all but max_bits blocks at
least, so they share a group for certain. For many, they are sampled bits, and
the number of tables follows from the recall wanted. The keys grow longer with
the table (and so do the tables in number), so the mean group stays near GROUP
whatever its size, but for the few lengths that blocks can have; bins of many
groups are linked at once, so small ones cost no more than their rows, and a
larger group is dealt as pairs of chunks, each a task's work of its own. (Pivot distances alone can't deal out the table: those of
random fingerprints lie within a few bits of each other.)

PIVOTS reference fingerprints, far from each other and from a bounded sample of
the table's own, are the same for all groups. In a group the distances to them form a table. By the triangle
inequality two fingerprints can only link when no coordinate differs by more
than max_bits: pairs are discarded by the largest coordinate difference, one
coordinate after the other, and only survivors are compared bit by bit. A group
returns a spanning forest of its links, not all pairs, which keeps every
component; components are then joined over the whole table.

`near_copies` is the form for near copies: fingerprints of four lanes over
distinct shingles link at NEAR_BITS, which only proposes components; within
each, pairs are verified by the exact Jaccard similarity of their shingle sets.

Defined cases: a null or empty text has fingerprint zero and links like any
other; fewer words than a shingle are one shingle of the whole sequence; rows
with a null id get a component through the others' ids, null if there is none;
repeated rows are equal fingerprints; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import narrow
from .components import components

SHINGLE, SEED, MAX_BITS = 4, 42, 4
GROUP, CHUNK, PIVOTS, BLOCK_PAIRS, BIN_ROWS = 256, 8192, 32, 65_536, 8192
#: Near copies: words of a shingle, least similarity, lanes, and the bits at which two sets of that similarity still link (64 of 256: their mean is 39).
NEAR_SHINGLE, SIMILARITY, LANES, NEAR_BITS, NEAR_CHUNK, RECALL = 5, 0.8, 4, 64, 512, 0.99
MIX = np.uint64(0xD6E8FEB86659FD93)


def shingle_hashes(text: str, shingle: int, seed: int) -> np.ndarray:
    """Of each shingle its XXH64; none for a text without words."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return np.zeros(0, np.uint64)
    n = len(words) - shingle + 1
    joined = b" ".join(words)
    if n <= 1:
        return np.array([xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    return np.array([xxh64_intdigest(joined[s:e], seed) for s, e in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(h: np.ndarray, lanes: int = 1) -> bytes:
    """The majority bits of the hashes; lanes after the first take them mixed anew."""
    total = np.zeros(64 * lanes, np.int64)
    for i in range(0, len(h), 4096):
        part = [h[i : i + 4096]]
        for k in range(1, lanes):
            x = (part[0] ^ np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * MIX
            part.append((x ^ (x >> np.uint64(32))) * MIX)
        rows = np.ascontiguousarray(np.stack(part, 1), "<u8")
        total += np.unpackbits(rows.view(np.uint8).reshape(len(rows), -1), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * total > len(h), bitorder="little").tobytes()


def row_key(id_col: str = "doc_id", text_col: str = "text"):
    """A hash of id and text: tells rows apart, whatever repeats."""
    return F.xxhash64(F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def lanes_of(count: int) -> list[str]:
    return [f"f{i}" for i in range(count)]


def fingerprinter(shingle: int, seed: int, lanes: int, distinct: bool):
    """Of rows of doc_id, text, row: doc_id, row, the fingerprint's lanes, and, where shingles count once, a hash of their set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            fps, sets = [], []
            for t in batch.column(1).to_pylist():
                h = shingle_hashes(t, shingle, seed)
                if distinct:
                    h = np.unique(h)
                    sets.append(xxh64_intdigest(h.tobytes()))
                fps.append(fingerprint(h, lanes))
            x = np.frombuffer(b"".join(fps), np.int64).reshape(-1, lanes)
            cols = [batch.column(0), batch.column(2), *(pa.array(np.ascontiguousarray(x[:, i])) for i in range(lanes))]
            yield pa.RecordBatch.from_arrays([*cols, *[pa.array(np.array(sets, np.uint64).view(np.int64))] * distinct], ["doc_id", "row", *lanes_of(lanes), *["set"] * distinct])

    return run


def fingerprints(docs: DataFrame, shingle: int, seed: int, lanes: int, distinct: bool, id_col: str, text_col: str) -> DataFrame:
    """doc_id, row (a hash of id and text), the lanes, and set."""
    own = narrow(docs, id_col, text_col).withColumn("row", row_key())
    return own.mapInArrow(fingerprinter(shingle, seed, lanes, distinct), "doc_id long, row long, " + ", ".join(f"{x} long" for x in lanes_of(lanes)) + ", set long" * distinct)


def blocks(n: int, max_bits: int, group: int = GROUP) -> list[np.ndarray]:
    """The key bits of each table: the fewest blocks at which a key of all but max_bits of them has log2(n / group) bits."""
    need = max(1, n // group).bit_length()
    for count in range(max_bits + 1, 17):
        cut = [64 * i // count for i in range(count + 1)]
        out = [np.concatenate([np.arange(cut[i], cut[i + 1]) for i in c]) for c in combinations(range(count), count - max_bits)]
        if min(map(len, out)) >= need:
            return out
    return out


def samples(n: int, lanes: int, similarity: float, recall: float, group: int = GROUP) -> list[np.ndarray]:
    """The key bits of each table: as many tables as find pairs at the similarity with the recall, by the share of bits that agree."""
    bits = max(4, min(60, max(1, n // group).bit_length()))
    agree = 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi
    count = math.ceil(math.log(1 - recall) / math.log1p(-(agree**bits)))
    rng = np.random.default_rng(17)
    return [np.sort(rng.choice(64 * lanes, bits, replace=False)) for _ in range(count)]


def stacked(columns: list) -> np.ndarray:
    """Rows of unsigned lanes."""
    return np.ascontiguousarray(np.stack([np.asarray(c, np.int64) for c in columns], 1)).view(np.uint64)


def dealer(tables: list[np.ndarray], lanes: int):
    """Of rows of id and lanes: a row for each table, with t and k (the key's bits, packed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                x = stacked([part.column(1 + i) for i in range(lanes)])
                bits = np.unpackbits(x.view(np.uint8).reshape(len(x), -1), axis=1, bitorder="little")
                for t, at in enumerate(tables):
                    k = bits[:, at].astype(np.int64) @ (np.int64(1) << np.arange(len(at), dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), t, np.int32)), pa.array(k), *part.columns], ["t", "k", "id", *lanes_of(lanes)])

    return run


def bits_between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    c = np.bitwise_count(a ^ b)
    return sum((c[..., k] for k in range(1, c.shape[-1])), c[..., 0].astype(np.int16))


def starts(x: np.ndarray) -> np.ndarray:
    """Where a value of x isn't that before it."""
    return np.concatenate([np.ones(min(len(x), 1), bool), x[1:] != x[:-1]])


def merged(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Links from the pairs that join what label (changed in place) doesn't hold together yet. A label is a row that has it."""
    links = []
    while len(i):
        low, high = np.minimum(label[i], label[j]), np.maximum(label[i], label[j])
        # each label goes to the least that it meets
        order = np.lexsort((low, high))
        order = order[starts(high[order])]
        order = order[np.lexsort((high[order], low[order]))]
        low, high = low[order], high[order]
        # those that go to one are linked in a row, so that no fingerprint gets a link to each of a crowd
        first, before = starts(low), np.roll(high, 1)
        links += zip(np.where(first, i[order], before).tolist(), np.where(first, j[order], high).tolist(), strict=True)
        to = np.arange(len(label))
        to[high] = low
        while not np.array_equal(to[to], to):
            to = to[to]
        label[:] = to[label]
        left = label[i] != label[j]
        i, j = i[left], j[left]
    return links


def references(x: np.ndarray) -> np.ndarray:
    """At most PIVOTS of x, each a quarter of the bits or more from the others: near ones would tell the same."""
    taken: list[int] = []
    for i in range(len(x)):
        if len(taken) < PIVOTS and (not taken or bits_between(x[taken], x[i]).min() >= 16 * x.shape[1]):
            taken.append(i)
    return x[taken]


def forest(x: np.ndarray, side: np.ndarray, max_bits: int, pivots: np.ndarray, group: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning links of the fingerprints x, within each group (numbered from 0). side: 0 for all alike; 1 and 2 for chunks of which only links across count."""
    table = np.stack([bits_between(x, p) for p in pivots]) if len(pivots) else np.zeros((1, len(x)), np.int16)
    table = table[np.argsort(-table.std(1), kind="stable")]  # what spreads most discards most
    # groups one after another, so far apart that no pair of two of them is near
    place = table[0].astype(np.int64) + (0 if group is None else group.astype(np.int64) * (64 * x.shape[1] + max_bits + 1))
    order = np.argsort(place, kind="stable")
    x, side, table, place = x[order], side[order], table[:, order], place[order]
    count = np.searchsorted(place, place + max_bits, "right") - np.arange(len(x)) - 1
    upto = np.cumsum(count)
    label, links, at = np.arange(len(x)), [], 0
    while at < len(x):
        end = max(at + 1, int(np.searchsorted(upto, upto[at] - count[at] + BLOCK_PAIRS, "right")))
        n = count[at:end]
        i = np.repeat(np.arange(at, end), n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        at = end
        keep = (label[i] != label[j]) & ((side[i] == 0) | (side[i] != side[j]))
        i, j = i[keep], j[keep]
        idle = 0
        for c in table[1:]:
            keep = np.abs(c[i] - c[j]) <= max_bits
            idle = idle + 1 if not len(i) or keep.mean() > 0.98 else 0
            i, j = i[keep], j[keep]
            if idle == 3:  # the radius is too wide for the triangle inequality, or what is left links
                break
        near = bits_between(x[i], x[j]) <= max_bits
        links += merged(label, i[near], j[near])
    return [(int(order[a]), int(order[b])) for a, b in links]


def linker(max_bits: int, lanes: int, pivots: np.ndarray):
    def run(key, rows):
        ids, groups = rows["id"].to_numpy(), np.unique(rows["g"].to_numpy(), return_inverse=True)[1]
        e = np.array(forest(stacked([rows[c].to_numpy() for c in lanes_of(lanes)]), rows["side"].to_numpy(), max_bits, pivots, groups), np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(ids[e[:, 0]]), "b": pa.array(ids[e[:, 1]])})

    return run


def chunked(dealt: DataFrame, keys: list[str], by: str, chunk: int) -> DataFrame:
    """dealt with i, j and side: groups of keys with over chunk rows become pairs of chunks."""
    # few groups are large; written, so that the join shuffles both sides anew or broadcasts these by their known size
    large = written(dealt.groupBy(*keys).agg(F.count("*").alias("c")).where(f"c > {chunk}"), "large-groups")
    salted = dealt.join(large, keys, "left").withColumn("m", F.expr(f"cast(coalesce(ceil(c / {chunk}), 1) as int)"))
    paired = salted.withColumn("own", F.pmod(F.xxhash64(by), "m").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    return paired.select(*dealt.columns, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.expr("case when own = other then 0 when own < other then 1 else 2 end").alias("side"))


def link_forest(nodes: DataFrame, tables: list[np.ndarray], max_bits: int, chunk: int = CHUNK, lanes: int = 1) -> DataFrame:
    """a, b: links among the ids of nodes (id and lanes, distinct) that connect whatever any links connect."""
    names = lanes_of(lanes)
    some = nodes.orderBy(F.xxhash64("id"), "id").limit(16 * PIVOTS).select(*names).collect()
    pivots = references(stacked([[r[c] for r in some] for c in names]))
    dealt = written(nodes.select("id", *names).mapInArrow(dealer(tables, lanes), "t int, k long, id long, " + ", ".join(f"{x} long" for x in names)), "dealt")
    # many groups at once, as with long keys most have a row or two; which ones doesn't matter, as each is linked by itself
    rows = nodes.count() * len(tables)
    bins = max(rows // BIN_ROWS, min(rows // GROUP, 16 * int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))) + 1
    grouped = chunked(dealt, ["t", "k"], "id", chunk).select(F.xxhash64("t", "k", "i", "j").alias("g"), "id", *names, "side")
    return grouped.groupBy(F.pmod("g", F.lit(bins)).alias("bin")).applyInArrow(linker(max_bits, lanes, pivots), "a long, b long")


def labelled(classes: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """key, root, component_id of each row of classes (key, least): the smallest key and `least` reachable over links of keys."""
    found = components(links)
    rooted = written(classes.join(found, F.col(key) == found.u, "left").select(key, "least", F.coalesce("root", key).alias("root")), "rooted")
    # written, so that the join shuffles both sides anew and Spark can split the root of a large component
    named = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "named")
    return written(rooted.join(named, "root").select(key, "root", "component_id"), "labelled")


def near_groups(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, max_bits: int = MAX_BITS, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (long), component_id of every row: the smallest id reachable over links."""
    each = written(fingerprints(docs, shingle, seed, 1, False, id_col, text_col).select("doc_id", F.col("f0").alias("fp")), "fingerprints")
    classes = written(each.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    nodes = classes.select(F.col("fp").alias("id"), F.col("fp").alias("f0"))
    by_fp = labelled(classes, link_forest(nodes, blocks(classes.count(), max_bits), max_bits, chunk), "fp")
    return each.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def similar_sets(sets: list[np.ndarray], side: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Spanning links of the sorted sets by exact Jaccard similarity; side as in forest."""
    order = np.argsort([len(x) for x in sets], kind="stable")
    size, side = np.array([len(x) for x in sets], np.int64)[order], side[order]
    label, links = np.arange(len(sets)), []
    for at in range(len(sets) - 1):
        own = sets[order[at]]
        # partners of a sufficient size stand in one run
        run = np.arange(at + 1, int(np.searchsorted(size, len(own) / similarity + 1e-9, side="right")))
        run = run[(label[run] != label[at]) & ((side[run] != side[at]) | (side[at] == 0))]
        if not len(run):
            continue
        flat = np.concatenate([sets[order[r]] for r in run])
        hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
        both = np.add.reduceat(hit, np.concatenate([[0], np.cumsum(size[run])[:-1]]), dtype=np.int64)
        run = run[both >= similarity * (len(own) + size[run] - both) - 1e-9]
        links += merged(label, np.full(len(run), at), run)
    return [(int(order[a]), int(order[b])) for a, b in links]


def set_linker(shingle: int, seed: int, similarity: float):
    def run(key, group):
        names = group["set"].to_numpy()
        # a text without words is a set of its own, equal to others of its kind, which have collapsed before
        sets = [np.unique(h) if len(h := shingle_hashes(t, shingle, seed)) else np.zeros(1, np.uint64) for t in group["text"].to_pylist()]
        i = np.array(similar_sets(sets, group["side"].to_numpy(), similarity), np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(names[i[:, 0]]), "b": pa.array(names[i[:, 1]])})

    return run


def near_copies(
    docs: DataFrame, shingle: int = NEAR_SHINGLE, similarity: float = SIMILARITY, max_bits: int = NEAR_BITS, chunk: int = NEAR_CHUNK, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, row, root, component_id of every row: its key, a name of its component, and the smallest id in it, over pairs of the Jaccard similarity or more."""
    each = written(fingerprints(docs, shingle, SEED, LANES, True, id_col, text_col), "sketches")
    names = lanes_of(LANES)
    sets = written(each.groupBy("set").agg(F.min("doc_id").alias("least"), F.min("row").alias("row"), *[F.max(c).alias(c) for c in names]), "sets")
    tables = samples(sets.count(), LANES, similarity, recall)
    proposed = components(link_forest(sets.select(F.col("set").alias("id"), *names), tables, max_bits, lanes=LANES))
    # the text of one row of each set that may have a partner: no others move, and no text moves more than once
    members = written(sets.select("set", "row").join(proposed, F.col("set") == proposed.u).select("set", "row", "root"), "members")
    texts = narrow(docs, id_col, text_col).select(row_key().alias("row"), "text")
    dealt = written(texts.join(members, "row").dropDuplicates(["set"]).select("root", "set", "text"), "member-texts")
    links = chunked(dealt, ["root"], "set", chunk).groupBy("root", "i", "j").applyInArrow(set_linker(shingle, SEED, similarity), "a long, b long")
    by_set = labelled(sets.select("set", "least"), links, "set")
    return each.select("doc_id", "row", "set").join(by_set, "set").select("doc_id", "row", "root", "component_id")
