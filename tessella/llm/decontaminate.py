"""Benchmark decontamination: CGK embedding, bit-sampling LSH and exact edit verification.

A document leaks an item when some passage of it is within (1 - SIMILARITY) of
the item's length in character edits, after lower-casing and reducing both to
words joined by one space.

The CGK walk reads characters with a pointer: step j writes the character under
the pointer and then moves on or stays, by a random bit of (j, character). It
maps few edits to few differing positions, because two walks fall back into
step soon after an edit. A hash of some sampled positions is a bit-sampling
LSH. Windows as long as the item start at every word of a document. As a tenth
or more of the characters may differ, no long walk stays in step; so item and
document are embedded from each of their words on, and a hit of the item's
character o at the document's character p proposes the window at p - o. A
window is a candidate when enough such hits agree on it, up to a drift of a
tenth of the item. The walks of all words of many documents are taken at once
in numpy. Items without spaces, or with few, are embedded from each character
on, and so are documents where the benchmark holds such items.

Repeats use other random bits and positions. Their number is the least at which
a fixed trial proposes RECALL of edited copies of the items; the copies have as
many edits as a leak may have, and each class of item lengths is held to it. A
block that misses it after MOST_REPEATS raises an error. Candidates are verified
by the exact edit distance (bit-parallel, free ends in the document), so
precision doesn't depend on the hashes.

The benchmark is the query set: it is read in blocks of bounded size, and one
block's index, plain arrays, is broadcast at a time. With one block documents
pass through one task each, without a shuffle or a join; with more, each block
writes its leaks by the text's digest, and documents join the leaks at the end.

Defined cases: null and empty texts leak nothing, and null or wordless items
match nothing; null ids are kept as they are; repeated documents are judged
each; repeated item ids are reported each; empty tables on either side give
documents without leaks; other columns are passed through.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

SIMILARITY, RECALL, MOST_REPEATS, TRIALS = 0.8, 0.95, 24, 300
#: Of each class of items: the least characters, how many hits have to agree, and its walks, for items with spaces and for
#: those without; of each walk: its steps, its sampled positions, and whether it starts at every character (short items, and
#: those without spaces, have few words).
CLASSES = ((140, 3, (0, 4)), (80, 2, (0, 4)), (48, 1, (1, 5)), (32, 1, (2, 6)), (1, 1, (3, 3)))
WALKS = ((28, 10, False), (18, 6, False), (8, 4, False), (5, 3, True), (28, 10, True), (18, 6, True), (8, 4, True))
#: An item has spaces if it has a word for each so many characters.
SPACED = 12
BLOCK_CHARS = 2_000_000
TABLE_BITS = 20
CHUNK_CHARS, SLICE = 1 << 20, 1 << 14
WORD = re.compile(r"\w+")
LEAK = "array<struct<item_id:bigint,edits:bigint,first_word:bigint,n_words:bigint>>"


def reduced(text: str) -> str:
    return " ".join(WORD.findall(text.lower()))


def most_edits(n: int, similarity: float) -> int:
    return int(n * (1 - similarity) + 1e-9)


def class_of(n: int) -> int:
    return next(i for i, (least, _, _) in enumerate(CLASSES) if n >= least)


def walk_of(text: str) -> int:
    return CLASSES[class_of(len(text))][2][(text.count(" ") + 1) * SPACED < len(text)]


def symbols(text: str) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """One byte for each character, and where words and where characters start."""
    x = np.frombuffer(text.encode("utf-32-le"), "<u4")
    x = (x ^ (x >> np.uint32(8))).astype(np.uint8)
    starts = np.append(np.int64(0), np.flatnonzero(x == 32) + 1).astype(np.int32), np.arange(len(x), dtype=np.int32)
    return np.append(x, np.zeros(64, np.uint8)), starts


def embedded(x: np.ndarray, starts: np.ndarray, walk: int, repeat: int) -> np.ndarray:
    """The hash of the sampled positions of the walk from each start on."""
    steps, samples, _ = WALKS[walk]
    rng = np.random.default_rng([walk, repeat])
    coins = rng.integers(0, 2, (steps, 256), dtype=np.int32).astype(np.intp)
    # one position in each equal stretch of the walk: neighbouring steps often write the same character
    edges = np.linspace(0, steps, samples + 1).astype(int)
    sampled = {int(rng.integers(a, b)) for a, b in zip(edges[:-1], edges[1:], strict=True)}
    out = np.empty(len(starts), np.uint32)
    for i in range(0, len(starts), SLICE):
        at = starts[i : i + SLICE].astype(np.intp)
        key, mixed = np.full(len(at), repeat, np.uint32), np.empty(len(at), np.uint32)
        s, move = np.empty(len(at), np.uint8), np.empty(len(at), np.intp)
        for j in range(max(sampled) + 1):
            np.take(x, at, out=s, mode="clip")  # no place is out of range; this mode fills `out` without a copy
            if j in sampled:
                key ^= s
                key *= np.uint32(0x9E3779B1)
                np.right_shift(key, np.uint32(15), out=mixed)
                key ^= mixed
            np.take(coins[j], s, out=move, mode="clip")
            at += move
        out[i : i + SLICE] = key
    return out


def distance(pattern: str, text: str) -> tuple[int, int]:
    """Least edits from pattern to a part of text, and where that part ends (the first such end)."""
    m = len(pattern)
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        masks[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, end = full, 0, m, m, 0
    for i, c in enumerate(text):
        eq = masks.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        right, left = down | (full & ~(diagonal | up)), up & diagonal
        if right & top:
            score += 1
        elif left & top:
            score -= 1
        right, left = right << 1 & full, left << 1 & full
        up, down = left | (full & ~(diagonal | right)), right & diagonal
        if score < best:
            best, end = score, i + 1
    return best, end


def table(texts: list[str], members: list[int], walk: int, repeat: int) -> tuple:
    """One LSH table: sorted keys with item and character, and which leading bits of a key occur."""
    keys, item, at = [], [], []
    for k in members:
        x, both = symbols(texts[k])
        starts = both[WALKS[walk][2]]
        # the walk's last words are too short for it, unless the item has no longer ones
        starts = starts[starts <= max(0, len(texts[k]) - WALKS[walk][0] // 2)]
        own = embedded(x, starts, walk, repeat)
        if WALKS[walk][2] and walk > 3:  # of what repeats within an item its first place is enough: the trial uses the same tables
            own, first = np.unique(own, return_index=True)
            starts = starts[first]
        keys.append(own), item.append(np.full(len(starts), k, np.int64)), at.append(starts.astype(np.int64))
    keys, item, at = map(np.concatenate, (keys, item, at))
    order = np.argsort(keys, kind="stable")
    seen = np.zeros(1 << TABLE_BITS, bool)
    seen[keys >> np.uint32(32 - TABLE_BITS)] = True
    return walk, repeat, keys[order], item[order], at[order], seen


def hits(x: np.ndarray, both: tuple, tab: tuple) -> np.ndarray:
    """Rows of (item, start of its window, hit word's start)."""
    walk, repeat, keys, item, at, seen = tab
    starts = both[WALKS[walk][2]]
    e = embedded(x, starts, walk, repeat)
    p = np.flatnonzero(seen[e >> np.uint32(32 - TABLE_BITS)])
    lo, hi = np.searchsorted(keys, e[p], "left"), np.searchsorted(keys, e[p], "right")
    count = hi - lo
    first = np.repeat(lo - np.cumsum(count) + count, count)
    row = first + np.arange(len(first))
    word = np.repeat(starts[p].astype(np.int64), count)
    return np.stack([item[row], word - at[row], word], 1)


def agreeing(found: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The distinct hits whose window enough others start near, in order of item and window."""
    if not len(found):
        return found
    key = (found[:, 0] << 40) + found[:, 1] + (1 << 32)
    order = np.lexsort((found[:, 2], key))
    found, key = found[order], key[order]
    fresh = np.append(True, (np.diff(key) != 0) | (np.diff(found[:, 2]) != 0))
    found, key = found[fresh], key[fresh]
    n = sizes[found[:, 0]]
    need = np.array([CLASSES[class_of(int(s))][1] if s else 1 for s in sizes])[found[:, 0]]
    return found[np.searchsorted(key, key + n // 10, "right") - np.searchsorted(key, key - n // 10, "left") >= need]


def edited(text: str, edits: int, rng: np.random.Generator) -> str:
    """text with so many characters replaced, inserted or deleted at random places."""
    s, letters = list(text), sorted(set(text))
    for p in sorted(rng.choice(len(s), min(edits, len(s)), replace=False).tolist(), reverse=True):
        kind, c = rng.integers(3), letters[int(rng.integers(len(letters)))]
        s[p : p + 1] = [[c], [c, s[p]], []][kind]
    return reduced("".join(s))


def repeats_for(texts: list[str], members: list[int], similarity: float, recall: float) -> int:
    """The least number of repeats at which items edited up to the limit are proposed with the target recall, in each class."""
    rng = np.random.default_rng(5)
    walk = walk_of(texts[members[0]])
    cases, places, own, at = [], [], [], 0
    by_class = defaultdict(list)
    for k in members:
        by_class[class_of(len(texts[k]))].append(k)
    for kind, some in by_class.items():
        for _ in range(TRIALS):
            k = some[int(rng.integers(len(some)))]
            before, after = (texts[members[int(rng.integers(len(members)))]][:80] for _ in range(2))
            copy = edited(texts[k], most_edits(len(texts[k]), similarity), rng)
            cases.append(f"{before} {copy} {after}")
            own.append((kind, k))
            places.append((at + len(before) + 1, at, at + len(cases[-1])))
            at += len(cases[-1]) + 1
    x, starts = symbols(" ".join(cases))
    sizes = np.array([len(t) for t in texts])
    ends = np.array([e for _, _, e in places])
    found = np.zeros((0, 3), np.int64)
    for repeat in range(MOST_REPEATS):
        found = np.unique(np.concatenate([found, hits(x, starts, table(texts, members, walk, repeat))]), axis=0)
        good = agreeing(found, sizes)
        case = np.searchsorted(ends, good[:, 2])
        met = [False] * len(cases)
        for c, (k, window, _) in zip(case.tolist(), good.tolist(), strict=True):
            met[c] = met[c] or (own[c][1] == k and abs(window - places[c][0]) <= max(2, most_edits(int(sizes[k]), similarity)))
        share = {kind: np.mean([m for m, (q, _) in zip(met, own, strict=True) if q == kind]) for kind in by_class}
        if min(share.values()) >= recall:
            return repeat + 1
    raise ValueError(f"{MOST_REPEATS} repeats propose a share of {min(share.values()):.3f} of copies at the limit of similarity {similarity}, less than {recall}")


def index_of(items: list[tuple[int, str]], similarity: float, recall: float) -> dict:
    """Plain data only, as a broadcast reaches executors that have no copy of this package."""
    items = [(i, t, t.count(" ") + 1) for i, t in items if t]
    texts, tables = [t for _, t, _ in items], []
    for walk in range(len(WALKS)):
        members = [k for k, t in enumerate(texts) if walk_of(t) == walk]
        if members:
            tables += [table(texts, members, walk, r) for r in range(repeats_for(texts, members, similarity, recall))]
    return {"items": items, "sizes": np.array([len(t) for t in texts], np.int64), "tables": tables}


def verified(text: str, item: tuple, windows: list[int], similarity: float) -> dict | None:
    """The best passage for one item in the regions around its windows, if it is within the limit."""
    item_id, pattern, n_words = item
    most, n, best = most_edits(len(pattern), similarity), len(pattern), None
    regions: list[list[int]] = []
    for w in sorted(windows):
        a, b = max(0, w - most - n // 10), min(len(text), w + n + most + n // 10)
        if regions and a <= regions[-1][1]:
            regions[-1][1] = max(regions[-1][1], b)
        else:
            regions.append([a, b])
    for a, b in regions:
        region = text[a:b]
        where = region.find(pattern)
        edits, end = (0, where + n) if where >= 0 else distance(pattern, region)
        if edits <= most and (best is None or edits < best[0]):
            best = edits, a + end
    if best is None:
        return None
    return {"item_id": item_id, "edits": best[0], "first_word": max(0, text.count(" ", 0, best[1]) + 1 - n_words), "n_words": n_words}


def leaks_in(texts: list[str], index: dict, similarity: float) -> list[list[dict]]:
    """The leaks of each of some reduced texts."""
    out: list[list[dict]] = [[] for _ in texts]
    x, starts = symbols(" ".join(texts))
    found = agreeing(np.concatenate([hits(x, starts, t) for t in index["tables"]]), index["sizes"]) if index["tables"] else np.zeros((0, 3), np.int64)
    ends = np.cumsum([len(t) + 1 for t in texts])
    windows = defaultdict(list)
    for d, (k, window, _) in zip(np.searchsorted(ends, found[:, 2], "right").tolist(), found.tolist(), strict=True):
        windows[d, k].append(window - int(ends[d]) + len(texts[d]) + 1)
    for (d, k), w in windows.items():
        leak = verified(texts[d], index["items"][k], w, similarity)
        if leak:
            out[d].append(leak)
    return out


def chunks(texts: list[str]) -> Iterator[list[str]]:
    held, size = [], 0
    for t in texts:
        held.append(reduced(t))
        size += len(held[-1])
        if size >= CHUNK_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def blocks(benchmark: DataFrame, item_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    rows = benchmark.select(F.col(item_col).cast("long").alias("i"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    held, size = [], 0
    for x in rows.toLocalIterator():
        held.append((x.i, reduced(x.t)))
        size += len(held[-1][1])
        if size >= block_chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def with_leaks(texts: DataFrame, index: dict, similarity: float) -> DataFrame:
    """texts: text and row. Returns leaks and row, and the broadcast that they read."""
    shared = texts.sparkSession.sparkContext.broadcast(index)
    arrow = pa.list_(pa.struct([(n, pa.int64()) for n in ("item_id", "edits", "first_word", "n_words")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaks = [x for some in chunks(batch.column(0).to_pylist()) for x in leaks_in(some, shared.value, similarity)]
            yield pa.RecordBatch.from_arrays([pa.array(leaks, arrow), batch.column(1)], ["leaks", "row"])

    return texts.mapInArrow(run, f"leaks {LEAK}, row {texts.schema['row'].dataType.simpleString()}"), shared


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The columns of docs and `leaks`, an array of (item_id, edits, first_word, n_words), empty for clean documents."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    back = [F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    whole = docs.select(text.alias("own_text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    some = blocks(benchmark, item_col, item_text_col, block_chars)
    now, following = next(some, []), next(some, None)
    if following is None:
        return with_leaks(whole, index_of(now, similarity, recall), similarity)[0].select(*back, "leaks")
    parts = []
    digest = F.sha2("own_text", 256)
    light = docs.select(text.alias("own_text")).select("own_text", F.struct(digest.alias("digest")).alias("row"))
    while now is not None:
        out, shared = with_leaks(light, index_of(now, similarity, recall), similarity)
        found = out.where(F.size("leaks") > 0).groupBy("row.digest").agg(F.first("leaks").alias("leaks"))  # equal texts have equal leaks
        parts.append(written(found, "leaks"))
        shared.unpersist()
        now, following = following, next(some, None)
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every = written(every.groupBy("digest").agg(F.flatten(F.collect_list("leaks")).alias("leaks")), "leaks")  # at most a row for each block
    out = whole.withColumn("digest", digest).join(every, "digest", "left")
    return out.select(*back, F.coalesce("leaks", F.expr(f"cast(array() as {LEAK})")).alias("leaks"))
