"""Exact, line, passage and near-duplicate operators against brute force, on rows with every odd case."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from tessella.llm import exact, lines, simhash, substrings

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TABLE = str.maketrans(UP, LOW)
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return (t or "").translate(TABLE)


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_groups(docs, rows, keep):
    groups = defaultdict(list)
    for d, t, *_ in rows:
        groups[lower(t)].append(d)
    want = Counter()
    for t, ids in groups.items():
        known = [x for x in ids if x is not None]
        stay = (max if keep == "largest" else min)(known) if known else None
        for d in ids:
            want[d, stay, len(ids), d == stay, hashlib.sha256(t.encode()).hexdigest()] += 1
    assert Counter(map(tuple, exact.exact_groups(docs, keep).collect())) == want


def test_exact_flushes_change_nothing(docs, monkeypatch):
    before = Counter(map(tuple, exact.exact_groups(docs).collect()))
    monkeypatch.setattr(exact, "BUFFER_BYTES", 500)
    assert Counter(map(tuple, exact.exact_groups(docs).collect())) == before


@pytest.mark.parametrize("max_filter_bytes", [64 << 20, 1 << 13])
def test_lines(docs, rows, max_filter_bytes):
    key = lambda line: lower(line).strip(" \t\n\x0b\x0c\r")
    seen = defaultdict(set)
    for d, t, *_ in rows:
        if d is not None:
            for line in (t or "").split("\n"):
                seen[key(line)].add(d)
    want = Counter()
    for d, t, *_ in rows:
        own = (t or "").split("\n")
        gone = [d is not None and len(key(x)) >= 10 and len(seen[key(x)]) > 1 and min(seen[key(x)]) < d for x in own]
        want[d, "\n".join(x for x, g in zip(own, gone) if not g), len(own), sum(gone)] += 1
    out = lines.dedup_lines(docs, max_filter_bytes=max_filter_bytes)
    assert out.columns == [*docs.columns, "lines"]
    got = out.collect()
    assert Counter((r.doc_id, r.text, r.lines.n_lines, r.lines.n_dropped) for r in got) == want
    assert sum(r.lines.n_dropped for r in got) > 10 and all(r["rest"] == r["row"] == "clash" for r in got)


def brute_repeats(rows, window):
    texts = [WORDS.findall(t or "") for _, t, *_ in rows]
    count = Counter(tuple(w[i : i + window]) for w in texts for i in range(len(w) - window + 1))
    out = Counter()
    for (d, *_), w in zip(rows, texts):
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out[d, " ".join(x for i, x in enumerate(w) if i not in gone), len(w), len(gone)] += 1
    return out


@pytest.mark.parametrize(("window", "gram"), [(35, 8), (6, 3), (5, 5)])
def test_repeated_passages(docs, rows, window, gram):
    out = substrings.remove_repeats(docs, window=window, gram=gram)
    assert out.columns == [*docs.columns, "words"]
    got = out.collect()
    assert Counter((r.doc_id, r.text, r.words.n_words, r.words.n_removed) for r in got) == brute_repeats(rows, window)
    assert sum(r.words.n_removed for r in got) > 100


def brute_fingerprint(text, n=4):
    w = WORDS.findall(lower(text))
    shingles = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, bits):
    """The root index of each row."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    x = np.array(fps, np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(x ^ x[i]) <= bits).tolist():
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_near_groups(docs, rows):
    fps = [brute_fingerprint(t) for _, t, *_ in rows]
    root = brute_components(fps, 4)
    least = {}
    for (d, *_), r in zip(rows, root):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    want = Counter((d, f, least.get(r)) for (d, *_), f, r in zip(rows, fps, root))
    got = simhash.near_groups(docs).collect()
    assert Counter((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in got) == want


@pytest.mark.parametrize(("chunk", "group", "bits"), [(8192, 256, 4), (16, 256, 4), (8192, 1, 4), (8192, 256, 2)])
def test_links_of_random_and_crowded_fingerprints(spark, chunk, group, bits):
    """Chains, a crowd around one fingerprint, and groups cut into chunks give the components of brute force."""
    rng = np.random.default_rng(1)
    x = list({int(v) for v in rng.integers(0, 2**63, 150)})
    crowd = [x[0] ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (120, 2))]
    chain = [x[1]]
    for _ in range(12):
        chain.append(chain[-1] ^ sum(1 << int(b) for b in rng.choice(64, bits, replace=False)))
    fps = list(dict.fromkeys([*x, *crowd, *chain]))
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    nodes = spark.createDataFrame([(s, s) for s in signed], "id long, f0 long")
    edges = simhash.link_forest(nodes, simhash.blocks(len(fps), bits, group), bits, chunk=chunk).collect()
    root = {s: s for s in signed}

    def find(s):
        while root[s] != s:
            s = root[s]
        return s

    for e in edges:
        root[max(find(e.a), find(e.b))] = min(find(e.a), find(e.b))
    want = brute_components(fps, bits)
    got = [find(s) for s in signed]
    assert len({*zip(want, got)}) == len(set(want)) == len(set(got))


def test_pivots_discard_no_link_and_most_pairs():
    """In one group: the components are those of brute force, and of unrelated pairs few are left to compare."""
    rng = np.random.default_rng(2)
    x = np.unique(np.concatenate([rng.integers(0, 2**63, 400).astype(np.uint64), np.uint64(5) ^ (np.uint64(1) << rng.integers(0, 60, 40).astype(np.uint64))]))[:, None]
    pivots, compared = simhash.references(rng.permutation(x)), []
    own = simhash.bits_between
    simhash.bits_between = lambda a, b: compared.append(len(a)) or own(a, b)
    try:
        links = simhash.forest(x, np.zeros(len(x), np.int64), 4, pivots)
    finally:
        simhash.bits_between = own
    root = list(range(len(x)))
    for a, b in links:
        root = [root[a] if r == root[b] else r for r in root]
    want = brute_components(x[:, 0].tolist(), 4)
    assert len({*zip(want, root)}) == len(set(want)) == len(set(root))
    assert sum(compared[len(pivots) :]) < 0.01 * len(x) ** 2 / 2


def test_tables_grow_with_the_input():
    for n in (10, 10**5, 10**7, 10**10):
        for t in simhash.blocks(n, 4):
            assert len(t) >= min(max(1, n // 256).bit_length(), 40)
    assert len(simhash.blocks(10**9, 4)) > len(simhash.blocks(10**3, 4))
    assert len(simhash.samples(10**9, 4, 0.8, 0.99)) > len(simhash.samples(10**3, 4, 0.8, 0.99))


def test_small_groups_are_linked_many_at_once(spark, monkeypatch):
    """Keys of 21 bits, as from a million fingerprints on: each of 300,000 groups was a call of its own."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, 2**62, 20_000)
    x[1::40] = x[::40] ^ sum(1 << b for b in (3, 17, 40, 61))
    fps = np.unique(x).tolist()
    calls, own = spark.sparkContext.accumulator(0), simhash.linker

    def counted(*args):
        run = own(*args)
        return lambda key, rows: (calls.add(1), run(key, rows))[1]

    monkeypatch.setattr(simhash, "linker", counted)
    edges = simhash.link_forest(spark.createDataFrame([(f, f) for f in fps], "id long, f0 long"), simhash.blocks(2_000_000, 4), 4).collect()
    assert calls.value < 15 * len(fps) / 100
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for e in edges:
        root[max(find(e.a), find(e.b))] = min(find(e.a), find(e.b))
    assert [find(f) for f in fps] == [fps[r] for r in brute_components(fps, 4)]
    assert len({find(f) for f in fps}) <= len(fps) - 500


def test_empty_tables(no_docs):
    assert exact.exact_groups(no_docs).count() == 0
    assert lines.dedup_lines(no_docs).count() == 0
    assert substrings.remove_repeats(no_docs).count() == 0
    assert simhash.near_groups(no_docs).count() == 0


def brute_shingles(t, k=5):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def brute_near_copies(rows):
    """The smallest id of each component of pairs at 0.8 or more, by row."""
    sets = [brute_shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and jaccard(sets[i], sets[j]) >= 0.8:
                a, b = root[i], root[j]
                root = [a if r == b else r for r in root]
    ids = defaultdict(list)
    for (d, _), r in zip(rows, root):
        ids[r] += [] if d is None else [d]
    return Counter((d, min(ids[r], default=None)) for (d, _), r in zip(rows, root))


@pytest.fixture(scope="module")
def edited_copies():
    """Texts with copies in which some words differ, around and over the limit of 0.8."""
    rng = np.random.default_rng(6)
    out = []
    for i in range(40):
        base = [f"w{x}" for x in rng.integers(0, 3000, 150)]
        for changes in (0, 1, 2, 3, 4, 6):
            w = list(base)
            for at in rng.choice(len(w), changes, replace=False):
                w[at] = f"z{rng.integers(1 << 30)}"
            out.append((6 * i + changes, " ".join(w)))
    return out


def test_recall_of_pairs_at_the_limit(spark):
    """Pairs alone, at a similarity from 0.8 to 0.84: at least nine in ten are found, and nothing below the limit is."""
    rng = np.random.default_rng(7)
    texts, pairs = [], []
    while len(pairs) < 200:
        base = [f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(60, 400)))]
        copy = list(base)
        for at in rng.choice(len(copy), max(1, len(copy) // 45), replace=False):
            copy[at] = f"z{rng.integers(1 << 30)}"
        s = jaccard(brute_shingles(" ".join(base)), brute_shingles(" ".join(copy)))
        if 0.77 <= s < 0.84:
            pairs.append((len(texts), len(texts) + 1, s))
            texts += [" ".join(base), " ".join(copy)]
    root = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    near = [root[a] == root[b] for a, b, s in pairs if s >= 0.8]
    assert len(near) > 60 and np.mean(near) >= 0.9
    assert not any(root[a] == root[b] for a, b, s in pairs if s < 0.8)


@pytest.mark.parametrize("chunk", [4096, 2])
def test_near_copies_by_jaccard(spark, docs, rows, edited_copies, chunk):
    every = [(d, t) for d, t, *_ in rows] + [(1000 + d, t) for d, t in edited_copies]
    got = simhash.near_copies(spark.createDataFrame(every, "doc_id long, text string").repartition(3), chunk=chunk).collect()
    assert Counter((r.doc_id, r.component_id) for r in got) == brute_near_copies(every)


def test_the_pipeline_drops_near_copies(spark, edited_copies):
    import corpus_pipeline

    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(edited_copies, "doc_id long, text string"), "")
    assert {r.doc_id for r in got.collect()} == {least for _, least in brute_near_copies(edited_copies)}


def test_near_copies_of_no_documents(no_docs):
    assert simhash.near_copies(no_docs).count() == 0
