"""The classifier's learning and scoring, and decontamination against whole edit distances."""

import random

import numpy as np
import pytest

from tessella.llm import decontaminate as D
from tessella.llm import quality as Q


def test_flat_trees_walk_as_they_were_grown():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 5)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < -0.2)).astype(float)
    model = Q.grow(x, y, trees=30, depth=3)

    def one(row):
        total = model.base
        for at in model.start:
            for _ in range(10):
                if model.left[at] == at:
                    break
                at = model.left[at] + (row[model.feature[at]] > model.cut[at])
            total += model.value[at]
        return total

    assert np.allclose(model.raw(x[:50]), [one(r) for r in x[:50]], atol=1e-5)
    assert ((model.score(x) > 0.5) == y).mean() > 0.95


def test_one_class_or_none():
    x = np.zeros((50, 2), np.float32)
    assert np.allclose(Q.grow(x, np.ones(50)).score(x), 1, atol=1e-5)
    assert np.allclose(Q.grow(x[:0], np.ones(0)).score(x), 1, atol=1e-5)


def test_statistics_of_odd_texts(rows):
    m = Q.matrix([t or "" for _, t, *_ in rows])
    assert m.shape == (len(rows), len(Q.FEATURES)) and np.isfinite(m).all()


def test_scored_keeps_columns_and_rows(spark, docs, rows):
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(7, None), (None, 1), (5000, 0)], "doc_id long, quality int")
    out = Q.scored(docs, Q.fit(docs, labels))
    got = out.collect()
    assert out.columns == [*docs.columns, "quality_score"] and len(got) == len(rows)
    assert all(0 <= r.quality_score <= 1 for r in got)


def test_held_out_accuracy(spark, small):
    d = small.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    from tessella.llm.queries import held_out

    model = Q.fit(docs, labels.where(~held_out()))
    got = Q.scored(docs, model).join(labels.where(held_out()), "doc_id").select("quality_score", "quality").toPandas()
    assert ((got.quality_score >= 0.3) == (got.quality == 1)).mean() > 0.97


def words(rng, n):
    return [rng.choice("abcdefghij") + "".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(1, 7))) for _ in range(n)]


def brute_distance(p, t):
    prev = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        now = [i]
        for j, x in enumerate(t, 1):
            now.append(min(prev[j] + 1, now[-1] + 1, prev[j - 1] + (c != x)))
        prev = now
    return min(prev)


def test_bit_parallel_distance():
    rng = random.Random(2)
    for _ in range(200):
        p, t = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 30))), "".join(rng.choice("abc ") for _ in range(rng.randint(0, 50)))
        assert D.distance(p, t)[0] == brute_distance(p, t)


@pytest.fixture(scope="module")
def planted(spark):
    """Items, and documents that hold one of them: whole, with other case and punctuation, or with edits."""
    rng = random.Random(4)
    items = [(i, " ".join(words(rng, n))) for i, n in enumerate([40, 25, 16, 60, 9, 5])]
    rows, want = [], set()
    for i, text in items:
        for kind in range(4):
            w = text.split()
            if kind == 1:
                w = [x.upper() + "," for x in w]
            elif kind == 2 and len(w) >= 16:
                for k in rng.sample(range(len(w)), max(1, len(w) // 12)):
                    w[k] = "zz"
            elif kind == 3 and len(w) >= 16:
                w = [x[:-1] + "q" if k % 9 == 4 else x for k, x in enumerate(w)]
            d = len(rows)
            rows.append((d, " ".join([*words(rng, rng.randint(0, 200)), *w, *words(rng, rng.randint(0, 200))])))
            want.add((d, i))
    clean = [(1000 + k, " ".join(words(rng, rng.randint(0, 300)))) for k in range(20)] + [(2000, None), (2001, ""), (None, items[0][1])]
    bench = spark.createDataFrame([*items, (90, None), (91, ""), (92, "...")], "item_id long, text string")
    docs = spark.createDataFrame([(*r, "clash", "clash") for r in rows + clean], "doc_id long, text string, leaks string, row string")
    return docs, bench, want


def test_planted_items_are_found(planted):
    docs, bench, want = planted
    out = D.find_leaks(docs.drop("leaks"), bench).collect()
    got = {(r.doc_id, x.item_id) for r in out for x in r.leaks}
    assert {x for x in got if x[0] is not None} == want and (None, 0) in got
    assert len(out) == docs.count()


@pytest.mark.parametrize("share", [0.02, 0.05, 0.1, 0.15, 0.18])
@pytest.mark.parametrize("words_each", [3, 8, 14, 40])
def test_leaks_up_to_the_limit_are_found(share, words_each):
    """Edits scattered over characters; only copies that are within the limit count."""
    rng, gen = random.Random(9), np.random.default_rng(8)
    items = [(i, " ".join(words(rng, words_each))) for i in range(80)]
    index = D.index_of(items, D.SIMILARITY, D.RECALL)
    found = total = 0
    for i, text in items:
        for _ in range(3):
            doc = f"{' '.join(words(rng, 50))} {D.edited(text, int(len(text) * share), gen)} {' '.join(words(rng, 50))}"
            if D.distance(text, doc)[0] <= D.most_edits(len(text), D.SIMILARITY):
                total += 1
                found += any(x["item_id"] == i for x in D.leaks_in([doc], index, D.SIMILARITY)[0])
    assert total > 150 and found / total >= 0.9


def test_a_recall_out_of_reach_is_an_error(monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(D, "MOST_REPEATS", 1)
    with pytest.raises(ValueError, match="repeats propose"):
        D.index_of([(i, " ".join(words(rng, 40))) for i in range(50)], D.SIMILARITY, 1.0)


def test_blocks_of_the_benchmark_give_the_same_leaks(planted):
    docs, bench, _ = planted
    rows = lambda df: sorted((repr(r.doc_id), r.row, sorted(map(tuple, r.leaks))) for r in df.collect())
    assert rows(D.find_leaks(docs.drop("leaks"), bench, block_chars=150)) == rows(D.find_leaks(docs.drop("leaks"), bench))


def test_whole_table_against_edit_distances(spark, small):
    """Every document against every item: no leak is reported that isn't one, and nine in ten of all are found."""
    items = [(r.item_id, D.reduced(r.text)) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    want = {(r.doc_id, i): d for r in docs.collect() for i, t in items if (d := D.distance(t, D.reduced(r.text))[0]) <= D.most_edits(len(t), D.SIMILARITY)}
    got = {(r.doc_id, x.item_id): x.edits for r in D.find_leaks(docs, spark.read.parquet(f"{small}/benchmark.parquet")).collect() for x in r.leaks}
    assert want and got.items() <= want.items() and len(got) >= 0.9 * len(want)


def test_executors_need_no_copy_of_the_package(tmp_path):
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    script = f"""
import sys
sys.path.insert(0, {root!r})
import corpus_pipeline
from tessella.llm import queries
from tessella.session import local_session
spark = local_session("4", partitions=4)
for f in (queries.op6_decontamination, corpus_pipeline.run):
    assert f(spark, "/root/testdata/sf0.001").count() > 0
"""
    paths = [x for x in os.environ.get("PYTHONPATH", "").split(":") if x and os.path.abspath(x) != root]
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=os.environ | {"PYTHONPATH": ":".join(paths)}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


def test_empty_sides(spark, no_docs, planted):
    docs, bench, _ = planted
    assert D.find_leaks(no_docs, bench).count() == 0
    assert all(not r.leaks for r in D.find_leaks(docs.drop("leaks"), bench.where("false")).collect())


def unspaced(rng, n):
    return "".join(rng.choice(list("あいうえおかきくけこさしすせそたちつてとなにぬねの漢字中文日本語学習資料"), n))


@pytest.mark.parametrize("length", [20, 40, 60, 90, 160, 400])
def test_items_without_spaces_are_found(length):
    """Exact and edited copies of unspaced, one-word and mixed items, alone and inside other text, beside ordinary items."""
    rng = np.random.default_rng(length)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9)))
    items = [(i, unspaced(rng, length)) for i in range(20)]
    items += [(100 + i, "".join(rng.choice(list("abcdefghij0123456789"), length))) for i in range(10)]
    items += [(200 + i, (unspaced(rng, length - 15) + " " + word() + " " + word())[:length].strip()) for i in range(10)]
    items += [(1000 + i, " ".join(word() for _ in range(40))) for i in range(60)]
    items = [(i, D.reduced(t)) for i, t in items]
    index = D.index_of(items, D.SIMILARITY, D.RECALL)
    for share, least in ((0.0, 1.0), (0.05, 0.97), (0.1, 0.95), (0.15, 0.93), (0.18, 0.9)):
        met = 0
        for i, t in items[:40]:
            copy = D.edited(t, int(len(t) * share), rng)
            around = unspaced(rng, 50) if i < 100 else " " + " ".join(word() for _ in range(12)) + " "
            (leaks,) = D.leaks_in([D.reduced(around + copy + around)], index, D.SIMILARITY)
            met += i in {x["item_id"] for x in leaks}
            if share == 0:
                (alone,) = D.leaks_in([t], index, D.SIMILARITY)
                assert (i, 0) in {(x["item_id"], x["edits"]) for x in alone}
        assert met >= least * 40, (length, share, met)


def test_a_benchmark_of_unspaced_and_repetitive_items_only():
    rng = np.random.default_rng(9)
    items = [(i, unspaced(rng, int(n))) for i, n in enumerate(rng.integers(60, 400, 30))] + [(50, "x" * 160), (51, "ab" * 90)]
    index = D.index_of(items, D.SIMILARITY, D.RECALL)
    for i, t in items:
        assert i in {x["item_id"] for x in D.leaks_in([t], index, D.SIMILARITY)[0]}
    (long,) = D.leaks_in(["x" * 200_000], index, D.SIMILARITY)
    assert {x["item_id"] for x in long} == {50}
    assert D.leaks_in([unspaced(rng, 5000)], index, D.SIMILARITY) == [[]]


def scalar_trees(x, y, trees, depth, rate):
    """Boosted trees row by row over raw thresholds; the margin of each row."""
    n, d = x.shape
    base = float(np.log(y.mean() / (1 - y.mean())))
    edges = [sorted({np.float32(q) for q in np.quantile(x[:, j], np.linspace(0, 1, Q.BINS + 1)[1:-1])}) for j in range(d)]
    margin = [base] * n
    for _ in range(trees):
        p = [1 / (1 + np.exp(-m)) for m in margin]
        g, h = [y[i] - p[i] for i in range(n)], [p[i] * (1 - p[i]) for i in range(n)]
        total = lambda rows: (sum(g[i] for i in rows), sum(h[i] for i in rows))  # noqa: B023, E731
        worth = lambda a, b: a * a / (b + Q.L2)

        def grow(rows, level):
            gain, cut = 1e-6, None
            for j in range(d if level < depth else 0):
                for e in edges[j]:
                    left = [i for i in rows if x[i, j] <= e]
                    if len(left) >= 10 and len(rows) - len(left) >= 10:
                        (gl, hl), (ga, ha) = total(left), total(rows)  # noqa: B023
                        better = worth(gl, hl) + worth(ga - gl, ha - hl) - worth(ga, ha)
                        if better > gain * (1 + 1e-9):
                            gain, cut = better, (left, [i for i in rows if x[i, j] > e])
            if cut is None:
                ga, ha = total(rows)  # noqa: B023
                return {i: rate * ga / (ha + Q.L2) for i in rows}
            return grow(cut[0], level + 1) | grow(cut[1], level + 1)

        step = grow(list(range(n)), 0)
        margin = [margin[i] + step[i] for i in range(n)]
    return np.array(margin)


def test_histogram_trees_against_a_scalar_booster():
    rng = np.random.default_rng(12)
    x = rng.normal(size=(70, 3)).astype(np.float32)
    x[:, 2] = np.round(x[:, 2])  # ties
    y = ((x[:, 0] + 0.5 * x[:, 1] * (x[:, 2] > 0) + rng.normal(0, 0.3, 70)) > 0).astype(float)
    model = Q.grow(x, y, trees=4, depth=2, rate=0.3)
    assert np.allclose(model.raw(x), scalar_trees(x, y, 4, 2, 0.3), atol=1e-5)


@pytest.mark.parametrize("text", ["", "One two two. THREE, four!\nA line 12 with | and http://x.y [z]\n\nOne two two", "é" * 40 + " ü\n" + "word " * 30, "a b c a b c a b c\ta\x07b\x7f"])
def test_statistics_restated(text):
    import math

    got = dict(zip(Q.FEATURES, Q.statistics(text), strict=True))
    raw = text.encode()
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    n, m, size = max(1, len(words)), max(1, len(lines)), max(1, len(raw))
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    entropy = lambda items: -sum(c / len(items) * math.log(c / len(items)) for c in (items.count(x) for x in set(items)))
    of = lambda chars: sum(b in chars for b in raw) / size
    longest = lambda items: max((items.count(x) for x in set(items)), default=0)
    sizes = [len(w) for w in words] or [0]
    want = {
        "log_chars": math.log(1 + len(raw)), "log_words": math.log(1 + len(words)), "log_lines": math.log(1 + len(lines)), "mean_word": sum(sizes) / len(sizes),
        "sd_word": (sum((s - sum(sizes) / len(sizes)) ** 2 for s in sizes) / len(sizes)) ** 0.5, "upper": of(bytes(range(65, 91))), "digits": of(b"0123456789"), "spaces": of(b" \t\r\n"),
        "dots": of(b"."), "commas": of(b","), "high_bytes": of(bytes(range(128, 256))), "marks": of(b"!#$%&*@~^"), "distinct_words": len(set(words)) / n, "top_word": longest(words) / n,
        "distinct_lines": len(set(lines)) / m, "mean_line": sum(map(len, lines)) / m, "short_lines": sum(len(x) < 20 for x in lines) / m if lines else 1.0,
        "distinct_grams": len(set(grams)) / max(1, len(grams)), "top_gram": longest(grams) / max(1, len(grams)), "word_entropy": entropy(words) if words else 0.0, "byte_entropy": entropy(list(raw)) if raw else 0.0,
        "capital_words": sum(65 <= w[0] <= 90 for w in words) / n, "long_words": sum(s > 14 for s in sizes) / n, "bars": raw.count(b"|") / n, "links": (raw.count(b"http") + raw.count(b"www.")) / n,
        "brackets": of(b"[]{}<>()"), "control": of(bytes(range(9)) + b"\x7f"), "vowels": of(b"aeiouAEIOU"), "repeated_half": sum(w in words[: len(words) // 2] for w in words[len(words) // 2 :]) / n,
    }
    for name, value in want.items():
        assert got[name] == pytest.approx(value, abs=1e-9), name
