"""Each pipeline stage on its own input against brute force, and the registered queries on the smallest tables."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tessella.llm import decontaminate as D
from tessella.llm import quality as Q
from tessella.llm import queries
from tessella.session import written

from .test_dedup import brute_near_copies, lower

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, small):
    """The rows before and after each stage."""
    docs, out = spark.read.parquet(f"{small}/documents.parquet"), []
    for name, f in corpus_pipeline.STAGES:
        before = docs
        docs = written(f(spark, docs, small), name)
        out.append((name, before, docs))
    return {n: (b.collect(), a.collect(), a.columns) for n, b, a in out}


def test_order_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "simhash", "decontamination", "packing"]
    for name, (_, _, columns) in stages.items():
        assert name == "packing" or columns == COLUMNS


def test_quality_keeps_what_scores(spark, small, stages):
    before, after, _ = stages["quality"]
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    model = Q.fit(docs, labels.where(~queries.held_out()))
    score = model.score(Q.matrix([r.text for r in before]))
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r, s in zip(before, score, strict=True) if s >= 0.3)
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    kept = {r.doc_id for r in after}
    assert len(good - kept) <= 0.02 * len(good) and all(any(tuple(r) == tuple(b) for b in before if b.doc_id == r.doc_id) for r in after)


def test_lines(stages):
    before, after, _ = stages["line_dedup"]
    key = lambda x: lower(x).strip(" \t\n\x0b\x0c\r")
    seen = defaultdict(set)
    for r in before:
        for x in r.text.split("\n"):
            seen[key(x)].add(r.doc_id)
    want = {r.doc_id: "\n".join(x for x in r.text.split("\n") if len(key(x)) < 10 or min(seen[key(x)]) == r.doc_id) for r in before}
    assert {r.doc_id: r.text for r in after} == want
    assert all(r.n_chars == len(r.text) for r in after if r.text != {b.doc_id: b.text for b in before}[r.doc_id])


def test_near_duplicates(stages):
    before, after, _ = stages["simhash"]
    least = {c for _, c in brute_near_copies([(r.doc_id, r.text) for r in before])}
    assert sorted(r.doc_id for r in after) == sorted(least)


def test_near_duplicates_of_repeated_and_missing_ids(spark):
    """Rows are judged, not ids: a text never goes because another one shares its id."""
    words = lambda seed: " ".join(np.random.default_rng(seed).choice(list("abcdefghijklmnop"), 40))
    rows = [(1, words(1)), (1, words(2)), (1, words(2)), (2, words(2)), (None, words(3)), (None, words(3)), (None, words(1)), (3, words(3)), (None, words(4)), (None, words(4))]
    docs = spark.createDataFrame([(*r, None, None, 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter([(1, words(1)), (1, words(2)), (3, words(3)), (None, words(4))])


def test_leaks(spark, small, stages):
    before, after, _ = stages["decontamination"]
    items = [D.reduced(r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    leaked = {r.doc_id for r in before if any(D.distance(t, D.reduced(r.text))[0] <= D.most_edits(len(t), 0.8) for t in items)}
    assert leaked and {r.doc_id for r in before} - {r.doc_id for r in after} == leaked


def test_packing(stages):
    from tokenizers import Tokenizer

    import public_tokenizers

    before, after, _ = stages["packing"]
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r.doc_id: np.array([*own.encode(r.text, add_special_tokens=False).ids, 0], "<u4") for r in before}
    got = defaultdict(int)
    for r in after:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(part.tobytes()) == r.ids_crc32 and len(part) == r.length and r.doc_tokens == len(ids[r.doc_id])
        got[r.doc_id] += r.length
    assert got == {k: len(v) for k, v in ids.items()}


def test_run_gives_the_last_stage(spark, small, stages):
    got = corpus_pipeline.run(spark, small)
    assert got.columns == stages["packing"][2]
    assert got.agg({"length": "sum"}).first()[0] == sum(r.length for r in stages["packing"][1])


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_against_sql(spark, small, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "labels", "pages", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet{'/*.parquet' if __import__('os').path.isdir(f'{small}/{t}.parquet') else ''}'")
    got = c.execute(queries.ORACLES[name])
    order = sorted(x[0] for x in got.description)
    at = [[x[0] for x in got.description].index(n) for n in order]
    df = queries.QUERIES[name](spark, small)
    assert sorted(df.columns) == order
    assert Counter(tuple(r[n] for n in order) for r in df.collect()) == Counter(tuple(r[i] for i in at) for r in got.fetchall())


def test_clashing_columns_come_out_unchanged(spark, tmp_path):
    names = ["quality_score", "lines", "leaks", "stay_row", "copy_number", "row", "digest", "rest", "input", "root", "own_text", "own_id", "set"]
    rows = [(i, f"a plain text of some words number {i} which goes on for a while and ends here", "en", "s", 5, *[f"{n}{i}" for n in names]) for i in range(6)]
    rows.append((6, rows[0][1], *rows[0][2:]))
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long, text string, lang string, source string, n_chars long", *[f"{n} string" for n in names]]))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, "nothing of this is in any of the documents at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, want, str(tmp_path)), name)
        assert out.columns == docs.columns
        got = {tuple(r) for r in out.collect()}
        assert got <= {tuple(r) for r in want.collect()} if name != "line_dedup" else {r[5:] for r in got} == {tuple(r)[5:] for r in want.collect()}
        want = out
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
