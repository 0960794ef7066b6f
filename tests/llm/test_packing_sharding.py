"""Packing and sharding: whole, gapless, within capacity, and the same at any cut."""

import shutil
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessella.llm import packing, sharding

PATH = public_tokenizers.path("byte_bpe_50k.json")


@given(st.lists(st.integers(1, 128), max_size=120))
@settings(max_examples=60, deadline=None)
def test_windows_hold_every_piece_within_capacity(sizes):
    window = packing.windows_for(sizes, 256)
    load = Counter()
    for s, w in zip(sizes, window, strict=True):
        load[w] += s
    assert not load or max(load.values()) <= 256


def test_differencing_balances():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 129, 600).tolist()
    window, most = packing.difference(sizes, 40)
    load = np.bincount(window, weights=sizes, minlength=40)
    assert most == load.max() and load.max() - load.min() <= 16


def test_ranks_give_the_ids_of_the_tokenizer_file(rows):
    own, fast = Tokenizer.from_file(PATH), packing.encoder(PATH)
    for _, t, *_ in rows:
        if len(t or "") < 30_000:
            assert fast(t or "") == own.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("ranks", [True, False])
def test_added_tokens_have_the_ids_of_the_tokenizer_file(tmp_path, ranks):
    own, path = Tokenizer.from_file(PATH), PATH
    if not ranks:  # no rank file beside the copy
        path = str(tmp_path / "alone.json")
        shutil.copy(PATH, path)
    encode, end = packing.encoder(path), "<|endoftext|>"
    assert encode(f"a{end}b") == [64, 50256, 65]
    for t in (end, f"{end}at the start", f"in the {end} middle", f"at the end{end}", f"{end}{end} \n{end}x", "<|endoftext", "<|endoftext|", f"é{end}\n\n"):
        assert encode(t) == own.encode(t, add_special_tokens=False).ids


def test_every_code_point_has_the_ids_of_the_tokenizer_file():
    own, fast = Tokenizer.from_file(PATH), packing.encoder(PATH)
    for start in range(0, 0x110000, 1 << 14):
        texts = [f"a{c}b 1{c}2 {c} .{c}, {c}{c}" for c in map(chr, range(start, start + (1 << 14), 7)) if not "\ud800" <= c <= "\udfff"]
        assert [fast(t) for t in texts] == [x.ids for x in own.encode_batch(texts, add_special_tokens=False)]


@given(st.integers(0, 3000), st.integers(0, 3000), st.sampled_from([" ", "\n\t ", "x "]))
@settings(max_examples=60, deadline=None)
def test_long_blank_runs_are_seen(before, after, blank):
    run = (blank * packing.LONG_BLANK)[: packing.LONG_BLANK]
    assert packing.long_blank("w" * before + run + "w" * after) or not run.isspace()
    assert not packing.long_blank("a b" * before)


@pytest.mark.parametrize("blank", [" ", "\n", "\t", "\u3000"])
def test_long_runs_of_blanks(blank):
    own, fast = Tokenizer.from_file(PATH), packing.encoder(PATH)
    for n in (packing.LONG_BLANK - 1, packing.LONG_BLANK, 1_000_000):
        assert fast(blank * n + "a") == own.encode(blank * n + "a", add_special_tokens=False).ids


@pytest.mark.parametrize("capacity", [1024, 64])
def test_pack(docs, rows, capacity):
    encode = packing.encoder(PATH)
    out = packing.pack(docs, PATH, capacity=capacity, piece=min(128, capacity // 8)).collect()
    want = Counter((d, zlib.crc32(np.array([*encode(t or ""), 0], "<u4").tobytes())) for d, t, *_ in rows)
    total = Counter()
    for r in out:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        total[r.sequence_id] += r.length
    assert max(total.values()) <= capacity
    by_sequence = defaultdict(list)
    for r in out:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for x in by_sequence.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
    # the pieces of a document, put together by start, give its ids; documents with equal ids are told apart by their total
    pieces = defaultdict(list)
    for r in out:
        pieces[r.doc_id, r.doc_tokens].append((r.start, r.ids))
    counts = Counter(d for d, _ in want.elements())
    for (d, n), x in pieces.items():
        if counts[d] == 1:
            ids = [i for _, p in sorted(x) for i in p]
            assert len(ids) == n and want[d, zlib.crc32(np.array(ids, "<u4").tobytes())] == 1
    assert sum(r.length for r in out) == sum(len(encode(t or "")) + 1 for _, t, *_ in rows)


def test_little_padding(spark, small):
    out = packing.pack(spark.read.parquet(f"{small}/documents.parquet").coalesce(1), PATH, with_ids=False).toPandas()
    load = out.groupby("sequence_id").length.sum()
    assert 1 - load.sum() / (1024 * len(load)) < 0.02


def test_shards(docs, rows):
    out = sharding.interleave(docs, shards=5).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    slots = defaultdict(list)
    mix = defaultdict(Counter)
    for r in out:
        slots[r.shard].append(r.slot)
        mix[r.source][r.shard] += 1
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    sizes = [len(x) for x in slots.values()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    for c in mix.values():
        assert max(c.values()) - min(c.get(s, 0) for s in range(5)) <= 2


def test_shards_follow_the_global_order(spark, small):
    """Against the same order taken with global windows in pandas."""
    import hashlib

    d = spark.read.parquet(f"{small}/documents.parquet")
    p = d.select("doc_id", "source", "text").toPandas()
    p["h"] = [hashlib.md5(f"deal:{i}:{zlib.crc32(t.encode())}:{len(t.encode()) + 8}".encode()).hexdigest() for i, t in zip(p.doc_id, p.text)]
    p["tie"] = [hashlib.md5(s.encode()).hexdigest() for s in p.source]
    p = p.sort_values(["source", "h"])
    p["r"] = p.groupby("source").cumcount()
    p["f"] = (2 * p.r + 1) / (2 * p.groupby("source").doc_id.transform("size"))
    p = p.sort_values(["f", "tie"]).reset_index(drop=True)
    want = {i: k * 24 // len(p) for k, i in enumerate(p.doc_id)}
    assert {r.doc_id: r.shard for r in sharding.interleave(d).collect()} == want


@pytest.mark.parametrize("bucket_rows", [100, 1 << 15])
def test_sources_of_one_row_are_dealt_over_many_buckets(spark, bucket_rows):
    """One source for each row: all fractional ranks are one half; the order is the same at any size of the buckets."""
    import hashlib

    df = spark.createDataFrame([(i, f"text {i}", f"site{i}.example") for i in range(2000)] + [(None, f"t{i}", "big") for i in range(501)], "doc_id long, text string, source string")
    got = sharding.interleave(df, shards=7, bucket_rows=bucket_rows).collect()
    order = sorted((r.shard, r.slot, r.source) for r in got)
    half = [s for _, _, s in order if s != "big"]
    assert half == sorted(half, key=lambda s: hashlib.md5(s.encode()).hexdigest())
    ranked = spark.createDataFrame([(0.5, 128, hashlib.md5(s.encode()).hexdigest()) for s in half] + [(0.50001, 128, "0" * 32)], "f double, j long, tie string")
    assert sharding.place_buckets(ranked, bucket_rows).select("bucket").distinct().count() >= (20 if bucket_rows == 100 else 1)


def test_empty(no_docs):
    assert packing.pack(no_docs, PATH).count() == 0
    assert sharding.interleave(no_docs).count() == 0
