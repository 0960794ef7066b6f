"""Archives round trip; conversations against a brute-force collapse."""

import glob
import hashlib
import struct
from collections import Counter, defaultdict

import pytest
import zstandard

from tessella.llm import chat, warc

LONG = "<html>" + "payload " * 40 + "</html>"
PAGES = [
    (1, "http://a.example/x y\r\n", LONG), (2, None, LONG), (3, "http://ü.example/", LONG), (4, "http://b.example", "short"), (5, "http://b.example", "short"), (6, "http://c.example", None),
    (7, "http://c.example", ""), (None, "http://d.example", LONG), (None, "http://d.example", "n" * 150), (2, "http://e.example", LONG), (8, "http://f.example", "é" * 60), (9, "http://f.example", "é" * 60),
    (10, "http://g.example", "w" * 300_000), (11, "http://h.example", "\r\n\r\nbody" * 20),
]


def expected():
    groups = defaultdict(list)
    for i, _, h in PAGES:
        groups[h or ""].append(i)
    out = Counter()
    for i, _, h in PAGES:
        raw = (h or "").encode()
        known = [x for x in groups[h or ""] if x is not None]
        first = min(known) if known else None
        revisit = len(raw) >= 100 and i != first
        out[i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first if revisit else None] += 1
    return out


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('warc')}/archives"
    pages = spark.createDataFrame([(*p, "clash", "clash") for p in PAGES], "page_id long, url string, html string, digest string, kind string").repartition(2)
    return warc.write(pages, folder).cache(), folder


def test_round_trip(written):
    archives, _ = written
    got = warc.read(archives).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == expected()
    for r in got:
        if r.record_type == "response":
            assert hashlib.sha256(bytes(r.payload)).hexdigest() == r.payload_digest and len(r.payload) == r.payload_bytes


def test_files_hold_a_dictionary_frame_and_a_frame_for_each_record(written):
    archives, folder = written
    files = glob.glob(folder.removeprefix("file://") + "/*")
    assert len(files) == archives.count() and all(f.endswith(".warc.zst") for f in files)
    records = 0
    for f in files:
        data = open(f, "rb").read()
        magic, size = struct.unpack("<II", data[:8])
        assert magic == 0x184D2A5D
        rest = data[8 + size :]
        while rest:
            one = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size])).decompressobj()
            text = one.decompress(rest)
            assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n")
            rest, records = one.unused_data, records + 1
    assert records == len(PAGES)


def test_no_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    archives = warc.write(none)
    assert archives.count() == 0 and warc.read(archives).count() == 0


TURNS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (2, 0, "user", "hi"), (2, 1, "assistant", "hello"), (2, 2, "user", "more"), (3, 0, "user", "hi"), (3, 1, "assistant", "other"), (4, 0, "user", "hi"),
    (5, 5, "user", "hi"), (5, 9, "assistant", "hello"), (5, 9, "user", "more"), (6, None, None, None), (7, 0, "user", "same"), (8, 0, "user", "same"), (9, 1, "assistant", "hello"), (9, 0, "user", "hi"),
    (10, 0, "user", "dup"), (10, 0, "user", "dup"), (11, 0, "user", "dup"), (None, 0, "user", "lost"), (12, 0, "us", "erhi"),
    (None, 3, "user", "lost"), (None, 0, "user", "hi"), (None, None, None, None), (None, 1, "user", "lost too"),
]


def brute_chats(turns):
    convs = defaultdict(list)
    for i, (c, n, role, text) in enumerate(turns):
        convs[(c,) if c is not None else (None, i)].append((n is not None, n or 0, role or "unknown", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    seqs = {}
    for (c, *_), x in convs.items():
        s = tuple((r, t) for _, _, r, _, t in sorted(x))
        seqs[s] = min((y for y in (c, seqs.get(s, c)) if y is not None), default=None)
    keep = {s: c for s, c in seqs.items() if not any(len(o) > len(s) and o[: len(s)] == s for o in seqs)}
    return Counter((c, len(s), ",".join(r for r, _ in s), "\n".join(f"<|{r}|>\n{t}\n<|end|>" for r, t in s)) for s, c in keep.items())


def test_chats(spark):
    df = spark.createDataFrame([(*t, "clash", "clash") for t in TURNS], "conv_id long, turn long, role string, text string, h string, n string").repartition(3)
    got = Counter((r.conv_id, r.n_turns, r.roles, r.chat) for r in chat.format_chats(df).collect())
    assert got == brute_chats(TURNS)
    assert (1, 2) not in {(k[0], k[1]) for k in got}


def test_tied_turns_against_brute_force_and_sql(spark):
    """Turns of equal number and role, so that one snapshot's turn may be any of another's first ones."""
    import random

    import duckdb
    import pandas as pd

    from tessella.llm import queries

    rng = random.Random(5)
    rows = [(c if c % 7 else None, rng.choice([0, 0, 1]), "user", rng.choice("pqrs")) for c in range(120) for _ in range(rng.randint(1, 4))]
    rows += [(500, 0, "user", "A"), (501, 0, "user", "A"), (501, 0, "user", "B"), (502, 0, "user", "C"), (503, 0, "user", "C"), (503, 0, "user", "D")]
    got = Counter((r.conv_id, r.n_turns, r.roles, r.chat) for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect())
    assert got == brute_chats(rows)
    c = duckdb.connect()
    c.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64"}))
    assert Counter(c.execute(queries.ORACLES["op5_chat_formatting"]).fetchall()) == got


def test_chats_of_a_table(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = Counter((r.conv_id, r.n_turns, r.roles, r.chat) for r in chat.format_chats(spark.read.parquet(f"{small}/conversations.parquet")).collect())
    assert got == brute_chats(rows)


def test_no_conversations(spark):
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
