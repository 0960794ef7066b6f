"""Source divergence audit: how far the term distributions of a language's sources lie from each other.

1. Each task packs the terms of about CHUNK bytes of text at a time, by length:
   up to 8 bytes are one uint64 word, up to 16 two, both radix-sorted by 16-bit
   digits; longer terms go to buckets of a power of two of bytes, each sorted as
   byte strings. Texts are taken in order of language and source and the sorts
   are stable, so runs of equal (term, source, document) lie together and are
   counted by where they change. One row per (language, source, term) leaves a
   chunk, never one per occurrence.
2. Spark sums these rows; terms in fewer than MIN_DOCS documents of their
   language go. Each group's smoothed share of a kept term is an integer in
   parts of SCALE, by decimal division.
3. `pairs` deals each language's kept terms by hash into buckets, one for each BUCKET_ROWS
   rows, and sums the divergence of every two of its sources bucket by bucket,
   over matrices of a bounded number of cells. `terms` keeps the TOP terms that a source
   overuses most; Spark's ranking limit cuts each task's rows before it shuffles.

Defined cases: null text, lang and source are empty strings; an empty text, or
one without letters, counts as a document of its group without terms; rows that
repeat an id are documents each; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .common import flat, pieces

MIN_DOCS, TOP, SCALE = 10, 10, 1_000_000_000
CHUNK, BUCKET_ROWS, CELLS = 16 << 20, 1 << 18, 1 << 22

_BYTES = np.arange(256, dtype=np.uint8)
_UPPER = (_BYTES >= ord("A")) & (_BYTES <= ord("Z"))
_TERM = _UPPER | ((_BYTES >= ord("a")) & (_BYTES <= ord("z"))) | (_BYTES >= 128)
_LOW = np.where(_UPPER, _BYTES + 32, _BYTES).astype(np.uint8)


def radix_order(words: list[np.ndarray]) -> np.ndarray:
    """Stable order by words, the first leading: one pass over each 16-bit digit (numpy sorts those by radix) that isn't the same everywhere."""
    order = np.arange(len(words[0]))
    for word in reversed(words):
        for shift in (0, 16, 32, 48):
            digit = (word >> np.uint64(shift)).astype(np.uint16)
            if len(digit) and digit.min() != digit.max():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def spans(raw: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and document of each term; a document's end also ends a term."""
    inside = np.zeros(len(raw) + 1, bool)
    inside[:-1] = _TERM[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[begins] = True
    starts = np.flatnonzero(inside[:-1] & (np.append(True, ~inside[:-2]) | edge[:-1])) if len(raw) else np.zeros(0, np.int64)
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge[1:])) + 1
    return starts, ends - starts, np.searchsorted(begins, starts, side="right") - 1


def packed(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """The terms of 16 bytes at most as one or two big-endian words, filled up with zeros."""
    padded = np.append(raw, np.zeros(16, np.uint8))
    at = np.ndarray(len(padded) - 7, ">u8", padded, strides=(1,))  # the 8 bytes from every place
    out = []
    for k in range(0, 16 if lengths.max(initial=0) > 8 else 8, 8):
        free = np.clip(8 - (lengths - k), 0, 8).astype(np.uint64)
        word = at[starts + k].astype(np.uint64)
        out.append(np.where(free < 8, word >> np.minimum(free, 7) * np.uint64(8) << np.minimum(free, 7) * np.uint64(8), np.uint64(0)))
    return out


def sorted_runs(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length bucket: the places (in starts) of its terms in sorted order, and where a new term begins among them."""
    for low, high in ((0, 8), (8, 16)):
        mine = np.flatnonzero((lengths > low) & (lengths <= high))
        words = packed(raw, starts[mine], lengths[mine])
        order = radix_order(words)
        fresh = np.append(True, np.any([w[order][1:] != w[order][:-1] for w in words], 0)) if len(mine) else np.zeros(0, bool)
        yield mine[order], fresh
    width = 32
    while (lengths > width // 2).any():
        mine = np.flatnonzero((lengths > max(16, width // 2)) & (lengths <= width))
        if len(mine):
            text = np.array([raw[s : s + n].tobytes() for s, n in zip(starts[mine], lengths[mine], strict=True)], f"S{width}")
            order = np.argsort(text, kind="stable")
            text = text[order]
            yield mine[order], np.append(True, text[1:] != text[:-1])
        width *= 2


def counted(chunk: pa.Table) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n, docs of a chunk's rows (lang, source, text)."""
    chunk = chunk.take(pc.sort_indices(chunk, sort_keys=[("lang", "ascending"), ("source", "ascending")])).combine_chunks()
    lang, source = (chunk.column(c).combine_chunks() for c in ("lang", "source"))
    changed = np.append(True, pc.or_(pc.not_equal(lang[1:], lang[:-1]), pc.not_equal(source[1:], source[:-1])).to_numpy(zero_copy_only=False).astype(bool))
    group = np.cumsum(changed) - 1
    first = np.flatnonzero(changed)
    raw, begins = flat(chunk.column("text").combine_chunks())
    raw = _LOW[raw]
    starts, lengths, doc = spans(raw, begins)
    for at, fresh in sorted_runs(raw, starts, lengths):
        if not len(at):
            continue
        d = doc[at]
        g = group[d]
        fresh_group = fresh | np.append(True, g[1:] != g[:-1])
        fresh_doc = fresh_group | np.append(True, d[1:] != d[:-1])
        head = np.flatnonzero(fresh_group)
        n = np.diff(np.append(head, len(at)))
        docs = np.add.reduceat(fresh_doc.astype(np.int64), head)
        s, size = starts[at[head]], lengths[at[head]]
        ends = np.append(0, np.cumsum(size))
        letters = raw[np.repeat(s - ends[:-1], size) + np.arange(ends[-1])]
        term = pa.StringArray.from_buffers(len(s), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(letters))
        place = pa.array(first[g[head]])
        yield pa.RecordBatch.from_arrays([lang.take(place), source.take(place), term, pa.array(n.astype(np.int64)), pa.array(docs)], ["lang", "source", "term", "n", "docs"])


def narrow(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])


def term_counts(docs: DataFrame, chunk: int = CHUNK, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, 2, chunk):
            yield from counted(piece)

    out = narrow(docs, text_col, lang_col, source_col).mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return out.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * kept)), in decimals."""
    whole = lambda c: c.cast("decimal(19,0)")
    top, under = F.lit(SCALE).cast("decimal(10,0)") * whole(n + 2), whole(total + 2 * kept)
    return 1 + F.call_function("div", top, under)


def difference(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS, **columns: str) -> tuple[DataFrame, DataFrame]:
    """Kept terms by group with count and shares: lang, source, term, n, p, q; and the groups: lang, source, rest (the share of a term it lacks), kept."""
    counts = written(term_counts(docs, **columns), "terms")
    wide = written(counts.groupBy("lang", "term").agg(F.sum("docs").alias("in_docs"), F.sum("n").alias("lang_n")).where(F.col("in_docs") >= min_docs).select("lang", "term", "lang_n"), "kept")
    kept = written(counts.join(wide, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "kept")
    of_lang = wide.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    own = [F.coalesce(F.col(columns.get(f"{n}_col", n)).cast("string"), F.lit("")).alias(n) for n in ("lang", "source")]
    groups = docs.select(*own).distinct()
    total = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    groups = groups.join(total, ["lang", "source"], "left").join(of_lang, "lang", "left").select("lang", "source", zero("total"), zero("kept"), zero("lang_total"))
    groups = written(groups.withColumn("rest", F.when(F.col("kept") > 0, share(F.lit(0), F.col("total"), F.col("kept")))), "groups")
    p, q = share(F.col("n"), F.col("total"), F.col("kept")), share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    return kept.join(groups, ["lang", "source"]).select("lang", "source", "term", "n", p.alias("p"), q.alias("q")), groups


def pair_sums(terms: pa.Table, groups: pa.Table) -> Iterator[pa.RecordBatch]:
    """Divergence of every two groups over one bucket's terms, in blocks of terms and of groups."""
    names = groups.column("source").to_pylist()
    rest = groups.column("rest").to_numpy()
    row = {s: i for i, s in enumerate(names)}
    coded = terms.column("source").combine_chunks().dictionary_encode()
    source = np.array([row[s] for s in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()]
    term = terms.column("term").combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
    order = np.argsort(term, kind="stable")
    term, source, p = term[order], source[order], terms.column("p").to_numpy()[order]
    block = max(1, CELLS // len(names))
    for a in range(0, len(names), block):
        sums = np.zeros((min(block, len(names) - a), len(names)), np.int64)
        for t in range(0, int(term[-1]) + 1, block):
            i, j = np.searchsorted(term, [t, t + block])
            shares = np.tile(rest[:, None], (1, min(block, int(term[-1]) + 1 - t)))
            shares[source[i:j], term[i:j] - t] = p[i:j]
            for x in range(len(sums)):
                sums[x] += difference(shares[a + x], shares).sum(1)
        for x in range(len(sums)):
            others = [s for i, s in enumerate(names) if i != a + x]
            yield pa.RecordBatch.from_arrays([pa.array([names[a + x]] * len(others), pa.string()), pa.array(others, pa.string()), pa.array(np.delete(sums[x], a + x))], ["source", "item", "value"])


def pairs(kept: DataFrame, groups: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """lang, source, item (another source of the language) and value; kept's rows are counted first, so it should be written."""
    last = kept.count() // bucket_rows
    dealt = kept.select("lang", F.pmod(F.xxhash64("term"), F.lit(last + 1)).alias("bucket"), "source", "term", "p")
    each = groups.where("kept > 0").select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))).alias("bucket"), "source", "rest")

    def run(key, terms, sources):  # without hints: Spark reads them to choose the kind of call
        found = [pa.Table.from_batches([b]) for b in pair_sums(terms, sources)] if terms.num_rows else []
        out = pa.concat_tables(found) if found else pa.table({"source": pa.array([], pa.string()), "item": pa.array([], pa.string()), "value": pa.array([], pa.int64())})
        return out.add_column(0, "lang", pa.array([key[0].as_py()] * out.num_rows, pa.string()))

    sums = dealt.groupBy("lang", "bucket").cogroup(each.groupBy("lang", "bucket")).applyInArrow(run, "lang string, source string, item string, value long")
    sums = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    bare = groups.where("kept = 0").select("lang", "source")
    return sums.unionByName(bare.join(bare.select("lang", F.col("source").alias("item")), "lang").where("source <> item").withColumn("value", F.lit(0).cast("long")))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, **columns: str) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    kept, groups = kept_terms(docs, min_docs, **columns)
    kept = written(kept, "shares")
    terms = kept.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    both = pairs(kept, groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    return both.select("*", rank).unionByName(terms.select("*", rank).where(F.col("rank") <= top))
