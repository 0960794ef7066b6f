"""Toxicity: non-negative positive-unlabelled learning over hashed words and byte grams.

Labels name some toxic documents; all others are unlabelled, not clean. A
linear classifier f is learnt from confirmed toxic documents P and a sample U of
all documents, with the risk

    prior * mean_P loss(f) + max(0, mean_U loss(-f) - prior * mean_P loss(-f))

for the logistic loss of a margin bounded to +-MARGIN. The second term estimates the risk on clean documents;
an overfit classifier drives it below zero, and then its gradient is turned
round until it is positive again. With the class prior right, the classifier's
sigmoid is the probability that a document is toxic.

- Features: presence of a word (a run of letters, A-Z lower-cased, of up to 16
  bytes) and of GRAM successive bytes of the lower-cased text, both hashed.
- Spark counts each feature's documents in P and in U; the `FEATURES` with the
  strongest evidence after the correction by the prior are kept, so only documents'
  few kept features reach the driver, where numpy fits the weights.
- Scoring reads the whole text, in pieces of bounded bytes.

Bounds: at most POSITIVES confirmed and UNLABELLED other documents are learnt
from, those with the smallest hash of the id. The prior is the share of label 1
in the labels given, unless it is passed.

Defined cases: a null or empty text has no features and is scored; several
labels of an id count as 1 where any is 1; labels of absent documents and null
labels or ids are left out; of rows that repeat an id one is learnt from; with
fewer than two confirmed documents every score is the prior, bounded like any
margin (the least score without labels);
repeated rows are scored each; an empty table gives no rows; columns other than
id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import flat, narrow, pieces

POSITIVES, UNLABELLED, FEATURES = 10_000, 20_000, 4096
GRAM, WORD, BITS = 5, 16, 22
LEAST_DOCS, LEAST_STRENGTH, MARGIN = 3, 20.0, 4.0
PIECE = 2 << 20

_BYTES = np.arange(256, dtype=np.uint8)
_UPPER = (_BYTES >= ord("A")) & (_BYTES <= ord("Z"))
_LETTER = _UPPER | ((_BYTES >= ord("a")) & (_BYTES <= ord("z"))) | (_BYTES >= 128)
#: letters lower-cased; all else is one separator
_PLAIN = np.where(_LETTER, np.where(_UPPER, _BYTES + 32, _BYTES), 32).astype(np.uint8)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


def slots(raw: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashed features of texts laid one after another, with repeats: document and slot of each."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # every text gets a separator before and after it, so no gram or word spans two texts
    doc_of = np.repeat(np.arange(len(begins) - 1), np.diff(begins) + 2)
    place = np.arange(len(raw)) + 2 * np.repeat(np.arange(len(begins) - 1), np.diff(begins)) + 1
    text = np.full(len(raw) + 2 * (len(begins) - 1), 32, np.uint8)
    text[place] = _PLAIN[raw]
    padded = np.append(text, np.zeros(WORD, np.uint8))
    at = np.ndarray(len(text), "<u8", padded, strides=(1,))
    gram = at & np.uint64((1 << 8 * GRAM) - 1)
    whole = np.arange(len(text))[: max(0, len(text) - GRAM + 1)]
    whole = whole[doc_of[whole] == doc_of[whole + GRAM - 1]]
    inner = text != 32
    starts = np.flatnonzero(inner & ~np.append(False, inner[:-1]))
    sizes = np.flatnonzero(inner & ~np.append(inner[1:], False)) + 1 - starts
    starts, sizes = starts[sizes <= WORD], sizes[sizes <= WORD]
    keep = lambda n: np.where(n >= 8, ~np.uint64(0), (np.uint64(1) << (np.uint64(8) * np.minimum(n, 7).astype(np.uint64))) - np.uint64(1))
    first = at[starts] & keep(sizes)
    second = np.where(sizes > 8, np.ndarray(len(text) + 8, "<u8", padded, strides=(1,))[starts + 8] & keep(np.maximum(sizes - 8, 0)), np.uint64(0))
    half = np.uint64(64 - BITS + 1)
    grams = mixed(gram[whole]) >> half
    words = (mixed(first ^ mixed(second + np.uint64(1))) >> half) + np.uint64(1 << (BITS - 1))
    return np.concatenate([doc_of[whole], doc_of[starts]]), np.concatenate([grams, words]).astype(np.int64)


def present(raw: np.ndarray, begins: np.ndarray, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, feature); with a table `only`, of its kept features, by their numbers."""
    doc, slot = slots(raw, begins)
    if only is not None:
        slot = only[slot]
        doc, slot = doc[slot >= 0], slot[slot >= 0]
    pair = np.unique(doc << BITS | slot)
    return pair >> BITS, pair & ((1 << BITS) - 1)


@dataclass
class Model:
    """The kept features' slots with their weights, and the score of a text without any of them."""

    slot: np.ndarray
    weight: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        out = np.full(1 << BITS, -1, np.int32)
        out[self.slot] = np.arange(len(self.slot))
        return out

    def score(self, raw: np.ndarray, begins: np.ndarray, table: np.ndarray) -> np.ndarray:
        doc, feature = present(raw, begins, table)
        return sigmoid(bounded(self.bias + np.bincount(doc, self.weight[feature], len(begins) - 1)))


def bounded(x: np.ndarray) -> np.ndarray:
    """A text with many marks is no surer than MARGIN; else the learnt documents' margins outgrow those of the same kind in U."""
    return MARGIN * np.tanh(x / MARGIN)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def nonnegative_fit(x_rows: list[np.ndarray], confirmed: np.ndarray, size: int, prior: float, steps: int = 400, rate: float = 0.05, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias. x_rows: the features present in each document; confirmed: which documents are in P (all others are U)."""
    n = len(x_rows)
    doc = np.repeat(np.arange(n), [len(r) for r in x_rows])
    feature = np.concatenate([*x_rows, np.zeros(0, np.int64)]).astype(np.int64)
    n_p, n_u = int(confirmed.sum()), int((~confirmed).sum())
    w, b = np.zeros(size), float(np.log(prior / (1 - prior)))
    momentum, square = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        f = bounded(b + np.bincount(doc, w[feature], n))
        p = sigmoid(f)
        # derivatives of the losses: loss(f) = log(1 + e^-f), loss(-f) = log(1 + e^f)
        found = np.where(confirmed, prior * (p - 1) / n_p, 0.0)
        clean = np.where(confirmed, -prior * p / n_p, p / n_u)
        risk = np.logaddexp(0, f)
        negative = risk[~confirmed].sum() / n_u - prior * risk[confirmed].sum() / n_p
        g = (found + clean if negative >= 0 else -clean) * (1 - (f / MARGIN) ** 2)
        grad = np.append(np.bincount(feature, g[doc], size) + ridge * w, g.sum())
        momentum, square = 0.9 * momentum + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        move = rate * (momentum / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def strength(in_p: Column, in_u: Column, n_p: int, n_u: int, prior: float) -> Column:
    """Likelihood ratio statistic of the documents of P with a feature against those expected at its share of clean documents, which follows from U and the prior."""
    clean = F.greatest(F.lit(0.0), (in_u / F.lit(float(n_u)) - prior * in_p / F.lit(float(n_p))) / (1 - prior))
    expected = n_p * (clean + 0.5 / n_u)
    return F.when(in_p > expected, 2 * (in_p * F.log(in_p / expected) - in_p + expected)).otherwise(0.0)


def fit(docs: DataFrame, labels: DataFrame, prior: float | None = None, unlabelled: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """labels: id and label, of which only 1 is learnt; unlabelled: which rows of docs may be drawn for U (all)."""
    known = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y")).where("doc_id is not null and y is not null")
        .groupBy("doc_id").agg(F.max("y").alias("y"))
    )
    share = known.agg(F.avg("y")).first()[0]
    prior = float(np.clip(share if prior is None else prior, 1e-3, 0.5)) if share is not None or prior is not None else 0.0
    none = Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(prior / (1 - prior))) if prior else -30.0)
    ids = docs.where(F.lit(True) if unlabelled is None else unlabelled).select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id is not null")
    by_hash = [F.xxhash64("doc_id"), "doc_id"]
    positive = known.where("y = 1").join(docs.select(F.col(id_col).cast("long").alias("doc_id")), "doc_id", "left_semi").orderBy(*by_hash).limit(POSITIVES).select("doc_id", F.lit(True).alias("confirmed"))
    drawn = ids.distinct().orderBy(*by_hash).limit(UNLABELLED).select("doc_id", F.lit(False).alias("confirmed"))
    # at most POSITIVES + UNLABELLED rows of an id and a mark; a document may be in both
    chosen = written(positive.unionByName(drawn).groupBy("doc_id").agg(F.max("confirmed").alias("in_p"), F.min("confirmed").alias("only_p")), "chosen")
    n_p = chosen.where("in_p").count()
    n_u = chosen.where("not only_p").count()
    if n_p < 2 or n_u < 2:
        return none
    some = narrow(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "in_p", "only_p").agg(F.min("text").alias("text"))
    some = written(some, "learnt")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, 3, PIECE):
            doc, slot = present(*flat(piece.column(3).combine_chunks()))
            in_p, in_u = piece.column(1).to_numpy(), ~piece.column(2).to_numpy()
            found, at = np.unique(slot, return_inverse=True)
            counts = [np.bincount(at, w[doc], len(found)).astype(np.int64) for w in (in_p, in_u)]
            yield pa.RecordBatch.from_arrays([pa.array(found), *map(pa.array, counts)], ["slot", "in_p", "in_u"])

    counts = some.mapInArrow(count, "slot long, in_p long, in_u long").groupBy("slot").agg(F.sum("in_p").alias("in_p"), F.sum("in_u").alias("in_u"))
    found = strength(F.col("in_p"), F.col("in_u"), n_p, n_u, prior).alias("strength")
    best = counts.where(F.col("in_p") >= LEAST_DOCS).select("slot", found).where(F.col("strength") >= LEAST_STRENGTH).orderBy(F.desc("strength"), "slot").limit(FEATURES)
    slot = np.array(sorted(r.slot for r in best.collect()), np.int64)  # FEATURES at most
    if not len(slot):
        return none
    shared = some.sparkSession.sparkContext.broadcast(Model(slot, np.zeros(len(slot)), 0.0).table())

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, 3, PIECE):
            doc, feature = present(*flat(piece.column(3).combine_chunks()), shared.value)
            cuts = np.searchsorted(doc, np.arange(piece.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(feature.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*[piece.column(i).combine_chunks() for i in range(3)], lists], ["doc_id", "in_p", "only_p", "features"])

    got = some.mapInArrow(kept, "doc_id long, in_p boolean, only_p boolean, features array<int>").toArrow().sort_by("doc_id")
    rows = [np.asarray(x, np.int64) for x in got.column("features").to_pylist()]
    in_p, in_u = np.array(got.column("in_p").to_pylist(), bool), ~np.array(got.column("only_p").to_pylist(), bool)
    both = [r for r, x in zip(rows, in_p, strict=True) if x] + [r for r, x in zip(rows, in_u, strict=True) if x]
    weight, bias = nonnegative_fit(both, np.arange(len(both)) < in_p.sum(), len(slot), prior)
    return Model(slot, weight, bias)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and toxicity, from 0 to 1, a row for each row of docs."""
    # plain data, as a broadcast reaches executors that have no copy of this package: a table of 2^BITS numbers and FEATURES weights
    shared = docs.sparkSession.sparkContext.broadcast((model.slot, model.weight, model.bias, model.table()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *parts, table = shared.value
        model = Model(*parts)
        for piece in pieces(batches, 1, PIECE):
            s = model.score(*flat(piece.column(1).combine_chunks()), table)
            yield pa.RecordBatch.from_arrays([piece.column(0).combine_chunks(), pa.array(s, pa.float64())], ["doc_id", "toxicity"])

    return narrow(docs, id_col, text_col).mapInArrow(run, "doc_id long, toxicity double")
