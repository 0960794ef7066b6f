"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed from the whole text in one Arrow pass. Training uses at
most `sample` labelled documents (a documented bound; the ones with the
smallest hash of the id), so the driver holds a bounded table of numbers, never
texts. Trees are grown on quantile bins and flattened into arrays: the node
tables of all trees, walked level by level for all rows of a batch at once.

Defined cases: a null or empty text has the statistics of the empty text and is
scored; several labels of one id count as their mean, rounded; labels of absent
documents and null labels or ids are left out; of rows that repeat a labelled
id one is learnt from; without two classes of labels
the score is the share of label 1, or 1 without any label; repeated rows are
scored each; an empty table gives no rows; columns other than id and text are
not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrow

SAMPLE, TREES, DEPTH, RATE, BINS, L2 = 20_000, 80, 4, 0.12, 64, 1.0
FEATURES = [
    "log_chars", "log_words", "log_lines", "mean_word", "sd_word", "letters", "upper", "digits", "spaces", "dots", "commas", "other_punct", "high_bytes",
    "marks", "distinct_words", "top_word", "distinct_lines", "mean_line", "short_lines", "no_end_lines", "distinct_grams", "top_gram", "word_entropy", "byte_entropy",
    "capital_words", "all_caps_words", "odd_words", "long_words", "bars", "links", "brackets", "repeated_half", "control", "stop_like", "word_end_punct", "vowels",
]
_CLASS = np.zeros(256, np.int64)
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
for _c in b" \t\r\n":
    _CLASS[_c] = 4
_CLASS[ord(".")], _CLASS[ord(",")] = 5, 6
for _c in b"!\"#$%&'()*+-/:;<=>?@[\\]^_`{|}~":
    _CLASS[_c] = 7
_CLASS[128:] = 8
_MARKS = np.frombuffer(b"!#$%&*@~^", np.uint8)


def entropy(counts: np.ndarray) -> float:
    p = counts[counts > 0] / max(1, counts.sum())
    return float(-(p * np.log(p)).sum())


def statistics(text: str) -> list[float]:
    raw = text.encode()
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = max(1, len(raw))
    kinds = np.bincount(_CLASS, weights=counts, minlength=9) / size
    words = raw.split()
    n = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    often = Counter(words)
    wc = np.fromiter(often.values(), np.int64, len(often))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    m = max(1, len(lines))
    line_lengths = np.fromiter(map(len, lines), np.int64, len(lines)) if lines else np.zeros(1, np.int64)
    grams = Counter(zip(words, words[1:], words[2:]))
    g = max(1, sum(grams.values()))
    firsts = bytes(w[0] for w in words)
    ends = bytes(w[-1] for w in words)
    half = set(words[: len(words) // 2])
    vowels = sum(int(counts[c]) for c in b"aeiouAEIOU")
    return [
        np.log1p(len(raw)), np.log1p(len(words)), np.log1p(len(lines)), lengths.mean(), lengths.std(), kinds[1] + kinds[2], kinds[2], kinds[3], kinds[4], kinds[5], kinds[6], kinds[7], kinds[8],
        counts[_MARKS].sum() / size, len(often) / n, wc.max(initial=0) / n, len(set(lines)) / m, line_lengths.mean(), (line_lengths < 20).sum() / m, sum(x.rstrip()[-1:] not in b".!?\"'" for x in lines) / m,
        len(grams) / g, max(grams.values(), default=0) / g, entropy(wc), entropy(counts),
        sum(65 <= c <= 90 for c in firsts) / n, sum(w.isupper() for w in words) / n, sum(not w.isalpha() and w.isascii() for w in words) / n, (lengths > 14).sum() / n, raw.count(b"|") / n, (raw.count(b"http") + raw.count(b"www.")) / n,
        sum(int(counts[c]) for c in b"[]{}<>()") / size, sum(w in half for w in words[len(words) // 2 :]) / n, counts[:9].sum() / size + counts[127] / size, (lengths <= 3).sum() / n, sum(33 <= c <= 47 or 58 <= c <= 64 for c in ends) / n, vowels / size,
    ]


def matrix(texts: list[str]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], np.float32).reshape(-1, len(FEATURES))


class Trees:
    """Boosted trees as arrays: feature, threshold, left child by node; leaves point to themselves."""

    def __init__(self, base: float):
        self.base, self.start = base, []
        self.feature, self.cut, self.left, self.value = (np.zeros(0, t) for t in (np.int16, np.float32, np.int32, np.float32))

    def add(self, feature, cut, left, value) -> None:
        at = len(self.feature)
        self.start.append(at)
        for name, x in (("feature", feature), ("cut", cut), ("left", np.asarray(left) + at), ("value", value)):
            setattr(self, name, np.concatenate([getattr(self, name), np.asarray(x, getattr(self, name).dtype)]))

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Sum over trees; all trees and rows step down one level at a time."""
        if not self.start:
            return np.full(len(x), self.base)
        node = np.tile(np.array(self.start, np.int32), (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            # a leaf has cut +inf and itself as left child
            node = self.left[node] + (x[rows, self.feature[node]] > self.cut[node])
        return self.base + self.value[node].sum(1, dtype=np.float64)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Trees:
    """Level-wise trees on quantile bins for the logistic loss."""
    n, d = x.shape
    share = float(np.clip(y.mean() if n else 1.0, 1e-6, 1 - 1e-6))
    model = Trees(float(np.log(share / (1 - share))))
    if n < 20 or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])).astype(np.float32) for j in range(d)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)  # bin b: edges[b-1] < v <= edges[b]
    flat = binned + np.arange(d) * BINS
    margin = np.full(n, model.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        feature, cut, left, value = [0], [np.inf], [0], [0.0]
        at = np.zeros(n, np.int64)  # node of each row
        level = [0]
        for step in range(depth + 1):
            if not level:
                break
            local = np.full(len(feature), -1)
            local[level] = np.arange(len(level))
            rows = np.flatnonzero(local[at] >= 0)
            slot = (local[at[rows]][:, None] * (d * BINS) + flat[rows]).ravel()
            size = len(level) * d * BINS
            hg = np.bincount(slot, np.repeat(grad[rows], d), size).reshape(len(level), d, BINS)
            hh = np.bincount(slot, np.repeat(hess[rows], d), size).reshape(len(level), d, BINS)
            hn = np.bincount(slot, minlength=size).reshape(len(level), d, BINS)
            total_g, total_h = hg[:, 0].sum(-1), hh[:, 0].sum(-1)
            gl, hl, nl = hg.cumsum(-1), hh.cumsum(-1), hn.cumsum(-1)
            total_n = nl[:, :1, -1:]
            gain = gl**2 / (hl + L2) + (total_g[:, None, None] - gl) ** 2 / (total_h[:, None, None] - hl + L2) - (total_g**2 / (total_h + L2))[:, None, None]
            gain[(nl < 10) | (total_n - nl < 10)] = -1
            new = []
            for k, node in enumerate(level):
                j, b = np.unravel_index(int(gain[k].argmax()), gain[k].shape)
                if step == depth or gain[k, j, b] <= 1e-6 or b >= len(edges[j]):
                    value[node] = rate * float(total_g[k] / (total_h[k] + L2))
                    left[node] = node
                    continue
                feature[node], cut[node], left[node] = int(j), float(edges[j][b]), len(feature)
                for _side in range(2):
                    feature.append(0), cut.append(np.inf), left.append(len(feature) - 1), value.append(0.0)
                mine = rows[at[rows] == node]
                at[mine] = left[node] + (binned[mine, j] > b)
                new += [left[node], left[node] + 1]
            level = new
        model.add(feature, cut, left, value)
        margin += np.array(value)[at]
    return model


def measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "x"])

    return narrow(docs, id_col, text_col).mapInArrow(run, "doc_id long, x binary")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Trees:
    """labels: id and label. The sample's texts are measured where they lie; only their numbers reach the driver."""
    known = (
        labels.select(F.col(id_col).cast("long").alias("label_id"), F.col(label_col).cast("double").alias("y")).where("label_id is not null and y is not null")
        .groupBy("label_id").agg(F.round(F.avg("y")).alias("y")).orderBy(F.xxhash64("label_id"), "label_id").limit(sample)
    )
    some = narrow(docs, id_col, text_col).join(F.broadcast(known), F.col("doc_id") == F.col("label_id"))  # at most `sample` rows of two numbers
    one = measured(some, "doc_id", "text").groupBy("doc_id").agg(F.min("x").alias("x"))  # an id may be repeated without bound
    got = sorted(one.join(F.broadcast(known), F.col("doc_id") == F.col("label_id")).select("doc_id", "y", "x").collect())
    x = np.frombuffer(b"".join(bytes(r.x) for r in got), np.float32).reshape(-1, len(FEATURES))
    return grow(x, np.array([r.y for r in got], float))


def scored(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of docs and quality_score, a double from 0 to 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.concatenate([model.score(matrix(batch.column(0).slice(i, 512).to_pylist())) for i in range(0, batch.num_rows, 512)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.float64()), batch.column(1)], ["quality_score", "row"])

    whole = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("own_text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    out = whole.mapInArrow(run, f"quality_score double, row {whole.schema['row'].dataType.simpleString()}")
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns], "quality_score")
