"""Column functions. All are JVM expressions unless a docstring says otherwise."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def json_number(col: Column, key: str) -> Column:
    """A numeric member of a JSON text; text that is no number, true and false are null."""
    return F.get_json_object(col, f"$.{key}").try_cast("double")


def finite(col: Column) -> Column:
    return F.when(~F.isnan(col) & (F.abs(col) != float("inf")), col)


def first_number(col: Column, keys: list[str]) -> Column:
    return F.coalesce(*[finite(json_number(col, k)) for k in keys])


def positive(col: Column) -> Column:
    return F.when(col > 0, col)


def known_by(created: Column, until: Column) -> Column:
    return created.isNull() | (created <= until)


def is_stale(ts: Column, ttl: float, as_of: Column) -> Column:
    return (F.unix_micros(as_of) - F.unix_micros(ts)) / 1e6 > ttl


def flipped(value: Column, flip: Column) -> Column:
    return F.when(flip, -value).otherwise(value)


SUFFIXES = ["incorporated", "corporation", "company", "limited", "holdings", "group", "inc", "corp", "co", "ltd", "llc", "plc", "lp", "sa", "ag", "nv"]


def normalise_company(name: Column) -> Column:
    """Lower case, marks off (the common Latin ones), suffixes off, punctuation but the hyphen off, blanks collapsed; empty is null."""
    x = F.translate(F.lower(name), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    x = F.regexp_replace(x, r"[^\p{L}\p{N}\s-]", " ")
    x = F.regexp_replace(x, rf"\b({'|'.join(SUFFIXES)})\b", " ")
    x = F.trim(F.regexp_replace(x, r"\s+", " "))
    return F.when(x != "", x)


def entity_key(kind: Column, key: Column) -> Column:
    return F.substring(F.sha2(F.concat(kind, F.lit(":"), key), 256), 1, 16)


def pair_hash(a: Column, b: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", F.least(a, b), F.greatest(a, b)), 256), 1, 12)


def mmsi(x: Column) -> Column:
    return F.lpad(F.regexp_replace(x, r"\D", ""), 9, "0")


def ladder(x: Column, steps: list[tuple[float, str]], last: str) -> Column:
    """The label of the first step whose bound x reaches; null stays null."""
    out = F.when(x.isNull(), None)
    for bound, label in steps:
        out = out.when(x >= bound, label)
    return out.otherwise(last)


def magnitude_label(m: Column) -> Column:
    return ladder(m, [(8, "GREAT"), (7, "MAJOR"), (6, "STRONG"), (5, "MODERATE"), (4, "LIGHT")], "MINOR")


def positioning_label(rank: Column) -> Column:
    return F.when(rank >= 0.80, "crowded_long").when(rank <= 0.20, "crowded_short").when(rank >= 0.65, "approaching_long").when(rank <= 0.35, "approaching_short").otherwise("neutral")


def urgency(filed: Column, sale: Column) -> Column:
    gap = F.date_diff(sale, filed)
    return F.when(gap.isNull(), "unknown").when(gap <= 1, "immediate").when(gap <= 7, "near_term").otherwise("planned")


def matched(text: Column, ladder_of: list[tuple[str, str]], last: str) -> Column:
    """The label of the first pattern found in text, any case."""
    out = None
    for pattern, label in ladder_of:
        hit = F.lower(text).rlike(pattern)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(last)


CHARGES = [("debenture", "debenture"), ("floating", "floating"), ("mortgage", "mortgage"), ("fixed", "fixed")]
ACQUISITIONS = [("open market|market purchase", "open_market"), ("private placement", "private_placement"), ("vest|restricted|rsu|option|award|compensation", "vesting")]


def symlog(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def symexp(x: Column) -> Column:
    return F.signum(x) * F.expm1(F.abs(x))


def clamp(x: Column, lo: float, hi: float) -> Column:
    """Null, NaN and infinities count as 0."""
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), F.coalesce(finite(x), F.lit(0.0))))


def sigmoid_score(raw: Column) -> Column:
    return F.round(2 / (1 + F.exp(-raw)) - 1, 6)


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])\s+")


def capitalised(sentence: Column) -> Column:
    """Runs of one to four capitalised words."""
    return F.regexp_extract_all(sentence, F.lit(r"([A-Z][A-Za-z]+(?: [A-Z][A-Za-z]+){0,3})"), F.lit(1))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    return F.when((na < 1e-12) | (nb < 1e-12), 0.0).otherwise(dot(a, b) / (na * nb))


def safe_number(x: Column) -> Column:
    t = F.trim(x)
    return F.when((t != "") & (t != "."), t).try_cast("double")


DATE_SHAPES = ["yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "yyyyMMdd", "dd MMM yyyy"]


def date_seconds(text: Column) -> Column:
    """Epoch seconds of a date in any of DATE_SHAPES; null when none fits."""
    return F.unix_timestamp(F.coalesce(*[F.try_to_timestamp(F.trim(text), F.lit(s)) for s in DATE_SHAPES]))


def relative_seconds(text: Column) -> Column:
    """'7d', '12h', '30m' or '45s' in seconds."""
    n = F.regexp_extract(text, r"^(\d+)([dhms])$", 1).try_cast("long")
    unit = F.regexp_extract(text, r"^(\d+)([dhms])$", 2)
    return n * F.when(unit == "d", 86_400).when(unit == "h", 3_600).when(unit == "m", 60).when(unit == "s", 1)


def discretise(x: Column, edges: list[float]) -> Column:
    """State number by right-open bins; below the first edge 0, the last bin takes all above."""
    out = F.when(x.isNull(), None)
    for i in range(len(edges) - 1, -1, -1):
        out = out.when(x >= edges[i], i)
    return out.otherwise(0)


@F.pandas_udf(DoubleType())
def normal_cdf(x: pd.Series) -> pd.Series:
    """Arrow UDF: Spark has no erf."""
    return x.map(lambda v: 0.5 * math.erfc(-v / math.sqrt(2)) if v == v else None)


@F.pandas_udf(DoubleType())
def two_sided_p(z: pd.Series) -> pd.Series:
    """Arrow UDF: both normal tails beyond |z|."""
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2)) if v == v else None)


@F.pandas_udf(DoubleType())
def binomial_upper(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    """Arrow UDF: P(X >= k) for X ~ Binomial(n, p), by logs of factorials."""

    def tail(k: float, n: float, p: float) -> float | None:
        if k != k or n != n or p != p:
            return None
        k, n = int(k), int(n)
        if k <= 0:
            return 1.0
        if p <= 0:
            return 0.0
        if p >= 1:
            return 1.0
        c = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
        return min(1.0, math.fsum(math.exp(c(i)) for i in range(k, n + 1)))

    return pd.Series([tail(*x) for x in zip(k, n, p, strict=True)])


def chi2_even_tail(x: Column, half_df: int) -> Column:
    """P(chi2 with 2*half_df degrees of freedom > x), closed form."""
    total, term = F.lit(1.0), F.lit(1.0)
    for j in range(1, half_df):
        term = term * (x / 2) / j
        total = total + term
    return F.exp(-x / 2) * total
