"""User-defined parts: feature builders, evidence extractors, strategies and the signal registry.

All are registries of functions of DataFrames or columns, so user code stays declarative; only strategies and
metrics, which are code over one fold's arrays, run as group maps.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES: dict[str, Callable[[DataFrame], DataFrame]] = {}
EXTRACTORS: dict[str, dict[str, Column | str]] = {}

# Categories and frequencies of signals.
FREQUENCY_SECONDS = {"intraday": 3_600, "daily": 86_400, "weekly": 604_800, "monthly": 2_592_000}


def feature(name: str):
    """Registers a function of the observations that returns (entity_id, effective_at, value)."""

    def put(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        FEATURES[name] = f
        return f

    return put


def build_features(observations: DataFrame, names: list[str] | None = None) -> DataFrame:
    """All registered features in one long table; a value that isn't finite becomes a missing reason."""
    out = None
    for name in names or sorted(FEATURES):
        f = FEATURES[name](observations).select(F.lit(name).alias("feature"), "entity_id", "effective_at", F.col("value").cast("double").alias("value"))
        out = f if out is None else out.unionByName(f)
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf"))
    return out.select("feature", "entity_id", "effective_at", F.when(finite, F.col("value")).alias("value"), F.when(~finite | F.col("value").isNull(), F.lit("not_finite")).alias("missing_reason"))


def extractor(source: str, **columns: str) -> None:
    """Registers how a source's value_json becomes evidence: SQL expressions for value, direction and confidence."""
    EXTRACTORS[source] = columns


def evidence(observations: DataFrame, extractors: dict[str, dict[str, str]] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Evidence rows of the sources that have an extractor: source, signal_id, ts, value, direction, confidence, and the columns to keep.

    extractors: by source, as `extractor` takes them; all registered ones if not given. One whose expressions don't fit
    the observations' columns (it was registered for another input) gives no rows; a value that isn't a number, none.
    """
    out = observations.select(*keep, "source", F.lit("").alias("signal_id"), "ts", *[F.lit(None).cast(t).alias(n) for n, t in (("value", "double"), ("direction", "int"), ("confidence", "double"))]).where("false")
    for source, c in sorted((EXTRACTORS if extractors is None else extractors).items()):
        try:
            rows = observations.where(F.col("source") == source).select(
                *keep, "source", F.concat_ws(".", "source", "entity_id").alias("signal_id"), "ts", F.expr(f"try_cast(({c.get('value', 'value')}) as double)").alias("value"),
                F.expr(f"cast({c.get('direction', 'signum(value)')} as int)").alias("direction"), F.expr(f"cast({c.get('confidence', '1.0')} as double)").alias("confidence"),
            )
        except AnalysisException as e:
            if extractors is not None or "UNRESOLVED_COLUMN" not in (e.getCondition() or ""):
                raise
            continue
        out = out.unionByName(rows)
    return out.where("value is not null")


def signal_registry(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """signal_id, category, frequency, flip_sign, ttl_seconds, min_observations; a missing TTL is one period of the frequency."""
    df = spark.createDataFrame(rows, "signal_id string, category string, frequency string, flip_sign boolean, ttl_seconds long, min_observations int")
    seconds = F.create_map(*[x for k, v in FREQUENCY_SECONDS.items() for x in (F.lit(k), F.lit(v))])
    return df.withColumn("ttl_seconds", F.coalesce("ttl_seconds", F.try_element_at(seconds, F.col("frequency")).cast("long"))).withColumn("min_observations", F.coalesce("min_observations", F.lit(30)))


def strategy(folds: DataFrame, weights: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """User weights per fold. folds: fold, asset, d, train (boolean), ret. weights(train returns, test returns) gives one
    weight per asset (columns in the order of their name). One fold is one group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index=["train", "d"], columns="asset", values="ret").fillna(0.0)
        part = lambda t: wide.loc[t].to_numpy() if t in wide.index.get_level_values(0) else np.zeros((0, wide.shape[1]))
        w = np.asarray(weights(part(True), part(False)), float)
        return pd.DataFrame({"fold": pdf["fold"].iloc[0], "asset": wide.columns, "weight": w})

    return folds.groupBy("fold").applyInPandas(run, "fold long, asset string, weight double")


def bootstrap_metric(series: DataFrame, metric: Callable[[np.ndarray], float], replicas: int = 100, seed: int = 1) -> DataFrame:
    """A user statistic of each key's series over circular blocks: key, estimate, lo, hi. series: key, d, ret."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("d")["ret"].to_numpy(float)
        n = len(x)
        block = max(1, round(n ** (1 / 3)))
        rng = np.random.default_rng([seed, n])
        starts = rng.integers(0, n, (replicas, -(-n // block)))
        at = (starts[:, :, None] + np.arange(block)).reshape(replicas, -1)[:, :n] % n
        stats = np.array([metric(x[i]) for i in at])
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "estimate": [metric(x)], "lo": [float(np.quantile(stats, 0.025))], "hi": [float(np.quantile(stats, 0.975))]})

    return series.groupBy("key").applyInPandas(run, "key string, estimate double, lo double, hi double")
