import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tessella.functions import plugins


def test_features_and_missing_reasons(spark):
    obs = spark.createDataFrame([("e1", 1.0, 2.0), ("e1", 2.0, float("inf")), ("e2", 1.0, None)], "entity_id string, t double, v double")

    @plugins.feature("twice")
    def twice(o):
        return o.select("entity_id", F.col("t").alias("effective_at"), (2 * F.col("v")).alias("value"))

    got = {(r.entity_id, r.effective_at): (r.value, r.missing_reason) for r in plugins.build_features(obs, ["twice"]).collect()}
    assert got == {("e1", 1.0): (4.0, None), ("e1", 2.0): (None, "not_finite"), ("e2", 1.0): (None, "not_finite")}


def test_evidence(spark):
    obs = spark.createDataFrame([("s", "e", 1.0, '{"x": -2.5}'), ("s", "e", 2.0, "bad"), ("other", "e", 1.0, "{}")], "source string, entity_id string, ts double, value_json string")
    plugins.extractor("s", value="get_json_object(value_json, '$.x')", direction="signum(get_json_object(value_json, '$.x'))", confidence="0.5")
    assert [(r.signal_id, r.value, r.direction, r.confidence) for r in plugins.evidence(obs).collect()] == [("s.e", -2.5, -1, 0.5)]


def test_evidence_of_two_inputs(spark):
    plugins.extractor("s", value="get_json_object(value_json, '$.x')", direction="1", confidence="0.5")
    plugins.extractor("t", value="reading * 2", direction="signum(reading)")
    other = spark.createDataFrame([(5, "t", "e", 1.0, 3.0), (6, "s", "e", 1.0, 3.0)], "id long, source string, entity_id string, ts double, reading double")
    assert [(r.id, r.value) for r in plugins.evidence(other, keep=("id",)).collect()] == [(5, 6.0)]
    with pytest.raises(AnalysisException):
        plugins.evidence(other, {"s": plugins.EXTRACTORS["s"]}).count()
    assert plugins.evidence(other, {}).count() == 0


def test_registry(spark):
    r = plugins.signal_registry(spark, [("a", "macro", "weekly", False, None, None), ("b", "macro", "daily", True, 5, 7)]).orderBy("signal_id").collect()
    assert [(x.ttl_seconds, x.min_observations) for x in r] == [(604_800, 30), (5, 7)]


def test_strategy_and_bootstrap(spark):
    rows = [(f, a, d, d < 5, (0.1 if a == "x" else -0.1) * (f + 1)) for f in range(2) for a in "xy" for d in range(8)]
    folds = spark.createDataFrame(rows, "fold long, asset string, d int, train boolean, ret double")
    got = {(r.fold, r.asset): r.weight for r in plugins.strategy(folds, lambda train, test: (train.mean(0) > 0).astype(float)).collect()}
    assert got == {(0, "x"): 1.0, (0, "y"): 0.0, (1, "x"): 1.0, (1, "y"): 0.0}
    s = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate(np.random.default_rng(0).normal(1, 0.1, 200))], "key string, d int, ret double")
    r = plugins.bootstrap_metric(s, lambda x: float(x.mean())).first()
    assert r.lo < r.estimate < r.hi and abs(r.estimate - 1) < 0.05
