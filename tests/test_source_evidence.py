"""Evidence of single payloads against rows written by hand, and the defined results of broken ones."""

import json

import pytest

from tessella.sources import evidence

LANDING = "source string, fetched_at double, data string"


def rows(spark, source, payload, **kw):
    data = payload if payload is None or isinstance(payload, str) else json.dumps(payload)
    out = evidence.evidence(spark.createDataFrame([(source, 7.0, data)], LANDING), [source], **kw)
    return {r.signal_id: (r.value, r.direction, r.confidence) for r in out.collect()}


HAND = [
    ("cftc", {"contracts": [{"Market_and_Exchange_Names": "CRUDE OIL - NYMEX", "_mm_net_pct_oi": -3.5}, {"_mm_net_pct_oi": "2"}, {"Market_and_Exchange_Names": "GOLD"}]}, {"cftc.crude_oil.mm_net_pct_oi": (-3.5, -1, 0.85), "cftc.unknown.mm_net_pct_oi": (2.0, 1, 0.85)}),
    ("weather_alerts", {"alert_count": 0, "fires": [1], "zones_affected": ["a", "b"]}, {"weather.us.alert_count": (0.0, 0, 0.7), "weather.global.infra_fire_zones": (2.0, 1, 0.65)}),
    ("earthquake_proximity", {"quakes": [{"magnitude": 4.2}, {"magnitude": None}], "zone": {"name": "San Andreas"}}, {"earthquake.san_andreas.count": (2.0, 1, 0.9), "earthquake.san_andreas.max_magnitude": (4.2, 0, 0.95)}),
    ("sovereign_debt", {"records": [{"curve_2s10s": 1.0}, {"curve_2s10s": -0.2, "curve_3m10y": 0}]}, {"sovereign.us.curve_2s10s": (-0.2, 1, 0.9), "sovereign.us.curve_3m10y": (0.0, -1, 0.9)}),
    ("patent_filings", {"cpc_class": "H01", "total_count": 9, "yearly_counts": {"2023": 3, "2021": 50, "2022": 2}}, {"patent.H01.total_count": (9.0, 0, 0.6), "patent.H01.yoy_growth": (0.5, 1, 0.6)}),
    ("job_postings", {"summary": {"UNRATE": {"latest_value": 4, "trend": "rising"}, "JTSJOL": {"latest_value": 9, "trend": "rising"}, "ICSA": {"trend": "rising"}}}, {"jobs.us.unemployment_rate": (4.0, 1, 0.8), "jobs.us.openings": (9.0, -1, 0.75)}),
    ("insider_filings", {"total_purchases": 0, "clusters": [{"ticker": "AB", "insider_count": 2, "total_value": 10, "conviction": 1}, {"ticker": "CD", "insider_count": 1}]}, {"insider.ab.cluster": (10.0, -1, 0.9)}),
    ("wikipedia_pageviews", {"spikes": [{"article": "A B", "z_score": 9}, {"article": "low", "z_score": 1.9}]}, {"wiki.a_b.spike_zscore": (9.0, 1, 0.9)}),
    ("power_grid", {"fuels": [{"fuel_type": "Natural Gas", "mw": 60}, {"fuel_type": "Wind", "mw": 40}], "total_mw": 100}, {"power_grid.fuel.gas_share_pct": (60.0, 1, 0.85), "power_grid.fuel.renewable_share_pct": (40.0, 0, 0.85)}),
    ("labor_disruptions", {"label": "workers", "signals": {"latest_value": 12, "trend": "NEW_ACTIVITY", "intensity_ratio": 9}}, {"strike.us.workers_involved": (12.0, 1, 0.75)}),
    ("academic_preprints", {"papers": [1, 2, 3], "count": 0, "total": None}, {"arxiv.volume": (3.0, 1, 0.5)}),
    ("market_data", {"^GSPC": [{"Close": 100}, {"Close": 97, "Volume": 5}], "note": "text"}, {"market.gspc.return": (-0.03, 1, 0.7), "market.gspc.volume": (5.0, 0, 0.5)}),
    ("gov_contracts", {"awards": [{"amount": 2, "agency": "Dept of Defense"}, {"amount_usd": 3}]}, {"gov_contract.us.award_count": (2.0, 1, 0.65), "gov_contract.us.total_value": (5.0, 1, 0.7), "gov_contract.us.defense_share": (0.5, 1, 0.75)}),
    ("satellite_activity", {"mode": "vegetation", "latest_ndvi": 0.25, "anomaly_pct": -12, "latest_health": "Dense"}, {"satellite.vegetation.ndvi_latest": (0.25, 0, 0.85), "satellite.vegetation.anomaly_pct": (-12.0, -1, 0.8), "satellite.vegetation.health_class_ordinal": (5.0, 0, 0.85)}),
    ("internet_infrastructure", {"mode": "outages", "alerts": [{"level": "critical"}, {"level": "critical", "country": "IR"}, {"level": "warning", "country": "FR"}]}, {"internet.outage.critical_count": (2.0, 1, 0.85)}),
]


@pytest.mark.parametrize("source, payload, want", HAND, ids=[h[0] for h in HAND])
def test_by_hand(spark, source, payload, want):
    have = rows(spark, source, payload)
    assert have.keys() == want.keys()
    for k, v in want.items():
        assert have[k] == pytest.approx(v), k


@pytest.mark.parametrize("payload", [None, "", "{not json", "3", "[]", "null", "{}", '{"contracts": 5}', '{"contracts": {"a": 1}}', '{"contracts": []}'])
def test_broken_payloads_give_no_rows(spark, payload):
    assert rows(spark, "cftc", payload) == {}


def test_a_broken_record_leaves_the_others(spark):
    good = {"Market_and_Exchange_Names": "GOLD", "_mm_net_pct_oi": 1}
    have = rows(spark, "cftc", {"contracts": [5, None, "x", {"_mm_net_pct_oi": None}, {"Market_and_Exchange_Names": "ODD", "_mm_net_pct_oi": [1]}, good]})
    assert have == {"cftc.gold.mm_net_pct_oi": (1.0, 1, 0.85), "cftc.odd.mm_net_pct_oi": (0.0, 0, 0.85)}


def test_every_source_survives_empty_and_foreign_payloads(spark):
    payloads = ["{}", "[]", "null", '"text"', "nonsense", None, '{"mode": 3, "signals": [], "records": {}, "clusters": 1, "awards": "x"}']
    landing = spark.createDataFrame([(s, 1.0, p) for s in evidence.RULES for p in payloads], LANDING)
    out = evidence.evidence(landing)
    assert out.where("value is null or signal_id is null or category is null").count() == 0
    assert {r.source for r in out.select("source").distinct().collect()} <= set(evidence.RULES)


def test_tables_without_rows_unknown_sources_and_clashing_columns(spark):
    empty = spark.createDataFrame([], LANDING)
    assert evidence.evidence(empty).count() == 0
    some = spark.createDataFrame([("nobody", 1.0, "{}", 1, 2, "t")], LANDING + ", p int, value int, signal_id string")
    assert evidence.evidence(some, ["nobody", "foia_requests"]).collect() == []
    assert evidence.evidence(some, ["cftc"]).columns == evidence.evidence(empty).columns == [f.split()[0] for f in evidence.SCHEMA.split(", ")]


def test_tags_ttl_and_time(spark):
    landing = spark.createDataFrame([("global_pmi", 5.5, json.dumps({"signals": {"USA": {"latest_value": 99, "mom_change": 1}}})) ], LANDING)
    got = {r.signal_id: r for r in evidence.evidence(landing, ["global_pmi"]).collect()}
    assert got["pmi.usa.cli"].tags == ["cli", "usa"] and got["pmi.usa.cli"].direction == -1
    assert got["pmi.usa.cli.mom"].tags == ["cli", "usa", "momentum"] and got["pmi.usa.cli.mom"].ts == 5.5 and got["pmi.usa.cli.mom"].ttl == 2_592_000


def test_a_callers_own_rules(spark):
    mine = {"mine": [evidence.Rule("mine.{k}", evidence.given("x", "r"), "macro_momentum", "0.5", 60, "mine", "v > 1", each=evidence.items("list"), names={"k": evidence.text("k", "r")})]}
    assert rows(spark, "mine", {"list": [{"k": "a", "x": 2}, {"x": 3}]}, rules=mine) == {"mine.a": (2.0, 1, 0.5)}


def test_no_shuffle_and_no_python(spark):
    landing = spark.createDataFrame([("gdelt", 1.0, "{}")], LANDING)
    plan = evidence.evidence(landing, ["gdelt"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
