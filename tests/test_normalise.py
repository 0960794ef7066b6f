"""Payloads of several sources to observations, entities, aliases and links."""

import hashlib
import json

import pytest

from tessella.sources import normalise as N


def key(kind, x):
    return hashlib.sha256(f"{kind}:{x}".encode()).hexdigest()[:16]


PAYLOADS = {
    "whale_alert": {"transfers": [{"hash": "h1", "time": 1000.0, "confirmed": True, "block_height": 5, "inputs": [{"addr": "a", "value_btc": 2.0}, {"addr": "", "value_btc": 1.0}], "outputs": [{"addr": "b", "value_btc": 1.5}, {"addr": "c", "value_btc": 1.4}]}]},
    "gdelt": {"events": [{"id": "1", "date": "20240102", "actor1": "US", "actor2": "CN", "event_root": "19", "goldstein": -10.0, "quad_class": 4, "num_mentions": 3, "place": "TW"}, {"id": "2", "date": "bad", "actor1": "FR", "actor2": " "}]},
    "lobbying": {"filings": [{"registrant_name": "R", "client_name": "C", "amount": 10.0, "dt_posted": "2024-01-02T03:04:05Z"}, {"registrant_name": "R", "client_name": "self"}, {"registrant_name": None, "client_name": "X"}]},
    "earthquake_proximity": {"features": [{"id": "q", "properties": {"mag": 6.1, "place": "P", "time": 5000.0}, "geometry": {"coordinates": [1.0, 2.0, 3.0]}}]},
    "comtrade": {"reporter": " usa ", "partner": "CHN", "records": [{"commodity_code": "85", "trade_value_usd": 5.0}, {"commodity_code": "01"}]},
}


@pytest.fixture(scope="module")
def landing(spark):
    rows = [(s, 77.0, json.dumps(p)) for s, p in PAYLOADS.items()] + [("lobbying", 78.0, "not json"), ("lobbying", 79.0, None), ("lobbying", 80.0, "{}"), ("other", 1.0, "{}")]
    return spark.createDataFrame(rows, "source string, fetched_at double, data string")


def test_observations(landing):
    got = N.observations(landing, N.SPECS).collect()
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
    assert sorted((r.entity_key, json.loads(r.value_json)["direction"], json.loads(r.value_json)["counterparty_count"], r.observed_at) for r in by["whale_alert"]) == [("a", "out", 2, 1000.0), ("b", "in", 2, 1000.0), ("c", "in", 2, 1000.0)]
    assert sorted((r.entity_key, json.loads(r.value_json)["role"], r.observed_at) for r in by["gdelt"]) == [("CN", "target", 1704153600.0), ("FR", "initiator", 77.0), ("US", "initiator", 1704153600.0)]
    assert sorted((r.entity_key, r.observed_at) for r in by["lobbying"]) == [("R", 77.0), ("R", 1704164645.0)]
    assert json.loads(by["earthquake_proximity"][0].value_json)["lat"] == 2.0 and by["earthquake_proximity"][0].observed_at == 5.0
    assert by["comtrade"][0].entity_key == "USA" and json.loads(by["comtrade"][0].value_json)["record_count"] == 2
    assert all(r.entity_id == key(r.entity_type, r.entity_key) for r in got) and "other" not in by


def test_entities_aliases_links(landing):
    assert {(r.entity_type, r.name) for r in N.entities(N.observations(landing, N.SPECS)).collect()} >= {("wallet", "a"), ("country", "US"), ("company", "R"), ("earthquake", "P")}
    assert {(r.alias_source, r.external_id) for r in N.aliases(landing, N.SPECS).collect()} >= {("btc_address", "a"), ("fips", "US")}
    got = {(r.entity_a, r.entity_b, r.link_type) for r in N.links(landing, N.SPECS).collect()}
    assert got == {(key("wallet", "a"), key("wallet", "b"), "transacts_with"), (key("wallet", "a"), key("wallet", "c"), "transacts_with"), (key("country", "US"), key("country", "CN"), "event_involves"), (key("company", "R"), key("company", "C"), "lobbies_for")}


@pytest.mark.parametrize("spec", [s for s in N.SPECS if s.observation_type], ids=lambda s: f"{s.source}-{s.observation_type}")
def test_every_spec_is_valid(landing, spec):
    assert N.observations(landing, [spec]).columns == N.OBSERVATION
    for k in spec.links:
        assert N.links(landing, [spec]).columns == ["entity_a", "entity_b", "link_type", "confidence"]


def land(spark, *rows):
    return spark.createDataFrame([(s, 77.0, json.dumps(p)) for s, p in rows], "source string, fetched_at double, data string")


def test_links_by_lookup_tables(spark):
    landing = land(
        spark,
        ("cert_transparency", {"domain": "api.Stripe.com", "certs": [{"common_name": "x"}, {"common_name": "y"}]}),
        ("dns_monitor", {"domain": "localhost", "analysis": {"record_count": 1}}),
        ("polymarket", {"markets": [{"condition_id": "m", "category": "fed"}, {"condition_id": "n"}, {"condition_id": "o", "category": "other"}]}),
        ("sanctions_monitor", {"records": [{"source": "ofac", "entity_id": "1", "programs": ["iran", "IRAN", "?"]}, {"source": "ofac", "entity_id": "2", "programs": None}]}),
    )
    table = lambda *rows: spark.createDataFrame(rows, "code string, target string")
    tables = {"domain_company": table(("stripe", "STRIPE"), ("localhost", "LOCAL")), "topic_instrument": table(("fed", "TLT"), ("fed", "SPY")), "program_country": table(("IRAN", "ir"))}
    got = {(r.entity_a, r.entity_b, r.link_type, r.confidence) for r in N.links(landing, N.SPECS, tables).collect()}
    assert got == {
        (key("domain", "api.Stripe.com"), key("company", "STRIPE"), "domain_owned_by", 0.8), (key("domain", "localhost"), key("company", "LOCAL"), "domain_owned_by", 0.8),
        (key("topic", "m"), key("instrument", "TLT"), "topic_relates_to_instrument", 0.7), (key("topic", "m"), key("instrument", "SPY"), "topic_relates_to_instrument", 0.7),
        (key("sanctioned", "ofac:1"), key("country", "ir"), "sanctioned_under", 0.95),
    }
    assert N.links(landing, N.SPECS).count() == 0


def test_instruments(spark):
    bars = [{"date": f"2024-01-{i:02d}", "close": float(c), "volume": v, "high": c + 1.0, "low": c - 1.0} for i, c, v in ((1, 8, 10), (2, 16, 20), (3, 8, None))]
    landing = land(spark, ("instrument_universe", {"histories": [{"ticker": "ab", "bars": [*bars, {"date": "2024-01-04"}]}, {"ticker": "one", "bars": bars[:1]}, {"ticker": "none", "bars": []}]}), ("instrument_universe", {"instruments": [{"ticker": "ab", "issuer": " Acme ", "country": "US", "quote_country": "JP"}, {"ticker": "cd", "protocol": "aave"}]}), ("energy_supply", {"rigs": [{"period": "2024-03", "value": 5.0}, {"period": " "}]}))
    got = {(r.entity_key, r.observation_type): (json.loads(r.value_json), r.observed_at) for r in N.observations(landing, N.SPECS).collect()}
    assert got.keys() == {("AB", "instrument_return"), ("AB", "instrument_volume"), ("AB", "instrument_volatility"), ("ONE", "instrument_volume"), ("rig_count", "rig_count")}
    assert got["AB", "instrument_return"][0] == pytest.approx({"log_return": -0.6931471805599453, "close": 8.0}) and got["AB", "instrument_return"][1] == 1704240000.0
    assert got["AB", "instrument_volume"][0] == {"volume": 0.0, "avg_volume_20d": 10.0}
    assert got["AB", "instrument_volatility"][0] == pytest.approx({"realized_vol_20d": 0.6931471805599453 * 252**0.5, "intraday_range": 2.0})
    assert got["rig_count", "rig_count"] == ({"mode": "rig_count", "period": "2024-03", "value": 5.0}, 1709251200.0)
    links = {(r.entity_a, r.entity_b, r.link_type) for r in N.links(landing, N.SPECS).collect()}
    assert links == {(key("instrument", "AB"), key("company", "Acme"), "tracks_issuer"), (key("instrument", "AB"), key("country", "US"), "located_in"), (key("company", "Acme"), key("country", "US"), "located_in"), (key("instrument", "AB"), key("country", "JP"), "fx_quote_country"), (key("instrument", "CD"), key("protocol", "aave"), "tracks_protocol")}


def test_links_of_targets_with_several_codes_are_distinct(spark):
    landing = land(spark, ("polymarket", {"markets": [{"condition_id": m, "category": c} for m, c in (("m", "fed"), ("m", "rates"), ("n", "rates"), ("n", "rates"), ("o", "other"))]}))
    table = spark.createDataFrame([("fed", "TLT"), ("rates", "TLT"), ("rates", "TLT"), ("fed", "SPY"), (None, "SPY"), ("rates", "GLD"), ("fed", None)], "code string, target string")
    got = sorted((r.entity_a, r.entity_b) for r in N.links(landing, N.SPECS, {"topic_instrument": table}).collect())
    assert got == sorted((key("topic", m), key("instrument", i)) for m, i in (("m", "TLT"), ("m", "SPY"), ("m", "GLD"), ("n", "TLT"), ("n", "GLD")))


def test_links_by_lookup_are_not_shuffled(spark, small):
    from tessella import catalog

    plan = catalog.QUERIES["nrm_polymarket_links"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and not plan.startswith("Aggregate")
