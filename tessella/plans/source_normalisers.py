"""A query for each source's normaliser: payloads are built from the tables, landed as JSON, and normalised.

An `Entry` says how rows of a base statement become the records of one source's payload, and what the observations'
values are in terms of the base rows; the check computes the same from the base alone, without JSON.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import functions as F

from ..registry import query
from ..sources import normalise
from . import views
from .source_modes import VIEWS, run
from .views import table

FETCHED = 1_700_000_000
#: Base rows: g and b name the payload (a bounded batch of rows), k and o are names, day is a date, v, w and x are numbers, n is a whole one.
BASES = {
    "orders": "SELECT concat('', o_custkey % 7) AS g, floor(o_orderkey / 500) AS b, concat('c', o_custkey) AS k, concat('o', o_orderkey) AS o, concat('', CAST(o_orderdate AS DATE)) AS day, o_totalprice AS v, o_totalprice / 3 AS w, o_totalprice / 7 AS x, o_orderkey AS n, o_orderpriority AS kind FROM orders",
    "part": "SELECT p_brand AS g, floor(p_partkey / 500) AS b, concat('p', p_partkey) AS k, p_brand AS o, '1999-01-31' AS day, p_retailprice AS v, p_retailprice / 3 AS w, p_retailprice / 7 AS x, p_size AS n, p_type AS kind FROM part",
    "supplier": "SELECT concat('', s_nationkey) AS g, floor(s_suppkey / 500) AS b, concat('s', s_suppkey) AS k, n_name AS o, '1998-12-01' AS day, s_acctbal AS v, s_acctbal / 3 AS w, s_acctbal / 7 AS x, s_nationkey AS n, s_name AS kind FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "nation": "SELECT n_name AS g, 0 AS b, n_name AS k, r_name AS o, '1997-06-30' AS day, n_nationkey * 1.5 AS v, n_nationkey * 0.25 AS w, n_nationkey - 7.5 AS x, n_nationkey AS n, r_name AS kind FROM nation JOIN region ON n_regionkey = r_regionkey",
    "bars": "SELECT brand AS g, 0 AS b, brand AS k, concat('b', brand) AS o, concat('', d) AS day, close AS v, volume AS w, high AS x, trades AS n, 'daily' AS kind FROM bars",
    "positioning": "SELECT brand AS g, 0 AS b, brand AS k, concat('t', brand) AS o, concat('', week) AS day, oi AS v, longs AS w, shorts AS x, CAST(oi AS BIGINT) AS n, 'weekly' AS kind FROM positioning",
    "obs": "SELECT source AS g, floor(obs_id / 500) AS b, entity_id AS k, source AS o, concat('', CAST(ts AS DATE)) AS day, value AS v, value / 3 AS w, value / 7 AS x, obs_id AS n, 'point' AS kind FROM obs",
}


@dataclass(frozen=True)
class Entry:
    """record: the fields of a record by their base columns; shape: the payload around the records rs (and of g).
    key, time and value are SQL over the base; value gives of each observed field its type and the base expression."""

    source: str
    observed: str
    base: str
    record: dict[str, str]
    shape: str
    kind: str
    value: dict[str, tuple[str, str]]
    key: str = "k"
    time: str = ""
    links: tuple[tuple[str, str, str], ...] = field(default_factory=tuple)
    alone: bool = False  # a payload for each base row

    @property
    def specs(self) -> list[normalise.Spec]:
        return [s for s in normalise.SPECS if s.source == self.source and s.observation_type == self.observed and s.entity_type == self.kind][:1]


DAY, COMPACT, ISO = "day", "replace(day, '-', '')", "concat(day, 'T00:00:00Z')"
D, L, S = "double", "bigint", "string"
ENTRIES = [
    Entry("academic_preprints", "research_velocity", "orders", {"sponsor": "k", "nct_id": "o", "title": "kind", "status": "g"}, "named_struct('trials', rs)", "company", {"nct_id": (S, "o"), "title": (S, "kind"), "status": (S, "g")}),
    Entry("ais_vessel", "port_call", "orders", {"mmsi": "k", "vesselName": "k", "eta": ISO, "portToVisit": "kind", "prevPort": "g", "arrivalWithCargo": "n % 2 = 0"}, "named_struct('calls', rs)", "vessel", {"port": (S, "kind"), "prev_port": (S, "g"), "arrival_with_cargo": (S, "CASE WHEN n % 2 = 0 THEN 'true' ELSE 'false' END")}, time=DAY),
    Entry("bankruptcy_court", "bankruptcy_status", "orders", {"debtor_name": "concat(' ', k, ' ')", "chapter": "kind", "court": "g", "case_number": "o", "pub_date": DAY}, "named_struct('entries', rs)", "company", {"case_number": (S, "o"), "chapter": (S, "kind"), "pub_date": (S, DAY)}),
    Entry("capital_flows", "capital_flow", "nation", {"country_code": "k", "country": "o", "latest_value_billions": "v", "mom_change_pct": "w"}, "named_struct('holdings', rs)", "country", {"latest_value": (D, "v"), "mom_change_pct": (D, "w"), "series": (S, "o")}),
    Entry("central_bank_balance", "cb_balance_sheet", "positioning", {"country_code": "k", "code": "o", "native_trillions": "v", "usd_trillions": "w", "wow_pct": "x"}, "named_struct('banks', rs)", "country", {"cb_code": (S, "o"), "native_trillions": (D, "v"), "wow_pct": (D, "x")}),
    Entry("central_bank_balance", "cb_policy_rate", "positioning", {"country_code": "k", "code": "o", "current_rate": "v / 8", "last_change_date": DAY, "last_change_bps": "x", "days_since_change": "n"}, "named_struct('rates', rs)", "country", {"cb_code": (S, "o"), "current_rate": (D, "v / 8"), "last_change_bps": (D, "x"), "days_since_change": (L, "n")}),
    Entry("cert_transparency", "cert_issued", "orders", {"entry_timestamp": ISO, "is_expired": "n % 3 = 0", "common_name": "k", "issuer_name": "kind"}, "named_struct('domain', g, 'certs', rs)", "domain", {"common_name": (S, "k"), "issuer_name": (S, "kind")}, key="g", time=DAY),
    Entry("cftc", "futures_positioning", "positioning", {"code": "concat(k, ' ')", "market": "o", "report_date": DAY, "open_interest": "v", "mm_net": "w - x", "pm_net": "x - w", "ticker": "o"}, "named_struct('rows', rs)", "cftc_contract", {"open_interest": (D, "v"), "mm_net": (D, "w - x"), "pm_net": (D, "x - w")}, time=DAY, links=(("cftc_tracks", "instrument", "o"),)),
    Entry("comtrade", "trade_flow", "nation", {"commodity_code": "'85'", "trade_value_usd": "v", "period": DAY}, "named_struct('reporter', concat(' ', lower(g)), 'partner', rs[0].period, 'flow', 'X', 'records', rs)", "country", {"trade_value_usd": (D, "v"), "record_count": (L, "1"), "partner": (S, DAY)}, key="upper(k)"),
    Entry("consumer_sentiment", "consumer_confidence", "nation", {"geo": "substr(k, 1, 2)", "value": "v", "period": DAY, "mom_change": "w", "trend": "o", "consecutive_decline": "n"}, "named_struct('countries', rs)", "country", {"latest": (D, "v"), "mom_change": (D, "w"), "consecutive_decline": (L, "n")}, key="substr(k, 1, 2)"),
    Entry("creditor_filings", "creditor_filing", "orders", {"company": "k", "form": "CASE WHEN n % 2 = 0 THEN kind END", "file_date": DAY}, "named_struct('filings', rs)", "company", {"form": (S, "CASE WHEN n % 2 = 0 THEN kind ELSE '8-K' END"), "file_date": (S, DAY)}, time=DAY),
    Entry("defi_flows", "tvl_change", "supplier", {"name": "upper(k)", "chain": "o", "category": "kind", "tvl_usd": "v", "change_1d_pct": "w", "change_7d_pct": "x"}, "named_struct('protocols', rs)", "protocol", {"tvl_usd": (D, "v"), "chain": (S, "o"), "change_7d_pct": (D, "x")}),
    Entry("disease_surveillance", "pathogen_level", "obs", {"pathogen": "o", "total_samples": "n", "states_count": "n % 50"}, "named_struct('wastewater', rs[0])", "country", {"pathogen": (S, "o"), "total_samples": (L, "n"), "states_count": (L, "n % 50")}, key="'US'", alone=True),
    Entry("dividend_data", "dividend", "orders", {"date": DAY, "amount": "v"}, "named_struct('ticker', concat('t', g), 'dividends', rs)", "instrument", {"amount": (D, "v"), "ex_date": (S, DAY)}, key="concat('T', g)", time=DAY),
    Entry("dns_monitor", "dns_change", "supplier", {"mx_provider": "o", "ns_provider": "kind", "min_ttl": "n", "low_ttl_warning": "n < 10", "record_count": "n + 1"}, "named_struct('domain', g, 'analysis', rs[0])", "domain", {"mx_provider": (S, "o"), "min_ttl": (L, "n"), "record_count": (L, "n + 1")}, key="g", alone=True),
    Entry("drug_regulatory", "drug_approval", "orders", {"sponsor_name": "k", "application_number": "o", "latest_submission_type": "kind", "latest_submission_date": COMPACT}, "named_struct('records', rs)", "company", {"application_number": (S, "o"), "submission_type": (S, "kind")}, time=DAY, links=(("market_authorized_in", "country", "'US'"),)),
    Entry("earthquake_proximity", "earthquake", "obs", {"id": "concat('q', n)", "properties": "named_struct('mag', v, 'place', k, 'time', 1.6e12 + n * 1000.0)", "geometry": "named_struct('coordinates', array(w, x, v))"}, "named_struct('features', rs)", "earthquake", {"magnitude": (D, "v"), "lon": (D, "w"), "lat": (D, "x"), "depth": (D, "v")}, key="concat('q', n)", time="seconds:1600000000 + n"),
    Entry("electricity_monitor", "grid_demand", "nation", {"x": "n"}, "named_struct('region', g, 'region_name', concat('r', g), 'mode', 'demand')", "organization", {"region_name": (S, "concat('r', g)"), "mode": (S, "'demand'")}, key="g", alone=True),
    Entry("energy_supply", "petroleum_inventory", "bars", {"name": "k", "values": "array(named_struct('period', 'p0', 'value', w), named_struct('period', day, 'value', v))"}, "named_struct('series', rs)", "energy_series", {"latest": (D, "v"), "period": (S, DAY), "periods": (L, "2")}),
    Entry("energy_supply", "rig_count", "bars", {"period": "concat(' ', substr(day, 1, 7))", "value": "n", "units": "k"}, "named_struct('rigs', rs)", "energy_series", {"period": (S, "substr(day, 1, 7)"), "value": (D, "n"), "units": (S, "k")}, key="'rig_count'", time="substr(day, 1, 7) || '-01'"),
    Entry("finra_short_volume", "short_interest", "bars", {"symbol": "lower(k)", "settlement_date": DAY, "short_volume": "w", "total_volume": "w + x", "short_ratio": "v", "days_to_cover": "x"}, "named_struct('records', rs)", "instrument", {"short_volume": (D, "w"), "total_volume": (D, "w + x"), "short_ratio": (D, "v")}, key="upper(k)", time=DAY),
    Entry("foia_requests", "investigation_signal", "orders", {"entity": "concat(k, '  ')", "source": "'foia'", "agency": "kind", "jurisdiction": "g", "date_filed": DAY, "status": "o"}, "named_struct('records', rs)", "company", {"agency": (S, "kind"), "date_filed": (S, DAY), "status": (S, "o")}),
    Entry("food_security", "food_security", "nation", {"yoy_change_pct": "v", "trend_direction": "o", "consecutive_years": "n", "stress_alert": "n > 9"}, "named_struct('country', g, 'mode', 'production', 'indicator', 'food', 'latest_value', rs[0].yoy_change_pct * 2, 'latest_year', 2001, 'signals', rs[0])", "country", {"yoy_change_pct": (D, "v"), "consecutive_years": (L, "n"), "latest_value": (D, "v * 2")}, key="g", alone=True),
    Entry("form144", "sell_intent", "orders", {"reporter_cik": "k", "issuer_cik": "g", "insider": "k", "ticker": "kind", "shares_to_sell": "n", "dollar_value": "v", "urgency": "'high'", "filing_date": DAY}, "named_struct('filings', rs)", "person", {"shares_to_sell": (L, "n"), "dollar_value": (D, "v"), "ticker": (S, "kind")}, time=DAY, links=(("works_for", "company", "g"),)),
    Entry("global_pmi", "economic_activity", "nation", {"iso": "k", "value": "v", "period": DAY, "regime": "o", "momentum_6m": "x"}, "named_struct('mode', 'pmi', 'countries', rs)", "country", {"value": (D, "v"), "regime": (S, "o"), "momentum_6m": (D, "x")}),
    Entry("gov_contracts", "contract_award", "orders", {"recipient": "k", "award_id": "o", "amount_usd": "v", "agency": "kind", "award_type": "'A'", "country": "'US'", "date": DAY}, "named_struct('awards', rs)", "company", {"award_id": (S, "o"), "amount_usd": (D, "v"), "agency": (S, "kind")}, time=DAY, links=(("operates_in", "country", "'US'"), ("awarded_by", "organization", "kind"))),
    Entry("instrument_universe", "instrument_daily", "bars", {"ticker": "lower(k)", "date": DAY, "close": "v", "log_return": "x - v", "volume": "w"}, "named_struct('bars', rs)", "instrument", {"close": (D, "v"), "log_return": (D, "x - v"), "volume": (D, "w")}, key="upper(k)", time=DAY),
    Entry("interconnection_queue", "project_status", "part", {"entity_name": "k", "plant_name": "o", "nameplate_capacity_mw": "v", "state": "g", "status": "CASE WHEN n > 25 THEN 'planned' ELSE 'built' END", "technology": "kind"}, "named_struct('projects', rs)", "company", {"nameplate_capacity_mw": (D, "v"), "status": (S, "CASE WHEN n > 25 THEN 'planned' ELSE 'built' END"), "technology": (S, "kind")}, links=(("located_in", "country", "'US'"),)),
    Entry("internet_outages", "internet_disruption", "nation", {"anomaly_rate_pct": "v", "disconnect_rate_pct": "w", "confirmed_count": "n", "alert": "o"}, "named_struct('country', g, 'mode', 'censorship', 'test_name', 'web', 'signals', rs[0])", "country", {"anomaly_rate_pct": (D, "v"), "confirmed_count": (L, "n"), "alert": (S, "o")}, key="g", alone=True),
    Entry("lobbying", "lobbying_spend", "orders", {"registrant_name": "k", "client_name": "CASE WHEN n % 5 = 0 THEN 'Self' ELSE concat('client ', g) END", "amount": "v", "filing_year": "1997", "filing_period": "kind", "dt_posted": ISO}, "named_struct('filings', rs)", "company", {"amount": (D, "v"), "filing_period": (S, "kind")}, time=DAY, links=(("lobbies_for", "company", "CASE WHEN n % 5 = 0 THEN NULL ELSE concat('client ', g) END"),)),
    Entry("migration_flows", "migration_pressure", "nation", {"total_displaced": "v", "acceptance_rate": "w", "latest_value": "x", "trend": "o"}, "named_struct('country', g, 'mode', 'displacement', 'role', 'origin', 'year', 2000, 'signals', rs[0])", "country", {"total_displaced": (D, "v"), "latest_value": (D, "x"), "trend": (S, "o")}, key="g", alone=True),
    Entry("nightlight_activity", "zone_activity", "supplier", {"zone": "k", "total_frp": "v", "hotspots": "n", "mean_brightness": "w", "high_share": "x"}, "named_struct('zones', rs)", "zone", {"total_frp": (D, "v"), "hotspots": (L, "n"), "high_share": (D, "x")}),
    Entry("options_chain", "options_chain_eod", "bars", {"spot": "v", "atm_iv": "w", "put_call_oi": "x", "total_oi": "n * 1.0"}, "named_struct('ticker', g, 'summary', rs[0], 'observed_at', 1.5e9)", "instrument", {"spot": (D, "v"), "atm_iv": (D, "w"), "total_oi": (D, "n * 1.0")}, key="upper(g)", time="seconds:1500000000", alone=True),
    Entry("patent_filings", "patent_filing", "part", {"assignee": "concat(' ', g)", "patent_number": "k", "patent_title": "kind", "cpc_subgroup_id": "array(o, kind)", "patent_date": DAY}, "named_struct('patents', rs)", "company", {"patent_number": (S, "k"), "patent_title": (S, "kind"), "cpc_subgroup_id": (S, "o")}, key="g", time=DAY, links=(("patents_in", "country", "'US'"),)),
    Entry("political_risk", "campaign_finance", "supplier", {"candidate_id": "k", "name": "kind", "party": "g", "office": "o", "state": "o", "has_raised_funds": "v > 0", "candidate_status": "'C'"}, "named_struct('candidates', rs)", "person", {"name": (S, "kind"), "party": (S, "g"), "has_raised_funds": (S, "CASE WHEN v > 0 THEN 'true' ELSE 'false' END")}),
    Entry("polymarket", "market_probability", "part", {"condition_id": "k", "question": "kind", "yes_price": "w / 1000", "no_price": "1 - w / 1000", "volume_24h": "v", "liquidity": "x"}, "named_struct('markets', rs)", "topic", {"yes_price": (D, "w / 1000"), "no_price": (D, "1 - w / 1000"), "liquidity": (D, "x")}),
    Entry("regulatory_gazette", "regulatory_velocity", "supplier", {"key": "k", "name": "kind", "doc_count": "n", "significant_count": "n % 4"}, "named_struct('mode', 'agency', 'agencies', rs)", "organization", {"doc_count": (L, "n"), "significant_count": (L, "n % 4"), "name": (S, "kind")}),
    Entry("sanctions_monitor", "sanctions_listing", "supplier", {"source": "'ofac'", "entity_id": "k", "name": "kind", "type": "'entity'", "programs": "array(o, g)", "nationality": "o", "listed_date": DAY}, "named_struct('records', rs)", "sanctioned", {"nationality": (S, "o"), "source": (S, "'ofac'")}, key="concat('ofac:', k)", time=DAY),
    Entry("sovereign_debt", "sovereign_yield", "nation", {"country": "k", "date": DAY, "yield_pct": "v", "curve_2s10s": "x", "maturity": "'10y'"}, "named_struct('records', rs)", "country", {"yield_pct": (D, "v"), "curve_2s10s": (D, "x"), "maturity": (S, "'10y'")}, time=DAY),
    Entry("supply_chain_monitor", "price_movement", "bars", {"series_id": "k", "sector": "o", "values": "array(named_struct('period', 'p0', 'value', x), named_struct('period', 'p1', 'value', w), named_struct('period', day, 'value', v))"}, "named_struct('series', rs)", "price_series", {"latest_value": (D, "v"), "num_periods": (L, "3"), "sector": (S, "o")}),
    Entry("transport_throughput", "border_throughput", "nation", {"border_country": "k"}, "named_struct('mode', 'recent', 'period', '1999-01', 'records', rs)", "country", {"record_count": (L, "1"), "period": (S, "'1999-01'")}),
    Entry("whale_alert", "btc_transfer", "orders", {"hash": "o", "time": "1.4e9 + n", "confirmed": "true", "block_height": "n", "inputs": "array(named_struct('addr', k, 'value_btc', v), named_struct('addr', '', 'value_btc', w))", "outputs": "array(named_struct('addr', concat('out', g), 'value_btc', x))"}, "named_struct('transfers', rs)", "wallet", {"tx_hash": (S, "o"), "value_btc": (D, "v"), "counterparty_count": (L, "1"), "direction": (S, "'out'")}, time="seconds:1400000000 + n", links=(("transacts_with", "wallet", "concat('out', g)"),)),
    Entry("wikipedia_pageviews", "pageview_spike", "orders", {"article": "k", "date": COMPACT, "z_score": "v", "latest_views": "w", "mean_views": "x", "project": "kind"}, "named_struct('spikes', rs)", "topic", {"z_score": (D, "v"), "latest_views": (D, "w"), "project": (S, "kind")}, time=DAY),
]


def landed(spark, d, e: Entry):
    """The payloads of an entry's base rows."""
    base = run(spark, BASES[e.base], lambda n: getattr(views, n)(spark, d) if n in VIEWS else table(spark, d, n))
    record = F.struct(*[F.expr(x).alias(c) for c, x in e.record.items()])
    packed = base.select("g", F.array(record).alias("rs")) if e.alone else base.select("g", "b", record.alias("r")).groupBy("g", "b").agg(F.collect_list("r").alias("rs"))
    return packed.select(F.lit(e.source).alias("source"), F.lit(float(FETCHED)).alias("fetched_at"), F.to_json(F.expr(e.shape)).alias("data"))


def key_of(kind: str, key: str) -> str:
    return f"substr(sha256('{kind}:' || {key}), 1, 16)"


def seconds_of(time: str) -> str:
    if not time:
        return str(FETCHED)
    return time.removeprefix("seconds:") if time.startswith("seconds:") else f"CAST(epoch(CAST({time} AS DATE)) AS BIGINT)"


def register(e: Entry) -> None:
    def observed(spark, d):
        out = normalise.observations(landed(spark, d, e), e.specs)
        return out.select("entity_id", F.col("observed_at").cast("long").alias("observed_s"), *[F.get_json_object("value_json", f"$.{c}").cast(t).alias(c) for c, (t, _) in e.value.items()])

    observed.__name__ = f"nrm_{e.source}_{e.observed}"
    values = ", ".join(f"{x} AS {c}" for c, (_, x) in e.value.items())
    query(f"WITH b AS ({BASES[e.base]}) SELECT {key_of(e.kind, e.key)} AS entity_id, {seconds_of(e.time)} AS observed_s, {values} FROM b")(observed)
    if e.links:

        def linked(spark, d):
            return normalise.links(landed(spark, d, e), e.specs).select("entity_a", "entity_b", "link_type")

        linked.__name__ = f"nrm_{e.source}_links"
        parts = [f"SELECT {key_of(e.kind, e.key)} AS entity_a, {key_of(to, key)} AS entity_b, '{name}' AS link_type FROM b WHERE {key} IS NOT NULL" for name, to, key in e.links]
        query(f"WITH b AS ({BASES[e.base]}), x AS ({' UNION ALL '.join(parts)}) SELECT DISTINCT * FROM x WHERE entity_a <> entity_b")(linked)


for _entry in ENTRIES:
    register(_entry)
