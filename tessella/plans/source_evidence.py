"""A query for each source's evidence: payloads are built from the tables, landed as JSON, and read by the source's rules.

A `Case` says how rows of a base statement become one payload, and which evidence rows follow, as SQL over the base rows
(`b`) or over one row a payload (`a`). That side knows neither the JSON nor the rules, so both state the signals apart.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import functions as F

from ..registry import query
from ..sources import evidence
from . import views
from .source_modes import VIEWS, run
from .source_normalisers import BASES
from .views import table

FETCHED = 1_700_000_000
#: One row a payload: number of records, sums, extremes, and how many have n divisible by 3 and by 5.
PAYLOADS = "SELECT g, b, count(*) AS c, sum(n) AS sn, max(n) AS mx, min(n) AS mn, count(CASE WHEN n % 3 = 0 THEN 1 END) AS c3, count(CASE WHEN n % 5 = 0 THEN 1 END) AS c5, arg_max(v, n) AS lastv, arg_max(x, n) AS lastx FROM b GROUP BY g, b"


@dataclass(frozen=True)
class Row:
    """signal, value, direction, confidence, category, ttl: SQL over `of`."""

    of: str
    signal: str
    value: str
    direction: str
    confidence: str
    category: str
    ttl: int
    where: str = "true"


@dataclass(frozen=True)
class Case:
    """record: a record's fields over the base; shape: the payload over g, b and its records rs, in the order of n."""

    source: str
    base: str
    record: dict[str, str]
    shape: str
    rows: tuple[Row, ...]


def sign(x: str, up: str = "> 0", down: str = "< 0") -> str:
    return f"CASE WHEN {x} {up} THEN 1 WHEN {x} {down} THEN -1 ELSE 0 END"


def above(x: str, limit: str, otherwise: int = 0) -> str:
    return f"CASE WHEN {x} > {limit} THEN 1 ELSE {otherwise} END"


BY_KEY = "map_from_arrays(transform(rs, r -> r.key), rs)"
DAY, WEEK, MONTH = 86_400, 604_800, 2_592_000
AREA, CONTRACTS, FLOWS, STRESS, POLICY = "physical_disruption", "positioning", "physical_flow", "financial_stress", "monetary_policy"
INTENT, RULING, MACRO, LIFE, WORLD, CHAIN = "behavioral_intent", "regulatory_action", "macro_momentum", "biological", "geopolitical", "supply_chain"
CASES = [
    Case("cftc", "positioning", {"Market_and_Exchange_Names": "concat(upper(k), ' - CHICAGO')", "_mm_net_pct_oi": "w - x"}, "named_struct('contracts', rs)", (Row("b", "'cftc.' || replace(lower(k), ' ', '_') || '.mm_net_pct_oi'", "w - x", sign("w - x"), "0.85", CONTRACTS, WEEK),)),
    Case("weather_alerts", "orders", {"severity": "case when n % 3 = 0 then 'Severe' when n % 5 = 0 then 'Extreme' else 'Minor' end", "market_relevant": "n % 5 = 0"}, "named_struct('alert_count', size(rs), 'count', size(rs) - 1, 'alerts', rs)", (
        Row("a", "'weather.us.alert_count'", "c", "1", "0.7", AREA, 43_200),
        Row("a", "'weather.global.fire_count_infra'", "c - 1", above("c", "1"), "0.6", AREA, 43_200),
        Row("(SELECT g, b, count(CASE WHEN n % 3 = 0 OR n % 5 = 0 THEN 1 END) AS s FROM b GROUP BY g, b)", "'weather.us.severe_alert_count'", "s", above("s", "0"), "0.75", AREA, 43_200),
        Row("a", "'weather.us.market_relevant_alerts'", "c5", "1", "0.8", AREA, 43_200, "c5 > 0"),
    )),
    Case("sanctions_monitor", "supplier", {"name": "kind", "count": "n"}, "if(cast(g as int) % 2 = 0, to_json(named_struct('days_back', 7, 'results', rs, 'count', size(rs))), to_json(named_struct('programs', rs)))", (
        Row("a", "'sanctions.global.recent_additions'", "c", "1", "0.9", RULING, DAY, "CAST(g AS INTEGER) % 2 = 0"),
        Row("a", "'sanctions.global.program_count'", "c", "0", "0.85", RULING, DAY, "CAST(g AS INTEGER) % 2 = 1"),
        Row("a", "'sanctions.global.total_entries'", "sn", "0", "0.85", RULING, DAY, "CAST(g AS INTEGER) % 2 = 1"),
    )),
    Case("ais_vessel_tracking", "supplier", {"key": "k", "n": "n"}, "named_struct('area', concat('Strait ', g), 'total_vessels', size(rs), 'type_counts', map('tanker', size(filter(rs, r -> r.n % 3 = 0))), 'strategic', map_from_arrays(transform(rs, r -> r.key), transform(rs, r -> r.n)))", (
        Row("a", "'ais.strait_' || g || '.vessel_count'", "c", "0", "0.7", FLOWS, DAY),
        Row("a", "'ais.strait_' || g || '.tanker_ratio'", "c3 / c", "0", "0.65", FLOWS, DAY),
        Row("b", "'ais.destination.' || k", "n", "0", "0.6", FLOWS, DAY),
    )),
    Case("finra_short_volume", "orders", {"short_ratio": "n % 64 / 64D"}, "if(cast(g as int) % 2 = 0, to_json(named_struct('results', rs, 'total_tickers', size(rs))), to_json(named_struct('ticker', concat('T', g), 'signals', named_struct('latest_ratio', rs[0].short_ratio, 'is_anomaly', size(rs) % 2 = 0, 'days_to_cover', size(rs) / 4, 'squeeze_risk', 'low'))))", (
        Row("(SELECT g, b, avg(n % 64) / 64 AS s FROM b GROUP BY g, b)", "'finra.market.avg_short_ratio'", "s", above("s", "0.5", -1), "0.7", CONTRACTS, DAY, "CAST(g AS INTEGER) % 2 = 0"),
        Row("a", "'finra.t' || g || '.short_ratio'", "mn % 64 / 64", above("mn % 64 / 64", "0.5", -1), "CASE WHEN c % 2 = 0 THEN 0.8 ELSE 0.6 END", CONTRACTS, DAY, "CAST(g AS INTEGER) % 2 = 1"),
        Row("a", "'finra.t' || g || '.days_to_cover'", "c / 4", above("c", "20"), "0.75", CONTRACTS, 14 * DAY, "CAST(g AS INTEGER) % 2 = 1"),
    )),
    Case("disease_surveillance", "orders", {"detections": "n % 3"}, "named_struct('pathogen', concat('SARS-', g, ' x'), 'summaries', rs, 'total_samples', 4 * size(rs), 'hot_states', size(rs) % 11, 'entries', rs)", (
        Row("(SELECT g, b, count(*) AS c, sum(n % 3) AS s FROM b GROUP BY g, b)", "'disease.sars_' || g || '_x.detection_rate'", "s / (4 * c)", above("s / (4 * c)", "0.3"), "0.8", LIFE, WEEK),
        Row("a", "'disease.sars_' || g || '_x.hot_states'", "c % 11", above("c % 11", "5"), "0.75", LIFE, WEEK),
        Row("a", "'disease.who.outbreak_count'", "c", above("c", "3"), "0.7", LIFE, WEEK),
    )),
    Case("earthquake_proximity", "part", {"magnitude": "n / 8D"}, "if(b % 2 = 0, to_json(named_struct('quakes', rs, 'zone', named_struct('name', g, 'sector', 'oil'))), to_json(named_struct('quakes', rs, 'near_infrastructure', size(rs) - 1)))", (
        Row("a", "'earthquake.' || replace(lower(g), ' ', '_') || '.count'", "c", "CASE WHEN mx >= 32 THEN 1 ELSE 0 END", "0.9", AREA, DAY, "b % 2 = 0"),
        Row("a", "'earthquake.' || replace(lower(g), ' ', '_') || '.max_magnitude'", "mx / 8", "CASE WHEN mx >= 40 THEN 1 ELSE 0 END", "0.95", AREA, DAY, "b % 2 = 0"),
        Row("a", "'earthquake.global.count'", "c", above("c", "5"), "0.9", AREA, DAY, "b % 2 = 1"),
        Row("a", "'earthquake.global.max_magnitude'", "mx / 8", "CASE WHEN mx >= 48 THEN 1 ELSE 0 END", "0.95", AREA, DAY, "b % 2 = 1"),
        Row("a", "'earthquake.global.near_infrastructure'", "c - 1", "1", "0.9", AREA, DAY, "b % 2 = 1 AND c > 1"),
    )),
    Case("global_pmi", "supplier", {"key": "if(n % 3 = 0, concat('_', k), upper(k))", "latest_value": "n * 5", "mom_change": "n % 5 - 2", "regime": "o"}, f"named_struct('mode', 'cli', 'signals', {BY_KEY})", (
        Row("b", "'pmi.' || k || '.cli'", "n * 5", sign("n * 5", "> 100", "< 100"), "0.8", MACRO, MONTH, "n % 3 <> 0"),
        Row("b", "'pmi.' || k || '.cli.mom'", "n % 5 - 2", sign("n % 5 - 2"), "0.75", MACRO, MONTH, "n % 3 <> 0 AND n % 5 <> 2"),
    )),
    Case("treasury_receipts", "nation", {"tga_daily_change_pct": "x", "net_flow_today": "x * 2", "total_deposits_today": "if(n % 3 = 0, null, n)"}, "named_struct('mode', 'dts', 'signals', rs[0])", (
        Row("b", "'treasury.tga.daily_change_pct'", "x", sign("x", "< 0", "> 0"), "0.85", MACRO, DAY),
        Row("b", "'treasury.us.net_flow_today'", "x * 2", sign("x"), "0.8", MACRO, DAY),
        Row("b", "'treasury.us.deposits_today'", "n", "0", "0.8", MACRO, DAY, "n % 3 <> 0"),
    )),
    Case("job_postings", "nation", {"latest_value": "v", "trend": "case when n % 3 = 0 then 'rising' when n % 3 = 1 then 'falling' else 'flat' end"}, "named_struct('summary', named_struct('JTSJOL', rs[0], 'UNRATE', rs[0], 'XYZ', rs[0]))", (
        Row("b", "'jobs.us.openings'", "v", sign("n % 3", "= 1", "= 0"), "0.75", INTENT, MONTH),
        Row("b", "'jobs.us.unemployment_rate'", "v", sign("n % 3", "= 0", "= 1"), "0.8", MACRO, MONTH),
    )),
    Case("transport_throughput", "orders", {"total": "n", "ratio": "n / 4D"}, "named_struct('records', rs, 'comparison', rs, 'series', array(named_struct('total', 8 * size(rs)), named_struct('total', 7 * size(rs) + 9)))", (
        Row("a", "'transport.us.border_total'", "sn", "0", "0.7", FLOWS, WEEK),
        Row("a", "'transport.us.canada_mexico_ratio'", "mx / 4", "0", "0.6", FLOWS, WEEK),
        Row("a", "'transport.us.volume_change'", "(9 - c) / (8 * c)", sign("(9 - c) / (8 * c)", "> 0.05", "< -0.05"), "0.65", FLOWS, WEEK),
    )),
    Case("capital_flows", "supplier", {"country": "concat(o, ' ', k)", "mom_change_pct": "n - 12", "flow_reversal": "n % 3 = 0", "key": "k", "latest_value": "n"}, "named_struct('holdings', rs, 'flows', rs, 'stress_alerts', rs, 'coordination', named_struct('coordinated_selling', size(rs) % 2 = 0, 'coordinated_buying', size(rs) % 2 = 1, 'sellers', rs, 'buyers', slice(rs, 1, 1)))", (
        Row("a", "'capital_flows.ust.coordinated_selling'", "c", "1", "0.85", POLICY, MONTH, "c % 2 = 0"),
        Row("a", "'capital_flows.ust.coordinated_buying'", "1", "-1", "0.85", POLICY, MONTH, "c % 2 = 1"),
        Row("b", "'capital_flows.' || left(replace(lower(o || ' ' || k), ' ', '_'), 20) || '.holdings_mom_pct'", "n - 12", sign("n - 12", "< -3", "> 3"), "0.7", POLICY, MONTH),
        Row("b", "'capital_flows.' || k || '.reversal'", "n", "1", "0.8", POLICY, MONTH, "n % 3 = 0"),
        Row("a", "'capital_flows.reserves.stress_count'", "c", "1", "0.85", POLICY, MONTH),
    )),
    Case("sovereign_debt", "orders", {"curve_2s10s": "x - 5000", "country": "if(n % 3 = 0, '', k)", "spread_vs_de": "n % 400"}, "named_struct('records', rs, 'spreads', rs, 'us_curve', named_struct('curve_3m10y', size(rs) - 40))", (
        Row("a", "'sovereign.us.curve_2s10s'", "lastx - 5000", "CASE WHEN lastx < 5000 THEN 1 ELSE -1 END", "0.9", STRESS, DAY),
        Row("b", "'sovereign.' || k || '.spread_vs_de'", "n % 400", above("n % 400", "200"), "0.8", STRESS, DAY, "n % 3 <> 0"),
        Row("a", "'sovereign.us.curve_3m10y'", "c - 40", "CASE WHEN c < 40 THEN 1 ELSE -1 END", "0.9", STRESS, DAY),
    )),
    Case("creditor_filings", "orders", {"company": "k"}, "named_struct('sec_count', size(rs), 'red_flags', size(rs) % 2, 'ch_red_flags', size(rs) % 3, 'clusters', rs)", (
        Row("a", "'creditor.sec.filing_count'", "c", above("c", "5"), "0.7", STRESS, DAY),
        Row("a", "'creditor.uk.red_flags'", "CASE WHEN c % 2 = 1 THEN 1 ELSE c % 3 END", "CASE WHEN c % 2 = 1 OR c % 3 > 0 THEN 1 ELSE 0 END", "0.75", STRESS, DAY),
        Row("a", "'creditor.sec.cluster_count'", "c", above("c", "3"), "0.8", STRESS, DAY),
    )),
    Case("bankruptcy_court", "orders", {"debtor": "k"}, "named_struct('mode', if(cast(g as int) % 2 = 0, 'sec_enforcement', ''), 'count', size(rs), 'type_breakdown', map('x', 1), 'chapter_breakdown', map('7', 1, if(cast(g as int) % 2 = 0, '11', 'Chapter 11'), size(rs)))", (
        Row("a", "'bankruptcy.' || CASE WHEN CAST(g AS INTEGER) % 2 = 0 THEN 'sec_enforcement' ELSE 'us' END || '.filing_count'", "c", above("c", "10"), "0.75", STRESS, DAY),
        Row("a", "'bankruptcy.us.chapter_11'", "c", "1", "0.8", STRESS, DAY),
        Row("a", "'bankruptcy.sec.enforcement_count'", "c", above("c", "3"), "0.8", STRESS, DAY, "CAST(g AS INTEGER) % 2 = 0"),
    )),
    Case("liquidity_regime", "nation", {"current_regime": "case when n % 3 = 0 then 'contraction' when n % 3 = 1 then 'expansion' else 'neutral' end", "current_state": "n % 3", "composite_zscore": "x / 4", "n_changepoints": "n"}, "rs[0]", (
        Row("b", "'liquidity.us.regime'", "n % 3", sign("n % 3", "= 0", "= 1"), "0.85", STRESS, WEEK),
        Row("b", "'liquidity.us.composite_zscore'", "x / 4", sign("x / 4", "< -1.5", "> 1.5"), "0.85", STRESS, WEEK),
        Row("b", "'liquidity.us.changepoint_count'", "n", "0", "0.7", STRESS, WEEK),
    )),
    Case("central_bank_balance", "supplier", {"code": "upper(k)", "wow_pct": "if(n % 3 = 0, null, n / 4D - 3)"}, "named_struct('banks', rs, 'net_usd', size(rs), 'synchronized', size(rs) % 2 = 0, 'divergences', rs)", (
        Row("b", "'cb.' || k || '.balance_wow_pct'", "n / 4 - 3", sign("n / 4 - 3", "< -0.5", "> 0.5"), "0.8", POLICY, WEEK, "n % 3 <> 0"),
        Row("a", "'cb.us.net_liquidity_usd'", "c", "0", "0.85", POLICY, WEEK),
        Row("a", "'cb.global.policy_synchronized'", "1 - c % 2", "0", "0.75", POLICY, MONTH),
        Row("a", "'cb.global.divergence_count'", "c", "CASE WHEN c >= 3 THEN 1 ELSE 0 END", "0.7", POLICY, MONTH),
    )),
    Case("drug_regulatory", "orders", {"has_boxed_warning": "n % 3 = 0"}, "named_struct('mode', element_at(array('approvals', 'adverse_events', 'labels'), 1 + cast(g as int) % 3), 'total', size(rs), 'results', rs, 'signals', named_struct('seriousness_ratio', size(rs) % 8 / 8D, 'serious_count', size(rs)))", (
        Row("a", "'fda.approvals.count'", "c", "0", "0.7", RULING, DAY, "CAST(g AS INTEGER) % 3 = 0"),
        Row("a", "'fda.adverse_events.seriousness_ratio'", "c % 8 / 8", above("c % 8", "4"), "0.75", RULING, DAY, "CAST(g AS INTEGER) % 3 = 1"),
        Row("a", "'fda.adverse_events.serious_count'", "c", above("c", "10"), "0.7", RULING, DAY, "CAST(g AS INTEGER) % 3 = 1"),
        Row("a", "'fda.labels.boxed_warning_count'", "c3", "1", "0.8", RULING, WEEK, "CAST(g AS INTEGER) % 3 = 2 AND c3 > 0"),
    )),
    Case("regulatory_gazette", "orders", {"significant": "n % 5 = 0"}, "named_struct('documents', rs, 'count', if(b % 2 = 0, null, 1000))", (
        Row("a", "'regulatory.us.document_count'", "CASE WHEN b % 2 = 0 THEN c ELSE 1000 END", "0", "0.65", RULING, DAY),
        Row("a", "'regulatory.us.significant_count'", "c5", "1", "0.8", RULING, DAY, "c5 > 0"),
    )),
    Case("building_permits", "supplier", {"key": "upper(k)", "mom_pct": "if(n % 5 = 0, null, n - 12)", "consecutive_declines": "n % 5"}, f"named_struct('summary', {BY_KEY})", (
        Row("b", "'permits.us.' || k || '.mom_pct'", "n - 12", sign("n - 12", "< -5", "> 5"), "0.7", MACRO, MONTH, "n % 5 <> 0"),
        Row("b", "'permits.us.' || k || '.consecutive_declines'", "n % 5", "1", "0.8", MACRO, MONTH, "n % 5 >= 3"),
    )),
    Case("patent_filings", "part", {"n": "n"}, "named_struct('mode', if(b % 2 = 0, 'search', 'trend'), 'cpc_class', g, 'total_count', size(rs), 'yearly_counts', map('2021', 4, '2023', size(rs), '2022', 16), 'signal_classes', map('a', 1, 'b', 2))", (
        Row("a", "'patent.' || g || '.total_count'", "c", "0", "0.6", INTENT, MONTH),
        Row("a", "'patent.' || g || '.yoy_growth'", "(c - 16) / 16", sign("(c - 16) / 16", "> 0.2", "< -0.2"), "0.6", INTENT, MONTH),
        Row("a", "'patent.signal_classes.count'", "2", "0", "0.5", INTENT, MONTH),
        Row("a", "'patent.search.total_count'", "c", "0", "0.5", INTENT, WEEK, "b % 2 = 0"),
    )),
    Case("lobbying", "orders", {"n": "n"}, "named_struct('mode', if(b % 2 = 0, 'search', 'spend'), 'target', concat('Acme ', g), 'total_count', size(rs), 'anomaly', named_struct('anomaly', size(rs) % 2 = 0, 'ratio', size(rs) / 4))", (
        Row("a", "'lobbying.acme_' || g || '.spend_anomaly'", "c / 4", "1 - c % 2", "CASE WHEN c % 2 = 0 THEN 0.7 ELSE 0.4 END", INTENT, MONTH),
        Row("a", "'lobbying.us.filing_count'", "c", "0", "0.5", INTENT, MONTH, "b % 2 = 0"),
    )),
    Case("wikipedia_pageviews", "orders", {"article": "concat('The ', k)", "z_score": "n % 9"}, "named_struct('spikes', rs, 'article', concat('On ', g), 'stats', named_struct('mean', 8, 'std', 4, 'max', size(rs)))", (
        Row("b", "'wiki.the_' || k || '.spike_zscore'", "n % 9", "1", "least(CAST(0.3 AS DOUBLE) + (n % 9) * CAST(0.1 AS DOUBLE), CAST(0.9 AS DOUBLE))", INTENT, DAY, "n % 9 >= 2"),
        Row("a", "'wiki.on_' || g || '.views_zscore'", "(c - 8) / 4", sign("c - 8"), "0.5", INTENT, DAY, "abs((c - 8) / 4) > 2"),
    )),
    Case("cert_transparency", "orders", {"common_name": "k"}, "named_struct('domain', concat(g, '.example.org'), 'count', size(rs), 'active', size(rs), 'expired', if(b % 2 = 0, 3, null), 'subdomains', rs)", (
        Row("a", "'cert.' || g || '_example_org.count'", "c", "0", "0.5", INTENT, DAY),
        Row("a", "'cert.' || g || '_example_org.active_ratio'", "c / (c + 3)", "0", "0.4", INTENT, DAY, "b % 2 = 0"),
        Row("a", "'cert.' || g || '_example_org.subdomain_count'", "c", "0", "0.4", INTENT, DAY),
    )),
    Case("dns_monitor", "orders", {"record": "k"}, "named_struct('domain', concat(g, '.example.org'), 'changes', rs, 'total_records', size(rs), 'domain_count', if(b % 2 = 0, 1, null))", (
        Row("a", "'dns.' || g || '_example_org.change_count'", "c", "1", "0.6", INTENT, DAY),
        Row("a", "'dns.bulk.total_records'", "c", "0", "0.4", INTENT, DAY, "b % 2 = 0"),
    )),
    Case("polymarket", "orders", {"slug": "if(n % 2 = 0, concat('Will-', o), '')", "question": "concat('Is it ', o)", "yes_price": "(n % 101) / 128D", "volume_24h": "n % 7 * 512", "price_change_24h": "(n % 5 - 2) / 8D"}, "named_struct('markets', rs)", (
        Row("b", "'polymarket.' || CASE WHEN n % 2 = 0 THEN 'will_' ELSE 'is_it_' END || o || '.probability'", "n % 101 / 128", above("n % 101 / 128", "0.85", -1), "CAST(0.5 AS DOUBLE) + n % 7 * 512 / CAST(100000 AS DOUBLE)", CONTRACTS, 43_200, "n % 7 >= 2 AND n % 101 > 0 AND (n % 101 / 128 > 0.85 OR n % 101 / 128 < 0.15)"),
        Row("b", "'polymarket.' || CASE WHEN n % 2 = 0 THEN 'will_' ELSE 'is_it_' END || o || '.price_change_24h'", "(n % 5 - 2) / 8", sign("n % 5 - 2"), "CAST(0.4 AS DOUBLE) + n % 7 * 512 / CAST(100000 AS DOUBLE)", CONTRACTS, 43_200, "n % 7 >= 2 AND n % 101 > 0 AND n % 5 <> 2"),
    )),
    Case("polymarket_whales", "orders", {"composite": "n % 3", "total_usdc": "n"}, "named_struct('wallets', rs, 'whales', rs)", (
        Row("(SELECT g, b, sum(n % 3) AS s, count(CASE WHEN n % 3 > 0 THEN 1 END) AS p FROM b GROUP BY g, b)", "'polymarket_whales.avg_composite'", "s / p", "0", "0.6", CONTRACTS, DAY, "p > 0"),
        Row("a", "'polymarket_whales.market_concentration'", "sn", "0", "0.55", CONTRACTS, DAY),
    )),
    Case("insider_filings", "orders", {"ticker": "if(n % 5 = 0, '', upper(k))", "insider_count": "n % 4", "total_value": "v", "conviction": "n % 3 / 4D"}, "named_struct('total_purchases', size(rs), 'clusters', rs)", (
        Row("a", "'insider.market.purchase_count'", "c", "-1", "0.8", CONTRACTS, WEEK),
        Row("b", "'insider.' || k || '.cluster'", "v", "-1", "CASE WHEN n % 3 = 0 THEN 0.7 ELSE CAST(0.5 AS DOUBLE) + n % 3 / CAST(4 AS DOUBLE) * CAST(0.4 AS DOUBLE) END", CONTRACTS, WEEK, "n % 5 <> 0 AND n % 4 >= 2"),
    )),
    Case("form144", "orders", {"ticker": "upper(k)", "urgency": "n % 3", "total_value": "v", "pct_of_outstanding": "n % 5 / 2D"}, "named_struct('total_filings', size(rs), 'clusters', rs)", (
        Row("a", "'form144.market.filing_count'", "c", "1", "0.7", CONTRACTS, WEEK),
        Row("b", "'form144.' || k || '.sell_cluster'", "v", "1", "CASE n % 3 WHEN 0 THEN 0.6 WHEN 1 THEN 0.8 ELSE 0.9 END", CONTRACTS, WEEK),
        Row("b", "'form144.' || k || '.pct_outstanding'", "n % 5 / 2", "1", "0.8", CONTRACTS, WEEK, "n % 5 > 2"),
    )),
    Case("gdelt", "orders", {"goldstein": "if(n % 3 = 0, null, n % 21 - 10)", "quad_label": "if(n % 5 = 0, 'Material Conflict', 'Verbal Cooperation')"}, "named_struct('events', rs, 'summary', named_struct('total_mentions', 0, 'num_mentions', size(rs)))", (
        Row("(SELECT g, b, sum(n % 21 - 10) AS s, count(*) AS p FROM b WHERE n % 3 <> 0 GROUP BY g, b)", "'gdelt.global.avg_goldstein'", "s / p", sign("s / p", "< -3", "> 3"), "0.6", WORLD, DAY),
        Row("a", "'gdelt.global.event_count'", "c", "0", "0.5", WORLD, DAY, "c > c3"),
        Row("a", "'gdelt.global.material_conflict_ratio'", "c5 / c", above("c5 / c", "0.3"), "0.65", WORLD, DAY),
        Row("a", "'gdelt.global.total_mentions'", "c", "0", "0.5", WORLD, DAY),
    )),
    Case("whale_alert", "orders", {"hash": "o"}, "named_struct('transactions', rs, 'summary', named_struct('total_value', size(rs) % 3))", (
        Row("a", "'crypto.btc.large_tx_count'", "c", "0", "0.6", STRESS, 43_200),
        Row("a", "'crypto.btc.whale_volume'", "c % 3", "0", "0.55", STRESS, 43_200, "c % 3 > 0"),
    )),
    Case("comtrade", "part", {"trade_value_usd": "n"}, "named_struct('reporter', if(b % 2 = 0, g, ''), 'partner', 'World X', 'flow', 'X', 'records', rs, 'commodity_code', if(b % 3 = 0, 85, null))", (
        Row("a", "'comtrade.' || CASE WHEN b % 2 = 0 THEN left(replace(lower(g || '_World X'), ' ', '_'), 30) ELSE 'global' END || '.X_value_usd'", "sn", "0", "0.6", CHAIN, MONTH),
        Row("a", "'comtrade.85.trade_volume'", "sn", "0", "0.6", CHAIN, MONTH, "b % 3 = 0"),
    )),
    Case("energy_supply", "supplier", {"key": "upper(k)", "wow_change": "n % 3", "change": "n - 12", "latest_value": "v"}, f"named_struct('signals', {BY_KEY}, 'count', size(rs), 'records', rs)", (
        Row("b", "'energy.' || k || '.level'", "v", "0", "0.75", FLOWS, WEEK),
        Row("b", "'energy.' || k || '.wow_change'", "CASE WHEN n % 3 = 0 THEN n - 12 ELSE n % 3 END", sign("(CASE WHEN n % 3 = 0 THEN n - 12 ELSE n % 3 END)", "< 0", "> 0"), "0.75", FLOWS, WEEK),
        Row("a", "'energy.rig_count.total'", "c", "0", "0.7", FLOWS, MONTH),
    )),
    Case("supply_chain_prices", "supplier", {"key": "upper(k)", "mom_pct": "n / 8D - 1"}, f"named_struct('mode', 'producer', 'signals', {BY_KEY}, 'pressure', named_struct('pressure_score', size(rs) % 8 / 8D))", (
        Row("b", "'supply_chain.' || k || '.mom_pct'", "n / 8 - 1", sign("n / 8 - 1", "> 0.5", "< -0.5"), "0.7", CHAIN, MONTH),
        Row("a", "'supply_chain.pressure_index'", "c % 8 / 8", sign("c % 8 / 8", "> 0.6", "< 0.3"), "0.75", CHAIN, MONTH),
    )),
    Case("macro_data", "supplier", {"key": "concat('FRED:', upper(k), '/M')", "v": "v"}, "map_from_arrays(transform(rs, r -> r.key), transform(rs, r -> array(named_struct('date', 'd0', 'value', 0), named_struct('date', 'd1', 'value', r.v))))", (Row("b", "'macro.fred_' || k || '_m.latest'", "v", "0", "0.6", MACRO, MONTH),)),
    Case("market_data", "supplier", {"key": "concat('^', upper(k), '=X')", "n": "n"}, "map_from_arrays(transform(rs, r -> r.key), transform(rs, r -> array(named_struct('Close', 16, 'Volume', 1), named_struct('Close', 4 + r.n, 'Volume', 100 * r.n))))", (
        Row("b", "'market.' || k || 'x.return'", "(n - 12) / 16", sign("(n - 12) / 16", "< -0.02", "> 0.02"), "0.7", CONTRACTS, DAY),
        Row("b", "'market.' || k || 'x.volume'", "100 * n", "0", "0.5", CONTRACTS, DAY),
    )),
    Case("satellite_activity", "orders", {"n": "n"}, "named_struct('mode', element_at(array('fire', 'vegetation', 'events'), 1 + cast(g as int) % 3), 'hotspot_count', size(rs), 'frp_total', 100 * size(rs), 'frp_max', 10 * size(rs), 'cluster_count', size(rs) % 9, 'observation_count', size(rs), 'latest_ndvi', size(rs) % 4 / 4D, 'anomaly_pct', 20 - size(rs), 'latest_health', 'Healthy', 'event_count', size(rs), 'category_counts', named_struct('wildfires', size(rs) % 8))", (
        *[Row("a", f"'satellite.fire.{k}'", x, above(x, lim), conf, AREA, 21_600, "CAST(g AS INTEGER) % 3 = 0") for k, x, lim, conf in (("hotspot_count", "c", "100", "0.8"), ("frp_total", "100 * c", "1000", "0.75"), ("frp_max", "10 * c", "100", "0.7"), ("cluster_count", "c % 9", "5", "0.75"))],
        Row("a", "'satellite.vegetation.ndvi_latest'", "c % 4 / 4", "0", "0.85", CHAIN, WEEK, "CAST(g AS INTEGER) % 3 = 1"),
        Row("a", "'satellite.vegetation.anomaly_pct'", "20 - c", sign("20 - c", "> 10", "< -10"), "0.8", CHAIN, WEEK, "CAST(g AS INTEGER) % 3 = 1"),
        Row("a", "'satellite.vegetation.health_class_ordinal'", "4", "0", "0.85", CHAIN, WEEK, "CAST(g AS INTEGER) % 3 = 1"),
        *[Row("a", f"'satellite.events.{k}'", x, above(x, lim), "0.8", AREA, 43_200, "CAST(g AS INTEGER) % 3 = 2") for k, x, lim in (("active_count", "c", "20"), ("wildfire_count", "c % 8", "5"), ("severe_storm_count", "0", "3"))],
    )),
    Case("internet_infrastructure", "orders", {"level": "if(n % 3 = 0, 'critical', 'warning')", "country": "concat('c', n % 5)", "score": "n % 64", "confirmed": "n % 2", "countries": "array(concat('c', n % 5), 'zz')"}, "named_struct('mode', element_at(array('outages', 'censorship', 'signals', 'incidents'), 1 + cast(g as int) % 4), 'alerts', rs, 'events', rs, 'rows', rs, 'incidents', rs, 'drops', rs, 'avg_rate', size(rs) % 4 / 16D, 'trend', if(size(rs) % 2 = 0, 'rising', 'falling'), 'current', size(rs) / 4, 'severity', if(size(rs) % 2 = 0, 'critical', 'normal'))", (
        Row("(SELECT g, b, count(DISTINCT CASE WHEN n % 3 = 0 THEN n % 5 END) AS s FROM b GROUP BY g, b)", "'internet.outage.critical_count'", "s", above("s", "0"), "0.85", AREA, 3_600, "CAST(g AS INTEGER) % 4 = 0"),
        Row("(SELECT g, b, max(n % 64) AS s FROM b GROUP BY g, b)", "'internet.outage.event_max_score'", "s", above("s", "50"), "0.8", AREA, 3_600, "CAST(g AS INTEGER) % 4 = 0"),
        Row("(SELECT g, b, count(DISTINCT n % 5) AS s FROM b GROUP BY g, b)", "'internet.outage.event_breadth'", "s", above("s", "2"), "0.8", AREA, 3_600, "CAST(g AS INTEGER) % 4 = 0"),
        Row("a", "'internet.censorship.anomaly_rate'", "c % 4 / 16", above("c % 4 / 16", "0.1"), "0.75", WORLD, DAY, "CAST(g AS INTEGER) % 4 = 1"),
        Row("a", "'internet.censorship.trend_rising'", "1 - c % 2", "CASE WHEN c % 2 = 0 THEN 1 ELSE -1 END", "0.7", WORLD, DAY, "CAST(g AS INTEGER) % 4 = 1"),
        Row("(SELECT g, b, sum(n % 2) AS s FROM b GROUP BY g, b)", "'internet.censorship.confirmed_total'", "s", above("s", "0"), "0.8", WORLD, DAY, "CAST(g AS INTEGER) % 4 = 1"),
        Row("a", "'internet.signals.connectivity_level'", "c / 4", "CASE WHEN c % 2 = 0 THEN -1 ELSE 0 END", "0.85", AREA, 1_800, "CAST(g AS INTEGER) % 4 = 2"),
        Row("a", "'internet.signals.drop_count'", "c", above("c", "3"), "0.8", AREA, 1_800, "CAST(g AS INTEGER) % 4 = 2"),
        Row("a", "'internet.incidents.active_count'", "c", above("c", "3"), "0.75", WORLD, 3_600, "CAST(g AS INTEGER) % 4 = 3"),
        Row("(SELECT g, b, 1 + count(DISTINCT n % 5) AS s FROM b GROUP BY g, b)", "'internet.incidents.country_breadth'", "s", above("s", "5"), "0.75", WORLD, 3_600, "CAST(g AS INTEGER) % 4 = 3"),
    )),
    Case("consumer_sentiment", "supplier", {"key": "upper(k)", "latest": "v", "mom_change": "if(n % 3 = 0, null, n - 12)"}, f"named_struct('mode', element_at(array('eu_confidence', 'us_sentiment', 'inflation_reality'), 1 + cast(g as int) % 3), 'signals', named_struct('countries', {BY_KEY}, 'synchronized_decline', size(rs) % 2 = 0, 'sentiment_latest', 12 * size(rs), 'inflation_exp_latest', size(rs), 'cpi_mom_change', size(rs) % 2, 'expectations_gap', size(rs) - 4))", (
        Row("b", "'consumer_sentiment.eu.' || k", "v", "CASE WHEN n % 3 = 0 THEN 0 ELSE sign(n - 12) END", "0.8", MACRO, MONTH, "CAST(g AS INTEGER) % 3 = 0"),
        Row("a", "'consumer_sentiment.eu.synchronized_decline'", "1", "-1", "0.9", MACRO, MONTH, "CAST(g AS INTEGER) % 3 = 0 AND c % 2 = 0"),
        Row("a", "'consumer_sentiment.us.headline'", "12 * c", sign("12 * c", ">= 70", "<= 50"), "0.85", MACRO, MONTH, "CAST(g AS INTEGER) % 3 = 1"),
        Row("a", "'consumer_sentiment.us.inflation_expectations'", "c", above("c", "3", -1), "0.8", MACRO, MONTH, "CAST(g AS INTEGER) % 3 = 1"),
        Row("a", "'consumer_sentiment.cpi.mom'", "c % 2", "c % 2", "0.9", MACRO, MONTH, "CAST(g AS INTEGER) % 3 = 2"),
        Row("a", "'consumer_sentiment.expectations_gap'", "c - 4", above("c", "4", -1), "0.75", MACRO, MONTH, "CAST(g AS INTEGER) % 3 = 2"),
    )),
    Case("food_security", "orders", {"value": "if(n % 5 = 0, null, n)"}, "named_struct('country', concat('C', g), 'indicator', if(b % 2 = 0, 'AG.PRD.FOOD.XD', 'SN.ITK'), 'records', rs, 'signals', named_struct('trend_direction', if(size(rs) % 2 = 0, 'up', 'down'), 'stress_alert', size(rs) % 3 = 0))", (
        Row("(SELECT g, b, count(*) AS c, max(CASE WHEN n % 5 <> 0 THEN n END) AS s FROM b GROUP BY g, b)", "'food_security.c' || g || CASE WHEN b % 2 = 0 THEN '.production.food' ELSE '.sn_itk' END", "s", "CASE WHEN c % 2 = 0 THEN 1 ELSE -1 END", "CASE WHEN c % 3 = 0 THEN 0.9 ELSE 0.8 END", LIFE, MONTH, "s IS NOT NULL"),
        Row("a", "'food_security.c' || g || '.stress'", "1", "-1", "0.9", LIFE, MONTH, "c % 3 = 0 AND c > c5"),
    )),
    Case("political_risk", "orders", {"candidate": "concat('Doe, ', k)", "total_spent": "n"}, "named_struct('result_type', element_at(array('expenditures', 'filings', 'candidates'), 1 + cast(g as int) % 3), 'records', rs, 'signals', named_struct('support_total', size(rs), 'oppose_total', 3, 'oppose_ratio', size(rs) % 4 / 4D, 'top_targets', rs, 'avg_cash_on_hand', size(rs), 'active_fundraisers', size(rs) % 9))", (
        Row("a", "'political_risk.ie_total_spend'", "c + 3", "1", "0.8", WORLD, WEEK, "CAST(g AS INTEGER) % 3 = 0"),
        Row("a", "'political_risk.oppose_ratio'", "c % 4 / 4", above("c % 4", "2", -1), "0.75", WORLD, WEEK, "CAST(g AS INTEGER) % 3 = 0 AND c % 4 > 0"),
        Row("(SELECT g, b, k, n, row_number() OVER (PARTITION BY g, b ORDER BY n) AS i FROM b)", "'political_risk.target.doe_' || k", "n", "1", "0.7", WORLD, WEEK, "CAST(g AS INTEGER) % 3 = 0 AND i <= 3 AND n > 0"),
        Row("a", "'political_risk.avg_cash_on_hand'", "c", "0", "0.7", WORLD, WEEK, "CAST(g AS INTEGER) % 3 = 1"),
        Row("a", "'political_risk.active_fundraisers'", "c % 9", above("c % 9", "5"), "0.65", WORLD, WEEK, "CAST(g AS INTEGER) % 3 = 2 AND c % 9 > 0"),
    )),
    Case("power_grid", "orders", {"fuel_type": "case when n % 3 = 0 then 'Natural Gas' when n % 3 = 1 then 'Wind' else 'Coal' end", "mw": "n", "spread": "n % 9 - 4", "da_lbmp": "if(n % 5 = 0, null, n % 200)", "significant_deviations": "n % 8"}, "case cast(g as int) % 4 when 0 then to_json(named_struct('total_peak_mw', size(rs), 'zones', rs)) when 1 then to_json(named_struct('mode', '', 'fuels', rs, 'total_mw', aggregate(rs, 0L, (a, r) -> a + r.mw))) when 2 then to_json(named_struct('mode', 'pricing', 'zones', rs, 'stressed_zones', slice(rs, 1, 1))) else to_json(named_struct('mode', 'forecast', 'zones', rs)) end", (
        Row("a", "'power_grid.demand.total_peak_mw'", "c", "0", "0.8", FLOWS, DAY, "CAST(g AS INTEGER) % 4 = 0"),
        Row("a", "'power_grid.demand.zone_count'", "c", "0", "0.9", FLOWS, DAY, "CAST(g AS INTEGER) % 4 = 0"),
        Row("(SELECT g, b, sum(CASE WHEN n % 3 = 0 THEN n ELSE 0 END) / sum(n) * 100 AS s FROM b GROUP BY g, b)", "'power_grid.fuel.gas_share_pct'", "round(s, 1)", above("s", "50"), "0.85", FLOWS, DAY, "CAST(g AS INTEGER) % 4 = 1"),
        Row("(SELECT g, b, sum(CASE WHEN n % 3 = 1 THEN n ELSE 0 END) / sum(n) * 100 AS s FROM b GROUP BY g, b)", "'power_grid.fuel.renewable_share_pct'", "round(s, 1)", "0", "0.85", FLOWS, DAY, "CAST(g AS INTEGER) % 4 = 1"),
        Row("a", "'power_grid.pricing.stressed_zone_count'", "1", "1", "0.8", STRESS, DAY, "CAST(g AS INTEGER) % 4 = 2"),
        Row("(SELECT g, b, max(abs(n % 9 - 4)) AS s FROM b GROUP BY g, b)", "'power_grid.pricing.max_spread'", "s", "0", "0.8", STRESS, DAY, "CAST(g AS INTEGER) % 4 = 2"),
        Row("(SELECT g, b, avg(n % 200) AS s FROM b WHERE n % 5 <> 0 GROUP BY g, b)", "'power_grid.pricing.avg_da_lbmp'", "round(s, 2)", above("s", "100"), "0.8", STRESS, DAY, "CAST(g AS INTEGER) % 4 = 2"),
        Row("a", "'power_grid.forecast.persistent_deviation_count'", "0", "0", "0.75", AREA, DAY, "CAST(g AS INTEGER) % 4 = 3"),
        Row("(SELECT g, b, max(n % 8) AS s FROM b GROUP BY g, b)", "'power_grid.forecast.max_significant_deviations'", "s", above("s", "5"), "0.7", AREA, DAY, "CAST(g AS INTEGER) % 4 = 3"),
    )),
    Case("defi_flows", "orders", {"tvl_usd": "n", "circulating_usd": "n", "change_1d_pct": "if(n % 3 = 0, null, n % 111 - 30)"}, "case cast(g as int) % 4 when 0 then to_json(named_struct('protocols', rs, 'total_tvl', 4 * rs[0].tvl_usd)) when 1 then to_json(named_struct('stablecoins', rs, 'total_supply', 4 * rs[0].tvl_usd)) when 2 then to_json(named_struct('mode', 'dex_volume', 'dexes', rs, 'total_volume_24h', size(rs))) else to_json(named_struct('chains', rs, 'grand_total_tvl', 4 * rs[0].tvl_usd)) end", (
        Row("a", "'defi.tvl.total_usd'", "4 * mn", "0", "0.8", STRESS, 3_600, "CAST(g AS INTEGER) % 4 = 0"),
        Row("(SELECT g, b, count(CASE WHEN n % 3 <> 0 AND n % 111 - 30 < -5 THEN 1 END) AS s FROM b GROUP BY g, b)", "'defi.tvl.drawdown_breadth'", "s", above("s", "3"), "0.75", STRESS, 3_600, "CAST(g AS INTEGER) % 4 = 0"),
        Row("a", "'defi.tvl.top_concentration_pct'", "25", "0", "0.7", CONTRACTS, 3_600, "CAST(g AS INTEGER) % 4 = 0 AND mn > 0"),
        Row("a", "'defi.stablecoin.total_supply'", "4 * mn", "0", "0.85", STRESS, 3_600, "CAST(g AS INTEGER) % 4 = 1"),
        Row("a", "'defi.stablecoin.top_share_pct'", "25", "0", "0.8", CONTRACTS, 3_600, "CAST(g AS INTEGER) % 4 = 1 AND mn > 0"),
        Row("a", "'defi.dex.total_volume_24h'", "c", "0", "0.75", CONTRACTS, 3_600, "CAST(g AS INTEGER) % 4 = 2"),
        Row("(SELECT g, b, count(CASE WHEN n % 3 <> 0 AND n % 111 - 30 > 50 THEN 1 END) AS s FROM b GROUP BY g, b)", "'defi.dex.panic_breadth'", "s", above("s", "2"), "0.7", STRESS, 3_600, "CAST(g AS INTEGER) % 4 = 2"),
        Row("a", "'defi.chain.total_tvl'", "4 * mn", "0", "0.8", STRESS, 3_600, "CAST(g AS INTEGER) % 4 = 3"),
        Row("a", "'defi.chain.top_concentration_pct'", "25", "0", "0.75", CONTRACTS, 3_600, "CAST(g AS INTEGER) % 4 = 3 AND mn > 0"),
    )),
    Case("labor_disruptions", "orders", {"n": "n"}, "case cast(g as int) % 3 when 0 then to_json(named_struct('label', 'workers', 'signals', named_struct('latest_value', size(rs), 'trend', 'RISING'))) when 1 then to_json(named_struct('label', 'idle_days', 'signals', named_struct('latest_value', size(rs), 'trend', 'DECLINING'))) else to_json(named_struct('signals', named_struct('workers', named_struct('latest_value', size(rs), 'trend', 'FLAT'), 'intensity_ratio', size(rs) % 4 / 2D, 'consecutive_active_months', size(rs) % 5))) end", (
        Row("a", "'strike.us.workers_involved'", "c", "CASE WHEN CAST(g AS INTEGER) % 3 = 0 THEN 1 ELSE 0 END", "0.75", INTENT, MONTH, "CAST(g AS INTEGER) % 3 <> 1"),
        Row("a", "'strike.us.idle_days'", "c", "-1", "0.7", MACRO, MONTH, "CAST(g AS INTEGER) % 3 = 1"),
        Row("a", "'strike.us.intensity'", "c % 4 / 2", sign("c % 4 / 2", "> 1.5", "< 0.5"), "0.65", MACRO, MONTH, "CAST(g AS INTEGER) % 3 = 2"),
        Row("a", "'strike.us.consecutive_months'", "c % 5", "CASE WHEN c % 5 >= 3 THEN 1 ELSE 0 END", "0.7", INTENT, MONTH, "CAST(g AS INTEGER) % 3 = 2 AND c % 5 > 0"),
    )),
    Case("gov_contracts", "orders", {"amount_usd": "if(n % 3 = 0, 0, n)", "amount": "1", "agency": "if(n % 5 = 0, 'US Army', null)", "description": "'roads'"}, "named_struct('region', if(b % 2 = 0, 'UK', null), 'awards', rs)", (
        Row("a", "CASE WHEN b % 2 = 0 THEN 'gov_contract.uk' ELSE 'gov_contract.us' END || '.award_count'", "c", "1", "0.65", RULING, 21_600),
        Row("(SELECT g, b, sum(CASE WHEN n % 3 = 0 THEN 1 ELSE n END) AS s FROM b GROUP BY g, b)", "CASE WHEN b % 2 = 0 THEN 'gov_contract.uk' ELSE 'gov_contract.us' END || '.total_value'", "s", "1", "0.7", RULING, 21_600),
        Row("a", "CASE WHEN b % 2 = 0 THEN 'gov_contract.uk' ELSE 'gov_contract.us' END || '.defense_share'", "round(c5 / c, 4)", above("c5 / c", "0.3"), "0.75", WORLD, 21_600),
    )),
    Case("academic_preprints", "orders", {"status": "case when n % 3 = 0 then 'Recruiting' when n % 3 = 1 then 'Completed' end", "sponsor_class": "if(n % 5 = 0, 'INDUSTRY', 'OTHER')"}, "if(b % 2 = 0, to_json(named_struct('trials', rs)), to_json(named_struct('papers', rs, 'count', 0)))", (
        Row("a", "'trials.active_count'", "c3", "1", "0.6", LIFE, DAY, "b % 2 = 0 AND c3 > 0"),
        Row("(SELECT g, b, count(*) AS s FROM b WHERE n % 3 = 1 GROUP BY g, b)", "'trials.completed_count'", "s", "1", "0.75", RULING, DAY, "b % 2 = 0"),
        Row("a", "'trials.industry_ratio'", "round(c5 / c, 4)", above("c5 / c", "0.5"), "0.6", INTENT, DAY, "b % 2 = 0"),
        Row("a", "'arxiv.volume'", "c", "1", "0.5", INTENT, DAY, "b % 2 = 1"),
    )),
]


def landed(spark, d, c: Case):
    """The payloads of a case's base rows, their records in the order of n, fetched so many seconds on as the least n."""
    base = run(spark, BASES[c.base], lambda n: getattr(views, n)(spark, d) if n in VIEWS else table(spark, d, n))
    record = F.struct(F.col("n").cast("long").alias("_n"), F.struct(*[F.expr(x).alias(f) for f, x in c.record.items()]).alias("_r"))
    packed = base.groupBy("g", "b").agg(F.array_sort(F.collect_list(record), lambda x, y: F.when(x["_n"] < y["_n"], -1).when(x["_n"] > y["_n"], 1).otherwise(0)).alias("_s"))
    shaped = packed.select("g", "b", F.col("_s")[0]["_n"].alias("least"), F.transform("_s", lambda s: s["_r"]).alias("rs"))
    data = F.expr(c.shape if c.shape.startswith(("if(", "case ")) else f"to_json({c.shape})")
    return shaped.select(F.lit(c.source).alias("source"), (F.lit(float(FETCHED)) + F.col("least")).alias("fetched_at"), data.alias("data"))


def register(c: Case) -> None:
    def rows(spark, d):
        return evidence.evidence(landed(spark, d, c), [c.source]).select("signal_id", F.col("ts").cast("long").alias("observed_s"), "value", "direction", "confidence", "category", "ttl")

    rows.__name__ = f"evd_{c.source}"
    parts = [
        f"SELECT {r.signal} AS signal_id, CAST({FETCHED} + since AS BIGINT) AS observed_s, CAST({r.value} AS DOUBLE) AS value, CAST({r.direction} AS INTEGER) AS direction, CAST({r.confidence} AS DOUBLE) AS confidence, '{r.category}' AS category, CAST({r.ttl} AS BIGINT) AS ttl FROM {r.of} AS rows_ JOIN t USING (g, b) WHERE {r.where}"
        for r in c.rows
    ]
    query(f"WITH b AS ({BASES[c.base]}), a AS ({PAYLOADS}), t AS (SELECT g, b, min(n) AS since FROM b GROUP BY g, b) {' UNION ALL '.join(parts)}")(rows)


for _case in CASES:
    register(_case)
