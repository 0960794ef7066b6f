"""Modes of the single sources, in SQL: each names its own rows, predicate, grouping, ladder and order.

`MODES` holds one statement for each mode over the bound tables and views; `run` applies one to DataFrames. The
statements use what Spark and DuckDB spell alike, so the same text is the check. Where a mode's result is a report, its
limit is the reports' length, with a total order.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..registry import query
from . import views
from .views import table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations", "benchmark")
VIEWS = ("obs", "entities", "links", "bars", "positioning", "country_events", "trades", "series")
NAME = re.compile(rf"\b(FROM|JOIN) ({'|'.join((*TABLES, *VIEWS))})\b")

#: Months of each named signal, and the same counted from the newest.
M = "m AS (SELECT signal, category, CAST(date_trunc('month', d) AS DATE) AS mth, sum(value) AS v FROM series GROUP BY 1, 2, 3)"
K = f"{M}, k AS (SELECT signal, category, mth, v, row_number() OVER (PARTITION BY signal ORDER BY mth DESC) AS r FROM m)"
#: Years of each supplier country.
Y = "y AS (SELECT s_nationkey AS country, year(l_shipdate) AS yr, sum(l_quantity) AS v, sum(l_extendedprice) AS usd FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"
DAY = "concat('', CAST({0} AS DATE))"


def at(n: int, col: str = "v") -> str:
    return f"max(CASE WHEN r = {n} THEN {col} END)"


def mean(a: int, b: int, col: str = "v") -> str:
    return f"avg(CASE WHEN r BETWEEN {a} AND {b} THEN {col} END)"


MODES: dict[str, str] = {
    # academic preprints: papers are documents, the language is the category
    "academic_preprints_arxiv_search": "SELECT doc_id, lang, n_chars FROM documents WHERE contains(lower(text), 'tion') AND lang IN ('en', 'fr') ORDER BY doc_id DESC LIMIT 100",
    "academic_preprints_arxiv_trending": "SELECT lang, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id DESC) AS k FROM documents) x WHERE k <= 20",
    "academic_preprints_clinical_trials": "SELECT p_brand AS sponsor, p_type AS condition, count(*) AS trials, count(*) FILTER (WHERE p_size >= 25) AS recruiting FROM part WHERE p_size > 10 GROUP BY 1, 2",
    # vessels: an observation's value gives the latitude, its id the longitude
    "ais_vessel_area": "WITH v AS (SELECT entity_id, source, value * 0.5 + 20 AS lat, obs_id % 60 - 30 AS lon, value FROM obs) SELECT source AS kind, count(*) AS positions, count(DISTINCT entity_id) AS vessels, count(*) FILTER (WHERE value > 20) AS moving FROM v WHERE lat BETWEEN 40 AND 60 AND lon BETWEEN -20 AND 20 GROUP BY 1",
    "ais_vessel_vessel": "SELECT entity_id, obs_id, value FROM (SELECT entity_id, obs_id, value, row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC, obs_id DESC) AS k FROM obs) x WHERE k = 1",
    "ais_vessel_port_calls": "SELECT c_nationkey AS port, count(*) AS calls, count(DISTINCT o_custkey) AS vessels, count(*) FILTER (WHERE o_orderstatus = 'F') AS with_cargo FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1",
    "ais_vessel_area_daily_snapshot": f"SELECT {DAY.format('ts')} AS day, count(*) AS positions, count(DISTINCT entity_id) AS vessels, round(avg(value), 6) AS mean_speed FROM obs GROUP BY 1",
    # courts and enforcement
    "bankruptcy_court_us_bankruptcy": f"SELECT o_orderkey, {DAY.format('o_orderdate')} AS filed, CASE WHEN o_orderpriority = '1-URGENT' THEN '7' WHEN o_orderpriority = '2-HIGH' THEN '11' ELSE '13' END AS chapter FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 200",
    "bankruptcy_court_sec_enforcement": f"SELECT o_orderkey, {DAY.format('o_orderdate')} AS published, o_custkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') ORDER BY o_orderdate DESC, o_orderkey LIMIT 150",
    "bankruptcy_court_sec_bankruptcy": "SELECT doc_id, source, n_chars FROM documents WHERE contains(lower(text), 'license') OR contains(lower(text), 'copyright') ORDER BY doc_id LIMIT 500",
    "bankruptcy_court_uk_insolvency": "SELECT s_nationkey AS office, s_suppkey, s_name, s_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS k FROM supplier WHERE s_acctbal < 2000) x WHERE k <= 10",
    # permits: order months of the segments
    "building_permits_permits": f"WITH {K} SELECT signal, {at(1)} AS latest, {at(2)} AS before, round(100.0 * ({at(1)} - {at(2)}) / nullif({at(2)}, 0), 2) AS mom_pct, round(100.0 * ({at(1)} - {at(13)}) / nullif({at(13)}, 0), 2) AS yoy_pct FROM k WHERE category = 'demand' GROUP BY 1",
    "building_permits_regional": f"SELECT n_regionkey AS census_region, concat('', CAST(date_trunc('month', o_orderdate) AS DATE)) AS mth, count(*) AS permits FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2",
    "building_permits_housing_starts": "WITH s AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS mth, count(*) AS starts FROM lineitem GROUP BY 1), p AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS mth, count(*) AS permits FROM orders GROUP BY 1) SELECT concat('', s.mth) AS mth, starts, permits, round(starts / permits, 4) AS ratio, CASE WHEN starts / permits > 1.0 THEN 'confident' WHEN starts / permits < 0.8 THEN 'cautious' ELSE 'normal' END AS builders FROM s JOIN p ON s.mth = p.mth",
    # capital flows
    "capital_flows_flows": f"WITH {Y} SELECT yr, round(sum(usd), 2) AS purchases, round(sum(CASE WHEN country < 12 THEN usd ELSE -usd END), 2) AS net FROM y GROUP BY 1",
    "capital_flows_reserves": f"WITH {Y}, r AS (SELECT country, yr, usd, lag(usd) OVER (PARTITION BY country ORDER BY yr) AS before, row_number() OVER (PARTITION BY country ORDER BY yr DESC) AS k FROM y) SELECT country, yr, round(usd, 2) AS reserves, round((usd / before - 1) * 100, 4) AS change_pct FROM r WHERE k <= 3",
    # central banks: a brand is a bank, its weekly open interest the balance sheet, the long share the rate
    "central_bank_balance_balance_sheets": f"WITH k AS (SELECT brand, oi AS v, row_number() OVER (PARTITION BY brand ORDER BY week DESC) AS r FROM positioning) SELECT brand, {at(1)} AS native, round({at(1)} * 1.1, 4) AS usd, round(100.0 * ({at(1)} / {at(2)} - 1), 4) AS wow_pct, round(100.0 * ({at(1)} / {at(5)} - 1), 4) AS mom_pct, round(100.0 * ({at(1)} / {at(53)} - 1), 4) AS yoy_pct FROM k GROUP BY 1",
    "central_bank_balance_policy_divergence": f"WITH k AS (SELECT brand, oi AS v, longs / oi AS share, row_number() OVER (PARTITION BY brand ORDER BY week DESC) AS r FROM positioning), b AS (SELECT brand, {mean(1, 4)} / {mean(14, 17)} - 1 AS quarter, {at(1, 'share')} AS rate FROM k GROUP BY 1), p AS (SELECT a.brand AS bank_a, b.brand AS bank_b, a.quarter - b.quarter AS gap, a.rate - b.rate AS rate_gap, a.quarter AS qa, b.quarter AS qb FROM b a JOIN b b ON a.brand < b.brand) SELECT bank_a, bank_b, round(gap * 100, 4) AS gap_pct, round(rate_gap, 6) AS rate_gap, CASE WHEN qa > 0.01 AND qb < -0.01 OR qa < -0.01 AND qb > 0.01 THEN 'diverging' ELSE 'aligned' END AS stance FROM p",
    "central_bank_balance_rate_monitor": "WITH x AS (SELECT brand, week, round(longs / oi, 1) AS rate FROM positioning), c AS (SELECT brand, week, rate, lag(rate) OVER (PARTITION BY brand ORDER BY week) AS before FROM x) SELECT brand, max_by(rate, week) AS current_rate, concat('', max(CASE WHEN rate <> before THEN week END)) AS last_change, round(max_by(rate - before, CASE WHEN rate <> before THEN week END), 6) AS last_step FROM c GROUP BY 1",
    # certificates: pages are certificates, the host is the domain
    "cert_transparency_search": "WITH c AS (SELECT page_id, substr(url, 9, position('/' IN substr(url, 9)) - 1) AS host FROM pages WHERE url LIKE 'https://%/%') SELECT host, count(*) AS certs, min(page_id) AS first_id, max(page_id) AS last_id FROM c GROUP BY 1",
    "cert_transparency_subdomains": "WITH c AS (SELECT page_id, lower(CASE WHEN url LIKE 'https://%' THEN substr(url, 9) ELSE substr(url, 8) END) AS rest FROM pages WHERE url LIKE 'http%://%/%'), h AS (SELECT page_id, substr(rest, 1, position('/' IN rest) - 1) AS host FROM c) SELECT substr(host, position('.' IN host) + 1) AS domain, count(DISTINCT host) AS hosts, count(*) AS certs FROM h WHERE contains(host, '.') GROUP BY 1",
    "cert_transparency_recent": "SELECT page_id, url, length(html) AS n FROM pages WHERE page_id >= (SELECT max(page_id) - 200 FROM pages) ORDER BY page_id DESC LIMIT 100",
    # trade flows: customer country to supplier country
    "comtrade_flows": "SELECT c_nationkey AS reporter, s_nationkey AS partner, count(*) AS records, round(sum(l_extendedprice), 2) AS trade_value FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2 ORDER BY round(sum(l_extendedprice), 2) DESC, reporter, partner LIMIT 250",
    "comtrade_commodity": "SELECT p_type AS commodity, s_nationkey AS partner, round(sum(l_extendedprice), 2) AS trade_value, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2",
    # consumer sentiment: the index of a series against its own mean
    "consumer_sentiment_eu_signals": f"WITH {K}, i AS (SELECT signal, r, 100.0 * v / avg(v) OVER (PARTITION BY signal) AS v FROM k WHERE category = 'logistics') SELECT signal, round({at(1)}, 4) AS latest, round({at(1)} - {at(2)}, 4) AS mom_change, CASE WHEN {at(2)} IS NULL THEN 'INSUFFICIENT_DATA' WHEN {at(1)} - {at(2)} > 1.0 THEN 'IMPROVING' WHEN {at(1)} - {at(2)} < -1.0 THEN 'DETERIORATING' ELSE 'STABLE' END AS trend, coalesce({at(1)} < {at(2)} AND {at(2)} < {at(3)}, false) AS consecutive_decline FROM i GROUP BY 1",
    "consumer_sentiment_us_signals": f"WITH {K}, i AS (SELECT signal, r, 100.0 * v / max(v) OVER (PARTITION BY signal) AS v FROM k WHERE category = 'demand') SELECT signal, round({at(1)}, 4) AS latest, round({at(1)} - {at(2)}, 4) AS mom, round(avg(v), 4) AS mean, round({at(1)} - avg(v), 4) AS vs_mean, CASE WHEN {at(1)} < 60 THEN 'CRITICAL_LOW' WHEN {at(1)} < 70 THEN 'WARNING' END AS alert FROM i GROUP BY 1",
    "consumer_sentiment_cpi_signals": f"WITH {K}, s AS (SELECT signal, {at(1)} AS v1, {at(2)} AS v2, {at(13)} AS v13, 100.0 * {mean(1, 12)} / nullif({mean(13, 24)}, 0) - 100 AS expected FROM k GROUP BY 1) SELECT signal, round((v1 / nullif(v2, 0) - 1) * 100, 2) AS mom_pct, round((v1 / nullif(v2, 0) - 1) * 1200, 1) AS annualised, round((v1 / nullif(v13, 0) - 1) * 100, 2) AS yoy_pct, CASE WHEN expected - (v1 / nullif(v13, 0) - 1) * 100 > 1.5 THEN 'ABOVE_REALITY' WHEN expected - (v1 / nullif(v13, 0) - 1) * 100 < -1.0 THEN 'BELOW_REALITY' WHEN v13 IS NOT NULL THEN 'ALIGNED' END AS gap FROM s",
    "consumer_sentiment_eu_confidence": f"WITH {K}, l AS (SELECT category, signal, v / avg(v) OVER (PARTITION BY signal) AS i, r FROM k) SELECT category, round(max(i) - min(i), 6) AS spread, max_by(signal, round(i, 9)) AS most_optimistic, min_by(signal, round(i, 9)) AS most_pessimistic, count(*) AS members FROM l WHERE r = 1 GROUP BY 1",
    "consumer_sentiment_us_sentiment": f"WITH {K} SELECT concat('', a.mth) AS mth, a.signal, a.v AS sentiment, b.v AS expectation FROM k a JOIN k b ON a.mth = b.mth AND a.r <= 24 AND b.signal = 'priority.1-URGENT' WHERE a.category = 'demand'",
    "consumer_sentiment_inflation_reality": f"WITH {M}, x AS (SELECT signal, category, mth, v, lag(v, 12) OVER (PARTITION BY signal ORDER BY mth) AS y FROM m) SELECT signal, concat('', mth) AS mth, v, round((v / y - 1) * 100, 4) AS yoy_pct FROM x WHERE y > 0 AND category IN ('demand', 'urgency')",
    # creditor filings
    "creditor_filings_search_efts": f"SELECT o_orderkey, o_custkey AS cik, {DAY.format('o_orderdate')} AS file_date FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderdate >= TIMESTAMP '1997-01-01 00:00:00' ORDER BY o_orderdate DESC, o_orderkey LIMIT 200",
    "creditor_filings_search_ch_company": "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE lower(c_name) LIKE '%00%1' ORDER BY c_name, c_custkey LIMIT 50",
    "creditor_filings_search": "SELECT o_custkey AS cik, count(*) AS filings, count(DISTINCT o_orderpriority) AS items FROM orders WHERE o_orderstatus IN ('F', 'P') GROUP BY 1",
    "creditor_filings_uk_charges": "SELECT s_suppkey AS company, count(*) AS charges, count(*) FILTER (WHERE l_linestatus = 'O') AS outstanding, count(*) FILTER (WHERE l_linestatus = 'F') AS satisfied, round(sum(CASE WHEN l_linestatus = 'O' THEN l_extendedprice ELSE 0 END), 2) AS secured FROM supplier JOIN lineitem ON s_suppkey = l_suppkey GROUP BY 1",
    "creditor_filings_stress_scan": f"WITH c AS (SELECT o_custkey AS company, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent, count(*) AS filings, max(o_orderdate) AS last FROM orders GROUP BY 1) SELECT company, urgent, filings, {DAY.format('last')} AS last_filed, round(urgent / filings, 6) AS stress FROM c WHERE urgent >= 3 AND urgent * 3 >= filings",
    # locked value: suppliers are protocols, their country the chain
    "defi_flows_tvl": "SELECT s_suppkey, s_name, s_nationkey AS chain, round(s_acctbal, 2) AS tvl, round(100.0 * s_acctbal / sum(s_acctbal) OVER (PARTITION BY s_nationkey), 4) AS share FROM supplier WHERE s_acctbal > 0 ORDER BY s_acctbal DESC, s_suppkey LIMIT 100",
    "defi_flows_stablecoins": "SELECT c_mktsegment AS issuer, count(*) AS holders, round(sum(c_acctbal), 2) AS circulating, round(100.0 * sum(c_acctbal) / (SELECT sum(c_acctbal) FROM customer WHERE c_acctbal > 0), 4) AS share FROM customer WHERE c_acctbal > 0 GROUP BY 1",
    "defi_flows_dex_volume": "WITH t AS (SELECT max(l_shipdate) AS now FROM lineitem), v AS (SELECT l_suppkey AS dex, sum(CASE WHEN l_shipdate > now - INTERVAL 7 DAY THEN l_extendedprice ELSE 0 END) AS week, sum(CASE WHEN l_shipdate > now - INTERVAL 30 DAY THEN l_extendedprice ELSE 0 END) AS month FROM lineitem, t GROUP BY 1) SELECT dex, round(week, 2) AS volume_7d, round(month, 2) AS volume_30d FROM v WHERE month > 0 ORDER BY round(week, 2) DESC, dex LIMIT 100",
    # diseases: event types are pathogens, users' parity the state
    "disease_surveillance_wastewater": f"WITH s AS (SELECT source AS pathogen, entity_id AS state, avg(value) AS level, count(*) AS samples FROM obs GROUP BY 1, 2) SELECT pathogen, sum(samples) AS total_samples, count(*) AS states, count(*) FILTER (WHERE level >= 75) AS surge_count, count(*) FILTER (WHERE level < 25) AS quiet_count FROM s GROUP BY 1",
    "disease_surveillance_outbreaks": f"SELECT obs_id, source AS disease, {DAY.format('ts')} AS day FROM obs WHERE value >= 99 AND ts >= TIMESTAMP '2024-01-10 00:00:00' ORDER BY ts DESC, obs_id LIMIT 200",
    "disease_surveillance_eu_surveillance": f"WITH w AS (SELECT source, CAST(date_trunc('week', ts) AS DATE) AS wk, sum(value) AS cases FROM obs GROUP BY 1, 2) SELECT source, concat('', wk) AS wk, round(cases, 6) AS cases, round(100.0 * (cases / lag(cases) OVER (PARTITION BY source ORDER BY wk) - 1), 4) AS change_pct FROM w",
    "disease_surveillance_genomics": "WITH w AS (SELECT source, CAST(date_trunc('week', ts) AS DATE) AS wk, count(*) AS n FROM obs GROUP BY 1, 2) SELECT source, concat('', wk) AS wk, n, round(n / avg(n) OVER (PARTITION BY source ORDER BY wk ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 4) AS velocity FROM w",
    # name service: a customer's orders are its records
    "dns_monitor_resolve": "SELECT o_custkey AS domain, o_orderpriority AS record_type, count(*) AS records, min(o_orderkey) AS first_value, round(min(o_totalprice), 2) AS min_ttl FROM orders GROUP BY 1, 2",
    "dns_monitor_diff": "WITH a AS (SELECT DISTINCT o_custkey AS domain, o_orderpriority AS t, o_orderstatus AS v FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01 00:00:00'), b AS (SELECT DISTINCT o_custkey AS domain, o_orderpriority AS t, o_orderstatus AS v FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01 00:00:00') SELECT coalesce(a.domain, b.domain) AS domain, coalesce(a.t, b.t) AS record_type, coalesce(a.v, b.v) AS value, CASE WHEN b.domain IS NULL THEN 'removed' ELSE 'added' END AS change FROM a FULL OUTER JOIN b ON a.domain = b.domain AND a.t = b.t AND a.v = b.v WHERE a.domain IS NULL OR b.domain IS NULL",
    "dns_monitor_bulk_resolve": "SELECT c_mktsegment AS list, count(DISTINCT c_custkey) AS domains, count(o_orderkey) AS records, count(DISTINCT c_custkey) FILTER (WHERE o_orderkey IS NULL) AS unresolved FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1",
    # earthquakes: a tenth of a value is the magnitude
    "earthquake_proximity_recent": "SELECT CASE WHEN value / 10 >= 9 THEN 'great' WHEN value / 10 >= 7 THEN 'major' WHEN value / 10 >= 6 THEN 'strong' ELSE 'moderate' END AS band, count(*) AS quakes, round(max(value) / 10, 6) AS strongest FROM obs WHERE value >= 50 GROUP BY 1",
    "earthquake_proximity_monitor": "SELECT entity_id AS zone, count(*) AS quakes, round(max(value) / 10, 6) AS strongest, count(*) FILTER (WHERE value >= 70) AS alerts FROM obs WHERE value >= 40 AND ts >= TIMESTAMP '2024-01-15 00:00:00' GROUP BY 1 HAVING max(value) >= 70",
    # electricity
    "electricity_monitor_fuel_mix_proportions": "WITH f AS (SELECT c_nationkey AS region, c_mktsegment AS fuel, sum(abs(c_acctbal)) AS mwh FROM customer GROUP BY 1, 2) SELECT region, fuel, round(mwh, 4) AS mwh, round(100.0 * mwh / sum(mwh) OVER (PARTITION BY region), 4) AS pct FROM f",
    "electricity_monitor_demand": "WITH h AS (SELECT source AS region, date_trunc('hour', ts) AS h, sum(value) AS demand FROM obs GROUP BY 1, 2), f AS (SELECT region, h, demand, avg(demand) OVER (PARTITION BY region ORDER BY h ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS forecast FROM h) SELECT region, count(*) AS hours, round(avg(100.0 * (demand - forecast) / forecast), 4) AS mean_deviation_pct, count(*) FILTER (WHERE abs(demand - forecast) > 0.5 * forecast) AS large FROM f WHERE forecast > 0 GROUP BY 1",
    "electricity_monitor_generation": "SELECT n_name AS region, c_mktsegment AS fuel, count(*) AS units, round(sum(c_acctbal), 2) AS generation FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY 1, 2",
    # energy
    "energy_supply_rig_signals": f"WITH {K}, s AS (SELECT signal, {at(1)} AS v1, {at(2)} AS v2, {at(3)} AS v3, {mean(1, 3)} AS recent, {mean(4, 6)} AS prior, avg(v) AS mean, max(v) AS peak, count(*) AS months FROM k WHERE category = 'returns' GROUP BY 1) SELECT signal, v1 AS latest, round(mean, 2) AS mean, peak, months, round(v1 - v2, 1) AS mom_change, CASE WHEN 100 * (v1 - v3) / nullif(v3, 0) < -10 THEN 'WARNING' WHEN 100 * (v1 - v3) / nullif(v3, 0) > 10 THEN 'NOTICE' END AS alert, CASE WHEN months < 6 THEN 'INSUFFICIENT_DATA' WHEN recent / nullif(prior, 0) > 1.05 THEN 'EXPANDING' WHEN recent / nullif(prior, 0) < 0.95 THEN 'CONTRACTING' ELSE 'STABLE' END AS trend FROM s",
    "energy_supply_stocks": "WITH x AS (SELECT brand, week, oi, oi - lag(oi) OVER (PARTITION BY brand ORDER BY week) AS step FROM positioning) SELECT brand, concat('', week) AS wk, oi AS stock, step, CASE WHEN step < 0 THEN 'draw' WHEN step > 0 THEN 'build' ELSE 'flat' END AS kind FROM x WHERE step IS NOT NULL AND week >= DATE '1999-01-01'",
    "energy_supply_supply": f"WITH {K} SELECT category, signal, {at(1)} AS latest, round({mean(1, 4)}, 4) AS mean_4, round({mean(1, 12)}, 4) AS mean_12 FROM k GROUP BY 1, 2",
    "energy_supply_rig_count": f"WITH {K} SELECT signal, concat('', mth) AS mth, v AS rigs FROM k WHERE category = 'returns' AND r <= 24",
    # short volume: returned lines are short
    "finra_short_volume_short_volume": f"SELECT l_partkey AS symbol, {DAY.format('l_shipdate')} AS day, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS short_volume, sum(l_quantity) AS total, round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / sum(l_quantity), 6) AS ratio FROM lineitem WHERE l_shipdate >= TIMESTAMP '1999-01-01 00:00:00' GROUP BY 1, 2",
    "finra_short_volume_short_interest": "WITH x AS (SELECT l_partkey AS symbol, CAST(date_trunc('month', l_shipdate) AS DATE) AS mth, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS short_interest, avg(l_quantity) AS daily FROM lineitem GROUP BY 1, 2), l AS (SELECT symbol, short_interest, daily, row_number() OVER (PARTITION BY symbol ORDER BY mth DESC) AS k FROM x) SELECT symbol, short_interest, round(short_interest / daily, 4) AS days_to_cover FROM l WHERE k = 1 AND short_interest > 0",
    "foia_requests_search": "SELECT doc_id, source AS agency, n_chars FROM documents WHERE contains(lower(text), 'benchmark') OR contains(lower(text), 'email') OR contains(text, '@') ORDER BY n_chars DESC, doc_id LIMIT 100",
    # food: yearly series of supplier countries
    "food_security_signals": f"WITH {Y}, x AS (SELECT country, yr, v, lag(v) OVER (PARTITION BY country ORDER BY yr) AS p, row_number() OVER (PARTITION BY country ORDER BY yr DESC) AS r FROM y), c AS (SELECT country, v, p, r, min(CASE WHEN p IS NULL OR v >= p THEN r END) OVER (PARTITION BY country) - 1 AS down, min(CASE WHEN p IS NULL OR v <= p THEN r END) OVER (PARTITION BY country) - 1 AS up, avg(v) OVER (PARTITION BY country) AS mean FROM x) SELECT country, round((v - p) / abs(p) * 100, 2) AS yoy_pct, round(mean, 2) AS mean, round((v - mean) / mean * 100, 2) AS deviation_pct, CASE WHEN up > 0 THEN 'up' WHEN down > 0 THEN 'down' END AS direction, greatest(up, down) AS consecutive_years, CASE WHEN down >= 2 THEN 'declining' WHEN (v - mean) / mean * 100 < -10 THEN 'below average' END AS stress FROM c WHERE r = 1",
    "food_security_production": f"WITH {Y} SELECT country, yr, v AS production, round(100.0 * v / first_value(v) OVER (PARTITION BY country ORDER BY yr), 4) AS idx FROM y",
    "food_security_cereal_yield": "SELECT s_nationkey AS country, year(l_shipdate) AS yr, sum(l_quantity) AS area, round(sum(l_extendedprice) / sum(l_quantity), 4) AS yield FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE p_size <= 15 GROUP BY 1, 2",
    "food_security_food_trade": "WITH t AS (SELECT s_nationkey AS country, year(l_shipdate) AS yr, sum(CASE WHEN p_size <= 10 THEN l_extendedprice ELSE 0 END) / sum(l_extendedprice) * 100 AS share FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) SELECT country, yr, round(share, 4) AS import_share, CASE WHEN share > 30 THEN 'high' WHEN share > 20 THEN 'moderate' END AS vulnerability FROM t",
    # interconnection queue: parts are projects
    "interconnection_queue_queue": "SELECT p_brand AS developer, p_type AS technology, count(*) AS projects, round(sum(p_retailprice), 2) AS capacity_mw FROM part WHERE p_size BETWEEN 5 AND 45 GROUP BY 1, 2",
    "interconnection_queue_summary": "SELECT CASE WHEN p_size < 15 THEN 'planned' WHEN p_size < 35 THEN 'under construction' ELSE 'operating' END AS status, p_type AS technology, count(*) AS projects, round(sum(p_retailprice), 2) AS capacity_mw, round(avg(p_retailprice), 4) AS mean_mw FROM part GROUP BY 1, 2",
    "interconnection_queue_datacenter": "SELECT p_brand AS developer, count(*) AS projects, round(sum(p_retailprice), 2) AS capacity_mw FROM part WHERE contains(lower(p_name), 'data') OR contains(lower(p_name), 'bolt') OR contains(lower(p_type), 'econ') GROUP BY 1 ORDER BY round(sum(p_retailprice), 2) DESC, developer LIMIT 50",
    # internet infrastructure: country events are alerts; -10 is the worst
    "internet_infrastructure_outages": f"SELECT entity_id, {DAY.format('ts')} AS day, count(*) AS alerts, round(min(score), 4) AS worst, CASE WHEN min(score) <= -9 THEN 'critical' WHEN min(score) <= -5 THEN 'warning' ELSE 'normal' END AS severity FROM country_events WHERE score < 0 AND ts >= TIMESTAMP '2000-01-01 00:00:00' GROUP BY 1, 2",
    "internet_infrastructure_censorship": "SELECT entity_id, quad AS test, count(*) AS measurements, count(*) FILTER (WHERE score <= -8) AS blocked, round(100.0 * count(*) FILTER (WHERE score <= -8) / count(*), 4) AS blocking_pct FROM country_events GROUP BY 1, 2",
    "internet_infrastructure_signals": "WITH w AS (SELECT entity_id, CAST(date_trunc('month', ts) AS DATE) AS mth, count(*) AS n FROM country_events GROUP BY 1, 2), x AS (SELECT entity_id, mth, n / max(n) OVER (PARTITION BY entity_id) AS level FROM w) SELECT entity_id, round(max_by(level, mth), 6) AS current, round(avg(level), 6) AS mean, round(min(level), 6) AS least, count(*) FILTER (WHERE level < 0.5) AS drops, CASE WHEN max_by(level, mth) < 0.2 THEN 'critical' WHEN max_by(level, mth) < 0.5 THEN 'warning' ELSE 'normal' END AS severity FROM x GROUP BY 1",
    "internet_infrastructure_incidents": "SELECT entity_id, year(ts) AS yr, count(*) AS incidents, count(*) FILTER (WHERE quad = 4) AS confirmed FROM country_events WHERE score <= -9 GROUP BY 1, 2",
    "internet_outages_aggregation_signals": "WITH c AS (SELECT entity_id, count(*) AS n, count(*) FILTER (WHERE score <= -2) AS anomaly, count(*) FILTER (WHERE score BETWEEN -1 AND 1) AS failure FROM country_events GROUP BY 1) SELECT entity_id, n, round(100.0 * anomaly / n, 2) AS anomaly_pct, round(100.0 * failure / n, 2) AS failure_pct, CASE WHEN 100.0 * anomaly / n > 50 THEN 'CRITICAL' WHEN 100.0 * anomaly / n > 20 THEN 'WARNING' WHEN 100.0 * failure / n > 30 THEN 'WARNING: failures' END AS alert FROM c",
    "internet_outages_network_health_signals": "WITH c AS (SELECT c_nationkey AS country, count(*) AS probes, count(*) FILTER (WHERE o_orderstatus = 'O') AS connected, count(*) FILTER (WHERE o_orderstatus = 'F') AS disconnected, count(*) FILTER (WHERE o_orderstatus = 'P') AS abandoned, count(DISTINCT o_custkey) AS asns FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) SELECT country, probes, connected, disconnected, abandoned, asns, round(100.0 * disconnected / nullif(connected + disconnected, 0), 2) AS disconnect_pct, CASE WHEN 100.0 * disconnected / nullif(connected + disconnected, 0) > 50 THEN 'CRITICAL' WHEN 100.0 * disconnected / nullif(connected + disconnected, 0) > 20 THEN 'WARNING' WHEN disconnected > 10 THEN 'NOTICE' END AS alert FROM c",
    "internet_outages_censorship": f"SELECT entity_id, {DAY.format('ts')} AS day, event_key, event_line, event_part, round(score, 4) AS score FROM country_events WHERE score <= -9.9 AND quad = 1",
    "internet_outages_network_health": "SELECT c_nationkey AS country, c_mktsegment AS asn, count(*) AS probes, count(*) FILTER (WHERE c_acctbal > 0) AS connected FROM customer GROUP BY 1, 2",
    "internet_outages_outage_detection": f"SELECT entity_id, {DAY.format('ts')} AS day, count(*) AS total, count(*) FILTER (WHERE score < -5) AS anomalies, count(*) FILTER (WHERE abs(score) < 1) AS failures FROM country_events WHERE ts >= TIMESTAMP '2001-01-01 00:00:00' GROUP BY 1, 2",
    # jobs
    "job_postings_trend": f"WITH {K} SELECT signal, CASE WHEN {at(4)} IS NULL THEN 'insufficient data' WHEN {at(1)} > {at(4)} * 1.05 THEN 'rising' WHEN {at(1)} < {at(4)} * 0.95 THEN 'falling' ELSE 'stable' END AS trend FROM k GROUP BY 1",
    "job_postings_jolts": f"WITH {K} SELECT signal, {at(1)} AS latest, {at(2)} AS before, concat('', max(mth)) AS mth FROM k WHERE category = 'urgency' GROUP BY 1",
    "job_postings_sector": "SELECT c_mktsegment AS sector, o_orderpriority AS measure, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY o_orderpriority), 4) AS pct FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2",
    "job_postings_labor_market": f"WITH {K}, s AS (SELECT category, mth, sum(v) AS v FROM k GROUP BY 1, 2) SELECT a.mth_text AS mth, a.v AS demand, b.v AS urgency, round(b.v / a.v, 6) AS tightness FROM (SELECT concat('', mth) AS mth_text, mth, v FROM s WHERE category = 'demand') a JOIN (SELECT mth, v FROM s WHERE category = 'urgency') b ON a.mth = b.mth",
    # labour
    "labor_disruptions_single_signals": f"WITH {K}, s AS (SELECT signal, {at(1)} AS latest, avg(v) AS mean, max(v) AS peak, count(*) AS months, count(*) FILTER (WHERE v > 0) AS active, {mean(1, 6)} AS recent, {mean(7, 12)} AS prior FROM k GROUP BY 1) SELECT signal, latest, round(mean, 2) AS mean, peak, months, round(100.0 * active / months, 1) AS active_pct, CASE WHEN latest > 500 THEN 'CRITICAL' WHEN latest > 100 THEN 'WARNING' WHEN latest > 0 THEN 'NOTICE' END AS alert, CASE WHEN months < 12 THEN 'INSUFFICIENT_DATA' WHEN prior <= 0 AND recent > 0 THEN 'NEW_ACTIVITY' WHEN prior <= 0 THEN 'QUIET' WHEN recent > prior * 1.5 THEN 'ESCALATING' WHEN recent > prior * 1.1 THEN 'RISING' WHEN recent < prior * 0.5 THEN 'DECLINING' ELSE 'STABLE' END AS trend FROM s",
    "labor_disruptions_overview_signals": f"WITH {K}, w AS (SELECT signal, r, v FROM k WHERE category = 'urgency'), i AS (SELECT r, sum(v) AS v FROM k WHERE category = 'returns' GROUP BY 1), x AS (SELECT w.signal, w.r, w.v, i.v AS idle, min(CASE WHEN w.v <= 0 THEN w.r END) OVER (PARTITION BY w.signal) AS quiet, count(*) OVER (PARTITION BY w.signal) AS months FROM w JOIN i ON w.r = i.r) SELECT signal, v AS workers, idle, round(idle / nullif(v, 0), 2) AS intensity, coalesce(quiet - 1, months) AS active_months, CASE WHEN idle > 10000 THEN 'CRITICAL' WHEN idle > 1000 THEN 'WARNING' WHEN idle > 0 THEN 'NOTICE' END AS alert FROM x WHERE r = 1",
    "labor_disruptions_single_series": f"WITH {M} SELECT signal, concat('', mth) AS mth, v, v - lag(v) OVER (PARTITION BY signal ORDER BY mth) AS change, round(avg(v) OVER (PARTITION BY signal ORDER BY mth ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), 4) AS mean_12 FROM m WHERE category = 'urgency'",
    "labor_disruptions_overview": f"WITH {M}, a AS (SELECT mth, sum(v) AS v FROM m WHERE category = 'urgency' GROUP BY 1), b AS (SELECT mth, sum(v) AS v FROM m WHERE category = 'returns' GROUP BY 1) SELECT concat('', coalesce(a.mth, b.mth)) AS mth, a.v AS workers, b.v AS idle FROM a FULL OUTER JOIN b ON a.mth = b.mth",
    # lobbying: customers are clients, suppliers registrants
    "lobbying_search": f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey AS registrant, {DAY.format('l_shipdate')} AS posted FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1999-01-01 00:00:00' AND l_suppkey <= 5",
    "lobbying_spending": "SELECT l_suppkey AS registrant, year(l_shipdate) AS yr, count(*) AS filings, count(DISTINCT l_orderkey) AS clients, round(sum(l_extendedprice), 2) AS spend FROM lineitem GROUP BY 1, 2",
    "lobbying_issues": "SELECT p_type AS issue, count(*) AS filings, count(DISTINCT l_suppkey) AS registrants, round(sum(l_extendedprice), 2) AS spend FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1",
    # migration: line states are the kinds of displaced persons and of decisions
    "migration_flows_displacement_signals": "WITH c AS (SELECT s_nationkey AS country, count(*) AS records, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS refugees, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS asylum, sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS idps FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1) SELECT country, records, refugees + asylum + idps AS displaced, round(100 * refugees / nullif(refugees + asylum + idps, 0), 1) AS refugee_pct, round(100 * idps / nullif(refugees + asylum + idps, 0), 1) AS idp_pct, CASE WHEN refugees + asylum + idps > 10000000 THEN 'CRITICAL' WHEN refugees + asylum + idps > 1000000 THEN 'WARNING' WHEN refugees + asylum + idps > 100000 THEN 'NOTICE' END AS alert FROM c",
    "migration_flows_asylum_signals": "WITH c AS (SELECT c_nationkey AS country, count(*) FILTER (WHERE o_orderstatus = 'O') AS recognised, count(*) FILTER (WHERE o_orderstatus = 'F') AS rejected, count(*) FILTER (WHERE o_orderstatus = 'P') AS closed, count(*) AS decisions FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) SELECT country, recognised, rejected, closed, decisions, round(100.0 * recognised / nullif(recognised + rejected, 0), 1) AS acceptance, round(100.0 * closed / decisions, 1) AS closure, CASE WHEN 100.0 * recognised / nullif(recognised + rejected, 0) < 20 THEN 'RESTRICTIVE' WHEN 100.0 * recognised / nullif(recognised + rejected, 0) > 80 THEN 'LIBERAL' END AS alert FROM c",
    "migration_flows_remittance_signals": f"WITH {Y}, k AS (SELECT country, usd AS v, row_number() OVER (PARTITION BY country ORDER BY yr DESC) AS r FROM y), s AS (SELECT country, {at(1)} AS v1, {at(2)} AS v2, {mean(1, 3)} AS recent, {mean(4, 6)} AS prior, max(v) AS peak, count(*) AS years FROM k GROUP BY 1) SELECT country, round(v1, 2) AS latest, round(peak, 2) AS peak, years, round(100 * (v1 - v2) / nullif(v2, 0), 1) AS yoy_pct, CASE WHEN 100 * (v1 - v2) / nullif(v2, 0) < -20 THEN 'CRITICAL' WHEN 100 * (v1 - v2) / nullif(v2, 0) < -10 THEN 'WARNING' WHEN 100 * (v1 - v2) / nullif(v2, 0) > 30 THEN 'SURGE' END AS alert, CASE WHEN years < 6 THEN 'INSUFFICIENT_DATA' WHEN recent / nullif(prior, 0) > 1.2 THEN 'GROWING' WHEN recent / nullif(prior, 0) < 0.8 THEN 'DECLINING' ELSE 'STABLE' END AS trend FROM s",
    "migration_flows_displacement": "SELECT s_nationkey AS origin, c_nationkey AS asylum, l_returnflag AS kind, sum(l_quantity) AS persons FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3",
    "migration_flows_asylum": "SELECT c_nationkey AS country, year(o_orderdate) AS yr, o_orderstatus AS outcome, count(*) AS decisions FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3",
    "migration_flows_remittances": f"WITH {Y} SELECT country, yr, round(usd, 2) AS received FROM y WHERE usd > 0 AND yr >= 1996",
    # patents: parts are patents, the brand the assignee, the type the class
    "patent_filings_search": "SELECT p_partkey, p_name, p_type FROM part WHERE contains(lower(p_name), 'red') AND p_type LIKE 'P%' AND p_size BETWEEN 10 AND 30 ORDER BY p_partkey DESC LIMIT 200",
    "patent_filings_trends": "SELECT p_type AS cpc, p_size AS yr, count(*) AS filings, count(*) - lag(count(*)) OVER (PARTITION BY p_type ORDER BY p_size) AS change FROM part GROUP BY 1, 2",
    "patent_filings_assignee": "SELECT p_brand AS assignee, p_size AS yr, count(*) AS filings, count(DISTINCT p_type) AS classes FROM part GROUP BY 1, 2",
    # campaign finance
    "political_risk_signals": "WITH e AS (SELECT o_custkey AS cand, c_mktsegment AS party, sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END) AS support, sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END) AS oppose, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) SELECT party, count(*) AS candidates, round(sum(support), 2) AS support_total, round(sum(oppose), 2) AS oppose_total, round(sum(oppose) / nullif(sum(support) + sum(oppose), 0), 3) AS oppose_ratio, sum(n) AS expenditures FROM e GROUP BY 1",
    "political_risk_candidates": "SELECT c_custkey, c_name, c_mktsegment AS party, c_nationkey AS state FROM customer WHERE c_acctbal > 9000 AND c_mktsegment IN ('BUILDING', 'MACHINERY') ORDER BY c_name, c_custkey LIMIT 100",
    "political_risk_filings": "SELECT o_custkey AS committee, o_orderpriority AS form_type, count(*) AS filings, round(avg(o_totalprice), 2) AS cash_on_hand, round(sum(o_totalprice), 2) AS receipts FROM orders GROUP BY 1, 2",
    "political_risk_expenditures": f"SELECT o_orderkey, o_custkey AS cand, {DAY.format('o_orderdate')} AS day, o_totalprice AS amount, CASE WHEN o_orderstatus = 'O' THEN 'S' ELSE 'O' END AS side FROM orders WHERE o_totalprice >= 100000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 300",
    # prediction markets
    "polymarket_resolved": "SELECT market, count(*) AS trades, round(sum(usdc), 2) AS volume, count(*) FILTER (WHERE correct) AS right_trades FROM trades WHERE resolved GROUP BY 1",
    "polymarket_whales_top_wallets": "WITH w AS (SELECT wallet, count(*) AS trades, count(DISTINCT market) AS markets, sum(usdc) AS volume, count(*) FILTER (WHERE correct AND resolved) AS hits, count(*) FILTER (WHERE resolved) AS judged FROM trades GROUP BY 1) SELECT wallet, trades, markets, round(volume, 2) AS volume, round(hits / judged, 6) AS accuracy FROM w WHERE judged >= 5 ORDER BY hits / judged DESC, round(volume, 2) DESC, wallet LIMIT 50",
    "polymarket_whales_market_whales": "WITH p AS (SELECT market, wallet, sum(CASE WHEN side = 'buy' THEN usdc ELSE 0 END) AS bought, sum(CASE WHEN side = 'sell' THEN usdc ELSE 0 END) AS sold FROM trades GROUP BY 1, 2), r AS (SELECT market, wallet, bought, sold, row_number() OVER (PARTITION BY market ORDER BY round(bought + sold, 2) DESC, wallet) AS k FROM p) SELECT market, wallet, round(bought, 2) AS bought, round(sold, 2) AS sold, CASE WHEN bought > sold THEN 'YES' ELSE 'NO' END AS lean FROM r WHERE k <= 5",
    "polymarket_whales_recent_signals": f"WITH c AS (SELECT market, side, count(DISTINCT wallet) AS wallets, sum(usdc) AS usd, max(ts) AS last FROM trades WHERE ts >= TIMESTAMP '2000-01-01 00:00:00' GROUP BY 1, 2), t AS (SELECT *, sum(wallets) OVER (PARTITION BY market) AS every FROM c) SELECT market, side, wallets, round(usd, 2) AS usd, {DAY.format('last')} AS last_day, CASE WHEN wallets >= 0.7 * every THEN 'consensus' WHEN wallets <= 0.3 * every THEN 'contrarian' ELSE 'whale' END AS kind FROM t",
    # grid: sources are zones
    "power_grid_demand": "WITH l AS (SELECT source AS zone, date_trunc('hour', ts) AS h, sum(value) AS load FROM obs GROUP BY 1, 2) SELECT zone, count(*) AS hours, round(max(load), 6) AS peak, round(avg(load), 6) AS mean, round(max(load) / avg(load), 6) AS peak_factor FROM l GROUP BY 1",
    "power_grid_fuel_mix": f"WITH f AS (SELECT {DAY.format('ts')} AS day, source AS fuel, sum(value) AS mw FROM obs GROUP BY 1, 2) SELECT day, fuel, round(mw, 6) AS mw, round(100.0 * mw / sum(mw) OVER (PARTITION BY day), 4) AS pct FROM f",
    # gazette: documents by source as agency
    "regulatory_gazette_recent": "SELECT doc_id, source, lang FROM documents WHERE lang = 'en' AND n_chars >= 200 ORDER BY doc_id DESC LIMIT 100",
    "regulatory_gazette_search": "SELECT doc_id, source, n_chars FROM documents WHERE contains(lower(text), 'password') OR contains(lower(text), 'license') ORDER BY doc_id DESC LIMIT 100",
    "regulatory_gazette_agency": "SELECT source AS agency, count(*) AS docs, count(*) FILTER (WHERE n_chars >= 2000) AS significant, count(DISTINCT lang) AS languages, max(doc_id) AS newest FROM documents GROUP BY 1",
    # sanctions: suppliers are the listed, their country the programme
    "sanctions_monitor_search": "SELECT s_suppkey, s_name, n_name AS program FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE lower(s_name) LIKE '%00%7' ORDER BY s_name, s_suppkey LIMIT 50",
    "sanctions_monitor_recent": "WITH f AS (SELECT l_suppkey, min(l_shipdate) AS listed, max(l_shipdate) AS updated FROM lineitem GROUP BY 1) SELECT s_suppkey, s_name, concat('', CAST(listed AS DATE)) AS listed, concat('', CAST(updated AS DATE)) AS updated FROM supplier JOIN f ON s_suppkey = l_suppkey ORDER BY f.updated DESC, s_suppkey LIMIT 100",
    "sanctions_monitor_programs": "SELECT n_name AS program, count(*) AS entities, count(*) FILTER (WHERE s_acctbal < 0) AS individuals, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1",
    # satellites
    "satellite_activity_fire": "WITH p AS (SELECT floor((value * 1.7 - 85) / 5) AS cy, floor((obs_id % 360 - 180) / 5) AS cx, value AS frp FROM obs) SELECT cy, cx, count(*) AS hotspots, round(sum(frp), 6) AS frp, round(max(frp), 6) AS strongest FROM p GROUP BY 1, 2 HAVING count(*) >= 2",
    "satellite_activity_vegetation": "WITH v AS (SELECT entity_id AS point, avg(value) / 100 AS ndvi, stddev_pop(value) / 100 AS spread, count(*) AS n FROM obs GROUP BY 1) SELECT point, round(ndvi, 6) AS ndvi, round(spread, 6) AS spread, n, CASE WHEN ndvi < 0.2 THEN 'bare' WHEN ndvi < 0.4 THEN 'stressed' WHEN ndvi < 0.6 THEN 'moderate' ELSE 'healthy' END AS health FROM v",
    "satellite_activity_events": f"SELECT source AS category, {DAY.format('ts')} AS day, count(*) AS open_events, round(max(value), 6) AS largest FROM obs WHERE value >= 30 GROUP BY 1, 2",
    # supply chains
    "supply_chain_monitor_ppi_signals": f"WITH {K}, s AS (SELECT category AS sector, signal, {at(1)} AS v1, {at(2)} AS v2, {at(4)} AS v4 FROM k GROUP BY 1, 2) SELECT sector, signal, v1 AS latest, round((v1 / nullif(v2, 0) - 1) * 100, 2) AS mom_pct, round((v1 / nullif(v4, 0) - 1) * 100, 2) AS three_month_pct, CASE WHEN (v1 / nullif(v2, 0) - 1) * 100 > 2.0 THEN 'RISING' WHEN (v1 / nullif(v2, 0) - 1) * 100 < -2.0 THEN 'FALLING' END AS alert FROM s",
    "supply_chain_monitor_import_signals": f"WITH {K} SELECT signal, {at(1)} AS latest, concat('', max(mth)) AS latest_period, round(({at(1)} / nullif({at(2)}, 0) - 1) * 100, 2) AS mom_pct FROM k WHERE category = 'logistics' GROUP BY 1",
    "supply_chain_monitor_producer_prices": "SELECT p_type AS series, concat('', CAST(date_trunc('month', l_shipdate) AS DATE)) AS mth, round(sum(l_extendedprice) / sum(l_quantity), 4) AS price FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2",
    "supply_chain_monitor_import_prices": "SELECT n_name AS origin, year(l_shipdate) AS yr, round(sum(l_extendedprice * (1 + l_tax)) / sum(l_quantity), 4) AS price FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2",
    "supply_chain_monitor_pressure_index": f"WITH {K}, s AS (SELECT category, signal, ({at(1)} / nullif({at(2)}, 0) - 1) * 100 AS mom FROM k GROUP BY 1, 2) SELECT category, count(*) AS series, round(avg(mom), 2) AS pressure, count(*) FILTER (WHERE mom > 0.5) AS rising, count(*) FILTER (WHERE mom < -0.5) AS falling, count(*) FILTER (WHERE mom > 0.5) >= 4 AS broad FROM s GROUP BY 1",
    # transport
    "transport_throughput_recent": "WITH t AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS mth, s_nationkey AS port, l_linestatus AS measure, sum(l_quantity) AS crossings FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3) SELECT port, measure, concat('', mth) AS mth, crossings FROM t WHERE mth = (SELECT max(mth) FROM t)",
    "transport_throughput_port": "SELECT s_nationkey AS port, concat('', CAST(date_trunc('month', l_shipdate) AS DATE)) AS mth, count(*) AS records, sum(l_quantity) AS crossings FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2",
    # weather
    "weather_alerts_alerts": "SELECT obs_id, source AS kind, CASE WHEN value >= 95 THEN 'Extreme' WHEN value >= 85 THEN 'Severe' ELSE 'Moderate' END AS severity FROM obs WHERE value >= 80 ORDER BY ts DESC, obs_id LIMIT 300",
    "weather_alerts_fires": "WITH z AS (SELECT n_nationkey AS zone, n_nationkey * 4 AS low, n_nationkey * 4 + 4 AS high FROM nation) SELECT zone, count(*) AS hotspots, round(sum(value), 6) AS frp FROM z JOIN (SELECT obs_id, value, floor(value / 4) AS cell FROM obs) p ON p.cell = z.zone AND value >= low AND value < high GROUP BY 1",
    "weather_alerts_summary": "SELECT source AS region, count(*) FILTER (WHERE value >= 85) AS severe, count(*) FILTER (WHERE value < 10) AS hotspots, count(*) AS records FROM obs GROUP BY 1",
    # page views: daily sums of an entity
    "wikipedia_pageviews_spike": f"WITH v AS (SELECT entity_id AS article, CAST(ts AS DATE) AS day, sum(value) AS views FROM obs GROUP BY 1, 2), k AS (SELECT article, views, row_number() OVER (PARTITION BY article ORDER BY day DESC) AS r FROM v), a AS (SELECT article, {at(1, 'views')} AS latest, avg(CASE WHEN r > 1 THEN views END) AS mean, stddev_pop(CASE WHEN r > 1 THEN views END) AS sd, count(*) AS days FROM k GROUP BY 1) SELECT article, round(latest, 6) AS latest, round(mean, 4) AS mean, CASE WHEN sd < 1.0 THEN 99.0 ELSE round((latest - mean) / sd, 4) END AS z FROM a WHERE days >= 7 AND (sd < 1.0 AND latest >= 200 AND (mean < 1.0 OR latest >= mean * 2) OR sd >= 1.0 AND (latest - mean) / nullif(sd, 0) >= 1.5) ORDER BY z DESC, article LIMIT 100",
    "wikipedia_pageviews_detect_spike": "WITH v AS (SELECT source AS article, CAST(ts AS DATE) AS day, count(*) AS views FROM obs GROUP BY 1, 2), b AS (SELECT article, day, views, avg(views) OVER w AS mean, stddev_pop(views) OVER w AS sd, count(*) OVER w AS n FROM v WINDOW w AS (PARTITION BY article ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT article, concat('', day) AS day, views, round((views - mean) / sd, 4) AS z FROM b WHERE n >= 6 AND sd >= 1.0 AND (views - mean) / nullif(sd, 0) >= 1.0",
    "wikipedia_pageviews_top": f"WITH v AS (SELECT {DAY.format('ts')} AS day, entity_id AS article, sum(value) AS views FROM obs GROUP BY 1, 2), k AS (SELECT day, article, views, row_number() OVER (PARTITION BY day ORDER BY round(views, 6) DESC, article) AS place FROM v) SELECT day, place, article, round(views, 6) AS views FROM k WHERE place <= 10",
    "wikipedia_pageviews_series": f"SELECT entity_id AS article, {DAY.format('ts')} AS day, round(sum(value), 6) AS views, count(*) AS requests FROM obs GROUP BY 1, 2",
}


def run(spark: SparkSession, sql: str, frames) -> DataFrame:
    """The statement over DataFrames: frames(name) gives that of a table or view."""
    names = {m.group(2) for m in NAME.finditer(sql)}
    return spark.sql(NAME.sub(r"\1 {\2}", sql), **{n: frames(n) for n in names})


#: Modes whose ladder stands on a mean of observed values. A sum of doubles depends on the order of its rows, so a mean on a step
#: falls to either side of it: values are added as the decimals they are written as, where all of a group have at most ten.
LADDERS = ("disease_surveillance_wastewater", "satellite_activity_vegetation")
WRITTEN = "try_cast(value AS DECIMAL(28, 10))"
STEADY = f"CASE WHEN count(value) = count(CASE WHEN CAST({WRITTEN} AS DOUBLE) = value THEN 1 END) THEN CAST(avg({WRITTEN}) AS DOUBLE) ELSE avg(value) END"


def register(name: str, sql: str) -> None:
    steady = sql.replace("avg(value)", STEADY) if name in LADDERS else sql

    def mode(spark, d):
        return run(spark, steady, lambda n: getattr(views, n)(spark, d) if n in VIEWS else table(spark, d, n))

    mode.__name__ = f"mod_{name}"
    query(sql)(mode)


for _name, _sql in MODES.items():
    register(_name, _sql)
