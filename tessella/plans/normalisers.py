"""Normalisers over landing payloads that are built from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query
from ..session import parts
from ..sources import normalise
from .views import bars, country_events, table, trades


def landing(df, source: str, field: str, group):
    """One landed payload per group: {field: [records]}."""
    g = df.groupBy(group.alias("g")).agg(F.collect_list(F.struct(*df.columns)).alias(field))
    return g.select(F.lit(source).alias("source"), F.lit(1.7e9).alias("fetched_at"), F.to_json(F.struct(field)).alias("data"))


def of(source: str, kind: str | None = None):
    return [s for s in normalise.SPECS if s.source == source and kind in (None, s.observation_type)]


KEY = "substr(sha256('{kind}:' || {key}), 1, 16)"


@query(f"SELECT {KEY.format(kind='country', key='entity_id')} AS entity_id, event_key || ':' || event_line || ':' || event_part AS event_id, score AS goldstein FROM country_events")
def nrm_gdelt(spark, d):
    e = country_events(spark, d)
    rows = e.select(F.concat_ws(":", "event_key", "event_line", "event_part").alias("id"), F.date_format("ts", "yyyyMMdd").alias("date"), F.col("entity_id").alias("actor1"), F.lit("").alias("actor2"), F.col("score").alias("goldstein"), F.col("quad").alias("quad_class"))
    out = normalise.observations(landing(rows, "gdelt", "events", F.col("date")), of("gdelt"))
    return out.select("entity_id", F.get_json_object("value_json", "$.event_id").alias("event_id"), F.get_json_object("value_json", "$.goldstein").cast("double").alias("goldstein"))


@query(f"SELECT {KEY.format(kind='wallet', key='wallet')} AS entity_id, count(*) AS n, round(sum(usdc), 4) AS volume FROM trades GROUP BY 1")
def nrm_polymarket_whales(spark, d):
    t = trades(spark, d).select("wallet", F.col("usdc").alias("total_volume"), F.col("price").alias("accuracy"), "market")
    rows = t.select("wallet", "total_volume", "accuracy", F.col("market").alias("markets"))
    out = normalise.observations(landing(rows, "polymarket_whales", "wallets", F.col("markets")), of("polymarket_whales"))
    return out.groupBy("entity_id").agg(F.count("*").alias("n"), F.round(F.sum(F.get_json_object("value_json", "$.total_volume").cast("double")), 4).alias("volume"))


@query(f"SELECT DISTINCT {KEY.format(kind='person', key='c_custkey')} AS entity_a, {KEY.format(kind='company', key='l_suppkey')} AS entity_b, 'works_for' AS link_type FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey")
def nrm_insider_filings_links(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    rows = j.select(F.col("o_custkey").cast("string").alias("reporter_cik"), F.col("l_suppkey").cast("string").alias("issuer_cik"), F.col("l_quantity").alias("shares"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"))
    return normalise.links(landing(rows, "insider_filings", "transactions", F.col("issuer_cik")), of("insider_filings")).select("entity_a", "entity_b", "link_type")


@query("SELECT l_shipdate::DATE::VARCHAR AS day, count(*) AS n FROM lineitem GROUP BY 1")
def nrm_insider_filings(spark, d):
    li = table(spark, d, "lineitem")
    rows = li.select(F.col("l_orderkey").cast("string").alias("reporter_cik"), F.col("l_suppkey").cast("string").alias("issuer_cik"), F.col("l_quantity").alias("shares"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"))
    out = normalise.observations(landing(rows, "insider_filings", "transactions", F.col("issuer_cik")), of("insider_filings"))
    return out.groupBy(F.to_date(F.timestamp_seconds("observed_at")).cast("string").alias("day")).agg(F.count("*").alias("n"))


@query(f"SELECT {KEY.format(kind='vessel', key='user_id')} AS entity_id, epoch_us(ts) // 1000000 AS s, round(value, 6) AS lat FROM events")
def nrm_ais_vessel(spark, d):
    e = table(spark, d, "events")
    rows = e.select(F.col("user_id").cast("string").alias("mmsi"), F.col("value").alias("lat"), F.col("value").alias("lon"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("double").alias("timestamp"))
    out = normalise.observations(landing(rows, "ais_vessel", "vessels", F.col("mmsi")), of("ais_vessel", "vessel_position"))
    return out.select("entity_id", F.col("observed_at").cast("long").alias("s"), F.round(F.get_json_object("value_json", "$.lat").cast("double"), 6).alias("lat"))


LATEST = "WITH r AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY brand ORDER BY d)) AS lr, row_number() OVER (PARTITION BY brand ORDER BY d DESC) AS back FROM bars)"


def histories(spark, d, observed: str):
    """One history a brand, its bars in the order of days."""
    bar = F.struct(F.date_format("d", "yyyy-MM-dd").alias("date"), *[F.col(c).cast("double").alias(c) for c in ("close", "high", "low", "volume")])
    one = bars(spark, d).groupBy(F.lower("brand").alias("ticker")).agg(F.array_sort(F.collect_list(bar)).alias("bars"))
    payload = one.select(F.lit("instrument_universe").alias("source"), F.lit(1.7e9).alias("fetched_at"), F.to_json(F.struct(F.array(F.struct("ticker", "bars")).alias("histories"))).alias("data"))
    out = normalise.observations(payload, of("instrument_universe", observed))
    number = lambda c: F.round(F.get_json_object("value_json", f"$.{c}").cast("double"), 4).alias(c)
    return out.select("entity_id", F.col("observed_at").cast("long").alias("observed_s"), *[number(c) for c in of("instrument_universe", observed)[0].value])


INSTRUMENT = KEY.format(kind="instrument", key="upper(brand)")
NEWEST = f"{INSTRUMENT} AS entity_id, max(CASE WHEN back = 1 THEN CAST(epoch(CAST(d AS TIMESTAMP)) AS BIGINT) END) AS observed_s"


@query(f"{LATEST} SELECT {NEWEST}, round(max(CASE WHEN back = 1 THEN lr END), 4) AS log_return, round(max(CASE WHEN back = 1 THEN close END), 4) AS close FROM r GROUP BY brand HAVING count(*) > 1")
def nrm_instrument_universe_return(spark, d):
    return histories(spark, d, "instrument_return")


@query(f"{LATEST} SELECT {NEWEST}, round(max(CASE WHEN back = 1 THEN CAST(volume AS DOUBLE) END), 4) AS volume, round(avg(CASE WHEN back <= 20 THEN CAST(volume AS DOUBLE) END), 4) AS avg_volume_20d FROM r GROUP BY brand")
def nrm_instrument_universe_volume(spark, d):
    return histories(spark, d, "instrument_volume")


@query(f"{LATEST} SELECT {NEWEST}, round(stddev_pop(CASE WHEN back <= 20 THEN lr END) * sqrt(252), 4) AS realized_vol_20d, round(max(CASE WHEN back = 1 THEN CAST(high AS DOUBLE) - CAST(low AS DOUBLE) END), 4) AS intraday_range FROM r GROUP BY brand HAVING count(*) > 2")
def nrm_instrument_universe_volatility(spark, d):
    return histories(spark, d, "instrument_volatility")


def linked(payload, source: str, lookups=None):
    return normalise.links(payload, of(source), lookups).select("entity_a", "entity_b", "link_type")


def link(a: tuple[str, str], b: tuple[str, str], kind: str) -> str:
    return f"SELECT DISTINCT {KEY.format(kind=a[0], key=a[1])} AS entity_a, {KEY.format(kind=b[0], key=b[1])} AS entity_b, '{kind}' AS link_type"


@query(
    f"WITH p AS (SELECT p_partkey, p_brand, p_type, 'K' || p_size AS c FROM part) {link(('instrument', "'P' || p_partkey"), ('company', 'p_brand'), 'tracks_issuer')} FROM p UNION {link(('instrument', "'P' || p_partkey"), ('country', 'c'), 'located_in')} FROM p "
    f"UNION {link(('company', 'p_brand'), ('country', 'c'), 'located_in')} FROM p UNION {link(('instrument', "'P' || p_partkey"), ('protocol', 'p_type'), 'tracks_protocol')} FROM p"
)
def nrm_instrument_universe_links(spark, d):
    p = table(spark, d, "part")
    rows = p.select(F.concat(F.lit("p"), "p_partkey").alias("ticker"), F.concat(F.lit(" "), "p_brand").alias("issuer"), F.concat(F.lit("K"), "p_size").alias("country"), F.col("p_type").alias("protocol"), F.floor(F.col("p_partkey") / 500).alias("batch"))
    return linked(landing(rows, "instrument_universe", "instruments", F.col("batch")), "instrument_universe")


@query(f"{link(('company', "'o' || o_custkey"), ('company', "'h' || l_suppkey"), 'debtor_of')} FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def nrm_creditor_filings_links(spark, d):
    li = table(spark, d, "lineitem")
    n = parts(li)
    j = li.select("l_orderkey", "l_suppkey").repartition(n, "l_orderkey").join(table(spark, d, "orders").select("o_orderkey", "o_custkey").repartition(n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    charges = j.groupBy("o_custkey", "o_orderkey").agg(F.collect_set(F.concat(F.lit("h"), "l_suppkey")).alias("holders"))
    data = F.to_json(F.struct(F.concat(F.lit(" o"), "o_custkey").alias("company_name"), F.array(F.struct(F.lit("c").alias("charge_code"), "holders")).alias("charges")))
    return linked(charges.select(F.lit("creditor_filings").alias("source"), F.lit(1.7e9).alias("fetched_at"), data.alias("data")), "creditor_filings")


DOMAINS = link(("domain", "'www.S' || s_suppkey || '.com'"), ("company", "s_name"), "domain_owned_by") + " FROM supplier"


def owned(spark, d, source: str, field: str, value):
    """Domains of suppliers, whose owners a table of base names gives."""
    s = table(spark, d, "supplier").withColumn("base", F.concat(F.lit("s"), "s_suppkey"))
    data = F.to_json(F.struct(F.concat(F.lit("www.S"), "s_suppkey", F.lit(".com")).alias("domain"), value.alias(field)))
    return linked(s.select(F.lit(source).alias("source"), F.lit(1.7e9).alias("fetched_at"), data.alias("data")), source, {"domain_company": s.select(F.col("base").alias("code"), F.col("s_name").alias("target"))})


@query(DOMAINS)
def nrm_cert_transparency_links(spark, d):
    return owned(spark, d, "cert_transparency", "certs", F.array(F.struct(F.col("s_name").alias("common_name"))))


@query(DOMAINS)
def nrm_dns_monitor_links(spark, d):
    return owned(spark, d, "dns_monitor", "analysis", F.struct(F.col("s_nationkey").alias("record_count")))


@query(f"{link(('topic', "'o' || o_orderkey"), ('instrument', "'C' || c_custkey"), 'topic_relates_to_instrument')} FROM orders JOIN customer ON c_mktsegment || c_custkey % 50 = (CASE o_orderstatus WHEN 'F' THEN 'BUILDING' ELSE 'MACHINERY' END) || o_custkey % 50")
def nrm_polymarket_links(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    rows = o.select(F.concat(F.lit("o"), "o_orderkey").alias("condition_id"), F.concat(F.when(F.col("o_orderstatus") == "F", "BUILDING").otherwise("MACHINERY"), F.col("o_custkey") % 50).alias("category"), F.floor(F.col("o_orderkey") / 500).alias("batch"))
    tickers = c.select(F.concat("c_mktsegment", F.col("c_custkey") % 50).alias("code"), F.concat(F.lit("C"), "c_custkey").alias("target"))
    return linked(landing(rows, "polymarket", "markets", F.col("batch")), "polymarket", {"topic_instrument": tickers})


@query(f"{link(('sanctioned', "'un:' || s_suppkey"), ('country', 'lower(n_name)'), 'sanctioned_under')} FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey <> 0")
def nrm_sanctions_monitor_links(spark, d):
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    rows = s.select(F.lit("un").alias("source"), F.col("s_suppkey").cast("string").alias("entity_id"), F.array(F.concat(F.lit("prog"), "s_nationkey"), F.lit("none")).alias("programs"), F.floor(F.col("s_suppkey") / 500).alias("batch"))
    programmes = n.where("n_regionkey <> 0").select(F.concat(F.lit("PROG"), "n_nationkey").alias("code"), F.lower("n_name").alias("target"))
    return linked(landing(rows, "sanctions_monitor", "records", F.col("batch")), "sanctions_monitor", {"program_country": programmes})
