"""Scans and sinks over the observation tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query
from ..session import parts
from ..sources import store
from ..sources.tables import PartitionedTable
from .views import bars, country_events, entities, links, obs, series, table


@query("SELECT obs_id, entity_id, source, epoch_us(ts) AS us, value FROM obs WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12'")
def src_read_observations(spark, d):
    return store.read_observations(obs(spark, d), "2024-01-05", "2024-01-12").select("obs_id", "entity_id", "source", F.unix_micros("ts").alias("us"), "value")


@query("SELECT obs_id, epoch_us(ts) AS us, value FROM obs WHERE entity_id = 'customer:7' AND ts >= TIMESTAMP '2024-01-03' ORDER BY ts DESC, obs_id LIMIT 20")
def src_read_entity_observations(spark, d):
    df = store.given(obs(spark, d), entity_id="customer:7", since_ts="2024-01-03")
    return store.newest(df, "ts", 20, ["obs_id"]).select("obs_id", F.unix_micros("ts").alias("us"), "value")


@query("SELECT obs_id, props FROM obs WHERE source = 'click' OR source = (SELECT min(source) FROM obs) ORDER BY ts DESC, obs_id LIMIT 50")
def src_read_landing(spark, d):
    o = obs(spark, d)
    least = o.agg(F.min("source").alias("least"))
    df = o.join(F.broadcast(least)).where("source = 'click' or source = least")  # one row
    return store.newest(df, "ts", 50, ["obs_id"]).select("obs_id", "props")


@query("SELECT source, count(*) AS n, epoch_us(max(ts)) AS latest_us FROM obs GROUP BY source")
def src_list_sources(spark, d):
    return obs(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.unix_micros(F.max("ts")).alias("latest_us"))


@query("SELECT signal, CAST(d AS VARCHAR) AS d, value FROM series WHERE signal = 'orders.BUILDING' AND d >= DATE '1997-01-01' ORDER BY series.d DESC LIMIT 100")
def src_read_signals(spark, d):
    df = store.given(series(spark, d), signal="orders.BUILDING", since_d="1997-01-01")
    return store.newest(df, "d", 100).select("signal", F.col("d").cast("string").alias("d"), "value")


@query("SELECT signal, CAST(d AS VARCHAR) AS d, value FROM series WHERE signal LIKE 'priority.%' AND d BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'")
def src_read_signals_by_prefix(spark, d):
    df = series(spark, d).where(F.col("signal").startswith("priority.") & F.col("d").between("1996-01-01", "1996-12-31"))
    return df.select("signal", F.col("d").cast("string").alias("d"), "value")


FEATURES = """f AS (SELECT o_custkey % 50 AS name, o_orderpriority AS version, CAST(o_orderdate AS DATE) AS effective_at, o_orderkey AS computed_at, o_totalprice AS value FROM orders)"""


def features(spark, d):
    return table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("name"), F.col("o_orderpriority").alias("version"), F.to_date("o_orderdate").alias("effective_at"), F.col("o_orderkey").alias("computed_at"), F.col("o_totalprice").alias("value"))


@query(f"WITH {FEATURES} SELECT name, version, CAST(effective_at AS VARCHAR) AS effective_at, value FROM f WHERE name = 3 AND version = '1-URGENT' AND effective_at >= DATE '1995-06-01' ORDER BY f.effective_at DESC, computed_at LIMIT 25")
def src_read_features(spark, d):
    df = store.given(features(spark, d), name=3, version="1-URGENT", since_effective_at="1995-06-01")
    return store.newest(df, "effective_at", 25, ["computed_at"]).select("name", "version", F.col("effective_at").cast("string"), "value")


@query("SELECT entity_id, name FROM entities WHERE entity_type = 'customer' ORDER BY entity_id LIMIT 40 OFFSET 20")
def src_read_entities(spark, d):
    return store.page(store.given(entities(spark, d), entity_type="customer"), ["entity_id"], 40, 20).select("entity_id", "name")


@query("SELECT * FROM links WHERE link_type = 'located_in' AND confidence >= 0.5 ORDER BY entity_a, entity_b LIMIT 30 OFFSET 5")
def src_read_links(spark, d):
    return store.page(store.given(links(spark, d), link_type="located_in", least_confidence=0.5), ["entity_a", "entity_b"], 30, 5)


@query(f"""WITH {FEATURES}, o AS (SELECT * FROM f WHERE computed_at % 2 = 0 UNION ALL SELECT * FROM f WHERE computed_at % 2 = 1 AND value > 5000 AND name < 10), r AS (SELECT *, row_number() OVER (PARTITION BY name, version, effective_at ORDER BY computed_at DESC) AS k FROM o)
SELECT name, version, CAST(effective_at AS VARCHAR) AS effective_at, computed_at, value FROM r WHERE k = 1""")
def src_upsert_features(spark, d):
    """A table partitioned by name; a batch for ten names, of which invalid rows are left out, replaces older rows of its keys. The table is then read back."""
    keys = ["name", "version", "effective_at"]
    first = features(spark, d).where("computed_at % 2 = 0")
    t = PartitionedTable.create(store.upsert(first.limit(0), first, keys, "computed_at"), ["name"])
    t.upsert(features(spark, d).where("computed_at % 2 = 1 and name < 10"), keys, "computed_at", valid=F.col("value") > 5000)
    return t.read().select("name", "version", F.col("effective_at").cast("string"), "computed_at", "value")


@query("SELECT entity_id, name FROM entities WHERE name <> '' AND entity_id NOT IN (SELECT entity_id FROM entities WHERE entity_type IN ('nation', 'region'))")
def src_register_entities(spark, d):
    e = entities(spark, d)
    return store.insert_ignore(e.where("entity_type in ('nation', 'region')"), e.where("name <> ''"), ["entity_id"], ["name"]).select("entity_id", "name")


@query("SELECT entity_type AS source, name AS external_id, min(entity_id) AS entity_id FROM entities WHERE entity_type <> 'region' GROUP BY 1, 2")
def src_add_aliases(spark, d):
    e = entities(spark, d).select(F.col("entity_type").alias("source"), F.col("name").alias("external_id"), "entity_id")
    return store.insert_ignore(e.where("source = 'region'"), e, ["source", "external_id"], ["entity_id"]).select("source", "external_id", "entity_id")


@query("SELECT entity_a, entity_b, link_type FROM links WHERE entity_a <> entity_b AND link_type <> 'part_of'")
def src_link_entities(spark, d):
    k = links(spark, d)
    return store.insert_ignore(k.where("link_type = 'part_of'"), k.union(k).where("entity_a <> entity_b"), ["entity_a", "entity_b", "link_type"], ["confidence"]).select("entity_a", "entity_b", "link_type")


@query("SELECT obs_id, entity_id FROM obs WHERE NOT (ts >= TIMESTAMP '2024-01-10 06:00:00' AND ts < TIMESTAMP '2024-01-20 18:00:00')")
def src_delete_alerts(spark, d):
    """Alerts by day; those of a half-open range go, whole days with their folders, and the table is read back."""
    t = PartitionedTable.create(obs(spark, d).select("obs_id", "entity_id", "ts", F.to_date("ts").alias("day")), ["day"])
    since, until = (F.lit(x).cast("timestamp") for x in ("2024-01-10 06:00:00", "2024-01-20 18:00:00"))
    t.delete((F.col("ts") >= since) & (F.col("ts") < until))
    return t.read().select("obs_id", "entity_id")


@query("SELECT o_custkey % 40 AS variable, o_orderkey AS version, true AS stale, o_custkey % 40 >= 20 AS changed FROM orders")
def src_mark_beliefs_stale(spark, d):
    """All beliefs that aren't stale yet become so; partitions in which all are keep their files. `changed` tells which were not."""
    b = table(spark, d, "orders").select((F.col("o_custkey") % 40).alias("variable"), F.col("o_orderkey").alias("version"), (F.col("o_custkey") % 40 < 20).alias("stale"), F.lit(False).alias("changed"))
    t = PartitionedTable.create(b, ["variable"])
    t.update(~F.col("stale"), stale=F.lit(True), changed=F.lit(True))
    return t.read().select("variable", "version", "stale", "changed")


@query("""SELECT o_orderkey AS id, o_totalprice AS reward, 'completed' AS state FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
UNION ALL SELECT o_orderkey, o_totalprice, 'pending' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def src_complete_pending(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    n = parts(li)
    pending = o.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("reward")).repartition(n, "id")
    outcomes = li.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id")).repartition(n, "id").distinct()
    return store.with_state(pending, outcomes, "id")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01')")
def src_signal_ledger(spark, d):
    surfaced = table(spark, d, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("id"))
    realised = table(spark, d, "lineitem").where("l_shipdate < timestamp_ntz '1998-01-01 00:00:00'").select(F.col("l_orderkey").alias("id"))
    return surfaced.join(realised, "id", "left_anti")


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gs'), '<[^>]+>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) AS text FROM pages""")
def src_pages_to_text(spark, d):
    return table(spark, d, "pages").select("page_id", pages_text(F.col("html")).alias("text"))


def pages_text(html):
    bare = F.regexp_replace(html, r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"<[^>]+>", " "), r"[ \t\r\n]+", " "))


@query("SELECT p_brand, string_agg(p_name || ' ' || p_type || ' ' || p_size, chr(10) ORDER BY p_partkey) AS text FROM part GROUP BY 1")
def src_flatten_csv_to_text(spark, d):
    p = table(spark, d, "part").select("p_brand", "p_partkey", F.concat_ws(" ", "p_name", "p_type", "p_size").alias("line"))
    lines = F.sort_array(F.collect_list(F.struct("p_partkey", "line")))
    return p.groupBy("p_brand").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"))


@query("SELECT brand, count(*) AS bars, CAST(min(d) AS VARCHAR) AS first_day, CAST(max(d) AS VARCHAR) AS last_day FROM bars GROUP BY brand")
def src_bars_census(spark, d):
    return bars(spark, d).groupBy("brand").agg(F.count("*").alias("bars"), F.min("d").cast("string").alias("first_day"), F.max("d").cast("string").alias("last_day"))


@query("SELECT entity_id, quad, count(*) AS n FROM country_events WHERE ts >= TIMESTAMP '1998-01-01' GROUP BY 1, 2")
def src_event_batches(spark, d):
    return store.read_observations(country_events(spark, d), since="1998-01-01").groupBy("entity_id", "quad").agg(F.count("*").alias("n"))
