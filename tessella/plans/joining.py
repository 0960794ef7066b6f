"""Interval, as-of, spatial, self, semi and anti joins over the observation tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.joins import alike_counts, asof_join, equirect_km, interval_join, latest, packed, proximity_join, seconds
from ..registry import query
from ..session import parts
from .views import bars, country_events, entities, links, obs, obs_dup, positioning, series, table, trades

HOURS = 3600.0


def co_occurrences(a, b, window):
    """Pairs of observations of the same entity within window seconds; delta = ta - tb."""
    return interval_join(a, b, window, ["entity_id"])


@query("""SELECT a.obs_id AS id_a, b.obs_id AS id_b, round(epoch(a.ts) - epoch(b.ts), 3) AS delta FROM obs a JOIN obs b ON a.entity_id = b.entity_id
WHERE a.source = (SELECT min(source) FROM obs) AND b.source = (SELECT max(source) FROM obs) AND abs(epoch(a.ts) - epoch(b.ts)) <= 259200""")
def join_co_occurrence(spark, d):
    o = obs(spark, d)
    ends = F.broadcast(o.agg(F.min("source").alias("s0"), F.max("source").alias("s1")))  # one row
    a, b = (o.join(ends).where(f"source = {s}").drop("s0", "s1") for s in ("s0", "s1"))
    return co_occurrences(a, b, 72 * HOURS).select(F.col("l.obs_id").alias("id_a"), F.col("r.obs_id").alias("id_b"), F.round("delta", 3).alias("delta"))


def linked(observations, edges, link_type: str):
    """Observations with the entities that links of a type lead to, as entity_b."""
    k = edges.where(F.col("link_type") == link_type).select(F.col("entity_a").alias("entity_id"), "entity_b")
    return observations.join(k, "entity_id")


#: Observations span a month and country events seven years: the month is stretched over the years, so that all of both meet.
STRETCH = 83
WIDE = f"wide AS (SELECT obs_id, entity_id, source, value, make_timestamp(788918400000000 + (epoch_us(ts) - 1704067200000000) * {STRETCH}) AS ts FROM obs)"


def wide(spark, d):
    us = F.lit(788_918_400_000_000) + (F.unix_micros("ts") - F.lit(1_704_067_200_000_000)) * STRETCH
    return obs(spark, d).withColumn("ts", F.timestamp_micros(us))


def closeness(window: float, score: str = "r.score"):
    """Of a pair of an interval join: abs(score)/10 * max(0, 1 - |dt|/window)."""
    return F.abs(score) / 10 * F.greatest(F.lit(0.0), 1 - F.abs("delta") / window)


EVENT = ["event_key", "event_line", "event_part"]


def event_pairs(spark, d, a, e, window: float, alike: list[str], **columns):
    """obs_id, the event's columns and those given of all pairs of observations and events of their linked country (entity_b).

    Observations of one time, and events of one time that are equal in `alike`, meet as packs: a pair's columns are made
    once for two packs, of which l holds the events and r the observations, and its rows are only written out.
    """
    of_event, of_seen = ["entity_b", "ts", *alike], [c for c in a.columns if c != "obs_id"]
    events, seen = packed(e, of_event, EVENT), packed(a, of_seen, ["obs_id"])
    # the events are the longer side: only the observations are dealt into two buckets
    met = interval_join(events, seen, window, ["entity_b"], into=parts(table(spark, d, "lineitem")), counts=(alike_counts(e, of_event), alike_counts(a, of_seen)))
    met = met.select(F.round(F.lit(0.0) - F.col("delta"), 3).alias("delta"), *[c.alias(n) for n, c in columns.items()], F.col("l.rows").alias("events"), F.col("r.rows").alias("seen"))
    each = met.select("delta", *columns, "seen", F.explode("events").alias("e")).select("delta", *columns, "e", F.explode("seen").alias("o"))
    return each.select("o.obs_id", *[f"e.{c}" for c in EVENT], "delta", *columns)


def event_scores(spark, d, window: float, least: float, source: str | None = None, weight=None):
    """Observations paired with events of the linked country, scored by closeness; weight is of the observation's value."""
    o = wide(spark, d)
    a = linked(o.where(F.col("source") == source) if source else o, links(spark, d), "headquartered_in").select("obs_id", "entity_b", "ts", *([] if weight is None else ["value"]))
    e = country_events(spark, d).where(F.col("score") <= least).withColumnRenamed("entity_id", "entity_b")
    s = closeness(window, "l.score")
    return event_pairs(spark, d, a, e, window, ["score"], score=F.round(s if weight is None else s * weight, 6))


def scored_sql(window: int, least: float, where: str = "true", weight: str = "1") -> str:
    """A CTE list that ends in sc, the scored pairs."""
    return f"""WITH {WIDE}, sc AS (SELECT o.obs_id, e.event_key, e.event_line, e.event_part, round(epoch(o.ts) - epoch(e.ts), 3) AS delta,
  round(abs(e.score) / 10 * greatest(0, 1 - abs(epoch(o.ts) - epoch(e.ts)) / {window}.0) * {weight}, 6) AS score
FROM wide o JOIN links k ON k.entity_a = o.entity_id AND k.link_type = 'headquartered_in' JOIN country_events e ON e.entity_id = k.entity_b
WHERE e.score <= {least} AND abs(epoch(o.ts) - epoch(e.ts)) <= {window} AND {where})"""


@query(scored_sql(259200, -2) + " SELECT * FROM sc")
def join_insider_x_event(spark, d):
    return event_scores(spark, d, 72 * HOURS, -2)


@query(scored_sql(172800, -9.5, "o.source = 'error'") + " SELECT * FROM sc")
def join_vessel_x_sanctions(spark, d):
    return event_scores(spark, d, 48 * HOURS, -9.5, "error")


@query(scored_sql(86400, -5, weight="least(o.value / 100.0, 1)") + " SELECT * FROM sc")
def join_transfer_x_event(spark, d):
    return event_scores(spark, d, 24 * HOURS, -5, weight=F.least(F.col("r.value") / 100, F.lit(1.0)))


@query(scored_sql(259200, -2) + " SELECT obs_id, count(*) AS patterns, max(score) AS best, 3 AS depth FROM sc WHERE score >= 0.5 GROUP BY 1")
def join_store_l3(spark, d):
    """Events of one country, time and score pair alike: they are counted first, so pairs grow with the observations alone."""
    a = linked(wide(spark, d), links(spark, d), "headquartered_in").select("obs_id", "ts", "entity_b")
    e = country_events(spark, d).where("score <= -2").groupBy(F.col("entity_id").alias("entity_b"), "ts", "score").agg(F.count("*").alias("n"))
    s = interval_join(a, e, 72 * HOURS, ["entity_b"]).select(F.col("l.obs_id").alias("obs_id"), F.col("r.n").alias("n"), F.round(closeness(72 * HOURS), 6).alias("score"))
    return s.where("score >= 0.5").groupBy("obs_id").agg(F.sum("n").alias("patterns"), F.max("score").alias("best"), F.lit(3).alias("depth"))


@query(f"""WITH {WIDE} SELECT a.obs_id AS obs_a, e.event_key, e.event_line, e.event_part, k.entity_b AS country, round(epoch(a.ts) - epoch(e.ts), 3) AS delta FROM wide a JOIN links k ON k.entity_a = a.entity_id
JOIN country_events e ON e.entity_id = k.entity_b WHERE k.link_type = 'headquartered_in' AND a.source = 'purchase' AND e.quad = 4 AND abs(epoch(a.ts) - epoch(e.ts)) <= 86400""")
def join_linked_co_occurrence(spark, d):
    """Observations of one source near those of another on a linked entity, for all linked pairs at once."""
    a = linked(wide(spark, d).where("source = 'purchase'"), links(spark, d), "headquartered_in").select("obs_id", "entity_b", "ts")
    b = country_events(spark, d).where("quad = 4").withColumnRenamed("entity_id", "entity_b")
    out = event_pairs(spark, d, a, b, 24 * HOURS, [], country=F.col("l.entity_b"))
    return out.select(F.col("obs_id").alias("obs_a"), *EVENT, "country", "delta")


GRID = "g AS (SELECT entity_id, TIMESTAMP '2024-01-02' + INTERVAL (i) DAY AS t FROM (SELECT DISTINCT entity_id FROM obs), range(28) x(i))"


def grid(spark, d):
    days = spark.range(28).select(F.expr("timestamp '2024-01-02' + make_interval(0, 0, 0, cast(id as int))").alias("t"))
    return obs(spark, d).select("entity_id").distinct().join(F.broadcast(days))  # 28 rows


@query(f"""WITH {GRID}, a AS (SELECT g.entity_id, g.t, max(o.ts) AS ts FROM g LEFT JOIN obs o ON o.entity_id = g.entity_id AND o.ts <= g.t GROUP BY 1, 2),
v AS (SELECT a.*, (SELECT max(value) FROM obs o WHERE o.entity_id = a.entity_id AND o.ts = a.ts) AS value FROM a)
SELECT entity_id, epoch_us(t) AS us, CASE WHEN epoch(t) - epoch(ts) <= 86400 THEN value END AS value FROM v""")
def join_asof_locf(spark, d):
    out = asof_join(grid(spark, d), obs(spark, d), ["entity_id"], "t", "ts", "value")
    fresh = seconds("t") - seconds(F.col("found.ts")) <= 86_400
    return out.select("entity_id", F.unix_micros("t").alias("us"), F.when(fresh, F.col("found.value")).alias("value"))


@query("""WITH p AS (SELECT brand, week, longs, week + INTERVAL 3 DAY AS known FROM positioning),
a AS (SELECT p.brand, p.week, p.longs, min(b.d) AS entry FROM p JOIN bars b ON b.brand = p.brand AND b.d >= p.known AND b.d <= p.known + INTERVAL 7 DAY GROUP BY 1, 2, 3)
SELECT a.brand, CAST(a.week AS VARCHAR) AS week, CAST(a.entry AS VARCHAR) AS entry, b.close FROM a JOIN bars b ON b.brand = a.brand AND b.d = a.entry""")
def join_asof_forward(spark, d):
    p = positioning(spark, d).withColumn("known", F.date_add("week", 3))
    out = asof_join(p, bars(spark, d).withColumnRenamed("d", "day"), ["brand"], "known", "day", "close", "forward")
    near = F.date_diff(F.col("found.ts"), F.col("known")) <= 7
    return out.where(near).select("brand", F.col("week").cast("string").alias("week"), F.col("found.ts").cast("string").alias("entry"), F.col("found.value").alias("close"))


def nearest(left, right, keys, left_ts, right_ts, value):
    """left with `near`, the closest right row in time on either side; the earlier one wins a tie."""
    back = asof_join(left, right, keys, left_ts, right_ts, value).withColumnRenamed("found", "_before")
    both = asof_join(back, right, keys, left_ts, right_ts, value, "forward").withColumnRenamed("found", "_after")
    gap = lambda x: F.abs(F.date_diff(F.col(f"{x}.ts"), F.col(left_ts)))
    return both.withColumn("near", F.when(F.col("_after").isNull() | (gap("_before") <= gap("_after")), F.col("_before")).otherwise(F.col("_after"))).drop("_before", "_after")


@query("""WITH t AS (SELECT brand, d, close, CAST(d + INTERVAL 29 DAY AS DATE) AS target FROM bars),
c AS (SELECT t.brand, t.d, t.close, b.d AS fd, b.close AS fc, row_number() OVER (PARTITION BY t.brand, t.d ORDER BY abs(b.d - t.target), b.d) AS k FROM t JOIN bars b ON b.brand = t.brand AND abs(b.d - t.target) < 3)
SELECT brand, CAST(d AS VARCHAR) AS d, CAST(fd AS VARCHAR) AS future, round((fc - close) / abs(close), 6) AS label FROM c WHERE k = 1""")
def join_asof_nearest(spark, d):
    b = bars(spark, d).select("brand", "d", "close")
    out = nearest(b.withColumn("target", F.date_add("d", 29)), b.select("brand", F.col("d").alias("fd"), F.col("close").alias("fc")), ["brand"], "target", "fd", "fc")
    ok = (F.abs(F.date_diff("near.ts", "target")) < 3) & (F.col("near.ts") != F.col("d"))
    return out.where(ok).select("brand", F.col("d").cast("string").alias("d"), F.col("near.ts").cast("string").alias("future"), F.round((F.col("near.value") - F.col("close")) / F.abs("close"), 6).alias("label"))


@query("""WITH l AS (SELECT brand, max(d) AS last FROM bars GROUP BY 1), c AS (SELECT b.brand, b.d, b.close, l.last, row_number() OVER (PARTITION BY b.brand ORDER BY abs(b.d - (l.last - 365)), b.d) AS k
FROM bars b JOIN l ON l.brand = b.brand WHERE abs(b.d - (l.last - 365)) <= 73) SELECT brand, CAST(d AS VARCHAR) AS d, close FROM c WHERE k = 1""")
def join_nearest_within(spark, d):
    return closest_to_last(bars(spark, d), 365, 73)


def closest_to_last(b, days: int, tolerance: int):
    last = Window.partitionBy("brand")
    off = F.abs(F.date_diff("d", F.date_sub(F.max("d").over(last), days)))
    near = b.withColumn("off", off).where(F.col("off") <= tolerance)
    return near.groupBy("brand").agg(F.min_by(F.struct("d", "close"), F.struct("off", "d")).alias("x")).select("brand", F.col("x.d").cast("string").alias("d"), "x.close")


@query("""WITH c AS (SELECT brand, d, close, row_number() OVER (PARTITION BY brand ORDER BY abs(d - DATE '1997-06-15'), bars.d DESC) AS k FROM bars WHERE abs(d - DATE '1997-06-15') <= 10)
SELECT brand, CAST(d AS VARCHAR) AS d, close FROM c WHERE k = 1""")
def join_closest_value(spark, d):
    off = F.abs(F.date_diff("d", F.lit("1997-06-15").cast("date")))
    near = bars(spark, d).withColumn("off", off).where("off <= 10")
    return near.groupBy("brand").agg(F.min_by(F.struct("d", "close"), F.struct("off", -F.unix_date("d"))).alias("x")).select("brand", F.col("x.d").cast("string").alias("d"), "x.close")


@query("SELECT obs_id, entity_id, source, value FROM (SELECT *, rank() OVER (PARTITION BY entity_id, source ORDER BY ts DESC) AS k FROM obs) WHERE k = 1")
def join_latest_per_key(spark, d):
    return latest(obs(spark, d), ["entity_id", "source"], "ts").select("obs_id", "entity_id", "source", "value")


@query("SELECT entity_a AS entity_id, entity_b AS other, link_type FROM links WHERE confidence >= 0.75 UNION SELECT entity_b, entity_a, link_type FROM links WHERE confidence >= 0.75")
def join_entity_links(spark, d):
    k = links(spark, d).where("confidence >= 0.75")
    out = k.select(F.col("entity_a").alias("entity_id"), F.col("entity_b").alias("other"), "link_type")
    return out.union(k.select("entity_b", "entity_a", "link_type")).distinct()


@query("SELECT s.signal, e.entity_id FROM (SELECT DISTINCT signal FROM series) s LEFT JOIN entities e ON e.entity_type = 'nation' AND 'ship.' || e.entity_id = s.signal")
def join_resolve_alias(spark, d):
    aliases = entities(spark, d).where("entity_type = 'nation'").select(F.concat(F.lit("ship."), "entity_id").alias("signal"), "entity_id")
    return series(spark, d).select("signal").distinct().join(aliases, "signal", "left")


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY positioning.week DESC) AS k FROM positioning)
SELECT 'brand:' || l.brand AS entity_id, n.entity_b AS country, round(longs / oi, 6) AS rank FROM l JOIN links n ON n.entity_a = 'brand:' || l.brand AND n.link_type = 'produced_in' WHERE k = 1""")
def join_positioning_by_instrument(spark, d):
    p = latest(positioning(spark, d), ["brand"], "week", ties=False).select(F.concat(F.lit("brand:"), "brand").alias("entity_id"), F.round(F.col("longs") / F.col("oi"), 6).alias("rank"))
    return linked(p, links(spark, d), "produced_in").select("entity_id", F.col("entity_b").alias("country"), "rank")


@query("SELECT entity_a AS instrument, string_agg(entity_b, ',' ORDER BY entity_b) AS countries FROM links WHERE link_type = 'produced_in' GROUP BY 1")
def join_supply_countries(spark, d):
    k = links(spark, d).where("link_type = 'produced_in'")
    return k.groupBy(F.col("entity_a").alias("instrument")).agg(F.array_join(F.array_sort(F.collect_list("entity_b")), ",").alias("countries"))


@query("SELECT n_nationkey, n_name, e.entity_id FROM nation LEFT JOIN entities e ON e.entity_type = 'nation' AND lower(e.name) = lower(n_name)")
def join_country_bridge(spark, d):
    bridge = entities(spark, d).where("entity_type = 'nation'").select(F.lower("name").alias("k"), "entity_id")
    return table(spark, d, "nation").withColumn("k", F.lower("n_name")).join(bridge, "k", "left").select("n_nationkey", "n_name", "entity_id")


STRESS = """c AS (SELECT entity_id, avg(score) AS s, count(*) AS n FROM country_events WHERE ts >= TIMESTAMP '1998-06-01' GROUP BY 1),
j AS (SELECT k.entity_a AS instrument, c.entity_id, c.s, c.n FROM links k LEFT JOIN c ON c.entity_id = k.entity_b WHERE k.link_type = 'produced_in'),
st AS (SELECT instrument, round(avg(s), 6) AS avg_score, CAST(coalesce(sum(n), 0) AS BIGINT) AS events, arg_min(entity_id, s) AS worst FROM j GROUP BY 1)"""


def stress(spark, d):
    """Average event score over the producer countries of each instrument, with a level."""
    c = country_events(spark, d).where("ts >= timestamp '1998-06-01'").groupBy("entity_id").agg(F.avg("score").alias("s"), F.count("*").alias("n"))
    k = links(spark, d).where("link_type = 'produced_in'").select(F.col("entity_a").alias("instrument"), F.col("entity_b").alias("entity_id"))
    out = k.join(c, "entity_id", "left").groupBy("instrument").agg(F.round(F.avg("s"), 6).alias("avg_score"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("events"), F.min_by("entity_id", "s").alias("worst"))
    a = F.col("avg_score")
    return out.withColumn("level", F.when(a.isNull(), "NO_DATA").when(a <= -0.2, "HIGH").when(a <= -0.1, "MODERATE").when(a <= 0, "LOW").otherwise("STABLE"))


@query(f"WITH {STRESS} SELECT *, CASE WHEN avg_score IS NULL THEN 'NO_DATA' WHEN avg_score <= -0.2 THEN 'HIGH' WHEN avg_score <= -0.1 THEN 'MODERATE' WHEN avg_score <= 0 THEN 'LOW' ELSE 'STABLE' END AS level FROM st")
def join_producer_stress(spark, d):
    return stress(spark, d)


@query("""WITH m AS (SELECT market, bool_or(resolved) AS resolved FROM trades GROUP BY 1 HAVING market % 3 <> 1)
SELECT wallet, count(*) AS trades, count(*) FILTER (WHERE m.resolved AND correct) AS won, count(*) FILTER (WHERE m.resolved) AS judged, round(sum(usdc), 4) AS volume FROM trades t LEFT JOIN m ON m.market = t.market GROUP BY 1""")
def join_wallet_outcome(spark, d):
    t = trades(spark, d)
    m = t.where("market % 3 <> 1").groupBy("market").agg(F.bool_or("resolved").alias("known"))
    known = F.coalesce("known", F.lit(False))
    return t.join(m, "market", "left").groupBy("wallet").agg(F.count("*").alias("trades"), F.count_if(known & F.col("correct")).alias("won"), F.count_if(known).alias("judged"), F.round(F.sum("usdc"), 4).alias("volume"))


POINTS = """pt AS (SELECT event_id, (event_id * 37 % 1800) / 10.0 - 90 AS lat, (event_id * 91 % 3600) / 10.0 - 180 AS lon, value FROM events),
zn AS (SELECT n_nationkey AS zone, (n_nationkey * 53 % 140) - 70.0 AS zone_lat, (n_nationkey * 97 % 340) - 170.0 AS zone_lon, 300.0 + 20 * n_nationkey AS radius_km FROM nation)"""
KM = "6371 * sqrt(pow(radians(zone_lat - lat), 2) + pow(radians(zone_lon - lon) * cos(radians((lat + zone_lat) / 2)), 2))"


def points(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", (F.col("event_id") * 37 % 1800 / 10.0 - 90).alias("lat"), (F.col("event_id") * 91 % 3600 / 10.0 - 180).alias("lon"), "value")


def zones(spark, d):
    n = F.col("n_nationkey").cast("long")
    return table(spark, d, "nation").select(n.alias("zone"), (n * 53 % 140 - 70.0).alias("zone_lat"), (n * 97 % 340 - 170.0).alias("zone_lon"), (20 * n + 300.0).alias("radius_km"))


@query(f"WITH {POINTS} SELECT event_id, zone, round({KM}, 3) AS km FROM pt, zn WHERE {KM} <= radius_km")
def join_proximity(spark, d):
    return proximity_join(points(spark, d), zones(spark, d)).select("event_id", "zone", F.round("km", 3).alias("km"))


@query(f"WITH {POINTS} SELECT event_id, zone FROM pt JOIN zn ON lat BETWEEN zone_lat - 5 AND zone_lat + 5 AND lon BETWEEN zone_lon - 8 AND zone_lon + 8")
def join_bbox(spark, d):
    z = F.broadcast(zones(spark, d))  # named areas: one per nation
    p = points(spark, d)
    inside = p.lat.between(F.col("zone_lat") - 5, F.col("zone_lat") + 5) & p.lon.between(F.col("zone_lon") - 8, F.col("zone_lon") + 8)
    return p.join(z, inside).select("event_id", "zone")


@query("SELECT a.l_partkey AS k1, b.l_partkey AS k2, count(DISTINCT a.l_orderkey) AS docs FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY 1, 2 HAVING count(DISTINCT a.l_orderkey) >= 2")
def join_self_pair(spark, d):
    li = table(spark, d, "lineitem")
    m = li.select(F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("k")).repartition(parts(li), "doc").distinct()
    p = m.withColumnRenamed("k", "k1").join(m.withColumnRenamed("k", "k2"), "doc").where("k1 < k2")
    return p.groupBy("k1", "k2").agg(F.count("*").alias("docs")).where("docs >= 2")


@query("""SELECT a.brand, CAST(a.d AS VARCHAR) AS d, CAST(min(b.d) AS VARCHAR) AS next FROM bars a JOIN bars b ON b.brand = a.brand AND b.d > a.d WHERE a.trades >= 3 AND b.volume >= 60 GROUP BY 1, 2""")
def join_lag_pairs(spark, d):
    b = bars(spark, d)
    src = b.where("trades >= 3").select("brand", "d")
    dst = b.where("volume >= 60").select("brand", F.col("d").alias("nd"), "volume")
    return asof_join(src, dst, ["brand"], "d", "nd", "volume", "forward", strict=True).where("found is not null").select("brand", F.col("d").cast("string").alias("d"), F.col("found.ts").cast("string").alias("next"))


SNAPSHOTS = """old AS (SELECT c_mktsegment AS kind, c_nationkey AS value, count(*) % 7 AS ttl FROM customer WHERE c_custkey % 3 <> 0 GROUP BY 1, 2 HAVING c_nationkey % 5 <> 0),
new AS (SELECT c_mktsegment AS kind, c_nationkey AS value, count(*) % 7 AS ttl FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1, 2 HAVING c_nationkey % 4 <> 1)"""


@query(f"""WITH {SNAPSHOTS} SELECT coalesce(o.kind, n.kind) AS kind, coalesce(o.value, n.value) AS value, CASE WHEN o.kind IS NULL THEN 'added' WHEN n.kind IS NULL THEN 'removed' WHEN o.ttl <> n.ttl THEN 'ttl_changed' ELSE 'same' END AS change
FROM old o FULL JOIN new n ON o.kind = n.kind AND o.value = n.value""")
def join_snapshot_diff(spark, d):
    c = table(spark, d, "customer").select(F.col("c_mktsegment").alias("kind"), F.col("c_nationkey").alias("value"), "c_custkey")
    shot = lambda rows, rest, name: rows.where(rest).groupBy("kind", "value").agg((F.count("*") % 7).alias(name))
    old, new = shot(c.where("c_custkey % 3 <> 0"), "value % 5 <> 0", "o"), shot(c.where("c_custkey % 2 = 0"), "value % 4 <> 1", "n")
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("o") != F.col("n"), "ttl_changed").otherwise("same")
    return old.join(new, ["kind", "value"], "full_outer").select("kind", "value", change.alias("change"))


@query("""WITH a AS (SELECT DISTINCT source, entity_id, CAST(ts AS DATE) AS edition FROM obs WHERE value > 60), m AS (SELECT max(edition) AS cur, max(edition) FILTER (WHERE edition < (SELECT max(edition) FROM a)) AS prev FROM a),
c AS (SELECT source, entity_id FROM a, m WHERE edition = cur), p AS (SELECT source, entity_id FROM a, m WHERE edition = prev)
SELECT coalesce(c.source, p.source) AS source, coalesce(c.entity_id, p.entity_id) AS entity_id, CASE WHEN p.source IS NULL THEN 'new' WHEN c.source IS NULL THEN 'resolved' ELSE 'held' END AS status
FROM c FULL JOIN p ON c.source = p.source AND c.entity_id = p.entity_id""")
def join_edition_diff(spark, d):
    a = obs(spark, d).where("value > 60").select("source", "entity_id", F.to_date("ts").alias("edition")).distinct()
    m = a.groupBy().agg(F.max("edition").alias("cur"))
    prev = a.join(F.broadcast(m)).where("edition < cur").groupBy().agg(F.max("edition").alias("prev"))  # one row each
    now = a.join(F.broadcast(m), F.col("edition") == F.col("cur")).select("source", "entity_id", F.lit(True).alias("c"))
    then = a.join(F.broadcast(prev), F.col("edition") == F.col("prev")).select("source", "entity_id", F.lit(True).alias("p"))
    status = F.when(F.col("p").isNull(), "new").when(F.col("c").isNull(), "resolved").otherwise("held")
    return now.join(then, ["source", "entity_id"], "full_outer").select("source", "entity_id", status.alias("status"))


@query("SELECT e.entity_id, b.brand AS asset FROM entities e LEFT JOIN (SELECT DISTINCT brand FROM bars WHERE trades >= 3) b ON e.entity_id = 'brand:' || b.brand WHERE e.entity_type IN ('brand', 'nation')")
def join_entity_to_asset(spark, d):
    assets = bars(spark, d).where("trades >= 3").select(F.concat(F.lit("brand:"), "brand").alias("entity_id"), F.col("brand").alias("asset")).distinct()
    return entities(spark, d).where("entity_type in ('brand', 'nation')").select("entity_id").join(assets, "entity_id", "left")


@query("""WITH a AS (SELECT brand, round(sum(volume), 6) AS v FROM bars GROUP BY 1), b AS (SELECT brand, sum(oi) AS v FROM positioning GROUP BY 1) SELECT a.brand, abs(a.v - b.v) <= 1e-3 AS agree FROM a FULL JOIN b ON a.brand = b.brand""")
def join_parity(spark, d):
    a = bars(spark, d).groupBy("brand").agg(F.sum("volume").alias("va"))
    b = positioning(spark, d).groupBy("brand").agg(F.sum("oi").alias("vb"))
    return a.join(b, "brand", "full_outer").select("brand", (F.abs(F.col("va") - F.col("vb")) <= 1e-3).alias("agree"))


CODES = [("1-URGENT", "URG"), ("2-HIGH", "HIG"), ("3-MEDIUM", "MED")]


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'URG' WHEN '2-HIGH' THEN 'HIG' WHEN '3-MEDIUM' THEN 'MED' END AS ticker FROM orders")
def join_code_to_ticker(spark, d):
    codes = spark.createDataFrame(CODES, "o_orderpriority string, ticker string")
    return table(spark, d, "orders").join(F.broadcast(codes), "o_orderpriority", "left").select("o_orderkey", "ticker")


@query("SELECT 'customer:' || c_custkey AS entity_a, 'nation:' || n_nationkey AS entity_b FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0")
def join_seed_company_country(spark, d):
    c, n = table(spark, d, "customer").where("c_acctbal > 0"), table(spark, d, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).select(F.concat(F.lit("customer:"), "c_custkey").alias("entity_a"), F.concat(F.lit("nation:"), "n_nationkey").alias("entity_b"))


@query("""SELECT DISTINCT 'supplier:' || s_suppkey AS entity_a, n_name AS country, 'port_call_to' AS link_type FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON upper(substr(n_name, 1, 2)) = upper(substr((SELECT n2.n_name FROM nation n2 WHERE n2.n_nationkey = s_nationkey), 1, 2))
WHERE l_quantity >= 45""")
def join_seed_vessel_country(spark, d):
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    ports = s.join(n, s.s_nationkey == n.n_nationkey).select("s_suppkey", F.upper(F.substring("n_name", 1, 2)).alias("code"))
    countries = n.select(F.upper(F.substring("n_name", 1, 2)).alias("code"), F.col("n_name").alias("country"))
    calls = table(spark, d, "lineitem").where("l_quantity >= 45").select(F.col("l_suppkey").alias("s_suppkey")).distinct()
    return calls.join(ports, "s_suppkey").join(countries, "code").select(F.concat(F.lit("supplier:"), "s_suppkey").alias("entity_a"), "country", F.lit("port_call_to").alias("link_type")).distinct()


@query("SELECT DISTINCT wallet AS entity_a, k.entity_b FROM trades JOIN links k ON k.entity_a = wallet AND link_type = 'headquartered_in' WHERE usdc >= 50000")
def join_seed_wallet_country(spark, d):
    w = trades(spark, d).where("usdc >= 50000").select(F.col("wallet").alias("entity_id")).distinct()
    return linked(w, links(spark, d), "headquartered_in").select(F.col("entity_id").alias("entity_a"), "entity_b")


@query("""SELECT p_partkey, m.ticker, m.confidence FROM part JOIN (VALUES ('PROMO', 'CU', 0.9), ('PROMO', 'ZN', 0.6), ('LARGE', 'FE', 0.8)) m(kind, ticker, confidence) ON p_type LIKE '%' || kind || '%'""")
def join_vessel_commodity(spark, d):
    rules = spark.createDataFrame([("PROMO", "CU", 0.9), ("PROMO", "ZN", 0.6), ("LARGE", "FE", 0.8)], "kind string, ticker string, confidence double")
    p = table(spark, d, "part")
    return p.join(F.broadcast(rules), F.contains(F.col("p_type"), F.col("kind"))).select("p_partkey", "ticker", F.col("confidence"))


@query("SELECT entity_a, entity_b FROM links WHERE link_type = 'produced_in' AND entity_b NOT IN ('nation:1', 'nation:2')")
def join_producer_country(spark, d):
    k = links(spark, d).where("link_type = 'produced_in'").select("entity_a", "entity_b")
    return k.join(k.where("entity_b in ('nation:1', 'nation:2')"), ["entity_a", "entity_b"], "left_anti")


@query("""SELECT DISTINCT p_brand, m.ticker FROM part JOIN (VALUES ('steel', 'FE'), ('tin', 'SN'), ('promo', 'XRT'), ('small', 'RUT')) m(word, ticker) ON contains(lower(p_type || ' ' || p_name), word)""")
def join_topic_instrument(spark, d):
    rules = spark.createDataFrame([("steel", "FE"), ("tin", "SN"), ("promo", "XRT"), ("small", "RUT")], "word string, ticker string")
    p = table(spark, d, "part").select("p_brand", F.lower(F.concat_ws(" ", "p_type", "p_name")).alias("t"))
    return p.join(F.broadcast(rules), F.contains(F.col("t"), F.col("word"))).select("p_brand", "ticker").distinct()


@query("SELECT brand, count(*) AS weeks FROM positioning WHERE 'brand:' || brand NOT IN (SELECT entity_a FROM links WHERE link_type = 'produced_in' AND entity_b IN ('nation:3', 'nation:4', 'nation:5')) GROUP BY 1 HAVING count(*) >= 20")
def join_unmapped_contracts(spark, d):
    k = links(spark, d).where("link_type = 'produced_in' and entity_b in ('nation:3', 'nation:4', 'nation:5')").select(F.col("entity_a").alias("entity_id")).distinct()
    p = positioning(spark, d).withColumn("entity_id", F.concat(F.lit("brand:"), "brand"))
    return p.join(k, "entity_id", "left_anti").groupBy("brand").agg(F.count("*").alias("weeks")).where("weeks >= 20")


@query("SELECT entity_id FROM entities WHERE entity_id NOT IN (SELECT entity_a FROM links WHERE link_type <> 'headquartered_in') AND entity_id NOT IN (SELECT entity_b FROM links WHERE link_type <> 'headquartered_in')")
def join_orphan_entities(spark, d):
    k = links(spark, d).where("link_type <> 'headquartered_in'")
    ends = k.select(F.col("entity_a").alias("entity_id")).union(k.select("entity_b")).distinct()
    return entities(spark, d).select("entity_id").join(ends, "entity_id", "left_anti")


@query("SELECT entity_id, epoch_us(ts) AS us, max(id.a) AS n FROM obs_dup GROUP BY 1, 2 HAVING count(*) > 1")
def join_repeated_keys(spark, d):
    return obs_dup(spark, d).groupBy("entity_id", "ts").agg(F.max("id.l_orderkey").alias("n"), F.count("*").alias("c")).where("c > 1").select("entity_id", F.unix_micros("ts").alias("us"), "n")
