"""Scalar functions over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.joins import equirect_km
from ..registry import query
from .joining import KM, POINTS, points, zones
from .views import bars, entities, obs, positioning, series, table


@query(r"""WITH c AS (SELECT c_custkey, lower(c_name || ', Inc. & Co') AS x FROM customer) SELECT c_custkey, trim(regexp_replace(regexp_replace(regexp_replace(x, '[^\p{L}\p{N}\s-]', ' ', 'g'), '\b(incorporated|corporation|company|limited|holdings|group|inc|corp|co|ltd|llc|plc|lp|sa|ag|nv)\b', ' ', 'g'), '\s+', ' ', 'g')) AS name FROM c""")
def fn_normalise_company(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.normalise_company(F.concat("c_name", F.lit(", Inc. & Co"))).alias("name"))


@query("SELECT entity_id AS raw, substr(sha256(entity_type || ':' || name), 1, 16) AS id FROM entities")
def fn_entity_id(spark, d):
    return entities(spark, d).select(F.col("entity_id").alias("raw"), S.entity_key(F.col("entity_type"), F.col("name")).alias("id"))


@query("SELECT o_orderkey, substr(sha256(least(o_orderstatus, o_orderpriority) || '|' || greatest(o_orderstatus, o_orderpriority)), 1, 12) AS h FROM orders")
def fn_pair_hash(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.pair_hash(F.col("o_orderstatus"), F.col("o_orderpriority")).alias("h"))


@query("SELECT s_suppkey, split_part(s_name, '#', 1) AS name, regexp_extract(s_name || ' (S' || s_suppkey || ')', '\\(([A-Z0-9]+)\\)', 1) AS ticker FROM supplier")
def fn_display_name(spark, d):
    shown = F.concat("s_name", F.lit(" (S"), "s_suppkey", F.lit(")"))
    return table(spark, d, "supplier").select("s_suppkey", F.split("s_name", "#")[0].alias("name"), F.regexp_extract(shown, r"\(([A-Z0-9]+)\)", 1).alias("ticker"))


@query("SELECT c_custkey, lpad(regexp_replace(c_name, '\\D', '', 'g'), 9, '0') AS mmsi FROM customer")
def fn_normalise_mmsi(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.mmsi(F.col("c_name")).alias("mmsi"))


@query("SELECT p_partkey, CASE WHEN p_size BETWEEN 30 AND 39 THEN 'fishing' WHEN p_size BETWEEN 20 AND 29 THEN 'wig' WHEN p_size >= 40 THEN 'high_speed' ELSE 'other' END AS label FROM part")
def fn_ship_type_label(spark, d):
    s = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", F.when(s.between(30, 39), "fishing").when(s.between(20, 29), "wig").when(s >= 40, "high_speed").otherwise("other").alias("label"))


@query("""WITH o AS (SELECT event_id, [value / 100, 1 - value / 100] AS p FROM events) SELECT event_id, CASE WHEN abs(p[1] - 1) < abs(p[2] - 1) THEN 0 WHEN abs(p[2] - 1) < abs(p[1] - 1) THEN 1 END AS winner FROM o""")
def fn_resolve_winner(spark, d):
    e = table(spark, d, "events").select("event_id", F.transform(F.array(F.col("value") / 100, 1 - F.col("value") / 100), lambda x: F.abs(x - 1)).alias("off"))
    least = F.array_min("off")
    alone = F.size(F.filter("off", lambda x: x == least)) == 1
    return e.select("event_id", F.when(alone, F.array_position("off", least) - 1).cast("int").alias("winner"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_shipdate::DATE - o_orderdate::DATE <= 1 THEN 'immediate' WHEN l_shipdate::DATE - o_orderdate::DATE <= 7 THEN 'near_term' ELSE 'planned' END AS urgency FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def fn_urgency(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    return li.join(o, li.l_orderkey == o.o_orderkey).select("l_orderkey", "l_linenumber", "l_partkey", S.urgency(F.to_date("o_orderdate"), F.to_date("l_shipdate")).alias("urgency"))


@query("SELECT p_partkey, CASE WHEN lower(p_type) LIKE '%promo%' THEN 'promo' WHEN lower(p_type) LIKE '%economy%' OR lower(p_type) LIKE '%small%' THEN 'cheap' ELSE 'other' END AS kind FROM part")
def fn_acquisition_class(spark, d):
    return table(spark, d, "part").select("p_partkey", S.matched(F.col("p_type"), [("promo", "promo"), ("economy|small", "cheap")], "other").alias("kind"))


@query("SELECT event_id, CASE WHEN value / 11 >= 8 THEN 'GREAT' WHEN value / 11 >= 7 THEN 'MAJOR' WHEN value / 11 >= 6 THEN 'STRONG' WHEN value / 11 >= 5 THEN 'MODERATE' WHEN value / 11 >= 4 THEN 'LIGHT' ELSE 'MINOR' END AS label FROM events")
def fn_magnitude_label(spark, d):
    return table(spark, d, "events").select("event_id", S.magnitude_label(F.col("value") / 11).alias("label"))


@query(f"WITH {POINTS} SELECT event_id, round({KM}, 3) AS km FROM pt, zn WHERE zone = 3")
def fn_equirect_km(spark, d):
    z = F.broadcast(zones(spark, d).where("zone = 3"))  # one row
    return points(spark, d).join(z).select("event_id", F.round(equirect_km(F.col("lat"), F.col("lon"), F.col("zone_lat"), F.col("zone_lon")), 3).alias("km"))


@query("SELECT brand, CAST(week AS VARCHAR) AS wk, CASE WHEN longs / oi >= 0.8 THEN 'crowded_long' WHEN longs / oi <= 0.2 THEN 'crowded_short' WHEN longs / oi >= 0.65 THEN 'approaching_long' WHEN longs / oi <= 0.35 THEN 'approaching_short' ELSE 'neutral' END AS label FROM positioning")
def fn_positioning_label(spark, d):
    return positioning(spark, d).select("brand", F.col("week").cast("string").alias("wk"), S.positioning_label(F.col("longs") / F.col("oi")).alias("label"))


@query("SELECT obs_id, CASE WHEN value >= 75 THEN 3 WHEN value >= 50 THEN 2 WHEN value >= 25 THEN 1 ELSE 0 END AS state FROM obs")
def fn_discretise(spark, d):
    return obs(spark, d).select("obs_id", S.discretise(F.col("value"), [0, 25, 50, 75]).alias("state"))


@query("SELECT obs_id, round(sign(value - 50) * ln(1 + abs(value - 50)), 6) AS y FROM obs")
def fn_symlog(spark, d):
    return obs(spark, d).select("obs_id", F.round(S.symlog(F.col("value") - 50), 6).alias("y"))


@query("SELECT brand, CAST(d AS VARCHAR) AS dd, least(0.1, greatest(-0.1, coalesce(ret, 0))) AS x FROM bars")
def fn_value_clamp(spark, d):
    return bars(spark, d).select("brand", F.col("d").cast("string").alias("dd"), S.clamp(F.col("ret"), -0.1, 0.1).alias("x"))


@query("SELECT obs_id, round(2 / (1 + exp(-(value - 50) / 10)) - 1, 6) AS s FROM obs")
def fn_sigmoid_score(spark, d):
    return obs(spark, d).select("obs_id", S.sigmoid_score((F.col("value") - 50) / 10).alias("s"))


@query("SELECT event_id, (event_id % 40) * CASE event_id % 4 WHEN 0 THEN 86400 WHEN 1 THEN 3600 WHEN 2 THEN 60 ELSE 1 END AS s FROM events")
def fn_relative_time(spark, d):
    unit = F.element_at(F.array(*[F.lit(x) for x in "dhms"]), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", S.relative_seconds(F.concat((F.col("event_id") % 40).cast("string"), unit)).alias("s"))


@query(r"SELECT doc_id, len(list_filter(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: true)) AS sentences FROM documents")
def fn_sentence_split(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(S.sentences(F.col("text"))).cast("long").alias("sentences"))


@query("SELECT item_id, array_to_string(regexp_extract_all(text, '([A-Z][A-Za-z]+(?: [A-Z][A-Za-z]+){0,3})', 1), '|') AS spans FROM benchmark")
def fn_capitalised_spans(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(S.capitalised(F.col("text")), "|").alias("spans"))


@query("SELECT obs_id, array_to_string(json_keys(props), ',') AS keys FROM obs")
def fn_json_keys(spark, d):
    return obs(spark, d).select("obs_id", F.array_join(F.json_object_keys("props"), ",").alias("keys"))


@query("""WITH t AS (SELECT p_brand, list(DISTINCT p_type || ':' || p_size) AS ts FROM part GROUP BY 1) SELECT a.p_brand AS a, b.p_brand AS b, round(len(list_intersect(a.ts, b.ts)) / len(list_distinct(list_concat(a.ts, b.ts))), 6) AS jaccard FROM t a JOIN t b ON a.p_brand < b.p_brand""")
def fn_jaccard(spark, d):
    """Brands share types: intersections by an equality join on the type, unions from the sizes."""
    t = table(spark, d, "part").select("p_brand", F.concat_ws(":", "p_type", "p_size").alias("p_type")).distinct()
    n = t.groupBy("p_brand").agg(F.count("*").alias("n"))
    both = t.toDF("a", "p_type").join(t.toDF("b", "p_type"), "p_type").where("a < b").groupBy("a", "b").agg(F.count("*").alias("i"))
    pairs = n.toDF("a", "na").join(F.broadcast(n.toDF("b", "nb")), F.col("a") < F.col("b"))  # 25 brands
    j = pairs.join(both, ["a", "b"], "left").fillna(0, ["i"])
    return j.select("a", "b", F.round(F.col("i") / (F.col("na") + F.col("nb") - F.col("i")), 6).alias("jaccard"))


@query("SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cos FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def fn_cosine(spark, d):
    e = table(spark, d, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(S.cosine(F.col("embedding"), F.col("other")), 6).alias("cos"))


@query("""WITH l AS (SELECT signal, max(d) AS d, arg_max(value, d) AS x FROM series GROUP BY 1) SELECT s.signal, round(100.0 * count(*) FILTER (WHERE value <= x) / count(*), 1) AS pct FROM series s JOIN l ON l.signal = s.signal AND s.d < l.d GROUP BY 1 HAVING count(*) >= 1""")
def fn_history_percentile(spark, d):
    s = series(spark, d)
    last = s.groupBy("signal").agg(F.max("d").alias("end"), F.max_by("value", "d").alias("x"))
    h = s.join(last, "signal").where("d < end")
    return h.groupBy("signal").agg(F.round(100.0 * F.count_if(F.col("value") <= F.col("x")) / F.count("*"), 1).alias("pct"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE value END AS x FROM events")
def fn_safe_cast(spark, d):
    raw = F.when(F.col("event_id") % 4 == 0, F.lit(" . ")).when(F.col("event_id") % 4 == 1, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.col("value").cast("string")))
    return table(spark, d, "events").select("event_id", S.safe_number(raw).alias("x"))


@query("SELECT o_orderkey, epoch(CAST(o_orderdate AS DATE))::BIGINT AS s FROM orders")
def fn_date_to_ts(spark, d):
    day = F.col("o_orderdate")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(day, "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format(day, "MM/dd/yyyy")).otherwise(F.date_format(day, "yyyyMMdd"))
    return table(spark, d, "orders").select("o_orderkey", S.date_seconds(text).alias("s"))


@query("""WITH b AS (SELECT brand, d, [CASE WHEN abs(ret) > 0.5 THEN 'RETURN_STRONG' WHEN abs(ret) > 0.3 THEN 'RETURN_WATCH' END, CASE WHEN (high - low) / close > 1.5 THEN 'SPREAD_STRONG' WHEN (high - low) / close > 0.8 THEN 'SPREAD_WATCH' END] AS a FROM bars)
SELECT brand, CAST(d AS VARCHAR) AS dd, unnest(list_filter(a, lambda x: x IS NOT NULL)) AS alert FROM b""")
def fn_micro_alerts(spark, d):
    spread = (F.col("high") - F.col("low")) / F.col("close")
    a = F.array_compact(F.array(F.when(F.abs("ret") > 0.5, F.lit("RETURN_STRONG")).when(F.abs("ret") > 0.3, F.lit("RETURN_WATCH")), F.when(spread > 1.5, F.lit("SPREAD_STRONG")).when(spread > 0.8, F.lit("SPREAD_WATCH"))))
    return bars(spark, d).select("brand", F.col("d").cast("string").alias("dd"), F.explode(a).alias("alert"))


@query("SELECT brand, CAST(week AS VARCHAR) AS wk, CASE WHEN longs / oi >= 0.8 OR longs / oi <= 0.2 THEN 3 WHEN longs / oi >= 0.65 OR longs / oi <= 0.35 THEN 1 ELSE 0 END + CASE WHEN oi > 200 THEN 2 ELSE 0 END AS priority FROM positioning")
def fn_priority_score(spark, d):
    rank = F.col("longs") / F.col("oi")
    points = F.when((rank >= 0.8) | (rank <= 0.2), 3).when((rank >= 0.65) | (rank <= 0.35), 1).otherwise(0) + F.when(F.col("oi") > 200, 2).otherwise(0)
    return positioning(spark, d).select("brand", F.col("week").cast("string").alias("wk"), points.alias("priority"))


@query("SELECT p_partkey, CASE WHEN lower(p_type) LIKE '%steel%' THEN 'debenture' WHEN lower(p_type) LIKE '%brass%' THEN 'floating' ELSE 'other' END AS charge FROM part")
def fn_charge_class(spark, d):
    text = F.when(F.contains(F.lower("p_type"), F.lit("steel")), "A fixed Debenture").when(F.contains(F.lower("p_type"), F.lit("brass")), "FLOATING and fixed").otherwise("none")
    return table(spark, d, "part").select("p_partkey", S.matched(text, S.CHARGES, "other").alias("charge"))


@query("SELECT page_id, CASE WHEN url LIKE '%.example.com/%' THEN 'com' WHEN url LIKE '%.example.net/%' THEN 'net' WHEN url LIKE '%.example.org/%' THEN 'org' ELSE 'other' END AS provider FROM pages")
def fn_mail_cloud_provider(spark, d):
    host = F.concat(F.regexp_extract("url", r"^https?://([^/]+)/", 1), F.lit("/"))
    ends = lambda s: F.endswith(host, F.lit(f".example.{s}/"))
    return table(spark, d, "pages").select("page_id", F.when(ends("com"), "com").when(ends("net"), "net").when(ends("org"), "org").otherwise("other").alias("provider"))


@query("SELECT p_partkey, CASE WHEN p_type LIKE '%STEEL%' THEN 'metals' WHEN p_type LIKE '%SMALL%' THEN 'size' ELSE '' END AS category FROM part")
def fn_topic_category(spark, d):
    """The category of the first tag found in the map: its words are the tags, the map's order decides."""
    tags = F.split("p_type", " ")
    return table(spark, d, "part").select("p_partkey", F.when(F.array_contains(tags, "STEEL"), "metals").when(F.array_contains(tags, "SMALL"), "size").otherwise("").alias("category"))


@query("SELECT event_id, CASE WHEN value / 100 >= 0.6 THEN 'dense' WHEN value / 100 >= 0.3 THEN 'moderate' WHEN value / 100 >= 0.1 THEN 'sparse' ELSE 'bare' END AS band FROM events")
def fn_ndvi_health(spark, d):
    return table(spark, d, "events").select("event_id", S.ladder(F.col("value") / 100, [(0.6, "dense"), (0.3, "moderate"), (0.1, "sparse")], "bare").alias("band"))


@query("SELECT vec_id, round(list_avg(list_transform(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x * 10000 BETWEEN -2000 AND 10000), lambda x: x)), 5) AS ndvi FROM embeddings")
def fn_ndvi_scale(spark, d):
    kept = F.filter(F.col("embedding").cast("array<double>"), lambda x: (x * 10000).between(-2000, 10000))
    mean = F.aggregate(kept, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(kept), F.lit(0))
    return table(spark, d, "embeddings").select("vec_id", F.round(mean, 5).alias("ndvi"))


@query("""WITH p AS (SELECT brand, week, round(longs / oi * 100, 4) AS r, sign(longs - lag(longs) OVER (PARTITION BY brand ORDER BY positioning.week)) AS dir FROM positioning)
SELECT brand, CAST(week AS VARCHAR) AS wk, CASE WHEN r >= 80 THEN 'CROWDED_LONG' WHEN r <= 20 THEN 'CROWDED_SHORT' WHEN r > 65 AND dir > 0 THEN 'MOMENTUM_UP' WHEN r > 20 AND r < 21 THEN 'NEUTRAL' WHEN r < 35 AND dir < 0 THEN 'MOMENTUM_DOWN' ELSE 'NEUTRAL' END AS signal FROM p""")
def fn_cot_signal(spark, d):
    from pyspark.sql import Window

    r = F.round(F.col("longs") / F.col("oi") * 100, 4)
    p = positioning(spark, d).withColumn("r", r).withColumn("dir", F.signum(F.col("longs") - F.lag("longs").over(Window.partitionBy("brand").orderBy("week"))))
    s = F.when(F.col("r") >= 80, "CROWDED_LONG").when(F.col("r") <= 20, "CROWDED_SHORT").when((F.col("r") > 65) & (F.col("dir") > 0), "MOMENTUM_UP").when((F.col("r") > 20) & (F.col("r") < 21), "NEUTRAL").when((F.col("r") < 35) & (F.col("dir") < 0), "MOMENTUM_DOWN").otherwise("NEUTRAL")
    return p.select("brand", F.col("week").cast("string").alias("wk"), s.alias("signal"))


@query("SELECT s_suppkey, n_name AS country FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def fn_resolve_port(spark, d):
    """A code's leading letters or a name, looked up in a port table."""
    ports = table(spark, d, "nation").select(F.concat(F.upper(F.substring("n_name", 1, 2)), F.lpad(F.col("n_nationkey").cast("string"), 3, "0")).alias("code"), F.col("n_name").alias("country"), "n_nationkey")
    calls = table(spark, d, "supplier").join(ports.select("n_nationkey", F.col("code").alias("called")), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "called")
    return calls.join(ports, F.col("called") == F.col("code")).select("s_suppkey", "country")
