"""The file readers on files that Spark writes from the tables to the shared folder, malformed rows among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import plugins
from ..operators.graphs import components
from ..registry import query
from ..session import new_path, written
from ..sources import files, store
from ..sources.tables import PartitionedTable
from .views import bars, entities, obs, positioning, table


def lines(df: DataFrame, line: Column, name: str, each: bool = False) -> str:
    """The folder of the lines, as text; each: a file for every line."""
    path = new_path(df.sparkSession, name)
    w = df.select(line.alias("value")).write
    (w.option("maxRecordsPerFile", 1) if each else w).text(path)
    return path


def documents(df: DataFrame, record: Column, key: Column, root: str, name: str) -> str:
    """The folder of well-formed documents of up to 500 records: those whose key has the same multiple of 500."""
    batch = df.select(F.floor(key / 500).alias("batch"), record.alias("x")).groupBy("batch").agg(F.concat_ws("", F.collect_list("x")).alias("x"))
    return lines(batch, F.concat(F.lit(f"<{root}>"), "x", F.lit(f"</{root}>")), name, each=True)


def tag(name: str, *inner) -> Column:
    return F.concat(F.lit(f"<{name}>"), *[F.coalesce(x.cast("string"), F.lit("")) if isinstance(x, Column) else F.lit(x) for x in inner], F.lit(f"</{name}>"))


HEADERS = ["Market_and_Exchange_Names", "Report_Date_as_YYYY-MM-DD", "CFTC_Contract_Market_Code", "Open_Interest_All", "M_Money_Positions_Long_All", "Pct_of_OI_Long", "Conc_Gross_4", *[f"Field_{i}" for i in range(16)]]


@query("SELECT brand AS code, count(*) AS weeks, CAST(sum(CAST(floor(oi) AS BIGINT)) AS BIGINT) AS open_interest, round(sum(longs / oi), 4) AS pct FROM positioning WHERE day(week) <> 13 GROUP BY 1")
def src_read_positioning_csv(spark, d):
    p = positioning(spark, d)
    whole = [F.concat(F.lit('"'), "brand", F.lit(', MARKET"')), F.col("week"), F.col("brand"), F.floor("oi"), F.floor("longs"), F.col("longs") / F.col("oi"), F.lit("."), *[F.lit(7)] * 16]
    short = F.concat_ws(",", "brand", F.col("week").cast("string"))
    line = F.when(F.dayofmonth("week") == 13, short).otherwise(F.concat_ws(",", *[c.cast("string") for c in whole]))
    r = files.read_positioning_csv(spark, lines(p, line, "positioning"), HEADERS)
    return r.groupBy(F.col("CFTC_Contract_Market_Code").alias("code")).agg(F.count("*").alias("weeks"), F.sum("Open_Interest_All").alias("open_interest"), F.round(F.sum("Pct_of_OI_Long"), 4).alias("pct"))


@query("SELECT 'o' || o_custkey AS reporter_cik, o_orderkey % 100 * 1.0 AS shares, o_totalprice AS price, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 100 > 0")
def src_read_filing_xml(spark, d):
    o = table(spark, d, "orders")
    code = F.when(F.col("o_orderstatus") == "O", "P").otherwise("S")
    deal = tag("nonDerivativeTransaction", tag("transactionDate", tag("value", F.to_date("o_orderdate"))), tag("transactionCoding", tag("transactionCode", code)), tag("transactionAmounts", tag("transactionShares", tag("value", F.col("o_orderkey") % 100)), tag("transactionPricePerShare", tag("value", F.col("o_totalprice")))))
    owner = tag("reportingOwner", tag("reportingOwnerId", tag("rptOwnerCik", F.concat(F.lit("o"), "o_custkey")), tag("rptOwnerName", F.lit("Doe J"))))
    doc = tag("ownershipDocument", tag("issuer", tag("issuerCik", F.lit("1")), tag("issuerName", F.lit("Acme")), tag("issuerTradingSymbol", F.lit("acm"))), owner, tag("nonDerivativeTable", deal))
    return files.read_filing_xml(spark, documents(o, doc, F.col("o_orderkey"), "filings", "filings")).select("reporter_cik", "shares", "price", "date")


@query("SELECT c_name AS insider, c_custkey AS shares, c_acctbal AS value, '1999-03-01' AS sale_date FROM customer WHERE c_custkey % 10 <> 0")
def src_read_sale_notice_xml(spark, d):
    c = table(spark, d, "customer")
    who = F.when(F.col("c_custkey") % 10 != 0, tag("nameOfPersonForWhoseAccountTheSecuritiesAreToBeSold", F.col("c_name"))).otherwise("")
    doc = tag("edgarSubmission", tag("formData", tag("issuerInfo", tag("issuerName", F.lit("Acme")), who), tag("securitiesInformation", tag("noOfUnitsSold", F.col("c_custkey")), tag("aggregateMarketValue", F.col("c_acctbal")), tag("approxSaleDate", F.lit("03/01/1999")))))
    return files.read_sale_notice_xml(spark, documents(c, doc, F.col("c_custkey"), "notices", "notices")).select("insider", "shares", "value", F.col("sale_date").cast("string").alias("sale_date"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS entity_id, s_name || ', SA' AS name, 'P' || s_nationkey || '|Q' AS programs, 'alias ' || s_suppkey AS alias, 'N' || s_nationkey AS nationality FROM supplier WHERE s_suppkey % 20 <> 0")
def src_read_sanctions_csv(spark, d):
    s = table(spark, d, "supplier")
    uid = F.when(F.col("s_suppkey") % 20 == 0, "EOF").otherwise(F.col("s_suppkey").cast("string"))
    remark = F.concat(F.lit("\"a.k.a. 'alias "), "s_suppkey", F.lit("'; nationality N"), "s_nationkey", F.lit(';"'))
    line = F.concat_ws(",", uid, F.concat(F.lit('"'), "s_name", F.lit(', SA"')), F.lit("-0- "), F.concat(F.lit('"P'), "s_nationkey", F.lit('] [Q"')), *[F.lit("-0- ")] * 7, remark)
    r = files.read_sanctions_csv(spark, lines(s, line, "sanctions"))
    return r.select("entity_id", "name", F.array_join("programs", "|").alias("programs"), F.array_join("aliases", "|").alias("alias"), "nationality")


@query("SELECT 'i' || c_custkey AS entity_id, 'individual' AS type, c_name || ' ' || c_mktsegment AS name, 'N' || c_nationkey AS nationality FROM customer UNION ALL SELECT 'e' || s_suppkey, 'entity', s_name, NULL FROM supplier")
def src_read_sanctions_xml(spark, d):
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    one = tag("INDIVIDUAL", tag("DATAID", F.concat(F.lit("i"), "c_custkey")), tag("FIRST_NAME", F.col("c_name")), tag("THIRD_NAME", F.col("c_mktsegment")), tag("UN_LIST_TYPE", F.lit("X")), tag("NATIONALITY", tag("VALUE", F.concat(F.lit("N"), "c_nationkey"))), tag("INDIVIDUAL_ALIAS", tag("ALIAS_NAME", F.lit("Z"))))
    two = tag("ENTITY", tag("DATAID", F.concat(F.lit("e"), "s_suppkey")), tag("FIRST_NAME", F.col("s_name")))
    lost = tag("ENTITY", tag("FIRST_NAME", F.lit("no id")))
    every = c.select(F.col("c_custkey").alias("k"), one.alias("x")).union(s.select("s_suppkey", two)).union(s.select("s_suppkey", lost))
    return files.read_sanctions_xml(spark, documents(every, F.col("x"), F.col("k"), "LIST", "consolidated")).select("entity_id", "type", "name", "nationality")


@query("SELECT CAST(d AS VARCHAR) AS period, count(*) AS n, round(sum(close), 4) AS total FROM bars WHERE trades % 5 <> 0 GROUP BY 1")
def src_read_sdmx_csv(spark, d):
    path = new_path(spark, "sdmx")
    rows = bars(spark, d).select(F.col("brand").alias("KEY"), F.col("d").cast("string").alias("TIME_PERIOD"), F.when(F.col("trades") % 5 != 0, F.col("close").cast("string")).otherwise("n/a").alias("OBS_VALUE"))
    rows.write.csv(path, header=True)
    return files.read_sdmx_csv(spark, path).groupBy("period").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


CURVE = "SELECT CAST(l_shipdate AS DATE) AS d, max(CASE WHEN l_linenumber = 1 THEN l_tax END) AS m3, max(CASE WHEN l_linenumber = 2 THEN l_tax END) AS y2, max(CASE WHEN l_linenumber >= 3 THEN l_tax END) AS y10 FROM lineitem GROUP BY 1"


@query(f"WITH c AS ({CURVE}) SELECT CAST(d AS VARCHAR) AS date, round(y10 - y2, 4) AS curve_2s10s, round(y10 - m3, 4) AS curve_3m10y, CAST(m3 IS NOT NULL AS INTEGER) + CAST(y2 IS NOT NULL AS INTEGER) + CAST(y10 IS NOT NULL AS INTEGER) AS tenors FROM c")
def src_read_yield_xml(spark, d):
    tax = lambda when: F.max(F.when(when, F.col("l_tax")))
    n = F.col("l_linenumber")
    c = table(spark, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("d")).agg(tax(n == 1).alias("m3"), tax(n == 2).alias("y2"), tax(n >= 3).alias("y10"))
    given = [F.when(F.col(x).isNotNull(), tag(t, F.col(x))).otherwise("") for x, t in (("m3", "BC_3MONTH"), ("y2", "BC_2YEAR"), ("y10", "BC_10YEAR"))]
    doc = tag("properties", tag("NEW_DATE", F.concat(F.col("d").cast("string"), F.lit("T00:00:00"))), *given)
    return files.read_yield_xml(spark, documents(c, doc, F.unix_date("d"), "feed", "yields")).select("date", "curve_2s10s", "curve_3m10y", F.size("yields").alias("tenors"))


@query("SELECT r_name AS region, n_name AS geo, sum(s_acctbal) IS NOT NULL AS held, round(coalesce(sum(s_acctbal), 0), 2) AS value FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2 HAVING count(s_suppkey) > 0")
def src_read_jsonstat(spark, d):
    """One cube for each region: a region dimension of one place, and its nations."""
    n, r, s = table(spark, d, "nation"), table(spark, d, "region"), table(spark, d, "supplier")
    v = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).join(s, F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy("r_name", "n_name").agg(F.sum("s_acctbal").alias("v"))
    g = v.groupBy("r_name").agg(F.sort_array(F.collect_list(F.struct("n_name", "v"))).alias("xs"))  # nations of a region
    index = F.expr("map_from_entries(transform(xs, (x, i) -> struct(x.n_name, i)))")
    values = F.expr("map_from_entries(filter(transform(xs, (x, i) -> struct(cast(i as string), x.v)), e -> e.v is not null))")
    dims = F.struct(F.struct(F.struct(F.create_map("r_name", F.lit(0)).alias("index")).alias("category")).alias("region"), F.struct(F.struct(index.alias("index")).alias("category")).alias("geo"))
    cube = F.to_json(F.struct(F.array(F.lit("region"), F.lit("geo")).alias("id"), F.array(F.lit(1), F.size("xs")).alias("size"), values.alias("value"), dims.alias("dimension")))
    out = files.read_jsonstat(spark, lines(g, cube, "cubes", each=True))
    return out.select(F.col("codes.region").alias("region"), F.col("codes.geo").alias("geo"), F.lit(True).alias("held"), F.round("value", 2).alias("value"))


@query("""SELECT CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE '98-' || o_orderkey END AS case_number, 'Debtor ' || o_custkey AS debtor, CASE WHEN o_orderkey % 3 = 0 THEN '11' WHEN o_orderkey % 3 = 1 THEN '7' END AS chapter FROM orders""")
def src_read_feed(spark, d):
    o = table(spark, d, "orders")
    title = F.concat(F.when(F.col("o_orderkey") % 9 == 0, "").otherwise(F.concat(F.lit("98-"), "o_orderkey", F.lit(" "))), F.lit("Debtor "), "o_custkey")
    text = F.when(F.col("o_orderkey") % 3 == 0, "Voluntary petition Chapter: 11").when(F.col("o_orderkey") % 3 == 1, "chapter 7 closed").otherwise("notice")
    item = tag("item", tag("title", title), tag("link", F.lit("http://court.example")), tag("description", text), tag("pubDate", F.lit("Fri, 01 Mar 1999 10:00:00 GMT")))
    return files.read_feed(spark, documents(o, item, F.col("o_orderkey"), "channel", "feed")).select("case_number", "debtor", "chapter")


@query("SELECT count(*) AS hotspots, round(sum(value), 4) AS frp, round(max(value * 2), 4) AS brightness FROM obs WHERE obs_id % 4 <> 0")
def src_read_fire_csv(spark, d):
    path = new_path(spark, "fires")
    o = obs(spark, d)
    bad = F.when(F.col("obs_id") % 4 == 0, "n")
    rows = o.select(F.lit("1.5").alias("latitude"), F.lit("-2").alias("longitude"), (F.col("value") * 2).cast("string").alias("brightness"), F.coalesce(bad, F.lit("80")).alias("confidence"), F.col("value").cast("string").alias("frp"), F.to_date("ts").cast("string").alias("acq_date"), F.lit("0100").alias("acq_time"))
    rows.write.csv(path, header=True)
    return files.read_fire_csv(spark, path).agg(F.count("*").alias("hotspots"), F.round(F.sum("frp"), 4).alias("frp"), F.round(F.max("brightness"), 4).alias("brightness"))


@query("SELECT CASE WHEN c_custkey % 2 = 0 THEN 'T' || c_custkey ELSE '' END AS ticker, c_name AS company FROM customer")
def fn_ticker_from_display(spark, d):
    """A listed name is followed by its ticker, or several, in brackets; then its registry number."""
    tickers = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("  (T"), "c_custkey", F.lit(", T-WS)"))).otherwise("")
    shown = F.concat("c_name", tickers, F.lit("  (CIK 000"), "c_custkey", F.lit(")"))
    return table(spark, d, "customer").select(ticker_of(shown).alias("ticker"), company_of(shown).alias("company"))


def ticker_of(shown: Column) -> Column:
    """The first symbol of the first bracket that holds nothing but symbols; empty if there is none."""
    inside = F.regexp_extract_all(shown, F.lit(r"\(([^()]*)\)"), F.lit(1))
    symbols = F.filter(inside, lambda x: F.regexp_like(x, F.lit(r"^[A-Z][A-Z0-9.-]{0,9}(,\s*[A-Z0-9.-]+)*$")))
    return F.coalesce(F.get(F.split(F.get(symbols, 0), ","), 0), F.lit(""))


def company_of(shown: Column) -> Column:
    at = F.instr(shown, "(")
    return F.trim(F.when(at > 1, F.substr(shown, F.lit(1), at - 1)).otherwise(shown))


@query("""WITH f AS (SELECT o_orderkey AS id, o_orderpriority AS source, o_custkey % 6 AS shape FROM orders), s AS (SELECT source, shape, count(*) AS n FROM f GROUP BY 1, 2 HAVING count(*) >= 5)
SELECT source, CASE WHEN shape < 3 THEN 0 ELSE 3 END AS cluster, CAST(sum(n) AS BIGINT) AS members, count(*) AS shapes FROM s GROUP BY 1, 2""")
def drf_field_set_clusters(spark, d):
    """Records of a source with alike field sets: a Jaccard similarity of one half or more, joined over distinct sets, so copies are one vertex.

    Candidates share a field; a set's size bounds its partners'. Clusters are components, which don't depend on an order.
    """
    o = table(spark, d, "orders")
    base = F.when(F.col("o_custkey") % 6 < 3, F.array(*[F.lit(x) for x in "abcd"])).otherwise(F.array(*[F.lit(x) for x in "wxyz"]))
    fields = F.array_sort(F.array_union(base, F.array(F.concat(F.lit("own"), (F.col("o_custkey") % 6).cast("string")))))
    sets = written(o.groupBy(F.col("o_orderpriority").alias("source"), fields.alias("fields"), (F.col("o_custkey") % 6).alias("shape")).agg(F.count("*").alias("n")).where("n >= 5").withColumn("id", F.concat_ws("|", "source", F.array_join("fields", ","))), "field-sets")
    each = sets.select("source", "id", F.size("fields").alias("size"), F.explode("fields").alias("field"))
    both = each.toDF("source", "a", "na", "field").join(each.toDF("source", "b", "nb", "field"), ["source", "field"]).where("a < b and nb <= 2 * na and na <= 2 * nb").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("common"))
    roots = components(both.where("common >= 0.5 * (na + nb - common)"), "a", "b")
    named = sets.join(roots, F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "id"))
    return named.groupBy("source", "root").agg(F.min("shape").alias("cluster"), F.sum("n").alias("members"), F.count("*").alias("shapes")).drop("root")


@query("SELECT obs_id, entity_id FROM obs WHERE obs_id % 2 = 0 UNION ALL SELECT obs_id, entity_id FROM obs WHERE obs_id % 3 = 0")
def src_append_observations(spark, d):
    """Appends repeat rows; readers deal with that."""
    path = new_path(spark, "observations")
    o = obs(spark, d).select("obs_id", "entity_id", "source")
    for part in (2, 3):
        o.where(f"obs_id % {part} = 0").write.mode("append").partitionBy("source").parquet(path)
    return spark.read.parquet(path).select("obs_id", "entity_id")


@query("""WITH b AS (SELECT entity_type AS variable_name, entity_id AS version, name AS value, 1 AS k FROM entities UNION ALL SELECT entity_type, entity_id, 'new ' || name, 2 FROM entities WHERE entity_type <> 'customer')
SELECT variable_name, version, arg_max(value, k) AS value FROM b GROUP BY 1, 2""")
def src_upsert_beliefs(spark, d):
    """A table partitioned by variable; a batch for all but one of them is written over its keys, and the table read back."""
    e = entities(spark, d).select(F.col("entity_type").alias("variable_name"), F.col("entity_id").alias("version"), F.lit("1999-01-01").alias("effective_at"), F.col("name").alias("value"), F.lit(1).alias("at"))
    new = e.where("variable_name <> 'customer'").withColumn("value", F.concat(F.lit("new "), "value")).withColumn("at", F.lit(2))
    t = PartitionedTable.create(e, ["variable_name"])
    t.upsert(new, ["variable_name", "version", "effective_at"], "at")
    return t.read().select("variable_name", "version", "value")


@query("""WITH d AS (SELECT entity_id, CAST(ts AS DATE) AS day, avg(value) AS v FROM obs GROUP BY 1, 2) SELECT 'daily_mean' AS feature, entity_id, concat('', day) AS effective_at, round(v, 6) AS value, NULL AS missing_reason FROM d
UNION ALL SELECT 'gap', entity_id, concat('', day), NULL, 'not_finite' FROM d""")
def udf_feature_builder(spark, d):
    """Registered builders over the observations: a daily mean, and one that has no finite value."""
    daily = lambda o: o.groupBy("entity_id", F.to_date("ts").alias("effective_at"))
    plugins.feature("daily_mean")(lambda o: daily(o).agg(F.avg("value").alias("value")))
    plugins.feature("gap")(lambda o: daily(o).agg(F.lit(float("nan")).alias("value")))
    out = plugins.build_features(obs(spark, d), ["daily_mean", "gap"])
    return out.select("feature", "entity_id", F.col("effective_at").cast("string").alias("effective_at"), F.round("value", 6).alias("value"), "missing_reason")


@query("SELECT obs_id, source || '.' || entity_id AS signal_id, round(value - 50, 6) AS value, CASE WHEN value > 50 THEN 1 WHEN value < 50 THEN -1 ELSE 0 END AS direction FROM obs WHERE source IN ('purchase', 'error')")
def udf_evidence_extractor(spark, d):
    """Two sources have an extractor; the others give no evidence."""
    rule = {"value": "value - 50", "direction": "signum(value - 50)", "confidence": "value / 100"}
    e = plugins.evidence(obs(spark, d), {"purchase": rule, "error": rule}, keep=("obs_id",))
    return e.select("obs_id", "signal_id", F.round("value", 6).alias("value"), "direction")


@query("WITH r AS (SELECT year(d) AS fold, brand AS asset, ret FROM bars WHERE ret IS NOT NULL), v AS (SELECT fold, asset, 1 / greatest(stddev_pop(ret), 1e-9) AS w FROM r GROUP BY 1, 2) SELECT fold, asset, round(w / sum(w) OVER (PARTITION BY fold), 4) AS weight FROM v")
def udf_strategy(spark, d):
    """Inverse deviation as a user strategy: a fold is a year, and its own returns are the training ones."""
    folds = bars(spark, d).where("ret is not null").select(F.year("d").cast("long").alias("fold"), F.col("brand").alias("asset"), "d", F.lit(True).alias("train"), "ret")

    def weights(train, test):
        import numpy as np

        held = np.where(train == 0, np.nan, train)  # days without a bar
        w = 1 / np.maximum(np.nanstd(held, axis=0), 1e-9)
        return w / w.sum()

    return plugins.strategy(folds, weights).select("fold", "asset", F.round("weight", 4).alias("weight"))


@query("SELECT brand AS key, round(avg(ret), 6) AS estimate, true AS inside FROM bars WHERE ret IS NOT NULL GROUP BY 1")
def udf_metric(spark, d):
    """A user statistic under the block bootstrap: the mean lies inside its own wide interval."""
    series = bars(spark, d).where("ret is not null").select(F.col("brand").alias("key"), "d", "ret")
    out = plugins.bootstrap_metric(series, lambda x: float(x.mean()))
    width = F.col("hi") - F.col("lo")
    return out.select("key", F.round("estimate", 6).alias("estimate"), F.col("estimate").between(F.col("lo") - width, F.col("hi") + width).alias("inside"))


@query("WITH r(category, frequency, ttl) AS (VALUES ('logistics', 'daily', 86400), ('demand', 'weekly', 604800), ('urgency', 'monthly', 2592000), ('returns', 'daily', 777)) SELECT DISTINCT signal AS signal_id, s.category, frequency, ttl AS ttl_seconds, 30 AS min_observations FROM series s JOIN r ON r.category = s.category")
def udf_signal_registry(spark, d):
    """A registry of rules by category, applied to all signals; a missing lifetime is a period of the frequency."""
    from .views import series

    rules = plugins.signal_registry(spark, [("logistics", "logistics", "daily", False, None, None), ("demand", "demand", "weekly", False, None, None), ("urgency", "urgency", "monthly", True, None, None), ("returns", "returns", "daily", False, 777, 30)])
    s = series(spark, d).select(F.col("signal").alias("own_id"), "category").distinct()
    return s.join(F.broadcast(rules), "category").select(F.col("own_id").alias("signal_id"), "category", "frequency", "ttl_seconds", "min_observations")  # four rules
