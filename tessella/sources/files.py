"""Readers of source files: event batches, positioning reports, filings, sanction lists, yields, statistics cubes, feeds.

All are Spark readers with a given schema; casts are lenient (null on failure), and malformed rows are dropped
where a rule says so. Paths may be lists or patterns. Streaming forms read the same files as they arrive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import date_seconds, safe_number

# Column positions of the public 61-column event format.
EVENT_FIELDS = {
    "event_id": 0, "day": 1, "actor1_name": 6, "actor1_country": 7, "actor1_type": 12, "actor2_name": 16, "actor2_country": 17, "actor2_type": 22, "event_code": 26, "event_root": 28, "quad_class": 29, "goldstein": 30,
    "num_mentions": 31, "num_sources": 32, "avg_tone": 34, "place": 52, "place_country": 53, "lat": 56, "lon": 57, "source_url": 60,
}
EVENT_COLUMNS = 61
NUMBERS = {"quad_class": "int", "goldstein": "double", "num_mentions": "int", "num_sources": "int", "avg_tone": "double", "lat": "double", "lon": "double"}


def event_columns(lines: DataFrame) -> DataFrame:
    """From a column `value` of tab-separated lines; shorter lines are dropped."""
    cells = lines.select(F.split("value", "\t").alias("c")).where(F.size("c") >= EVENT_COLUMNS)
    cell = lambda i: F.trim(F.element_at("c", i + 1))
    return cells.select(*[(safe_number(cell(i)).cast(NUMBERS[n]) if n in NUMBERS else F.nullif(cell(i), F.lit(""))).alias(n) for n, i in EVENT_FIELDS.items()])


def read_tsv_event_batches(spark: SparkSession, paths) -> DataFrame:
    return event_columns(spark.read.text(paths))


def stream_tsv_event_batches(spark: SparkSession, path: str) -> DataFrame:
    """Batches as they are published; their time is the file's."""
    return event_columns(spark.readStream.text(path))


TEXT_COLUMNS = {
    "Market_and_Exchange_Names", "Report_Date_as_YYYY-MM-DD", "CFTC_Contract_Market_Code", "CFTC_Market_Code", "CFTC_Region_Code", "CFTC_Commodity_Code", "Contract_Units",
    "CFTC_SubGroup_Code", "FutOnly_or_Combined", "As_of_Date_In_Form_YYMMDD",
}
LEAST_FIELDS = 22


def read_positioning_csv(spark: SparkSession, paths, headers: list[str] | None = None) -> DataFrame:
    """Weekly report rows. headers names the columns of files without a header line; else the files have one.
    Percent and concentration columns are doubles, the known text columns strings, all others integers. Rows with
    fewer than 22 fields are dropped."""
    raw = spark.read.csv(paths, header=headers is None, schema=", ".join(f"`{h}` string" for h in headers) if headers else None, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, mode="PERMISSIVE")
    filled = sum((F.col(f"`{c}`").isNotNull().cast("int") for c in raw.columns[:LEAST_FIELDS]), F.lit(0))
    out = raw.where(filled >= min(LEAST_FIELDS, len(raw.columns))) if len(raw.columns) >= LEAST_FIELDS else raw.where("false")

    def kind(c: str) -> Column:
        x = F.col(f"`{c}`")
        if c in TEXT_COLUMNS:
            return x
        return safe_number(x) if "Pct_of" in c or "Conc_" in c else x.try_cast("long")

    return out.select(*[kind(c).alias(c) for c in raw.columns])


def xml(spark: SparkSession, paths, row_tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).option("ignoreNamespace", "true").schema(schema).load(paths)


VALUE = "struct<value: string>"
TRANSACTION = f"struct<transactionDate: {VALUE}, transactionCoding: struct<transactionCode: string>, transactionAmounts: struct<transactionShares: {VALUE}, transactionPricePerShare: {VALUE}>>"
FILING = f"""issuer struct<issuerCik: string, issuerName: string, issuerTradingSymbol: string>,
reportingOwner array<struct<reportingOwnerId: struct<rptOwnerCik: string, rptOwnerName: string>, reportingOwnerRelationship: struct<officerTitle: string>>>,
nonDerivativeTable struct<nonDerivativeTransaction: array<{TRANSACTION}>>"""


def read_filing_xml(spark: SparkSession, paths) -> DataFrame:
    """One row per open-market purchase (code P) with shares above zero; the last owner named counts."""
    f = xml(spark, paths, "ownershipDocument", FILING).withColumn("t", F.explode("nonDerivativeTable.nonDerivativeTransaction"))
    owner = F.element_at("reportingOwner", -1)
    shares = F.coalesce(safe_number(F.col("t.transactionAmounts.transactionShares.value")), F.lit(0.0))
    return f.where((F.trim("t.transactionCoding.transactionCode") == "P") & (shares > 0)).select(
        F.upper(F.trim("issuer.issuerTradingSymbol")).alias("ticker"), F.trim("issuer.issuerName").alias("company"), F.trim(owner["reportingOwnerId"]["rptOwnerName"]).alias("name"), F.trim(owner["reportingOwnerRelationship"]["officerTitle"]).alias("role"),
        shares.alias("shares"), F.coalesce(safe_number(F.col("t.transactionAmounts.transactionPricePerShare.value")), F.lit(0.0)).alias("price"), F.trim("t.transactionDate.value").alias("date"),
        F.trim(owner["reportingOwnerId"]["rptOwnerCik"]).alias("reporter_cik"), F.trim("issuer.issuerCik").alias("issuer_cik"),
    )


NOTICE = """formData struct<
issuerInfo: struct<issuerName: string, nameOfPersonForWhoseAccountTheSecuritiesAreToBeSold: string, relationshipsToIssuer: struct<relationshipToIssuer: string>>,
securitiesInformation: struct<noOfUnitsSold: string, aggregateMarketValue: string, noOfUnitsOutstanding: string, approxSaleDate: string, securitiesExchangeName: string>>"""


def read_sale_notice_xml(spark: SparkSession, paths) -> DataFrame:
    """Sale intents; a notice without the seller's name is dropped."""
    n = xml(spark, paths, "edgarSubmission", NOTICE)
    i, s = "formData.issuerInfo", "formData.securitiesInformation"
    person = F.trim(f"{i}.nameOfPersonForWhoseAccountTheSecuritiesAreToBeSold")
    return n.where(F.coalesce(person, F.lit("")) != "").select(
        F.trim(f"{i}.issuerName").alias("company"), person.alias("insider"), F.trim(f"{i}.relationshipsToIssuer.relationshipToIssuer").alias("relationship"),
        F.coalesce(safe_number(F.col(f"{s}.noOfUnitsSold")), F.lit(0.0)).cast("long").alias("shares"), F.coalesce(safe_number(F.col(f"{s}.aggregateMarketValue")), F.lit(0.0)).alias("value"),
        F.coalesce(safe_number(F.col(f"{s}.noOfUnitsOutstanding")), F.lit(0.0)).cast("long").alias("outstanding"), F.to_date(F.timestamp_seconds(date_seconds(F.col(f"{s}.approxSaleDate")))).alias("sale_date"),
        F.trim(f"{s}.securitiesExchangeName").alias("exchange"),
    )


def labelled(remarks: Column, label: str) -> Column:
    """The values of the fields of a remark, which stand between semicolons, that carry a label; quotes and brackets around them go."""
    fields = F.split(F.coalesce(remarks, F.lit("")), ";")
    place = lambda x: F.locate(label, F.lower(x))
    value = lambda x: F.btrim(F.substr(x, place(x) + len(label)), F.lit(" '\"()."))
    return F.filter(F.transform(F.filter(fields, lambda x: place(x) > 0), value), lambda x: x != "")


SANCTION_COLUMNS = ["uid", "name", "type", "program", "title", "call_sign", "vessel_type", "tonnage", "grt", "flag", "owner", "remarks"]


def read_sanctions_csv(spark: SparkSession, paths) -> DataFrame:
    """Headerless list; '-0-' is empty; rows without a numeric uid are dropped; 'A] [B' are two programmes."""
    raw = spark.read.csv(paths, schema=", ".join(f"{c} string" for c in SANCTION_COLUMNS), escape='"')
    clean = raw.select(*[F.nullif(F.nullif(F.trim(c), F.lit("-0-")), F.lit("")).alias(c) for c in SANCTION_COLUMNS]).where(F.col("uid").try_cast("long").isNotNull())
    programs = F.filter(F.transform(F.split(F.coalesce("program", F.lit("")), r"\]\s*\["), lambda p: F.regexp_replace(F.trim(p), r"^\[+|\]+$", "")), lambda p: p != "")
    kind = F.when(F.lower("type").isin("individual", "vessel", "aircraft"), F.lower("type")).otherwise("entity")
    aliases = labelled(F.col("remarks"), "a.k.a.")
    nationality = F.try_element_at(labelled(F.col("remarks"), "nationality"), F.lit(1))
    return clean.select(F.lit("ofac").alias("source"), F.col("uid").alias("entity_id"), F.coalesce("name", F.lit("")).alias("name"), kind.alias("type"), programs.alias("programs"), F.lit(None).cast("string").alias("listed_date"), nationality.alias("nationality"), aliases.alias("aliases"), F.coalesce("remarks", F.lit("")).alias("remarks"))


PERSON = "DATAID string, FIRST_NAME string, SECOND_NAME string, THIRD_NAME string, UN_LIST_TYPE string, LISTED_ON string, COMMENTS1 string, NATIONALITY array<struct<VALUE: string>>, INDIVIDUAL_ALIAS array<struct<ALIAS_NAME: string>>"
BODY = "DATAID string, FIRST_NAME string, NAME_ORIGINAL_SCRIPT string, UN_LIST_TYPE string, LISTED_ON string, COMMENTS1 string, ENTITY_ALIAS array<struct<ALIAS_NAME: string>>"


def read_sanctions_xml(spark: SparkSession, paths) -> DataFrame:
    """Consolidated list: individuals and entities in one table; records without an id are dropped."""

    def rows(df: DataFrame, kind: str, name: Column, nationality: Column, alias: str) -> DataFrame:
        programs = F.filter(F.array(F.coalesce("UN_LIST_TYPE", F.lit(""))), lambda p: p != "")
        aliases = F.filter(F.coalesce(F.col(f"{alias}.ALIAS_NAME"), F.array().cast("array<string>")), lambda a: a.isNotNull())
        return df.where(F.coalesce("DATAID", F.lit("")) != "").select(F.lit("un").alias("source"), F.col("DATAID").alias("entity_id"), name.alias("name"), F.lit(kind).alias("type"), programs.alias("programs"), F.col("LISTED_ON").alias("listed_date"), nationality.alias("nationality"), aliases.alias("aliases"), F.coalesce("COMMENTS1", F.lit("")).alias("remarks"))

    people, bodies = xml(spark, paths, "INDIVIDUAL", PERSON), xml(spark, paths, "ENTITY", BODY)
    full = F.array_join(F.array_compact(F.array(*[F.nullif(F.trim(c), F.lit("")) for c in ("FIRST_NAME", "SECOND_NAME", "THIRD_NAME")])), " ")
    first = F.filter(F.col("NATIONALITY.VALUE"), lambda x: x.isNotNull())
    return rows(people, "individual", full, F.try_element_at(first, F.lit(1)), "INDIVIDUAL_ALIAS").unionByName(rows(bodies, "entity", F.coalesce("FIRST_NAME", "NAME_ORIGINAL_SCRIPT", F.lit("")), F.lit(None).cast("string"), "ENTITY_ALIAS"))


def read_sdmx_csv(spark: SparkSession, paths) -> DataFrame:
    """period and value; rows without either are dropped."""
    raw = spark.read.csv(paths, header=True)
    out = raw.select(F.trim("TIME_PERIOD").alias("period"), safe_number(F.col("OBS_VALUE")).alias("value"))
    return out.where("period <> '' and value is not null")


# Maturities of the public yield-curve feed.
MATURITIES = {"BC_1MONTH": "1m", "BC_3MONTH": "3m", "BC_6MONTH": "6m", "BC_1YEAR": "1y", "BC_2YEAR": "2y", "BC_5YEAR": "5y", "BC_10YEAR": "10y", "BC_30YEAR": "30y"}


def read_yield_xml(spark: SparkSession, paths) -> DataFrame:
    """date, yields by tenor, and the 2s10s and 3m10y slopes."""
    raw = xml(spark, paths, "properties", "NEW_DATE string, " + ", ".join(f"{m} string" for m in MATURITIES)).where("NEW_DATE is not null")
    y = {label: safe_number(F.col(m)) for m, label in MATURITIES.items()}
    pairs = F.map_filter(F.create_map(*[x for label, v in y.items() for x in (F.lit(label), v)]), lambda _, v: v.isNotNull())
    return raw.select(F.substring("NEW_DATE", 1, 10).alias("date"), pairs.alias("yields"), F.round(y["10y"] - y["2y"], 4).alias("curve_2s10s"), F.round(y["10y"] - y["3m"], 4).alias("curve_3m10y"))


CUBE = "value map<string,double>, id array<string>, size array<int>, dimension map<string,struct<category:struct<index:map<string,int>,label:map<string,string>>>>"


def jsonstat_rows(cubes: DataFrame, col: str = "value") -> DataFrame:
    """A column of JSON-stat texts to (dimension codes, value): the flat index in mixed radix over the sizes."""
    c = cubes.select(F.from_json(col, CUBE).alias("j")).select("j.*").select("id", "size", "dimension", F.explode("value").alias("flat", "v")).withColumn("flat", F.col("flat").cast("long"))
    after = F.expr("transform(size, (s, i) -> aggregate(slice(size, i + 2, size(size)), 1L, (a, x) -> a * x))")
    at = c.withColumn("step", after).withColumn("pos", F.expr("transform(size, (s, i) -> cast(pmod(flat div step[i], s) as int))"))
    codes = F.expr("map_from_arrays(id, transform(id, (d, i) -> map_keys(map_filter(dimension[d].category.index, (k, v) -> v = pos[i]))[0]))")
    return at.select(codes.alias("codes"), F.col("v").alias("value")).where("value is not null")


def read_jsonstat(spark: SparkSession, paths) -> DataFrame:
    return jsonstat_rows(spark.read.text(paths, wholetext=True))


def read_feed(spark: SparkSession, paths) -> DataFrame:
    """Docket feed items: case number and debtor from the title, chapter (spelled out or short: "Chapter 11", "Ch. 11", "ch 7") from the description or the title."""
    items = xml(spark, paths, "item", "title string, link string, description string, pubDate string")
    title, text = F.trim(F.coalesce("title", F.lit(""))), F.trim(F.coalesce("description", F.lit("")))
    case = F.regexp_extract(title, r"^(\S*\d\S*)\s+(.+)$", 1)
    chapter = lambda x: F.nullif(F.regexp_extract(x, r"(?i)\b(?:chapter|chap\.?|ch\.?)[:\s]*(\d{1,2})\b", 1), F.lit(""))
    when = F.try_to_timestamp(F.regexp_extract(F.col("pubDate"), r"(\d{1,2} \w{3} \d{4} \d{2}:\d{2}:\d{2})", 1), F.lit("d MMM yyyy HH:mm:ss"))
    return items.select(case.alias("case_number"), F.when(case != "", F.regexp_extract(title, r"^(\S*\d\S*)\s+(.+)$", 2)).otherwise(title).alias("debtor"), F.coalesce(chapter(text), chapter(title)).alias("chapter"), when.alias("published"), F.trim("link").alias("link"), F.substring(text, 1, 300).alias("description"))


def read_fire_csv(spark: SparkSession, paths) -> DataFrame:
    """Hotspots; rows without numeric position, brightness, confidence or power are dropped."""
    raw = spark.read.csv(paths, header=True)
    num = {c: safe_number(F.col(c)) for c in ("latitude", "longitude", "brightness", "frp")}
    out = raw.select(num["latitude"].alias("lat"), num["longitude"].alias("lon"), num["brightness"].alias("brightness"), F.col("confidence").try_cast("int").alias("confidence"), num["frp"].alias("frp"), "acq_date", "acq_time")
    return out.dropna(subset=["lat", "lon", "brightness", "confidence", "frp"])
