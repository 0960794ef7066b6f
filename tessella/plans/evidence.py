"""Documents as evidence: deduplication, mentions, relations, neighbours."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import capitalised, sentences
from ..registry import query
from .views import country_events, table

WORDS = "[A-Za-z][A-Za-z]{5,}"


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS h, count(*) AS copies FROM documents GROUP BY 2")
def txt_document_dedupe(spark, d):
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "h", "copies")


DICT = f"dc AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '{WORDS}'))) AS w FROM benchmark)"
SENT = r"se AS (SELECT doc_id, unnest(ss) AS s, generate_subscripts(ss, 1) - 1 AS n FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS ss FROM documents))"
MENT = f"""{DICT}, {SENT}, tk AS (SELECT DISTINCT doc_id, n, lower(unnest(regexp_extract_all(s, '[A-Za-z]+'))) AS w FROM se), mt AS (SELECT doc_id, n, w AS entity, 0.95 AS confidence FROM tk WHERE w IN (SELECT w FROM dc))"""


def dictionary(spark, d):
    return table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(f"({WORDS})"))).alias("w")).select(F.lower("w").alias("w")).distinct()


def split_sentences(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(sentences(F.col("text"))).alias("n", "s"))


def mentions(spark, d):
    """Dictionary words in each sentence, once; an equality join on the word, broadcast by Spark when small."""
    t = split_sentences(spark, d).select("doc_id", "n", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("s", F.lit("([A-Za-z]+)")), F.lower))).alias("w"))
    return t.join(dictionary(spark, d), "w").select("doc_id", "n", F.col("w").alias("entity"), F.lit(0.95).alias("confidence"))


@query(f"WITH {MENT} SELECT doc_id, n, entity, confidence FROM mt")
def txt_mention_extraction(spark, d):
    return mentions(spark, d).withColumn("n", F.col("n").cast("long"))


@query(rf"WITH {SENT}, sp AS (SELECT doc_id, n, unnest(regexp_extract_all(s, '([A-Z][A-Za-z]+(?: [A-Z][A-Za-z]+){{0,3}})', 1)) AS span FROM se) SELECT doc_id, span, min(n) AS first FROM sp WHERE length(span) >= 12 GROUP BY 1, 2")
def txt_capitalised_mentions(spark, d):
    s = split_sentences(spark, d).select("doc_id", "n", F.explode(capitalised(F.col("s"))).alias("span")).where("length(span) >= 12")
    return s.groupBy("doc_id", "span").agg(F.min("n").cast("long").alias("first"))


RELS = f"""{MENT}, kp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, n ORDER BY entity) AS k FROM mt) WHERE k <= 12),
rl AS (SELECT doc_id, a, b, max(c) AS c FROM (SELECT a.doc_id, a.entity AS a, b.entity AS b, 0.9 AS c FROM kp a JOIN kp b ON a.doc_id = b.doc_id AND a.n = b.n AND a.entity < b.entity UNION ALL SELECT a.doc_id, least(a.entity, b.entity), greatest(a.entity, b.entity), 0.4 FROM kp a JOIN kp b ON a.doc_id = b.doc_id AND b.n = a.n + 1 AND a.entity <> b.entity) GROUP BY 1, 2, 3),
r2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, a, b) AS k FROM rl) WHERE k <= 2000)"""


def relations(spark, d):
    """Pairs in the same sentence (0.9) or in adjacent ones (0.4): 12 mentions a sentence and 2,000 links a document at most, by definition."""
    k = mentions(spark, d).withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "n").orderBy("entity"))).where("k <= 12")
    a, b = k.select("doc_id", "n", F.col("entity").alias("x")), k.select("doc_id", "n", F.col("entity").alias("y"))
    same = a.join(b, ["doc_id", "n"]).where("x < y").select("doc_id", F.col("x").alias("a"), F.col("y").alias("b"), F.lit(0.9).alias("c"))
    following = a.join(b.withColumn("n", F.col("n") - 1), ["doc_id", "n"]).where("x <> y").select("doc_id", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.lit(0.4).alias("c"))
    r = same.union(following).groupBy("doc_id", "a", "b").agg(F.max("c").alias("c"))
    return r.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("c"), "a", "b"))).where("k <= 2000").drop("k")


@query(f"WITH {RELS} SELECT doc_id, a, b, CAST(c AS DOUBLE) AS confidence FROM r2")
def txt_sentence_relations(spark, d):
    return relations(spark, d).withColumnRenamed("c", "confidence")


@query(f"WITH {MENT}, f AS (SELECT min(entity) AS e FROM mt) SELECT doc_id, count(*) AS mentions FROM mt, f WHERE entity = e GROUP BY 1")
def txt_entity_search(spark, d):
    m = mentions(spark, d)
    first = F.broadcast(m.agg(F.min("entity").alias("e")))  # one row
    return m.join(first, F.col("entity") == F.col("e")).groupBy("doc_id").agg(F.count("*").alias("mentions"))


@query(f"WITH {RELS} SELECT a, b, count(*) AS docs, max(c)::DOUBLE AS confidence FROM r2 GROUP BY 1, 2 HAVING max(c) >= 0.9")
def txt_related_entities(spark, d):
    return relations(spark, d).groupBy("a", "b").agg(F.count("*").alias("docs"), F.max("c").alias("confidence")).where("confidence >= 0.9")


@query(f"WITH {MENT}, dm AS (SELECT DISTINCT doc_id, entity FROM mt) SELECT a.entity AS a, b.entity AS b, count(*) AS docs FROM dm a JOIN dm b ON a.doc_id = b.doc_id AND a.entity < b.entity GROUP BY 1, 2 HAVING count(*) >= 2")
def txt_doc_co_occurrence(spark, d):
    return cross_doc(spark, d)


def cross_doc(spark, d):
    """Pairs of dictionary entities by the documents that hold both; a document holds each entity once."""
    m = mentions(spark, d).groupBy("doc_id").agg(F.sort_array(F.collect_set("entity")).alias("es"))
    pairs = F.expr("flatten(transform(es, (x, i) -> transform(slice(es, i + 2, size(es)), y -> struct(x as a, y as b))))")
    return m.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("docs")).where("docs >= 2")


@query(f"WITH {MENT}, dm AS (SELECT DISTINCT doc_id, entity FROM mt) SELECT a.entity AS a, b.entity AS b, count(*) AS docs FROM dm a JOIN dm b ON a.doc_id = b.doc_id AND a.entity < b.entity GROUP BY 1, 2 HAVING count(*) >= 2 ORDER BY docs DESC, a, b LIMIT 30")
def txt_cross_doc_pairs(spark, d):
    return cross_doc(spark, d).orderBy(F.desc("docs"), "a", "b").limit(30)


@query(f"WITH {RELS} SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM mt) AS mentions, (SELECT count(*) FROM r2) AS links, (SELECT count(DISTINCT entity) FROM mt) AS entities")
def txt_evidence_stats(spark, d):
    m = mentions(spark, d).agg(F.count("*").alias("mentions"), F.countDistinct("entity").alias("entities"))
    docs, n = table(spark, d, "documents").agg(F.count("*").alias("documents")), relations(spark, d).agg(F.count("*").alias("links"))
    return docs.join(F.broadcast(m)).join(F.broadcast(n)).select("documents", "mentions", "links", "entities")  # one row each


@query("SELECT entity_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS cycle, 'Event in ' || entity_id || ' class ' || quad AS text, count(*) AS events FROM country_events GROUP BY 1, 2, quad")
def txt_event_documents(spark, d):
    e = country_events(spark, d)
    return e.groupBy("entity_id", F.to_date("ts").cast("string").alias("cycle"), "quad").agg(F.count("*").alias("events")).select("entity_id", "cycle", F.concat(F.lit("Event in "), "entity_id", F.lit(" class "), F.col("quad").cast("string")).alias("text"), "events")
