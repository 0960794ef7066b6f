"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, divergence, exact, filter_audit, lines, packing, quality, sharding, simhash, substrings, toxicity, warc
from .common import LOWER, UPPER


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


def held_out(folds: int = 5, fold: int = 0, col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    out = quality.scored(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), F.col("quality_score").alias("score"), F.expr("cast(quality_score >= 0.3 as int)").alias("predicted"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleave(table(spark, sf_dir, "documents"), shards=24).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "lines.n_lines", "lines.n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", F.explode("leaks").alias("x")).select("doc_id", "x.item_id", "x.edits", "x.first_word", "x.n_words")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "words.n_words", "words.n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write(table(spark, sf_dir, "pages"))
    return warc.read(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"), keep="largest")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, apart = table(spark, sf_dir, "documents").select("doc_id", "text"), held_out(4, 2)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~apart), unlabelled=~apart)
    return toxicity.scored(docs, model).select("doc_id", apart.alias("held_out"), F.col("toxicity").alias("score"), F.expr("cast(toxicity >= 0.3 as int)").alias("predicted"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_packing, op2_quality_classifier, op3_sharding, op4_line_dedup, op5_chat_formatting, op6_decontamination, op7_substring_dedup,
        op8_warc, op9_exact_dedup, op10_simhash_near_dedup, op11_filter_audit, op12_divergence_audit, op13_toxicity,
    )
}

ORACLES: dict[str, str] = {
    # DuckDB has no CRC-32: it is folded over the bytes with a table made from the reversed polynomial
    "op3_sharding": """
WITH tab AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, n)) AS t),
h AS (SELECT doc_id, coalesce(source, '') AS source, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, source, len(h) // 2 + 8 AS size, list_transform(range(1, len(h), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT)) AS bs FROM h),
c AS (SELECT doc_id, source, size, xor(4294967295, list_reduce(bs, lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8), 4294967295)) AS crc FROM b, tab),
m AS (SELECT *, md5('deal:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || crc || ':' || size) AS m FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY m, doc_id, crc, size) - 1 AS r, count(*) OVER (PARTITION BY source) AS n, count(*) OVER () AS total FROM m),
g AS (SELECT *, row_number() OVER (ORDER BY (2 * r + 1) / (2 * n), md5(source), source, r) - 1 AS g FROM r)
SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, CAST(g * 24 // total AS INTEGER) AS shard, g - ((g * 24 // total) * total + 23) // 24 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM g""",
    "op4_line_dedup": f"""
WITH t AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM t),
r AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
j AS (SELECT k.doc_id, i, line, coalesce(k.doc_id > r.first, false) AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id""",
    "op5_chat_formatting": """
WITH r AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
t AS (SELECT CAST(conv_id AS VARCHAR) AS key, * FROM r WHERE conv_id IS NOT NULL UNION ALL SELECT DISTINCT 'alone:' || md5(role) || md5(text), NULL, 0, role, text FROM r WHERE conv_id IS NULL),
a AS (SELECT key, max(conv_id) AS conv_id, list(struct_pack(r := role, x := text) ORDER BY turn NULLS FIRST, role, md5(text)) AS ts FROM t GROUP BY key),
u AS (SELECT min(conv_id) AS conv_id, ts FROM a GROUP BY ts),
k AS (SELECT * FROM u WHERE NOT EXISTS (SELECT 1 FROM u b WHERE len(b.ts) > len(u.ts) AND b.ts[1] = u.ts[1] AND b.ts[1:len(u.ts)] = u.ts))
SELECT conv_id, len(ts) AS n_turns, array_to_string(list_transform(ts, lambda t: t.r), ',') AS roles,
  array_to_string(list_transform(ts, lambda t: '<|' || t.r || '|>' || chr(10) || t.x || chr(10) || '<|end|>'), chr(10)) AS chat FROM k""",
    "op7_substring_dedup": r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 33, 1))) AS i FROM t),
h AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS win FROM s),
r AS (SELECT doc_id, i FROM h QUALIFY count(*) OVER (PARTITION BY win) > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM r),
l AS (SELECT doc_id, list(p) AS ps FROM c GROUP BY doc_id),
k AS (SELECT t.doc_id, len(w) AS n, coalesce(len(ps), 0) AS gone, w, ps FROM t LEFT JOIN l ON t.doc_id = l.doc_id),
u AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM t),
j AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.p) AS txt FROM u LEFT JOIN c ON u.doc_id = c.doc_id AND u.p = c.p WHERE c.p IS NULL GROUP BY u.doc_id)
SELECT k.doc_id, n AS n_words, gone AS n_removed, sha256(coalesce(txt, '')) AS kept_sha256 FROM k LEFT JOIN j ON k.doc_id = j.doc_id""",
    "op8_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
g AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY h) ELSE page_id END AS first FROM p)
SELECT page_id, n AS payload_bytes, sha256(h) AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM g""",
    "op9_exact_dedup": f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)""",
    "op11_filter_audit": r"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w),
  100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text), regexp_matches(text, '[#$%&*|]'),
  coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY text), false)] AS f FROM t LEFT JOIN l ON t.doc_id = l.doc_id),
g AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY part, f),
o AS (SELECT '' AS o UNION ALL SELECT o || c FROM o, unnest(['A', 'B', 'C', 'D', 'E']) u(c) WHERE len(o) < 5 AND NOT contains(o, c)),
s AS (SELECT o AS filter_order, step, substr(o, step, 1) AS filter, substr(o, 1, step - 1) AS before FROM o, range(1, 6) r(step) WHERE len(o) = 5),
x AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, filter, n, good, toxic, f[ascii(filter) - 64] AS own,
  len(list_filter([1, 2, 3, 4, 5], lambda i: f[i] AND contains(before, chr(CAST(64 + i AS INTEGER))))) > 0 AS gone, len(list_filter(f, lambda b: b)) AS fails FROM g, s),
y AS (SELECT part, filter_order, step, filter, sum(n) FILTER (WHERE NOT own AND NOT gone) AS kept, sum(n) FILTER (WHERE own AND NOT gone) AS removed, sum(n) FILTER (WHERE own AND gone) AS redundant,
  sum(n) FILTER (WHERE own AND fails = 1) AS unique_fails, sum(good) FILTER (WHERE own AND NOT gone) AS good_lost, sum(toxic) FILTER (WHERE own AND NOT gone) AS toxic_lost FROM x GROUP BY ALL)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
  CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, filter), 0) AS BIGINT) AS shapley FROM y""",
    "op12_divergence_audit": rf"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS text FROM documents),
t AS (SELECT i, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT i) >= 10),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
c AS (SELECT t.lang, source, t.term, count(*) AS n FROM t JOIN k ON t.lang = k.lang AND t.term = k.term GROUP BY ALL),
m AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, CAST(1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(m.total, 0) + 2 * v.v) AS BIGINT) AS p,
  CAST(1 + (1000000000::HUGEINT * (k.n + 2)) // (v.total + 2 * v.v) AS BIGINT) AS q
  FROM g JOIN k ON g.lang = k.lang JOIN v ON g.lang = v.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN m ON m.lang = g.lang AND m.source = g.source),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q),
s AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r)
SELECT * FROM s WHERE part = 'pair' OR rank <= 10""",
}
