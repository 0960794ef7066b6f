"""Sharding by proportional stratified interleaving, in DataFrame operations only.

Rows of each source are ranked in a seeded shuffle (by a hash of the id and of
the text's CRC and size, so that rows without an id are dealt too); a row of
rank r among n has the fractional rank (2r + 1) / 2n. Sorting all rows by it
(ties: by a hash of the source) interleaves the sources in proportion, and
cutting the order into equal runs gives shards that each match the mixture, with
row counts at most one apart.

No rank is taken over a whole source or the whole table: hashes and fractional
ranks are cut into buckets of bounded size, rows are ranked within a bucket,
and the counts of earlier buckets are added. So a source with a third of all
rows is dealt over as many tasks as any other. A fractional rank that very many
small sources share (one half, if each has one row) is cut further, by the
hash of the source. Texts are not shuffled.

Defined cases: a null text has size 8 and the CRC of nothing; a null source is
one with the empty name; null ids are shuffled as the empty text; repeated rows
get a slot each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET_ROWS, LEAST_BUCKETS = 1 << 15, 256


def place_buckets(ranked: DataFrame, bucket_rows: int) -> DataFrame:
    """ranked and `bucket`, a struct in the order of (f, tie): j, the last crowded rank up to f, whether f lies beyond it, and a part of a crowded rank."""
    # ranks that over bucket_rows rows share are at most rows / bucket_rows
    crowds = ranked.groupBy("j", "f").agg(F.count("*").alias("c")).where(f"c > {bucket_rows}").groupBy("j").agg(F.sort_array(F.collect_list(F.struct("f", "c"))).alias("crowds"))
    before = F.filter("crowds", lambda x: x["f"] <= F.col("f"))
    out = ranked.join(F.broadcast(crowds), "j", "left").withColumn("last", F.try_element_at(before, F.lit(-1)))
    own = F.col("last.f").eqNullSafe(F.col("f"))
    part = F.expr(f"cast(conv(substr(tie, 1, 8), 16, 10) as bigint) * (last.c div {bucket_rows} + 1) div 4294967296")
    return out.withColumn("bucket", F.struct("j", F.coalesce("last.f", F.lit(-1.0)).alias("crowd"), (~own).alias("beyond"), F.when(own, part).otherwise(F.lit(0)).alias("part"))).drop("crowds", "last")


def interleave(docs: DataFrame, shards: int = 24, seed: str = "deal", bucket_rows: int = BUCKET_ROWS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, text_crc32, source, shard, slot of every row."""
    total = docs.count()
    buckets = max(LEAST_BUCKETS, -(-total // bucket_rows))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    ).withColumn("h", F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_crc32", "size").cast("binary"))).withColumn("b", F.expr(f"cast(conv(substr(h, 1, 8), 16, 10) as bigint) * {buckets} div 4294967296"))
    by_source = Window.partitionBy("source")
    before = (
        rows.groupBy("source", "b").agg(F.count("*").alias("c"))
        .select("source", "b", (F.sum("c").over(by_source.orderBy("b")) - F.col("c")).alias("before"), F.sum("c").over(by_source).alias("n"))
    )
    within = Window.partitionBy("source", "b").orderBy("h", "doc_id", "text_crc32", "size")
    ranked = (
        rows.join(before, ["source", "b"])
        .withColumn("r", F.col("before") + F.row_number().over(within) - 1)
        .withColumn("j", F.expr(f"(2 * r + 1) * {buckets} div (2 * n)"))
        .withColumn("f", (2 * F.col("r") + 1) / (2 * F.col("n")))
        .select("doc_id", "source", "size", "text_crc32", "r", "j", "f", F.md5(F.col("source").cast("binary")).alias("tie"))
    )
    ranked = place_buckets(ranked, bucket_rows)
    # few counts, whatever the table: a small multiple of rows / bucket_rows
    start = ranked.groupBy("bucket").agg(F.count("*").alias("c")).select("bucket", (F.sum("c").over(Window.orderBy("bucket")) - F.col("c")).alias("start"))
    place = Window.partitionBy("bucket").orderBy("f", "tie", "source", "r")
    return (
        ranked.join(start, "bucket")
        .withColumn("g", F.col("start") + F.row_number().over(place) - 1)
        .withColumn("shard", F.expr(f"cast(g * {shards} div {max(total, 1)} as int)"))
        .withColumn("slot", F.expr(f"g - (cast(shard as bigint) * {max(total, 1)} + {shards - 1}) div {shards}"))
        .select("doc_id", "size", "text_crc32", "source", "shard", "slot")
    )
