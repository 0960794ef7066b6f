"""A corpus cleaned and packed for training: five stages, each on what the one before kept.

Every stage but the last returns the columns of documents. A stage judges only
its own input, drops what its decision says, and changes nothing else:

1. quality: documents that score below 0.3 go.
2. line_dedup: repeated lines go from all documents but the first; n_chars is
   counted anew where a text has changed.
3. simhash: one row of each group of near-duplicates stays, the one with the
   smallest id (a row without one only where no other has any); texts link at a
   Jaccard similarity of their 5-word shingles of 0.8 or more.
4. decontamination: documents that hold a passage of the benchmark go.
5. packing: pieces of windows of 1024 tokens.

Each stage's rows are written to the shared folder, so that a later stage, which
reads its input several times, never runs an earlier one again.

Defined cases: a null or empty text is scored, is one empty line, is a near copy
of other empty texts, leaks nothing and packs as its end id; null ids are kept
as they are; rows that repeat an id are judged each by its text; empty tables
give no rows; other columns, of whatever names, pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm import decontaminate, lines, packing, quality, queries, simhash
from tessella.session import written

#: No SQL expresses the stages; tests compare them with brute force.
ORACLE_SQL = None
LEAST_SCORE = 0.3


def apart(docs: DataFrame) -> DataFrame:
    """What the operators read, and all columns in one struct, so that no name of the input can clash with one that a stage adds."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("input"))


def together(kept: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of docs again, but for the changed ones."""
    return kept.select(*[changed.get(c, F.col(f"input.`{c}`")).alias(c) for c in docs.columns])


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = queries.table(spark, sf_dir, "labels").where(~queries.held_out())
    each = apart(docs)
    return together(quality.scored(each, quality.fit(each, labels)).where(F.col("quality_score") >= LEAST_SCORE), docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out, changed = lines.dedup_lines(apart(docs)), {"text": F.col("text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.when(F.col("lines.n_dropped") > 0, F.length("text").cast(kind)).otherwise(F.col("input.n_chars"))
    return together(out, docs, **changed)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    each = apart(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    stay = simhash.near_copies(each).groupBy("root").agg(first.alias("first")).select(F.col("first.row").alias("stay_row"))
    kept = each.join(stay, simhash.row_key() == F.col("stay_row"))
    # rows that repeat the id and the text of one that stays
    one = Window.partitionBy("stay_row").orderBy("input")
    return together(kept.withColumn("copy_number", F.row_number().over(one)).where("copy_number = 1"), docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return together(decontaminate.find_leaks(apart(docs), queries.table(spark, sf_dir, "benchmark")).where(F.size("leaks") == 0), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


STAGES = [
    ("quality", drop_low_quality),
    ("line_dedup", drop_repeated_lines),
    ("simhash", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
