"""Chat formatting with cumulative-snapshot collapse, in DataFrame operations only.

Logs hold a conversation many times, each snapshot longer by a turn or more.
Every turn gets a hash of its position, role and text; the running xor over a
conversation is the hash of each of its prefixes (two independent 64-bit hashes,
with the position in each term, so order counts). A conversation whose whole
hash is a proper prefix of another is removed by an anti-join, and equal
conversations keep the smallest id. The rest are rendered.

Prefixes are grouped before the join, so a first turn that a third of all
conversations share is one row of it. The hashes are found from digests; texts
are shuffled once, those of the conversations that stay, for rendering.

Turns are ordered by (turn, role, MD5 of the text), in the hashes and in the
rendered text alike. Defined cases: a null role is "unknown" and a null text is
empty; null turns come first; a turn with a null id is a conversation of its
own; repeated rows are repeated turns; an empty table gives no rows; other
columns are not read. A conversation is one row of the result, so it has to fit
in a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|{}|>", "<|end|>"


def md5(col: str):
    return F.md5(F.col(col).cast("binary"))


def maximal(turns: DataFrame) -> DataFrame:
    """key of the conversations that no other one extends; of equal ones that with the smallest id, and of those without an id one."""
    light = turns.select("key", "conv_id", "turn", "role", "m", F.xxhash64("role", "text").alias("h"))
    own = Window.partitionBy("key")
    order = own.orderBy("turn", "role", "m")
    placed = light.withColumn("pos", F.row_number().over(order)).withColumn("n", F.count("*").over(own))
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prefixes = placed.select(
        "key", "conv_id", "pos", "n",
        F.bit_xor(F.xxhash64("pos", "h", "m")).over(running).alias("p1"),
        F.bit_xor(F.xxhash64("m", "role", "h", "pos")).over(running).alias("p2"),
    )
    first = F.min(F.struct(F.col("conv_id").isNull().alias("none"), "conv_id", "key")).alias("first")
    whole = prefixes.where("pos = n").groupBy("n", "p1", "p2").agg(first)
    longer = prefixes.where("pos < n").select(F.col("pos").alias("n"), "p1", "p2").distinct()
    return whole.join(longer, ["n", "p1", "p2"], "left_anti").select("first.key")


def format_chats(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, n_turns, roles (comma-separated), chat (the rendered text) of each maximal conversation."""
    turns = conversations.select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    # turns without an id may be a third of all and alike: equal ones are one conversation, found with a combine before the shuffle
    alone = turns.where("conv_id is null").groupBy("role", "text").agg(F.min("turn").alias("turn"))
    every = turns.where("conv_id is not null").select(F.col("conv_id").cast("string").alias("key"), "conv_id", "turn", "role", "text").unionByName(
        alone.select(F.concat(F.lit("alone:"), md5("role"), md5("text")).alias("key"), F.lit(None).cast("long").alias("conv_id"), "turn", "role", "text")
    ).withColumn("m", md5("text"))
    kept = every.join(maximal(every), "key", "left_semi")
    each = kept.groupBy("key").agg(F.max("conv_id").alias("conv_id"), F.sort_array(F.collect_list(F.struct("turn", "role", "m", "text"))).alias("turns"))
    line = lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit(f"\n{CLOSE}"))
    return each.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform("turns", lambda t: t["role"]), ",").alias("roles"), F.array_join(F.transform("turns", line), "\n").alias("chat")
    )
