"""Interval, as-of and spatial joins as plain DataFrame plans.

A bare condition on |ta - tb| would be a nested loop over both sides. Here the
time axis is cut into buckets as wide as the window, one side is dealt into its
own and the two neighbouring buckets, and the join is an equality on keys and
bucket with the exact condition on top, so it shuffles on a key and stays linear.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import parts, written


def seconds(col: str | Column) -> Column:
    """Epoch seconds with fractions."""
    return F.unix_micros(F.col(col) if isinstance(col, str) else col) / F.lit(1e6)


def interval_join(left: DataFrame, right: DataFrame, window: float, keys: list[str], left_ts: str = "ts", right_ts: str = "ts", low: float | None = None, into: int | None = None, counts: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Rows l, r (structs) with equal keys and low <= l.ts - r.ts <= window seconds; low is -window unless given. delta: l.ts - r.ts.
    Both sides are dealt into `into` partitions, where that is given: adaptive execution goes by their bytes, which say little of the pairs.
    Where both sides are packs, of which counts (`alike_counts` of each side) are given, they are cut first, and those of a key and bucket of
    more than PAIRS pairs are dealt over several tasks."""
    if counts:
        left, right = cut(left), cut(right)
    low = -window if low is None else low
    width = max(window - low, 1e-6)
    of = lambda df, row: df.select(F.struct("*").alias(row), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    # l.ts lies in [r.ts + low, r.ts + window]: two buckets of that width hold it
    start = F.floor((seconds(F.col(f"r.{right_ts}")) + low) / width)
    bucket = {"l": F.floor(seconds(F.col(f"l.{left_ts}")) / width), "r": F.explode(F.array(start, start + 1))}
    a, b = (of(df, row).withColumn("_b", bucket[row]) for row, df in (("l", left), ("r", right)))
    on = [*[f"_k{i}" for i in range(len(keys))], "_b"]
    if counts:
        n_l, n_r = (of(n, row).withColumn("_b", bucket[row]).groupBy(*on).agg(F.sum(f"{row}._n").alias(f"_{row}")) for row, n in zip("lr", counts, strict=True))
        hot = n_l.join(n_r, on).where(F.col("_l") * F.col("_r") > PAIRS)
        # at most one key for PAIRS pairs, and usually none
        hot = F.broadcast(hot.select(*on, F.least(F.ceil(F.col("_l") * F.col("_r") / PAIRS), F.col("_l")).cast("int").alias("_deals")))
        deals = F.coalesce(F.col("_deals"), F.lit(1))
        a = a.join(hot, on, "left").withColumn("_deal", F.pmod(F.xxhash64("l"), deals).cast("int")).drop("_deals")
        b = b.join(hot, on, "left").withColumn("_deal", F.explode(F.sequence(F.lit(0), deals - 1))).drop("_deals")
        on = [*on, "_deal"]
    if into:
        a, b = a.repartition(into, *on), b.repartition(into, *on)
    out = a.join(b, on).withColumn("delta", seconds(F.col(f"l.{left_ts}")) - seconds(F.col(f"r.{right_ts}")))
    return out.where((F.col("delta") >= low) & (F.col("delta") <= window)).select("l", "r", "delta")


#: Rows of a pack, about, at most, where it is gathered.
PACK = 1000
#: Rows of a pack, at most, where it is paired: Spark holds the rows of a pair of packs until all are made.
CUT = 64
#: Pairs of one key and bucket that one task makes, about, at most.
PAIRS = 20_000_000


def alike_counts(df: DataFrame, alike: list[str]) -> DataFrame:
    """The columns `alike` and _n, the number of rows that are alike."""
    return df.groupBy(*alike).agg(F.count("*").alias("_n"))


def packed(df: DataFrame, alike: list[str], own: list[str]) -> DataFrame:
    """The columns `alike` and `rows`, an array of structs of the columns `own` of rows that are alike.

    What depends on the alike columns alone is then found once for a pair of packs. Where more than PACK rows are alike
    they are dealt into several packs by the hash of their own columns, so neither a row nor a task grows with a hot value;
    of such values there is at most one for PACK rows, and usually none: they are broadcast.
    """
    many = alike_counts(df, alike).where(F.col("_n") > PACK)
    many = F.broadcast(many.select(*[F.col(c).alias(f"_{c}") for c in alike], F.ceil(F.col("_n") / PACK).alias("_packs")))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in alike]
    dealt = df.join(many, same, "left").withColumn("_pack", F.coalesce(F.pmod(F.xxhash64(*own), F.col("_packs")), F.lit(0)))
    return dealt.groupBy(*alike, "_pack").agg(F.collect_list(F.struct(*own)).alias("rows")).drop("_pack")


def cut(packs: DataFrame) -> DataFrame:
    """Packs of at most CUT rows."""
    at = packs.withColumn("_at", F.explode(F.sequence(F.lit(1), F.size("rows"), F.lit(CUT))))
    return at.withColumn("rows", F.slice("rows", F.col("_at"), F.lit(CUT))).drop("_at")


def all_pairs(left: DataFrame, right: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """a, b of all rows of left and right with the same key. They meet as packs, so a pair costs little more than its row; keys of over PAIRS
    pairs are dealt over several tasks, and there is a task for each PAIRS pairs."""
    left, right = (df.where(F.col(key).isNotNull()) for df in (left, right))
    n_l, n_r = (alike_counts(df, [key]).withColumnRenamed("_n", f"_{side}") for side, df in (("l", left), ("r", right)))
    counts = written(n_l.join(n_r, key).select(key, (F.col("_l").cast("double") * F.col("_r")).alias("_pairs")), "pair-counts")
    # some tasks for each core at least, as keys differ in their pairs
    into = max(parts(left), 4 * left.sparkSession.sparkContext.defaultParallelism, math.ceil((counts.agg(F.sum("_pairs")).first()[0] or 0) / PAIRS))
    # at most one key for PAIRS pairs, and usually none
    hot = F.broadcast(counts.where(F.col("_pairs") > PAIRS).select(key, F.ceil(F.col("_pairs") / PAIRS).cast("int").alias("_deals")))
    deals, on = F.coalesce(F.col("_deals"), F.lit(1)), [key, "_deal"]
    x = cut(packed(left, [key], [a])).join(hot, key, "left").select(key, F.pmod(F.xxhash64("rows"), deals).cast("int").alias("_deal"), F.col(f"rows.{a}").alias("_as"))
    y = cut(packed(right, [key], [b])).join(hot, key, "left").select(key, F.explode(F.sequence(F.lit(0), deals - 1)).alias("_deal"), F.col(f"rows.{b}").alias("_bs"))
    met = x.repartition(into, *on).join(y.repartition(into, *on), on)
    return met.select(F.explode("_as").alias(a), "_bs").select(a, F.explode("_bs").alias(b))


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, value: str, direction: str = "backward", strict: bool = False, bucket_days: float = 30.0) -> DataFrame:
    """left with `found`, the struct (ts, value) of the nearest right row at or before (backward) or at or after (forward) it.

    One union and a window over key and time bucket, so a busy key is dealt over many tasks; what earlier buckets of a
    key leave behind is carried into later ones over a row for each bucket. No pair is made. strict leaves equal times out.
    Of right rows with equal times the one with the largest value counts.
    """
    back = direction == "backward"
    fact = F.struct(F.col(right_ts).alias("ts"), F.col(value).alias("value"))
    bucket = lambda c: F.floor(seconds(F.col(c).cast("timestamp")) / (bucket_days * 86_400)).alias("_b")
    rows = left.select(*keys, F.col(left_ts).alias("_t"), bucket(left_ts), F.struct("*").alias("_l"), F.lit(None).cast(right.select(fact.alias("x")).schema["x"].dataType).alias("_r"))
    facts = right.select(*keys, F.col(right_ts).alias("_t"), bucket(right_ts), F.lit(None).cast(rows.schema["_l"].dataType).alias("_l"), fact.alias("_r"))
    both = rows.union(facts).withColumn("_probe", F.col("_l").isNotNull())
    # backward: facts before probes of the same time unless strict; forward reads the axis the other way round
    first = F.col("_probe").cast("int") if not strict else 1 - F.col("_probe").cast("int")
    order = [F.asc("_t") if back else F.desc("_t"), first.asc(), F.col("_r.value").asc()]
    w = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = both.withColumn("found", F.last("_r", ignorenulls=True).over(w)).where("_probe")
    # the last fact of each bucket in the order of reading, and of the buckets read before it
    at = F.col("_t") if back else -seconds(F.col("_t").cast("timestamp"))
    end = facts.groupBy(*keys, "_b").agg(F.max_by("_r", F.struct(at, F.col("_r.value"))).alias("_end"))
    every = left.select(*keys, bucket(left_ts)).distinct().withColumn("_end", F.lit(None).cast(end.schema["_end"].dataType)).unionByName(end).groupBy(*keys, "_b").agg(F.first("_end", ignorenulls=True).alias("_end"))
    past = Window.partitionBy(*keys).orderBy(F.asc("_b") if back else F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    carried = every.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_cb"), F.last("_end", ignorenulls=True).over(past).alias("_carried"))
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_b").eqNullSafe(F.col("_cb"))]
    return near.join(carried, on, "left").select("_l.*", F.coalesce("found", "_carried").alias("found"))


def latest(df: DataFrame, keys: list[str], ts: str, ties: bool = True) -> DataFrame:
    """The newest rows of each key; all of them when several share the newest time, unless ties is false."""
    rank = (F.rank if ties else F.row_number)().over(Window.partitionBy(*keys).orderBy(F.desc(ts)))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def equirect_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    x = F.radians(lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    y = F.radians(lat2 - lat1)
    return F.lit(6371.0) * F.sqrt(x * x + y * y)


def proximity_join(points: DataFrame, zones: DataFrame, cell: float = 5.0) -> DataFrame:
    """points (lat, lon) within radius_km of zones (zone_lat, zone_lon, radius_km).

    Both sides meet on grid cells of `cell` degrees: a zone is dealt into the cells its radius touches.
    """
    reach = F.col("radius_km") / 111.0
    wide = reach / F.greatest(F.cos(F.radians(F.abs(F.col("zone_lat")) + reach)), F.lit(0.01))
    span = lambda c, r: F.sequence(F.floor((F.col(c) - r) / cell), F.floor((F.col(c) + r) / cell))
    z = zones.withColumn("_y", F.explode(span("zone_lat", reach))).withColumn("_x", F.explode(span("zone_lon", wide)))
    p = points.withColumn("_y", F.floor(F.col("lat") / cell)).withColumn("_x", F.floor(F.col("lon") / cell))
    out = p.join(z, ["_y", "_x"]).withColumn("km", equirect_km(F.col("lat"), F.col("lon"), F.col("zone_lat"), F.col("zone_lon")))
    return out.where("km <= radius_km").drop("_y", "_x")
