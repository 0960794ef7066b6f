"""Recursions over streams in event-time order, with the state in Spark's state store.

`Fold` says how a key's state moves from one event time to the next; `ordered`
runs it with transformWithStateInPandas. Rows wait in a list state until the
watermark has passed them, so rows that come out of order, or in any number of
triggers, give the rows of the batch form; only rows behind the watermark are
dropped, and Spark counts them. Event-time timers wake a key whose rows, or
whose deadline, the watermark has passed. State is bounded by the fold: what it
returns is kept, None is deleted.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from itertools import groupby
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import _parse_datatype_string

from ..session import new_path

Rows = list[tuple]
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass
class Fold:
    """columns and results are DDL. step(state, us, rows) takes all rows of one event time (microseconds), sorted, and gives
    the next state and result rows. kind: `value` (state is a tuple of the DDL in `state`), `list` (a list of such tuples)
    or `map` (a dict of a string to such a tuple); None, or empty, deletes it. due(state) is the event time at which
    expire(state) is called if no row comes before; it gives the next state and result rows."""

    columns: str
    state: str
    results: str
    step: Callable[[Any, int, Rows], tuple[Any, Rows]]
    kind: str = "value"
    due: Callable[[Any], int | None] = lambda state: None
    expire: Callable[[Any], tuple[Any, Rows]] = lambda state: (state, [])


def names(ddl: str) -> list[str]:
    return [f.name for f in _parse_datatype_string(ddl).fields] if ddl else []


class Ordered(StatefulProcessor):
    """One key's waiting rows and state."""

    def __init__(self, fold: Fold):
        self.fold = fold
        self.names = names(fold.columns)
        self.out = ["key", *names(fold.results)]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        if self.fold.kind == "map":
            self.state = handle.getMapState("state", "name string", self.fold.state)
        else:
            self.state = (handle.getListState if self.fold.kind == "list" else handle.getValueState)("state", self.fold.state)

    def load(self) -> Any:
        if self.fold.kind == "map":
            return {k[0]: tuple(v) for k, v in self.state.iterator()} if self.state.exists() else None
        if self.fold.kind == "list":
            return [tuple(x) for x in self.state.get()] or None
        found = self.state.get()
        return None if found is None else tuple(found)

    def save(self, old: Any, new: Any) -> None:
        if new == old:
            return
        if not new:
            self.state.clear()
        elif self.fold.kind == "map":
            for k in (old or {}).keys() - new.keys():
                self.state.removeKey((k,))
            for k, v in new.items():
                if (old or {}).get(k) != v:
                    self.state.updateValue((k,), v)
        else:
            (self.state.put if self.fold.kind == "list" else self.state.update)(new)

    def wait(self, added: Rows, timers: list[int]) -> None:
        """Rows that all lie ahead of the watermark are put beside those that wait, unread."""
        self.waiting.appendValue((pickle.dumps(added),))
        self.wake(min(r[0] for r in added), timers, keep=True)

    def wake(self, us: int | None, timers: list[int], keep: bool = False) -> None:
        """The key's one timer, at us, or where it stands if it is to be kept and is earlier."""
        at = None if us is None else -(-us // 1000)
        if keep and timers:
            at = min(at, *timers)
        for t in timers:
            if t != at:
                self.handle.deleteTimer(t)
        if at is not None and at not in timers:
            self.handle.registerTimer(at)

    def advance(self, key: tuple, added: Rows, watermark: int, timers: list[int]) -> Iterator[pd.DataFrame]:
        now = watermark * 1000
        held = [r for (rows,) in self.waiting.get() for r in pickle.loads(rows)]
        rows = held + added
        ready, left = sorted(r for r in rows if r[0] <= now), [r for r in rows if r[0] > now]
        old = state = self.load()
        out: Rows = []
        for us, rows in groupby(ready, key=lambda r: r[0]):
            state, found = self.fold.step(state, us, [r[1:] for r in rows])
            out += found
        due = None if state is None else self.fold.due(state)
        while due is not None and due <= now:
            state, found = self.fold.expire(state)
            out += found
            due = None if state is None else self.fold.due(state)
        self.save(old, state)
        if left and left != held:
            self.waiting.put([(pickle.dumps(left),)])
        elif held and not left:
            self.waiting.clear()
        self.wake(min([*(r[0] for r in left), *([] if due is None else [due])], default=None), timers)
        if out:
            yield pd.DataFrame([(key[0], *r) for r in out], columns=self.out)

    def handleInputRows(self, key, rows, timerValues):
        added = [x for pdf in rows for x in zip(*(pdf[c].tolist() for c in ("us", *self.names)), strict=True)]
        watermark, timers = timerValues.getCurrentWatermarkInMs(), list(self.handle.listTimers())
        if all(r[0] > watermark * 1000 for r in added) and all(t > watermark for t in timers):
            return self.wait(added, timers)
        yield from self.advance(key, added, watermark, timers)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        # Spark takes the expired timer away
        timers = [t for t in self.handle.listTimers() if t != expiredTimerInfo.getExpiryTimeInMs()]
        yield from self.advance(key, [], timerValues.getCurrentWatermarkInMs(), timers)

    def close(self) -> None:
        pass


def ordered(stream: DataFrame, key: Column, ts: str, fold: Fold, late: str = "1 day", at: Column | None = None) -> DataFrame:
    """The fold's results by key (a string). ts is the watermark's column; at, the event time that orders rows, isn't before it."""
    marked = stream.withWatermark(ts, late)
    rows = marked.select(key.cast("string").alias("key"), ts, F.unix_micros(F.col(ts) if at is None else at).alias("us"), *[n for n in names(fold.columns) if n != ts])
    return rows.groupBy("key").transformWithStateInPandas(Ordered(fold), f"key string, {fold.results}", "append", "EventTime")


@contextmanager
def rocks(spark: SparkSession):
    """State of several variables and timers needs this provider of Spark; the session's own setting comes back after."""
    old = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, old) if old else spark.conf.unset(PROVIDER)


@dataclass
class Run:
    """What a bounded run left: its result, its checkpoint, and how many rows came behind the watermark."""

    result: DataFrame
    marks: str
    late: int


def run(stream: DataFrame, out: str | None = None, marks: str | None = None) -> Run:
    """Runs the stream over what is there and ends. With the folders of an earlier run it goes on from its checkpoint."""
    spark = stream.sparkSession
    out, marks = out or new_path(spark, "stream"), marks or new_path(spark, "stream-marks")
    with rocks(spark):
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start()
        q.awaitTermination()
    late = sum(int(o.numRowsDroppedByWatermark) for p in q.recentProgress for o in p.stateOperators)
    return Run(spark.read.schema(stream.schema).parquet(out), marks, late)


def stored(spark: SparkSession, marks: str, variable: str = "state") -> DataFrame:
    """The checkpointed state of a run: key and value as Spark's state reader gives them."""
    with rocks(spark):
        return spark.read.format("statestore").option("path", marks).option("stateVarName", variable).load()


def hawkes(mu: float = 0.1, alpha: float = 0.5, beta: float = 1.0, unit: float = 86_400.0, forget: float = 60.0) -> Fold:
    """A = exp(-beta dt) (A + 1), 0 at the first event; intensity mu + alpha A. After `forget` units without an event what is left of A is below any rounding, and the state goes."""

    def step(state, us, rows):
        out = []
        for (i,) in rows:
            a = 0.0 if state is None else math.exp(-beta * (us - state[0]) / 1e6 / unit) * (state[1] + 1)
            state = (us, a)
            out.append((i, a, mu + alpha * a))
        return state, out

    last = lambda state: int(state[0] + forget / beta * unit * 1e6)
    return Fold("id long", "us long, a double", "id long, a double, intensity double", step, due=last, expire=lambda state: (None, []))


def hawkes_at(spark: SparkSession, marks: str, at: Column, mu: float = 0.1, alpha: float = 0.5, beta: float = 1.0, unit: float = 86_400.0) -> DataFrame:
    """Intensity of each key at a time without an event, from the checkpointed state."""
    gap = (F.unix_micros(at) - F.col("us")) / 1e6 / unit
    last = stored(spark, marks).select("key.key", "value.us", "value.a")
    return last.select("key", (mu + alpha * F.exp(-beta * gap) * (F.col("a") + 1)).alias("intensity"))


def heartbeat(after_seconds: float) -> Fold:
    """`failed` at the last heartbeat plus the limit, and `running` when a failed key is heard again."""
    limit = int(after_seconds * 1e6)

    def step(state, us, rows):
        out = []
        if state is not None and (state[1] or us - state[0] > limit):
            out = [] if state[1] else [(state[0], "failed", state[0] + limit)]
            out.append((us, "running", us))
        return (us, False), out

    due = lambda state: None if state[1] else state[0] + limit
    return Fold("", "us long, failed boolean", "last_us long, status string, at_us long", step, due=due, expire=lambda s: ((s[0], True), [(s[0], "failed", s[0] + limit)]))


def rolling_baseline(window: int = 30, gap: int = 5) -> Fold:
    """Mean of the `window` values that end `gap` before the current one; at most window + gap - 1 values are kept."""

    def step(state, us, rows):
        held, out = list(state or []), []
        for i, x in rows:
            base = [v for (v,) in held[: max(0, len(held) - gap + 1)]]
            out.append((i, sum(base) / len(base) if base else None, len(base)))
            held = [*held, (x,)][-(window + gap - 1) :]
        return held, out

    return Fold("id long, value double", "value double", "id long, mean double, n long", step, kind="list")


def persistence(min_periods: int = 2) -> Fold:
    """Fingerprints present in at least min_periods cycles of the key in a row. A cycle is one event time; those absent from it are forgotten."""

    def step(state, us, rows):
        old = state or {}
        new = {f: (old.get(f, (0,))[0] + 1,) for f in {f for (f,) in rows}}
        return new, sorted((us, f, n) for f, (n,) in new.items() if n >= min_periods)

    return Fold("fingerprint string", "streak long", "cycle_us long, fingerprint string, streak long", step, kind="map")


def persistence_parts(min_periods: int = 2) -> Fold:
    """`persistence` where a key holds a part of the fingerprints, and so doesn't see every cycle: each row names the cycle before its own (-1: none)."""

    def step(state, us, rows):
        old, new = state or {}, {}
        for f, before in rows:
            streak, last = old.get(f, (0, None))
            new[f] = (streak + 1 if last == before else 1, us)
        return new, sorted((us, f, n) for f, (n, _) in new.items() if n >= min_periods)

    return Fold("fingerprint string, before_us long", "streak long, last_us long", "cycle_us long, fingerprint string, streak long", step, kind="map")


def failure_streaks(limit: int = 3) -> Fold:
    """`dropped` when a key has failed `limit` times in a row, `promoted` at its next success; failures is the streak that this ends or reaches."""

    def step(state, us, rows):
        n, out = (state or (0,))[0], []
        for i, failed in rows:
            if failed:
                n += 1
                out += [(i, n, "dropped")] if n == limit else []
            else:
                out += [(i, n, "promoted")] if n >= limit else []
                n = 0
        return ((n,) if n else None), out

    return Fold("id long, failed boolean", "failures long", "id long, failures long, event string", step)


def realised(pending: DataFrame, values: DataFrame, within: str, points: int = 3, late: str = "1 day") -> DataFrame:
    """Pending signals (signal_id, key, signal_ts, level, sign) and the first later values (key, ts, id, value) of their key.

    An interval join of two streams, both with watermarks: state of either side goes when no partner can come any more,
    and a signal without any value comes out then as an outer row. success is whether the mean of the first `points`
    values lies on the signal's side of its level; null, still pending, with fewer values within the interval.
    """
    p = pending.withWatermark("signal_ts", late).alias("p")
    v = values.select(F.col("key").alias("value_key"), "ts", "id", "value").withWatermark("ts", late)
    on = F.expr(f"key = value_key and ts > signal_ts and ts <= signal_ts + interval {within}")
    each = p.join(v, on, "left_outer").groupBy("signal_id", F.window("signal_ts", "1 second").alias("w"), "level", "sign")
    seen = F.sort_array(F.collect_list(F.when(F.col("ts").isNotNull(), F.struct("ts", "id", "value"))))
    first = each.agg(F.slice(seen, 1, points).alias("first"))
    mean = F.aggregate("first", F.lit(0.0), lambda a, x: a + x["value"]) / points
    return first.select("signal_id", F.size("first").cast("long").alias("points"), F.when(F.size("first") == points, (mean > F.col("level")) == (F.col("sign") > 0)).alias("success"))
