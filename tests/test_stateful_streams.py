"""Streams against their batch form, over files that arrive in many triggers and out of order, and over restarts."""

import math
import os
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.sources import window_batches as windows
from tessella.streaming import monitors, stateful

MIN = 60_000_000
START = 1_700_000_000_000_000
SCHEMA = "id long, k string, us long, value double, ts timestamp"


def made(n=240, seed=1, keys=4):
    """Rows of four keys over ten days, arriving up to some hours out of order; (id, key, microseconds, value)."""
    rng = random.Random(seed)
    rows = [(i, f"k{rng.randrange(keys)}", START + int(i * 60 * MIN + rng.randrange(50) * MIN), float(rng.randrange(100))) for i in range(n)]
    arrival = sorted(rows, key=lambda r: r[2] + rng.randrange(10 * 60) * MIN)
    return rows, arrival


def put(folder, name, rows):
    os.makedirs(folder, exist_ok=True)
    df = pd.DataFrame(rows, columns=["id", "k", "us", "value"])
    df["ts"] = pd.to_datetime(df["us"], unit="us", utc=True).astype("datetime64[us, UTC]")
    df.to_parquet(f"{folder}/.{name}")
    os.rename(f"{folder}/.{name}", f"{folder}/{name}")
    time.sleep(0.02)  # file sources read in the order of modification


def stream(spark, folder, per_trigger=1):
    return monitors.file_stream(spark, str(folder), spark.createDataFrame([], SCHEMA).schema, per_trigger)


def split(folder, rows, parts):
    for i in range(parts):
        put(folder, f"f{i:03}.parquet", rows[i * len(rows) // parts : (i + 1) * len(rows) // parts])


@pytest.fixture(scope="module")
def arrived(tmp_path_factory):
    rows, arrival = made()
    folder = tmp_path_factory.mktemp("in")
    split(folder, arrival, 9)
    horizon = (max(r[2] for r in rows) // 1000 - 86_400_000) * 1000
    return folder, sorted((r for r in rows if r[2] <= horizon), key=lambda r: (r[2], r[0])), horizon


def of(spark, arrived, fold, **kw):
    s = stream(spark, arrived[0]).withColumn("failed", F.col("value") < 60)
    return stateful.run(stateful.ordered(s, F.col("k"), "ts", fold, **kw))


def test_hawkes_over_many_triggers_and_the_state_reader(spark, arrived):
    run = of(spark, arrived, stateful.hawkes())
    want, last = {}, {}
    for i, k, us, _ in arrived[1]:
        a = math.exp(-(us - last[k][0]) / 86_400e6) * (last[k][1] + 1) if k in last else 0.0
        last[k] = (us, a)
        want[i] = 0.1 + 0.5 * a
    got = {r.id: r.intensity for r in run.result.collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in want)
    assert run.late == 0
    at = START + 20 * 86_400_000_000
    found = {r.key: r.intensity for r in stateful.hawkes_at(spark, run.marks, F.timestamp_micros(F.lit(at))).collect()}
    assert found.keys() == last.keys()
    assert all(math.isclose(found[k], 0.1 + 0.5 * math.exp(-(at - us) / 86_400e6) * (a + 1), rel_tol=1e-9) for k, (us, a) in last.items())


def test_hawkes_state_is_forgotten(spark, tmp_path):
    put(tmp_path, "a.parquet", [(1, "old", START, 1.0), (2, "new", START + 200 * 86_400_000_000, 1.0)])
    put(tmp_path, "b.parquet", [(3, "new", START + 203 * 86_400_000_000, 1.0)])
    run = stateful.run(stateful.ordered(stream(spark, tmp_path), F.col("k"), "ts", stateful.hawkes()))
    assert [r.key for r in stateful.stored(spark, run.marks).select("key.key").collect()] == ["new"]


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    put(tmp_path, "a.parquet", [(1, "k", START, 1.0), (2, "k", START + 5 * 86_400_000_000, 1.0)])
    put(tmp_path, "b.parquet", [(3, "k", START + 6 * 86_400_000_000, 1.0)])
    put(tmp_path, "c.parquet", [(4, "k", START + 1000, 1.0), (5, "k", START + 8 * 86_400_000_000, 1.0)])
    run = stateful.run(stateful.ordered(stream(spark, tmp_path), F.col("k"), "ts", stateful.hawkes()))
    assert sorted(r.id for r in run.result.collect()) == [1, 2, 3] and run.late == 1


def test_rolling_baseline_is_bounded(spark, arrived):
    run = of(spark, arrived, stateful.rolling_baseline(6, 3))
    held, want = {}, {}
    for i, k, _, v in arrived[1]:
        mine = held.setdefault(k, [])
        base = mine[max(0, len(mine) - 8) : max(0, len(mine) - 2)]
        want[i] = (sum(base) / len(base) if base else None, len(base))
        mine.append(v)
    got = {r.id: (r.mean, r.n) for r in run.result.collect()}
    assert got.keys() == want.keys()
    assert all(got[i][1] == n and (m is None) == (got[i][0] is None) and (m is None or math.isclose(got[i][0], m)) for i, (m, n) in want.items())
    sizes = stateful.stored(spark, run.marks).groupBy("key").count().collect()
    assert {r["count"] for r in sizes} == {8}


def test_persistence_forgets_what_disappears(spark, arrived):
    folder, rows, horizon = arrived
    s = stream(spark, folder).withColumn("fingerprint", F.concat(F.lit("f"), (F.col("id") % 7).cast("string")))
    cycle = F.timestamp_micros(F.floor(F.col("us") / (360 * MIN)) * (360 * MIN) + 360 * MIN)
    run = stateful.run(stateful.ordered(s, F.col("k"), "ts", stateful.persistence(2), at=cycle))
    cycles: dict = {}
    for i, k, us, _ in rows:
        end = us // (360 * MIN) * 360 * MIN + 360 * MIN
        if end <= horizon:
            cycles.setdefault((k, end), set()).add(f"f{i % 7}")
    want, streaks = set(), {}
    for (k, end), names in sorted(cycles.items()):
        streaks[k] = {f: streaks.get(k, {}).get(f, 0) + 1 for f in names}
        want |= {(k, end, f, n) for f, n in streaks[k].items() if n >= 2}
    assert {(r.key, r.cycle_us, r.fingerprint, r.streak) for r in run.result.collect()} == want
    kept = stateful.stored(spark, run.marks).select("key.key", "user_map_key.name", "user_map_value.streak").collect()
    assert {(r.key, r.name, r.streak) for r in kept} == {(k, f, n) for k, m in streaks.items() for f, n in m.items()}


def test_failure_streaks(spark, arrived):
    run = of(spark, arrived, stateful.failure_streaks(3))
    want, n = set(), {}
    for i, k, _, v in arrived[1]:
        if v < 60:
            n[k] = n.get(k, 0) + 1
            want |= {(k, i, 3, "dropped")} if n[k] == 3 else set()
        else:
            want |= {(k, i, n[k], "promoted")} if n.get(k, 0) >= 3 else set()
            n[k] = 0
    assert {tuple(r) for r in run.result.collect()} == want
    assert {r.key for r in stateful.stored(spark, run.marks).select("key.key").collect()} == {k for k, c in n.items() if c}


def test_heartbeats_over_many_triggers(spark, arrived):
    limit = 6 * 3600
    run = of(spark, arrived, stateful.heartbeat(limit))
    times: dict = {}
    for _, k, us, _ in arrived[1]:
        times.setdefault(k, []).append(us)
    want = set()
    for k, ts in times.items():
        for a, b in zip(ts, [*ts[1:], None], strict=True):
            if (b - a > limit * 1_000_000) if b else (a + limit * 1_000_000 <= arrived[2]):
                want |= {(k, a, "failed", a + limit * 1_000_000)} | ({(k, b, "running", b)} if b else set())
    assert {tuple(r) for r in run.result.collect()} == want and any(s == "running" for _, _, s, _ in want)


def test_a_late_heartbeat_cancels_the_timer(spark, tmp_path):
    day = 86_400_000_000
    beats = [("a", 0), ("a", 4), ("b", 0), ("b", 4), ("z", 4.5)]
    put(tmp_path, "a.parquet", [(i, k, int(START + t * day), 0.0) for i, (k, t) in enumerate(beats)])
    # b's silence of four days is filled by a heartbeat that comes after them, but before the watermark has passed it
    put(tmp_path, "b.parquet", [(10, "b", int(START + 2 * day), 0.0), (11, "z", int(START + 5 * day), 0.0)])
    put(tmp_path, "c.parquet", [(12, k, int(START + 5.5 * day), 0.0) for k in "abz"])
    s = stateful.ordered(stream(spark, tmp_path), F.col("k"), "ts", stateful.heartbeat(2.5 * 86_400), late="3 days")
    got = {(r.key, r.status, (r.at_us - START) / day) for r in stateful.run(s).result.collect() if r.at_us <= START + 2.5 * day}
    assert got == {("a", "failed", 2.5)}


def test_a_restart_goes_on_from_the_checkpoint(spark, tmp_path):
    _, arrival = made(seed=3)
    whole, parts = tmp_path / "whole", tmp_path / "parts"
    split(whole, arrival, 6)
    fold = stateful.rolling_baseline(6, 3)
    once = stateful.run(stateful.ordered(stream(spark, whole), F.col("k"), "ts", fold))
    out, marks = f"file://{tmp_path}/out", f"file://{tmp_path}/marks"
    for i in range(3):
        for j in (2 * i, 2 * i + 1):
            put(parts, f"f{j:03}.parquet", arrival[j * len(arrival) // 6 : (j + 1) * len(arrival) // 6])
        again = stateful.run(stateful.ordered(stream(spark, parts), F.col("k"), "ts", fold), out, marks)
    assert sorted(map(tuple, again.result.collect()), key=str) == sorted(map(tuple, once.result.collect()), key=str)


def test_pending_signals_over_many_triggers(spark, tmp_path):
    rows, arrival = made(300, seed=5, keys=3)
    rng = random.Random(6)
    signals = [(1000 + i, f"k{rng.randrange(4)}", START + rng.randrange(300 * 60) * MIN, float(rng.randrange(100))) for i in range(60)]
    split(tmp_path / "v", arrival, 5)
    split(tmp_path / "p", sorted(signals, key=lambda r: r[2]), 4)
    p = stream(spark, tmp_path / "p").select(F.col("id").alias("signal_id"), F.col("k").alias("key"), F.col("ts").alias("signal_ts"), F.col("value").alias("level"), F.lit(1.0).alias("sign"))
    v = stream(spark, tmp_path / "v").select(F.col("k").alias("key"), "ts", "id", "value")
    got = {r.signal_id: (r.points, r.success) for r in stateful.run(stateful.realised(p, v, "6 hours")).result.collect()}
    settled = min(max(r[2] for r in rows), max(r[2] for r in signals)) - 2 * 86_400_000_000
    for i, k, us, level in signals:
        if us <= settled:
            later = sorted((t, j, x) for j, kk, t, x in rows if kk == k and us < t <= us + 360 * MIN)[:3]
            assert got[i] == (len(later), (sum(x for *_, x in later) / 3 > level) if len(later) == 3 else None)
    assert any(n < 3 for n, _ in got.values()) and any(n == 3 for n, _ in got.values())
    assert len(got) == len({i for i in got})


def window_stream(spark, folder):
    spark.dataSource.register(windows.WindowBatches)
    return spark.readStream.format("window_batches").schema("id long, k string").option("path", str(folder)).option("grace", 0).load()


def test_window_batches_in_any_order_once_each(spark, tmp_path):
    folder, out, marks = tmp_path / "w", f"file://{tmp_path}/out", f"file://{tmp_path}/marks"
    seen = []
    for names in (["0300", "0100"], ["0200"], [], ["0500-part0", "0500-part1"], ["0400"], ["0050", "0600"]):
        for n in names:
            put(folder, f"{n}.parquet", [(int(n[:4]), n, START, 0.0)])
        run = stateful.run(window_stream(spark, folder), out, marks)  # each run is a restart from the offsets
        seen.append(sorted(r.k for r in run.result.collect()))
    assert seen == [
        ["0100"], ["0100", "0200"], ["0100", "0200"], ["0100", "0200", "0300"], ["0100", "0200", "0300", "0400"],
        ["0050", "0100", "0200", "0300", "0400", "0500-part0", "0500-part1"],
    ]
    assert run.result.count() == 7


def test_window_batches_of_an_empty_folder(spark, tmp_path):
    (tmp_path / "w").mkdir()
    assert stateful.run(window_stream(spark, tmp_path / "w")).result.count() == 0
