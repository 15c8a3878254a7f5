"""Replays against brute force on random series (small fixtures)."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from tripwire.operators.replay import next_at_or_after, suppress_replay
from tripwire.operators.state import state_replay

T0 = dt.datetime(2024, 1, 1)


def _series(seed, keys=4, n=60, span_h=200):
    rnd = random.Random(seed)
    rows = []
    eid = 0
    for k in range(keys):
        times = sorted(T0 + dt.timedelta(minutes=rnd.randrange(span_h * 60)) for _ in range(rnd.randrange(1, n)))
        for t in times:
            eid += 1
            rows.append((k, t, eid, rnd.randrange(100)))
    return rows


def _greedy(rows, interval):
    want = set()
    for k in {r[0] for r in rows}:
        last = None
        for _, t, i, _v in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])):
            if last is None or t - last >= interval:
                want.add((k, i))
                last = t
    return want


def _dense(seed, keys=3, n=40):
    """Sub-second steps and ties, one key much longer than the others."""
    rnd = random.Random(seed)
    rows, eid = [], 0
    for k in range(keys):
        t = T0
        for _ in range(n * (8 if k == 0 else 1)):
            t += dt.timedelta(milliseconds=rnd.choice([0, 50, 100, 150, 299, 300, 301]))
            eid += 1
            rows.append((k, t, eid, 0))
    return rows


@pytest.mark.parametrize("interval", [dt.timedelta(0), dt.timedelta(microseconds=1), dt.timedelta(milliseconds=300),
                                      dt.timedelta(seconds=2), dt.timedelta(hours=5), dt.timedelta(days=400)])
@pytest.mark.parametrize("make", [_series, _dense])
def test_suppress_replay_matches_greedy(spark, interval, make):
    rows = make(2)
    df = spark.createDataFrame(rows, "k int, ts timestamp_ntz, id long, v int")
    for ranges in (1, 9):  # nine: series that cross several ranges
        got = [(r["k"], r["id"]) for r in suppress_replay(df, "k", "ts", "id", interval, ranges).collect()]
        assert len(got) == len(set(got)) and set(got) == _greedy(rows, interval)


def _hot(seed, n=4000):
    """One key with most rows in a burst, then a gap, then another; many short keys; a key that is NULL."""
    rnd = random.Random(seed)
    rows = [(0, T0 + dt.timedelta(milliseconds=rnd.randrange(60_000) + (0 if i % 3 else 86_400_000)), i, 0) for i in range(n)]
    rows += [(rnd.randrange(1, 300), T0 + dt.timedelta(seconds=rnd.randrange(90_000)), n + i, 0) for i in range(900)]
    return rows + [(None, T0 + dt.timedelta(seconds=i // 2), 9000 + i, 0) for i in range(500)]


@pytest.mark.parametrize("interval", [dt.timedelta(milliseconds=40), dt.timedelta(seconds=7), dt.timedelta(hours=3)])
def test_suppress_replay_of_a_hot_key(spark, interval):
    rows = _hot(5)
    df = spark.createDataFrame(rows + [(0, None, -1, 0)], "k int, ts timestamp_ntz, id long, v int")
    got = [(r["k"], r["id"]) for r in suppress_replay(df, "k", "ts", "id", interval, 16).collect()]
    assert len(got) == len(set(got)) and set(got) == _greedy(rows, interval)


def test_a_long_dense_series_is_linear(spark):
    """200,000 rows of one key, 9 ms apart, interval 333 ms, equal to the step machine and done in seconds."""
    df = spark.range(200_000).select(F.lit(1).alias("k"), F.timestamp_add("MICROSECOND", F.col("id") * 9000, F.lit(T0).cast("timestamp_ntz")).alias("ts"), "id")
    start = time.monotonic()
    got = {r["id"] for r in suppress_replay(df, "k", "ts", "id", dt.timedelta(milliseconds=333), 16).collect()}
    assert time.monotonic() - start < 60
    assert got == set(range(0, 200_000, 37))


@pytest.mark.parametrize("ranges", [1, 7, None])
def test_next_at_or_after(spark, ranges):
    rows = _dense(8)
    df = spark.createDataFrame(rows, "k int, ts timestamp_ntz, id long, v int")
    off = dt.timedelta(milliseconds=300)
    got = {(r.k, r.src_id): r.dst_id for r in next_at_or_after(df, "k", "ts", "id", off, ranges).collect()}
    want = {(k, i): min(((t2, i2) for k2, t2, i2, _ in rows if k2 == k and t2 >= t + off), default=(None, None))[1] for k, t, i, _ in rows}
    assert got == want


def test_suppress_replay_edges(spark):
    none = spark.createDataFrame([], "k int, ts timestamp_ntz, id long")
    assert suppress_replay(none, "k", "ts", "id", dt.timedelta(hours=1)).count() == 0
    with pytest.raises(ValueError):
        suppress_replay(none, "k", "ts", "id", dt.timedelta(seconds=-1))


@pytest.mark.parametrize("ranges", [1, 11])
def test_state_replay_skips_samples_without_a_flag(spark, ranges):
    """ON, NULL, below: the machine goes ON->OFF; checked within and across ranges."""
    rnd = random.Random(9)
    rows = [(k, T0 + dt.timedelta(minutes=7 * i), 100 * k + i, rnd.choice([None, None, 10, 60])) for k in range(6) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, ts timestamp_ntz, id long, v int")
    got = {r["id"]: r["action"] for r in state_replay(df, "k", "ts", "id", F.col("v") >= 50, ranges=ranges).collect()}
    want = {}
    for k in range(6):
        seen, last = False, None
        for _, _t, i, v in (r for r in rows if r[0] == k):
            if v is None:
                want[i] = None
                continue
            br = v >= 50
            want[i] = (("NEW->ON" if br else "IGNORE") if not seen else
                       "ON->OFF" if last and not br else "OFF->ON" if br and not last else "IGNORE")
            seen, last = seen or br, br
    assert got == want


def test_state_replay_matches_step_machine(spark):
    for seed in (4, 5):
        rows = _series(seed, keys=5, n=80, span_h=72)
        df = spark.createDataFrame(rows, "k int, ts timestamp_ntz, id long, v int")
        out = state_replay(df, "k", "ts", "id", F.col("v") >= 50, ranges=6)
        got = {r["id"]: r["action"] for r in out.collect()}
        want = {}
        for k in {r[0] for r in rows}:
            state = None
            for _, _t, i, v in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])):
                br = v >= 50
                if state is None:
                    want[i] = "NEW->ON" if br else "IGNORE"
                    state = "ON" if br else None
                else:
                    want[i] = "ON->OFF" if state == "ON" and not br else "OFF->ON" if state == "OFF" and br else "IGNORE"
                    state = "ON" if br else "OFF"
        assert got == want
