"""Anchored lookbacks: the bucketed interval join against its definition, and what it reads."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tripwire.operators.select import anchor_lookback, time_ranges

NOW = dt.datetime(2024, 6, 1, 12)


def test_time_ranges():
    assert time_ranges([]) == []
    assert time_ranges([5, 3, 4, 9, 9]) == [(3, 5), (9, 9)]
    assert time_ranges([0, 10, 11, 13, 40, 100], most=3) == [(0, 13), (40, 40), (100, 100)]
    rnd = random.Random(2)
    for most in (1, 2, 5):
        b = [rnd.randrange(1000) for _ in range(60)]
        runs = time_ranges(b, most)
        assert len(runs) <= most and all(any(lo <= x <= hi for lo, hi in runs) for x in b)
        assert all(p[1] < q[0] for p, q in zip(runs, runs[1:]))


@pytest.fixture(scope="module")
def frames(spark, tmp_path_factory):
    """A year of facts, one file a month; one instance stopped a year ago, the others minutes ago."""
    rnd = random.Random(1)
    facts = [(k, NOW - dt.timedelta(minutes=rnd.randrange(365 * 1440), seconds=rnd.randrange(60)), i) for i, k in enumerate([1, 2, 3] * 1500)]
    facts += [(k, NOW - dt.timedelta(minutes=m), 10_000 + 100 * k + m) for k in (1, 2, 3) for m in range(0, 90, 7)]
    facts += [(9, NOW - dt.timedelta(days=364, minutes=m), 20_000 + m) for m in range(0, 300, 10)]
    path = f"{tmp_path_factory.mktemp('facts')}/f"
    df = spark.createDataFrame(facts, "k int, ts timestamp_ntz, id long").withColumn("month", F.date_trunc("month", "ts"))
    df.repartitionByRange(13, "month").sortWithinPartitions("ts").drop("month").write.parquet(path)
    anchors = {k: max(t for k2, t, _ in facts if k2 == k) for k in (1, 2, 3, 9)}
    return facts, anchors, spark.read.parquet(path), spark.createDataFrame([*anchors.items(), (5, None), (7, NOW)], "k int, at timestamp_ntz")


@pytest.mark.parametrize("minutes", [1, 45, 1440, 5000])
@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("prune", [False, True])
def test_equals_its_definition(frames, minutes, strict, prune):
    facts, anchors, f, a = frames
    got = {r.id for r in anchor_lookback(f, a, "k", "ts", "at", minutes, strict, prune).collect()}
    since = {k: t - dt.timedelta(minutes=minutes) for k, t in anchors.items()}
    assert got == {i for k, t, i in facts if (t > since[k] if strict else t >= since[k])}


def test_a_stale_key_does_not_widen_the_scan(spark, frames):
    """The pushed ranges are the stale day and the last days; the months between are not read."""
    _, _, f, a = frames
    j = anchor_lookback(f, a, "k", "ts", "at", 45)
    filters = [e for e in j._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in e and "OR" in e]
    assert len(filters) == 1, j._jdf.queryExecution().optimizedPlan().toString()
    assert all(f" >= {d} 00:00:00" in filters[0] for d in ("2023-06-03", "2024-06-01"))
    scan = f.filter(((F.col("ts") >= F.lit("2023-06-03").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2023-06-04").cast("timestamp_ntz")))
                    | (F.col("ts") >= F.lit("2024-06-01").cast("timestamp_ntz")))
    assert scan.select("_metadata.file_name").distinct().count() <= 3  # of some thirteen


def test_no_anchor_no_fact(frames):
    _, _, f, a = frames
    assert anchor_lookback(f, a.filter("k = 5"), "k", "ts", "at", 45).count() == 0
    assert anchor_lookback(f, a.limit(0), "k", "ts", "at", 45).count() == 0
