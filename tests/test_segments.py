"""Ranges of equal row counts: running results equal those of plain windows, whatever the keys."""

import random

import pytest
from pyspark.sql import Window, functions as F

from tripwire.operators.segments import SEG, cut, numbered, running_sum


@pytest.fixture(scope="module")
def series(spark):
    rnd = random.Random(1)
    rows = [(None if i % 5 == 0 else 1 if i % 2 else rnd.randrange(40), rnd.randrange(500), i, rnd.randrange(9) - 4) for i in range(3000)]
    return spark.createDataFrame(rows, "k int, t int, id long, v int")


@pytest.mark.parametrize("ranges", [1, 13, None])
def test_numbered_and_running_sum(series, ranges):
    w = Window.partitionBy("k").orderBy("t", "id")
    want = series.withColumn("n", F.row_number().over(w).cast("long")).withColumn(
        "s", F.coalesce(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    got = running_sum(numbered(series, ["k"], ["t", "id"], "n", ranges), ["k"], ["t", "id"], F.col("v"), "s", ranges)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_a_hot_key_fills_many_ranges(series):
    rows = cut(series, ["k"], ["t", "id"], 12)
    sizes = [r["count"] for r in rows.groupBy(SEG).count().collect()]
    assert len(sizes) > 8 and max(sizes) < 3 * 3000 / 12
    assert rows.filter("k = 1").select(SEG).distinct().count() > 3


def test_empty(spark):
    none = spark.createDataFrame([], "k int, t int, v int")
    assert numbered(none, ["k"], ["t"], "n").count() == 0 == running_sum(none, ["k"], ["t"], F.col("v"), "s").count()
