"""Running computations over ordered series, cut into ranges of about equal row counts.

A window over a whole series puts a key's rows into one task. Here rows are range-partitioned by (keys, order):
Spark samples them, so a range holds about as many rows as any other, whether one key fills many ranges or one range
holds many keys. The window then runs inside (range, keys), and what crosses a border is one summary per
(keys, range). Ranges are contiguous, so at most one key of a range has rows in an earlier range and at most one has
rows in a later one: a carry table has no more rows than there are ranges and may be broadcast.

`cut` writes its result to the shared checkpoint folder: range borders come from sampling, and every later use must
see the same ones.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from tripwire.session import materialized

SEG = "_seg"


def cut(df: DataFrame, keys: Sequence[str], order: "Sequence[str | Column]", ranges: int | None = None) -> DataFrame:
    """df with the number of its range (column `_seg`) in the order of (keys, order), written to the shared folder.

    Without `ranges` there are as many as shuffle partitions, fewer where adaptive execution merges small ones. Rows
    that are equal in keys and order may fall into two neighbouring ranges.
    """
    by = [*[F.col(k) for k in keys], *[F.col(o) if isinstance(o, str) else o for o in order]]
    parted = df.repartitionByRange(ranges, *by) if ranges else df.repartitionByRange(*by)
    return materialized(parted.withColumn(SEG, F.spark_partition_id()))


def inside(keys: Sequence[str], *order) -> "Window":
    """The window of one key's rows inside one range."""
    return Window.partitionBy(SEG, *keys).orderBy(*order)


def with_carry(rows: DataFrame, keys: Sequence[str], summary: dict[str, Column], carry: dict[str, Column],
               later: bool = False) -> DataFrame:
    """rows (with `_seg`) plus what the other ranges of the same key hand over; NULL where there are none.

    `summary` reduces the rows of a (range, key) to named values; `carry` combines the summaries of all earlier ranges of
    the key (of all later ones with `later`): each of its columns is an aggregate of summary names, evaluated over those
    ranges in the order from far to near.
    """
    parts = rows.groupBy(SEG, *keys).agg(*[c.alias(n) for n, c in summary.items()])
    others = (Window.partitionBy(*keys).orderBy(F.col(SEG).desc() if later else F.col(SEG))
              .rowsBetween(Window.unboundedPreceding, -1))
    near = parts.select(F.col(SEG).alias("_cs"), *[F.col(k).alias(f"_c_{k}") for k in keys],
                        F.count(F.lit(1)).over(others).alias("_cn"), *[c.over(others).alias(n) for n, c in carry.items()])
    near = near.filter(F.col("_cn") > 0).drop("_cn")  # at most one key of a range: no more rows than ranges
    same = [F.col(SEG) == F.col("_cs"), *[F.col(k).eqNullSafe(F.col(f"_c_{k}")) for k in keys]]
    return rows.join(F.broadcast(near), reduce(and_, same), "left").drop("_cs", *[f"_c_{k}" for k in keys])


def numbered(df: DataFrame, keys: Sequence[str], order: "Sequence[str | Column]", out: str, ranges: int | None = None) -> DataFrame:
    """df with the row number (from 1) of every row in its key, in the given order; no key is one task's work.

    Rows of equal order are numbered in any order.
    """
    rows = cut(df, keys, order, ranges)
    local = F.row_number().over(inside(keys, *order))
    rows = with_carry(rows.withColumn(out, local), keys, {"_n": F.count(F.lit(1))}, {"_before": F.sum("_n")})
    return rows.withColumn(out, (F.col(out) + F.coalesce("_before", F.lit(0))).cast("long")).drop("_before", SEG)


def running_sum(df: DataFrame, keys: Sequence[str], order: "Sequence[str | Column]", value: Column, out: str,
                ranges: int | None = None) -> DataFrame:
    """df with the sum of `value` over the rows before each row of its key (0 at the first)."""
    rows = cut(df, keys, order, ranges).withColumn("_v", value)
    local = F.sum("_v").over(inside(keys, *order).rowsBetween(Window.unboundedPreceding, -1))
    rows = with_carry(rows.withColumn(out, F.coalesce(local, F.lit(0))), keys, {"_n": F.sum("_v")}, {"_before": F.sum("_n")})
    return rows.withColumn(out, F.col(out) + F.coalesce("_before", F.lit(0))).drop("_before", "_v", SEG)
