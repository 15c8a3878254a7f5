"""Telemetry selection: latest / last-k per key, anchored lookbacks, first-in-window.

Scale notes
* "latest per key" is an aggregate (`max_by` over a struct), not a window: it combines
  map-side, so a key holding a third of all rows still shuffles one partial row per task.
* "last k per key" uses `row_number() <= k`; Spark plans a partial WindowGroupLimit before
  the shuffle, so at most k rows per key per task cross the network.
* Literal time bounds are plain filters on the fact column and reach the Parquet scan.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

DAY_MINUTES = 24 * 60


def lookback(df: DataFrame, ts_col: str, as_of: dt.datetime, minutes: int) -> DataFrame:
    """Keep facts with `as_of - minutes <= ts <= as_of` (literal bounds: pushed into the scan)."""
    c = F.col(ts_col)
    lo = as_of - dt.timedelta(minutes=minutes)
    return df.filter((c >= F.lit(lo).cast("timestamp_ntz")) & (c <= F.lit(as_of).cast("timestamp_ntz")))


def window_half_open(df: DataFrame, ts_col: str, lo: dt.datetime, hi: dt.datetime) -> DataFrame:
    """Keep facts with `lo <= ts < hi`."""
    c = F.col(ts_col)
    return df.filter((c >= F.lit(lo).cast("timestamp_ntz")) & (c < F.lit(hi).cast("timestamp_ntz")))


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row per key: the values of the row with the greatest `order` tuple.

    `order` must make rows unique within a key (add a tie-break column) for a deterministic pick.
    """
    keys, order, values = list(keys), list(order), list(values)
    payload = [c for c in order + values if c not in keys]
    picked = F.max_by(F.struct(*payload), F.struct(*order)).alias("_p")
    return df.groupBy(*keys).agg(picked).select(*keys, *[F.col("_p." + c).alias(c) for c in payload])


def earliest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row per key: the values of the row with the smallest `order` tuple."""
    keys, order, values = list(keys), list(order), list(values)
    payload = [c for c in order + values if c not in keys]
    picked = F.min_by(F.struct(*payload), F.struct(*order)).alias("_p")
    return df.groupBy(*keys).agg(picked).select(*keys, *[F.col("_p." + c).alias(c) for c in payload])


def last_k_per_key(df: DataFrame, keys: Sequence[str], order_desc: Sequence[str], k: int, rn: str = "rn") -> DataFrame:
    """Rows ranked 1..k per key by `order_desc` descending, with their rank in `rn`."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order_desc])
    return df.withColumn(rn, F.row_number().over(w)).filter(F.col(rn) <= k)


RANGES = 24  # literal time ranges of one scan, at most


def window_buckets(anchors: DataFrame, anchor_ts: str, minutes: int) -> tuple[DataFrame, int]:
    """anchors once per time bucket that their window [anchor - minutes, anchor] touches (`_bucket`), and the bucket's width
    in microseconds: a day or, if it is longer, the window, so an anchor has two buckets at most."""
    width = max(minutes, DAY_MINUTES) * 60_000_000
    end = F.unix_micros(F.col(anchor_ts).cast("timestamp"))
    start = end - F.lit(minutes * 60_000_000)
    buckets = F.sequence(F.floor(start / width), F.floor(end / width))
    return anchors.filter(F.col(anchor_ts).isNotNull()).withColumn("_bucket", F.explode(buckets)), width


def time_ranges(buckets: "Sequence[int]", most: int = RANGES) -> list[tuple[int, int]]:
    """Runs of neighbouring buckets as (first, last); the smallest gaps are closed until at most `most` runs are left."""
    runs: list[tuple[int, int]] = []
    for b in sorted(buckets):
        if runs and b <= runs[-1][1] + 1:
            runs[-1] = (runs[-1][0], b)
        else:
            runs.append((b, b))
    if len(runs) > most:
        gaps = sorted((runs[i + 1][0] - runs[i][1], i) for i in range(len(runs) - 1))
        close = {i for _, i in gaps[:len(runs) - most]}
        merged = [runs[0]]
        for i, r in enumerate(runs[1:]):
            merged = [*merged[:-1], (merged[-1][0], r[1])] if i in close else [*merged, r]
        runs = merged
    return runs


def anchor_lookback(
    facts: DataFrame,
    anchors: DataFrame,
    key: str,
    fact_ts: str,
    anchor_ts: str,
    minutes: int,
    strict: bool = False,
    prune: bool = True,
) -> DataFrame:
    """Interval join: facts of a key from `minutes` before that key's anchor time up to the anchor.

    An anchor is the key's latest collection, so it has no later facts. Both sides are keyed by (key, time bucket): an
    anchor stands in the one or two buckets of its window and a fact in its own, so the join is an equi-join with a
    range residual in which a key's facts are spread over its buckets and only those of the window's buckets can meet.
    The anchor side has few rows per key; AQE broadcasts it when its runtime size is under the broadcast threshold and
    falls back to a sort-merge join otherwise (with skew-join splitting).

    With `prune`, the distinct buckets of all windows (a number per day at most, read on the driver) become literal time
    ranges, which Catalyst pushes into the Parquet scan: only row groups that can match are read. A key whose last
    collection is a year old adds its own day to the scan and not the year between. The ranges cover every window, so
    they drop nothing.
    """
    a, width = window_buckets(anchors.select(F.col(key).alias("_ak"), F.col(anchor_ts).alias("_anchor")), "_anchor", minutes)
    if prune:
        runs = time_ranges([r[0] for r in a.select("_bucket").distinct().collect()])
        epoch, day = dt.datetime(1970, 1, 1), dt.timedelta(microseconds=width)
        keep = F.lit(False)
        for first, last in runs:
            low, high = (F.lit(epoch + n * day).cast("timestamp_ntz") for n in (first, last + 1))
            keep = keep | ((F.col(fact_ts) >= low) & (F.col(fact_ts) < high))
        facts = facts.filter(keep)
    lo = F.col("_anchor") - F.make_dt_interval(mins=F.lit(minutes))
    bucket = F.floor(F.unix_micros(F.col(fact_ts).cast("timestamp")) / width)
    cond = ((F.col(key) == F.col("_ak")) & (bucket == F.col("_bucket")) & (F.col(fact_ts) <= F.col("_anchor"))
            & ((F.col(fact_ts) > lo) if strict else (F.col(fact_ts) >= lo)))
    return facts.join(a, cond).drop("_ak", "_bucket")


def first_in_window(
    snapshots: DataFrame,
    key: str,
    ts_col: str,
    since: dt.datetime,
    tie: Sequence[str],
    values: Sequence[str],
) -> DataFrame:
    """Per key, the earliest snapshot at or after `since` (OUTER APPLY TOP 1 ORDER BY ts).

    Written as a filtered `min_by` aggregate: partial aggregation per task, no global sort.
    """
    recent = snapshots.filter(F.col(ts_col) >= F.lit(since).cast("timestamp_ntz"))
    return earliest_per_key(recent, [key], [ts_col, *tie], values)


def exact_snapshot(facts: DataFrame, anchors: DataFrame, key: str, fact_ts: str, anchor_ts: str) -> DataFrame:
    """Facts taken exactly at the key's anchor time (two-key equi-join)."""
    a = anchors.select(F.col(key).alias("_ak"), F.col(anchor_ts).alias("_anchor"))
    return facts.join(a, (F.col(key) == F.col("_ak")) & (F.col(fact_ts) == F.col("_anchor"))).drop("_ak", "_anchor")
