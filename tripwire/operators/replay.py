"""Repeat-interval suppression replayed over a whole breach series, distributed.

Rule (one key): the first breach is notified; afterwards a breach is notified when at
least `interval` has passed since the last *notified* breach. The notified set is the chain
first -> next(first) -> next(next(first)) ..., where next(e) is the first breach at or after
e.ts + interval. With an interval of zero every breach is notified.

One path for every key and interval, linear in the rows:
1. rows are range-partitioned by (key, time, id), so ranges hold about equally many rows however
   they fall on keys, and sorted. One pass over a range walks the chain of every key from its first
   row there. For a key that enters or leaves the range, the pass also notes for each row where the
   chain through it leaves: the time `out` from which the next breach is notified.
2. A key that fills several ranges (at most one enters and one leaves each of them) is a chain of
   exits: `out` -> first row at or after it -> that row's own `out`. Distinct exits are resolved by
   a backward merge (`next_at_or_after`) and the chain of exits grows by pointer doubling; it has no
   more links than the key has ranges.
3. Where the chain enters a range, the walk of step 1 is repeated from the entered row.
Results between steps go to the shared checkpoint folder. The walk is sequential by nature, so it
runs over Arrow columns in tasks; a task holds the keys, times and ids of one range.
"""

from __future__ import annotations

import datetime as dt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tripwire.operators.segments import cut, inside, with_carry
from tripwire.session import materialized


def next_at_or_after(events: DataFrame, key: str, ts: str, eid: str, offset: dt.timedelta, ranges: int | None = None) -> DataFrame:
    """For each event: the first event of the same key with time >= event time + offset.

    Returns (key, src_id, src_ts, dst_id, dst_ts); dst is NULL when there is none.
    """
    probes = events.select(F.col(key).alias("k"), (F.col(ts) + F.lit(offset)).alias("t"),
                           F.struct(F.col(eid).alias("src_id"), F.col(ts).alias("src_ts")).alias("probe"))
    points = events.select(F.col(key).alias("k"), F.col(ts).alias("t"), F.struct(F.col(ts).alias("t"), F.col(eid).alias("id")).alias("point"))
    found = first_at_or_after(probes, points, ranges)
    return found.select(F.col("k").alias(key), "probe.src_id", "probe.src_ts", F.col("point.id").alias("dst_id"), F.col("point.t").alias("dst_ts"))


def first_at_or_after(probes: DataFrame, points: DataFrame, ranges: int | None = None) -> DataFrame:
    """probes (k, t, probe) with the smallest `point` (k, t, point) at the least time t >= the probe's; NULL if there is none.

    A merge of both sides by (key, time), scanned from the end: each probe takes the last point seen. Ranges hold equal
    row counts and hand their first point to the ranges before them, so neither a hot key nor a dense hour is one task.
    """
    none = F.lit(None)
    u = (probes.select("k", "t", "probe", F.lit(0).alias("side"), none.cast(points.schema["point"].dataType).alias("point"))
         .unionByName(points.select("k", "t", none.cast(probes.schema["probe"].dataType).alias("probe"), F.lit(1).alias("side"), "point")))
    rows = cut(u, ["k"], ["t", "side", "point"], ranges)
    back = inside(["k"], F.col("t").desc(), F.col("side").desc(), F.col("point").desc())
    rows = rows.withColumn("near", F.last("point", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    rows = with_carry(rows, ["k"], {"first": F.min_by("point", F.when(F.col("side") == 1, F.struct("t", "point")))},
                      {"later": F.last("first", ignorenulls=True)}, later=True)
    return rows.filter("side = 0").select("k", "t", "probe", F.coalesce("near", "later").alias("point"))


def chain_of(t: np.ndarray, interval: int, exits: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """(rows on the chain from the first row; for every row the time from which its chain continues after the last row)."""
    n = len(t)
    following = np.searchsorted(t, t + interval, "left")
    on = np.zeros(n, bool)
    step, at = following.tolist(), 0
    while at < n:
        on[at] = True
        at = step[at]
    if not exits:
        return on, None
    out = (t + interval).tolist()
    for i in range(n - 1, -1, -1):
        if step[i] < n:
            out[i] = out[step[i]]
    return on, np.array(out, np.int64)


def _walked(rows: DataFrame, interval: int, run: list[str], edges: bool) -> DataFrame:
    """Sorted partitions of rows (run columns, k, t, id, ts): rows on the chain of their run, and with `edges` all rows of
    the first and last run of the partition: (seg, edge, k, t, id, ts, sent, out)."""

    def walk(batches):
        held = list(batches)
        if not held:
            return
        held = pa.Table.from_batches(held).combine_chunks()
        n = held.num_rows
        if not n:
            return
        new = np.zeros(n, bool)
        for c in run:
            codes = held.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            new[1:] |= codes[1:] != codes[:-1]
        starts = [0, *np.flatnonzero(new).tolist(), n]
        t = held.column("t").to_numpy()
        sent, edge, out = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, np.int64)
        for a, z in zip(starts[:-1], starts[1:]):
            at_edge = edges and (a == 0 or z == n)
            sent[a:z], exits = chain_of(t[a:z], interval, at_edge)
            if at_edge:
                edge[a:z], out[a:z] = True, exits
        take = np.flatnonzero(sent | edge)
        part = held.take(pa.array(take))
        seg = np.full(len(take), TaskContext.get().partitionId(), np.int32)
        names = ["seg", "edge", "k", "t", "id", "ts", "sent", "out"]
        columns = [pa.array(seg), pa.array(edge[take]), *[part.column(c) for c in ("k", "t", "id", "ts")], pa.array(sent[take]), pa.array(out[take])]
        yield from pa.table(dict(zip(names, columns))).to_batches(max_chunksize=100_000)

    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(walk, f"seg int, edge boolean, k {kind['k']}, t long, id {kind['id']}, ts {kind['ts']}, sent boolean, out long")


def suppress_replay(events: DataFrame, key: str, ts: str, eid: str, interval: dt.timedelta, ranges: int | None = None) -> DataFrame:
    """The notified events of each key's breach series under the repeat interval.

    (key, eid) must be unique; ties in time are ordered by eid. Events without a time are never notified. A negative
    interval is an error.
    """
    if interval < dt.timedelta(0):
        raise ValueError("the repeat interval must not be negative")
    if not interval:
        return events.select(key, ts, eid)
    micros = interval // dt.timedelta(microseconds=1)
    rows = events.filter(F.col(ts).isNotNull()).select(
        F.col(key).alias("k"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col(eid).alias("id"), F.col(ts).alias("ts"))
    order = ["k", "t", "id"]
    parted = rows.repartitionByRange(ranges, *order) if ranges else rows.repartitionByRange(*order)
    walked = materialized(_walked(parted.sortWithinPartitions(*order), micros, ["k"], True))
    # at most two runs of a range are at its edge: no more rows than twice the ranges
    runs = walked.filter("edge").groupBy("k", "seg").agg(F.min_by("out", F.struct("t", "id")).alias("out"))
    first = Window.partitionBy("k").orderBy("seg")
    runs = runs.withColumn("nth", F.row_number().over(first)).withColumn("runs", F.count(F.lit(1)).over(Window.partitionBy("k"))).filter("runs > 1")
    runs = materialized(runs)
    sent = walked.filter("sent")
    if runs.take(1):
        later = F.broadcast(runs.filter("nth > 1").select(F.col("k").alias("rk"), F.col("seg").alias("rs")))
        same = F.col("k").eqNullSafe(F.col("rk")) & (F.col("seg") == F.col("rs"))
        crossing = F.broadcast(runs.filter("nth = 1").select(F.col("k").alias("ck")))
        open_rows = walked.filter("edge").join(crossing, F.col("k").eqNullSafe(F.col("ck")), "left_semi")
        entered = _entered(runs, open_rows, ranges)
        again = open_rows.join(F.broadcast(entered), F.col("k").eqNullSafe(F.col("ek")) & (F.col("seg") == F.col("es"))).filter(
            F.struct("t", "id") >= F.col("at"))
        again = again.select("seg", "k", "t", "id", "ts").repartition("seg").sortWithinPartitions("seg", "k", "t", "id")
        sent = (sent.join(later, same, "left_anti").select("k", "ts", "id")
                .unionByName(_walked(again, micros, ["seg", "k"], False).select("k", "ts", "id")))
    return sent.select(F.col("k").alias(key), F.col("ts").alias(ts), F.col("id").alias(eid))


def _entered(runs: DataFrame, open_rows: DataFrame, ranges: int | None) -> DataFrame:
    """(ek, es, at): the row (time, id) by which each key's chain enters its later ranges; at most one row per (key, range)."""
    exits = open_rows.groupBy("k", "out").agg(F.lit(0).alias("probe")).select("k", F.col("out").alias("t"), F.struct("probe").alias("probe"))
    points = open_rows.select("k", "t", F.struct("t", "id", "seg", "out").alias("point"))
    jump = materialized(first_at_or_after(exits, points, ranges).filter(F.col("point").isNotNull()).select(
        "k", F.col("t").alias("out"), F.col("point.seg").alias("seg"), F.struct("point.t", "point.id").alias("at"), F.col("point.out").alias("next")))
    # the chain of exits by pointer doubling: `far` skips 2^i links, `chain` holds the first 2^i of every key
    chain = materialized(runs.filter("nth = 1").select("k", "out"))
    far = jump.select("k", "out", "next")
    while True:
        step = far.select(F.col("k").alias("fk"), F.col("out").alias("fo"), "next")
        ahead = materialized(chain.join(step, F.col("k").eqNullSafe(F.col("fk")) & (F.col("out") == F.col("fo"))).select("k", F.col("next").alias("out")))
        if not ahead.take(1):
            break
        chain = materialized(chain.unionByName(ahead))
        mid = far.select(F.col("k").alias("mk"), F.col("out").alias("mo"), F.col("next").alias("mn"))
        far = materialized(far.join(mid, F.col("k").eqNullSafe(F.col("mk")) & (F.col("next") == F.col("mo"))).select("k", "out", F.col("mn").alias("next")))
    on = chain.select(F.col("k").alias("fk"), F.col("out").alias("fo"))
    return jump.join(on, F.col("k").eqNullSafe(F.col("fk")) & (F.col("out") == F.col("fo")), "left_semi").select(
        F.col("k").alias("ek"), F.col("seg").alias("es"), "at")
