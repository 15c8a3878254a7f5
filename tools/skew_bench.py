"""Replays on a generated series in which one instance holds a third of all rows.

usage: python tools/skew_bench.py [rows of the state replay] [rows of the interval replay]

Timing only (noop sink, local master); correctness is tested on small series in tests/.
"""

from __future__ import annotations

import datetime as dt
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from tripwire.operators.replay import suppress_replay  # noqa: E402
from tripwire.operators.routing import ROUTE_FIELDS, route_by_audience  # noqa: E402
from tripwire.operators.state import state_replay  # noqa: E402
from tripwire.session import get_spark  # noqa: E402


def series(spark, n: int):
    """n samples over 30 days; every third belongs to instance 0, the rest to 10,000 others."""
    i = F.col("id")
    return spark.range(n).select(
        F.when(i % 3 == 0, F.lit(0)).otherwise(F.pmod(F.xxhash64("id"), F.lit(10_000)) + 1).alias("k"),
        F.timestamp_add("SECOND", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(30 * 86400)), F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz")).alias("ts"),
        i.alias("id"), F.pmod(F.xxhash64("id", F.lit(2)), F.lit(100)).cast("int").alias("v"))


def timed(name: str, df) -> None:
    t0 = time.perf_counter()
    df().write.format("noop").mode("overwrite").save()
    print(f"{name}: {time.perf_counter() - t0:.1f} s", flush=True)


def main() -> None:
    state_rows = int(sys.argv[1]) if len(sys.argv) > 1 else 20_000_000
    replay_rows = int(sys.argv[2]) if len(sys.argv) > 2 else 1_000_000
    spark = get_spark("local[8]", 64)
    timed(f"state_replay, {state_rows} samples", lambda: state_replay(series(spark, state_rows), "k", "ts", "id", F.col("v") >= 50))
    hour = spark.range(replay_rows).select(F.lit(1).alias("k"), F.timestamp_add(
        "MICROSECOND", F.floor(F.col("id") * F.lit(3_600_000_000) / replay_rows), F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz")).alias("ts"), "id")
    timed(f"suppress_replay, {replay_rows} breaches of one key in one hour, interval 333 ms",
          lambda: suppress_replay(hour, "k", "ts", "id", dt.timedelta(milliseconds=333)))
    for interval in (dt.timedelta(hours=5), dt.timedelta(minutes=1)):
        timed(f"suppress_replay, {replay_rows} breaches, interval {interval}",
              lambda: suppress_replay(series(spark, replay_rows), "k", "ts", "id", interval))
    rows = spark.range(1_000_000).select(F.concat(F.lit("host"), F.col("id")).alias("instance"),
                                         *[F.when(F.col("id") < 0, F.lit("x")).otherwise(F.lit("ops")).alias(c) for c in ROUTE_FIELDS])
    timed("route_by_audience, 1000000 rows of one audience", lambda: route_by_audience(rows, "instance", F.concat(F.lit("<tr>"), "instance", F.lit("</tr>"))))


if __name__ == "__main__":
    main()
