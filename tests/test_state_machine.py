"""Keyed ON/OFF state over split, late and restarted files, against the batch replay."""

import shutil

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tripwire.operators import state as st
from tripwire.plans.queries import REGISTRY
from tripwire.plans.context import Run
from tripwire.streaming import jobs as sj
from tripwire.streaming import state_machine as sm

COLS = ["instance_id", "event_time", "event_id", "total_cpu", "threshold", "action"]


def rows_of(df):
    return sorted(map(str, df.select(*COLS).collect()))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The test tables with the events split over five files by time, every seventh event in a file three days late."""
    base = tmp_path_factory.mktemp("split")
    for t in ("customer", "nation", "region", "part", "supplier", "lineitem", "orders"):
        shutil.copy(f"{SF_SMALL}/{t}.parquet", f"{base}/{t}.parquet")
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    lo, hi = ev.agg(F.unix_micros(F.min("ts").cast("timestamp")), F.unix_micros(F.max("ts").cast("timestamp"))).first()
    late = F.when(F.col("event_id") % 7 == 0, 3 * 86_400_000_000).otherwise(0)
    part = F.least(F.floor((F.unix_micros(F.col("ts").cast("timestamp")) + late - lo) * 5 / (hi - lo + 1)), F.lit(4))
    for i in range(5):
        ev.filter(part == i).coalesce(1).write.parquet(f"{base}/stage/{i}")
    return base


def arrive(base, i):
    (base / "events.parquet").mkdir(exist_ok=True)
    for f in (base / "stage" / str(i)).glob("part-*.parquet"):
        shutil.copy(f, base / "events.parquet" / f"f{i}.parquet")


def test_split_late_and_restarted_files_equal_the_batch_replay(spark, folder):
    out = None
    for i in range(5):  # a stream that is stopped after every file and started again
        arrive(folder, i)
        out = sm.run_keyed_state_machine(spark, str(folder), "4 days", out=out or f"{folder}/out", config=None)
    got = sj.current_actions(spark, out)
    run = Run(spark, SF_SMALL)
    assert got.count() == run.tm.cpu().join(run.instances, "instance_id").count()
    limits = got.select("instance_id", "threshold").distinct()
    samples = got.select(*COLS[:-1])
    want = st.state_replay(samples, "instance_id", "event_time", "event_id", F.col("total_cpu") >= F.col("threshold"))
    assert rows_of(got) == rows_of(want) and limits.count() > 10
    emitted = sj._epochs(spark, f"{out}/actions")
    assert emitted.select("event_id").distinct().count() == got.count() < emitted.count() < 1.6 * got.count()  # corrections only


def test_registered_query_equals_the_batch_replay(spark):
    run = Run(spark, SF_SMALL)
    assert rows_of(REGISTRY["stream_state_machine"](run)) == rows_of(REGISTRY["state_replay"](run).select(*COLS))


def test_steps():
    machine, seen = (None, False), []
    for breach in (None, False, True, True, None, False, False, True):
        machine, action = sm.step(machine, breach)
        seen.append(action)
    assert seen == [None, "IGNORE", "NEW->ON", "IGNORE", None, "ON->OFF", "IGNORE", "OFF->ON"]
