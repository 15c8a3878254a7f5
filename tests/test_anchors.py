"""Maintained collection dates against full recomputation, with late files; and what an update reads."""

import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from tripwire.plans import alerts as al
from tripwire.plans.context import Run
from tripwire.sources import anchors, sinks
from tripwire.sources.tables import Tables

from conftest import SF_SMALL

T0 = dt.datetime(2024, 3, 1)


def write(spark, path, rows, name):
    df = spark.createDataFrame(rows, "user_id long, event_type string, ts timestamp_ntz")
    df.coalesce(1).write.mode("append").parquet(path)
    time.sleep(0.05)


def full(spark, path):
    return {tuple(r) for r in spark.read.parquet(path).groupBy("user_id", "event_type").agg(F.max("ts")).collect()}


def update(spark, path, store):
    got = anchors.update(spark.read.parquet(path), store, "user_id", F.col("event_type"), "ts")
    return {tuple(r) for r in got.collect()}


def test_updates_equal_recomputation_with_late_files(spark, tmp_path):
    path, store = f"{tmp_path}/events", f"{tmp_path}/store"
    day = dt.timedelta(days=1)
    batches = [
        [(1, "view", T0 + 5 * day), (2, "view", T0), (1, "error", T0 + day)],
        [(1, "view", T0 + 9 * day), (3, "view", T0 + 2 * day)],
        [(2, "view", T0 + 3 * day), (1, "view", T0 - 30 * day), (4, "click", T0 - 40 * day)],  # late: older than what is known
        [(2, "view", T0 - day)],
    ]
    for rows in batches:
        write(spark, path, rows, "f")
        assert update(spark, path, store) == full(spark, path)
    assert update(spark, path, store) == full(spark, path)
    assert {tuple(r) for r in anchors.stored(spark, store).collect()} == full(spark, path)


def test_an_update_reads_only_new_files(spark, tmp_path):
    path, store = f"{tmp_path}/events", f"{tmp_path}/store"
    write(spark, path, [(i, "view", T0) for i in range(500)], "old")
    for f in os.listdir(path):  # an older file, as a table has them
        os.utime(f"{path}/{f}", (1_600_000_000, 1_600_000_000))
    update(spark, path, store)
    write(spark, path, [(7, "view", T0 + dt.timedelta(hours=1))], "new")
    since = sinks.latest(spark, store).agg(F.max("seen")).first()[0]
    read = anchors.new_files(spark.read.parquet(path), since + dt.timedelta(seconds=1))
    assert read.select("_metadata.file_name").distinct().count() == 1 and read.count() == 1
    old = [f for f in os.listdir(path) if os.stat(f"{path}/{f}").st_mtime < 1_700_000_000 and f.endswith(".parquet")]
    write(spark, f"{tmp_path}/moved", [(1, "view", T0)], "x")
    os.replace(f"{path}/{old[0]}", f"{tmp_path}/moved/{old[0]}.away")  # not needed any more: the store knows it
    assert {tuple(r) for r in anchors.update(spark.read.parquet(path), store, "user_id", F.col("event_type"), "ts").filter(
        "instance_id < 9").collect()} == {(i, "view", T0 + dt.timedelta(hours=1) if i == 7 else T0) for i in range(9)}


@pytest.mark.parametrize("job", ["cpu", "queries"])
def test_jobs_agree_with_and_without_a_store(spark, tmp_path, job):
    plain, kept = (Run(spark, SF_SMALL, tables=Tables(spark, SF_SMALL), anchors=a) for a in (None, f"{tmp_path}/a"))

    def rows(run):
        df = al.cpu_latest(run, 2880) if job == "cpu" else al.top_blocker_groups(run, 40_000, None)
        return sorted(map(str, df.collect()))

    assert rows(plain) == rows(kept) and rows(plain)
    again = Run(spark, SF_SMALL, tables=Tables(spark, SF_SMALL), anchors=f"{tmp_path}/a")
    assert rows(again) == rows(plain)
