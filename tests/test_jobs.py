"""End-to-end job runs: persistence and the repeat-interval property."""

import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from tripwire.plans.jobs import run_job
from tripwire.sources import sinks


def test_rerun_at_same_time_sends_nothing_new(spark):
    out = tempfile.mkdtemp(prefix="tw-job-")
    first = run_job(spark, "blocking-duration", SF_SMALL, out, 7 * 24 * 60)
    second = run_job(spark, "blocking-duration", SF_SMALL, out, 7 * 24 * 60)
    assert first["history"] != second["history"]
    ob = spark.read.parquet(f"{out}/outbox")
    assert ob.filter(F.col("channel") == "email").count() >= 1
    # the second poll found every breaching instance inside the repeat interval
    assert spark.read.parquet(second["outbox"]).count() == 0
    assert ob.select("run").distinct().count() == 1
    h = sinks.latest_history(spark, f"{out}/history")
    assert h is not None and h.count() == spark.read.parquet(first["history"]).count()


def test_cpu_transitions_persist(spark):
    out = tempfile.mkdtemp(prefix="tw-job-")
    run_job(spark, "cpu", SF_SMALL, out)
    h = sinks.latest_history(spark, f"{out}/history")
    assert h.filter(F.col("alert_id") == 3).filter(F.col("status").isin("ON", "OFF")).count() > 0
