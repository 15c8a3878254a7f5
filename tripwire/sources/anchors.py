"""Collection dates as a maintained aggregate: the latest snapshot time per (instance, dataset), updated from new files only.

A store is a folder of versions (sinks.write_snapshot); each holds one row per (instance, reference) and the high-water
mark of the update that wrote it: the latest modification time of the fact files that it has seen. An update reads the
files that are at least as new (Spark skips the others when it lists the table), reduces their three narrow columns and
merges the maxima into the stored ones. A late file, with old times in a new file, is read like any other, so the store
always equals the aggregate over all files; reading a file of the very same moment twice changes no maximum.

Facts are append-only. Where files are rewritten or removed, `rebuild` computes the store anew.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from tripwire.sources import sinks

KEYS = ["instance_id", "reference"]


def reduced(facts: DataFrame, instance: str, reference, ts: str) -> DataFrame:
    """(instance_id, reference, snapshot_date, seen): the latest time per key and the newest file that was read."""
    return facts.groupBy(F.col(instance).alias("instance_id"), reference.alias("reference")).agg(
        F.max(ts).alias("snapshot_date"), F.max("_metadata.file_modification_time").alias("seen"))


def new_files(facts: DataFrame, since: dt.datetime | None) -> DataFrame:
    """The rows of files that are at least as new as `since` (all of them without it)."""
    if since is None:
        return facts
    return facts.filter(F.col("_metadata.file_modification_time") >= F.lit(since))


def stored(spark: SparkSession, store: str) -> DataFrame | None:
    """The collection dates of the newest complete version, or None."""
    found = sinks.latest(spark, store)
    return None if found is None else found.select(*KEYS, "snapshot_date")


def update(facts: DataFrame, store: str, instance: str, reference, ts: str, rebuild: bool = False) -> DataFrame:
    """Bring the store up to date with the files of `facts` (a plain read of a file table) and return its collection dates."""
    spark = facts.sparkSession
    old = None if rebuild else sinks.latest(spark, store)
    since = None if old is None else old.agg(F.max("seen")).first()[0]  # one value
    new = reduced(new_files(facts, since), instance, reference, ts)
    both = new if old is None else old.unionByName(new)
    merged = both.groupBy(*KEYS).agg(F.max("snapshot_date").alias("snapshot_date"), F.max("seen").alias("seen"))
    return spark.read.parquet(sinks.write_snapshot(merged, store)).select(*KEYS, "snapshot_date")
