"""Readers for the input tables.

Every read is lazy: Catalyst prunes columns to what the plan uses and pushes literal
filters into the Parquet scan, so a job never reads more than it needs.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

INPUT_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


class Tables:
    """Lazy handle on a directory of `<name>.parquet` tables (or catalog tables).

    File listings and scalars live as long as the handle; a poller that wants to see new data
    makes a new one.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, database: str | None = None):
        self.spark = spark
        self.root = root.rstrip("/") if root else None
        self.database = database
        self._frames: dict[str, DataFrame] = {}
        self._scalars: dict[str, object] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._frames:
            if self.root is not None:
                self._frames[name] = self.spark.read.parquet(f"{self.root}/{name}.parquet")
            else:
                self._frames[name] = self.spark.table(f"{self.database}.{name}" if self.database else name)
        return self._frames[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name in INPUT_TABLES:
            return self.table(name)
        raise AttributeError(name)

    def scalar(self, key: str, df: DataFrame) -> object:
        """One value from a one-row aggregate, read once per catalog (e.g. evaluation time)."""
        if key not in self._scalars:
            self._scalars[key] = df.first()[0]
        return self._scalars[key]

    def events_now(self) -> dt.datetime:
        """Evaluation time for event-based telemetry: the latest event time."""
        return self.scalar("events_now", self.events.agg(F.max("ts")))

    def event_instances(self) -> DataFrame:
        """Every instance id of the event log, once (column c_custkey): one pass over one column."""
        return self.events.select(F.col("user_id").alias("c_custkey")).distinct()

    def lineitem_now(self) -> dt.datetime:
        """Evaluation time for lineitem-based telemetry: the latest ship date."""
        return self.scalar("lineitem_now", self.lineitem.agg(F.max("l_shipdate")))
