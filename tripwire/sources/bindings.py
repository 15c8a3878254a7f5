"""Telemetry tables as views over the given input tables.

The alerting jobs read a monitoring repository (instances, tags, collection dates, CPU
samples, blocking snapshots, waits, counters, running queries, drives, data files). The test
inputs are a TPC-H-like schema plus an event log, so each telemetry table is bound onto them
here. Every binding is a lazy projection/filter/join, so the jobs' filters and column
pruning reach the Parquet scans.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import Column, DataFrame, functions as F

from tripwire.session import materialized
from tripwire.sources import anchors
from tripwire.sources.tables import Tables


def _props_int(props: Column) -> Column:
    return F.regexp_extract(props, "([0-9]+)", 1).cast("int")


def _ms_from_value(value: Column) -> Column:
    return (value.cast("decimal(18,2)") * F.lit(1000)).cast("bigint")


def cpu_percent(value: Column) -> Column:
    """Whole percent, at most 100; a missing reading stays missing."""
    return F.floor(F.when(value > 100.0, F.lit(100.0)).otherwise(value)).cast("int")


class Telemetry:
    """Named telemetry views over one `Tables` handle, as known at an evaluation time.

    With `as_of` (event log) and `li_as_of` (lineitem) every fact and every collection date ends
    there: nothing later is seen by any job. `anchors` names a folder in which the collection dates are
    maintained (sources/anchors.py); a run at a past time needs the dates of that time and does not use it.
    """

    def __init__(self, tables: Tables, as_of: dt.datetime | None = None, li_as_of: dt.datetime | None = None, anchors: str | None = None):
        self.t = tables
        self.as_of, self.li_as_of = as_of, li_as_of
        self.anchors = anchors

    @property
    def events(self) -> DataFrame:
        e = self.t.events
        return e if self.as_of is None else e.filter(F.col("ts") <= F.lit(self.as_of).cast("timestamp_ntz"))

    @property
    def lineitem(self) -> DataFrame:
        li = self.t.lineitem
        return li if self.li_as_of is None else li.filter(F.col("l_shipdate") <= F.lit(self.li_as_of).cast("timestamp_ntz"))

    # -- inventory -------------------------------------------------------------------------
    def instances(self) -> DataFrame:
        c = self.t.customer
        return c.join(self._seen_ids(), "c_custkey", "left_semi").select(
            F.col("c_custkey").alias("instance_id"),
            F.col("c_name").alias("instance_display_name"),
            F.lower("c_name").alias("connection_id"),
            (F.col("c_acctbal") >= 0).alias("is_active"),
        )

    def _seen_ids(self) -> DataFrame:
        """Distinct instance ids of the event log: the instance inventory's key set.

        In a monitoring repository the inventory is a small dimension table; here it is
        derived from the largest table, and every job uses it several times (instances,
        fleet-derived overrides and history), which would rescan the events each time. It is
        therefore written once per handle (distinct first: one row per instance). The inventory
        does not depend on the evaluation time.
        """
        return self._ids

    @cached_property
    def _ids(self) -> DataFrame:
        return materialized(self.t.event_instances())

    def instance_tags(self) -> DataFrame:
        c = self.t.customer
        seg = c.select(
            F.col("c_custkey").alias("instance_id"),
            F.lit("segment").alias("tag_name"),
            F.col("c_mktsegment").alias("tag_value"),
        )
        nat = c.join(self.t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
            F.col("c_custkey").alias("instance_id"),
            F.lit("nation").alias("tag_name"),
            F.col("n_name").alias("tag_value"),
        )
        return seg.unionByName(nat)

    def collection_dates(self) -> DataFrame:
        """Latest collection time per (instance, dataset)."""
        return self._collections

    @cached_property
    def _collections(self) -> DataFrame:
        """One pass over three narrow columns, written once per handle: every anchored job reads this
        small table instead of the whole history. With a store only files that are new to it are read."""
        if self.anchors and self.as_of is None:
            return anchors.update(self.t.events, f"{self.anchors}/events", "user_id", F.col("event_type"), "ts")
        return materialized(self.events.groupBy(
            F.col("user_id").alias("instance_id"), F.col("event_type").alias("reference")
        ).agg(F.max("ts").alias("snapshot_date")))

    def summary_anchors(self) -> DataFrame:
        """Latest running-query summary per instance, from the collection dates."""
        return self._collections.filter(F.col("reference").isin("click", "signup")).groupBy("instance_id").agg(
            F.max("snapshot_date").alias("anchor"))

    def query_anchors(self) -> DataFrame:
        """Latest running-query collection per instance: two columns of the fact table, no join."""
        return self._query_collections

    @cached_property
    def _query_collections(self) -> DataFrame:
        if self.anchors and self.li_as_of is None:
            kept = anchors.update(self.t.lineitem, f"{self.anchors}/lineitem", "l_suppkey", F.lit("queries"), "l_shipdate")
            return kept.select("instance_id", F.col("snapshot_date").alias("anchor"))
        return materialized(self.lineitem.groupBy(F.col("l_suppkey").alias("instance_id")).agg(F.max("l_shipdate").alias("anchor")))

    # -- event-based facts -----------------------------------------------------------------
    def cpu(self) -> DataFrame:
        e = self.events
        return e.filter(F.col("event_type") == "view").select(
            F.col("user_id").alias("instance_id"),
            F.col("ts").alias("event_time"),
            "event_id",
            cpu_percent(F.col("value")).alias("total_cpu"),
        )

    def blocking_snapshot(self) -> DataFrame:
        e = self.events
        return e.filter(F.col("event_type") == "error").select(
            F.col("user_id").alias("instance_id"),
            F.col("ts").alias("snapshot_date"),
            "event_id",
            _ms_from_value(F.col("value")).alias("blocked_wait_time"),
            (_props_int(F.col("props")) % 10).alias("blocked_session_count"),
        )

    def waits(self) -> DataFrame:
        e = self.events
        return e.select(
            F.col("user_id").alias("instance_id"),
            F.col("ts").alias("snapshot_date"),
            F.col("event_type").alias("wait_type"),
            F.col("event_type").isin("error", "purchase").alias("is_critical_wait"),
            F.col("value").cast("decimal(18,2)").alias("wait_time_ms"),
            (_props_int(F.col("props")) + 1).alias("sample_ms_diff"),
        )

    def performance_counters(self) -> DataFrame:
        e = self.events
        return e.select(
            F.col("user_id").alias("instance_id"),
            F.col("event_type").alias("counter_name"),
            F.lit("App").alias("object_name"),
            F.lit("").alias("instance_name"),
            F.col("ts").alias("snapshot_date"),
            "event_id",
            F.col("value").cast("decimal(18,2)").alias("value"),
        )

    def running_queries_summary(self) -> DataFrame:
        e = self.events
        k = F.regexp_extract(F.col("props"), "([0-9]+)", 1).cast("bigint")
        fl = F.floor(F.col("value")).cast("bigint")
        return e.filter(F.col("event_type").isin("click", "signup")).select(
            F.col("user_id").alias("instance_id"),
            F.col("ts").alias("snapshot_date"),
            "event_id",
            _ms_from_value(F.col("value")).alias("longest_running_query_ms"),
            (k % 5).alias("tempdb_wait_count"),
            (fl * 50).alias("tempdb_wait_time_ms"),
            (k % 3).alias("critical_wait_count"),
            (fl * 80).alias("critical_wait_time"),
        )

    # -- lineitem / part / customer based facts -------------------------------------------
    def running_queries(self) -> DataFrame:
        li, s = self.lineitem, self.t.supplier
        j = li.join(s, F.col("s_suppkey") == F.col("l_suppkey"))
        price = F.floor(F.col("l_extendedprice")).cast("bigint")
        qty = F.floor(F.col("l_quantity")).cast("bigint")
        return j.select(
            F.col("l_suppkey").alias("instance_id"),
            F.col("s_name").alias("instance_display_name"),
            (F.col("s_acctbal") >= 0).alias("is_active"),
            F.col("l_shipdate").alias("snapshot_date"),
            F.concat(F.lit("h"), F.col("l_partkey").cast("string")).alias("sql_handle"),
            F.col("l_orderkey").alias("session_id"),
            F.when(F.col("l_linestatus") == "O", "running").otherwise("suspended").alias("status"),
            F.col("l_linenumber").alias("open_transaction_count"),
            qty.alias("block_count"),
            (qty * F.col("l_linenumber")).alias("block_count_recursive"),
            price.alias("block_wait_ms"),
            (price * (F.lit(1) + F.col("l_linenumber"))).alias("block_wait_recursive_ms"),
            (qty * 100).alias("duration_ms"),
            (F.col("l_returnflag") == "R").alias("is_root_blocker"),
        )

    def query_texts(self) -> DataFrame:
        """Text of each statement handle; joined only to the rows that are shown."""
        p = self.t.part
        return p.select(F.concat(F.lit("h"), F.col("p_partkey").cast("string")).alias("sql_handle"),
                        F.col("p_name").alias("query_text"))

    def drive_status(self) -> DataFrame:
        """Four drives per instance: the customers of four neighbouring keys."""
        c = self.t.customer
        host = (F.col("c_custkey") - F.col("c_custkey") % 4).cast("bigint")
        free = F.floor(F.col("c_acctbal") + F.lit(1000.0)).cast("bigint")
        return c.select(
            host.alias("instance_id"),
            F.concat(F.lit("Host#"), host.cast("string")).alias("instance_display_name"),
            F.col("c_name").alias("name"),
            F.lit(11000).alias("total_gb"),
            free.alias("free_gb"),
            (free / F.lit(11000.0)).alias("pct_free_space"),
            F.lit(0.1).cast("double").alias("critical_threshold"),
            F.lit(0.2).cast("double").alias("warning_threshold"),
        )

    def db_files(self) -> DataFrame:
        p = self.t.part
        return p.select(
            F.col("p_partkey").alias("file_id"),
            F.col("p_name").alias("file_name"),
            F.col("p_brand").alias("database_name"),
            (F.right("p_brand", F.lit(1)) != "5").alias("database_is_active"),
            (F.col("p_size") % 7 != 0).alias("file_is_active"),
            (F.col("p_partkey") % 100).alias("instance_id"),
            F.floor(F.col("p_retailprice")).cast("bigint").alias("size"),
            (F.col("p_size") % 2).alias("is_percent_growth"),
            F.when(F.col("p_size") % 2 == 1, F.lit(10)).otherwise(F.lit(64)).alias("growth"),
        )

    def db_file_snapshot(self) -> DataFrame:
        li = self.lineitem
        return li.select(
            F.col("l_partkey").alias("file_id"),
            F.col("l_shipdate").alias("snapshot_date"),
            F.floor(F.col("l_quantity") * F.lit(25.0)).cast("bigint").alias("size"),
            "l_orderkey",
            "l_linenumber",
        )
