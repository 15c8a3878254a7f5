"""The work-in-progress alerts: critical waits, performance counters, running-query summary,
long-running queries, multi-tag blocking, and the per-type delay gate.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from tripwire.functions import text as tx
from tripwire.operators import params as pm
from tripwire.operators import routing as rt
from tripwire.operators import select as sel
from tripwire.operators import thresholds as th
from tripwire.plans import alerts as al
from tripwire.plans.context import Run


def delay_gate(df: DataFrame, delays: DataFrame, alert_type_col: str, as_of: dt.datetime, delay_minutes: int) -> DataFrame:
    """Drop the rows of alert types whose last alert was sent less than `delay` minutes ago.

    A type without a row counts as never sent (seeded as 1900-01-01)."""
    recent = delays.filter(F.col("alert_sent_date") > F.lit(as_of - dt.timedelta(minutes=delay_minutes)).cast("timestamp_ntz"))
    return df.join(F.broadcast(recent.select(F.col("alert_type").alias(alert_type_col))), alert_type_col, "left_anti")


def mark_sent(delays: DataFrame, alert_type: str, as_of: dt.datetime) -> DataFrame:
    """The delay table after an alert of this type was sent at `as_of` (its row is added when missing)."""
    sent = delays.sparkSession.range(1).select(F.lit(alert_type).alias("alert_type"), F.lit(as_of).cast("timestamp_ntz").alias("alert_sent_date"))
    return delays.filter(~F.col("alert_type").eqNullSafe(F.lit(alert_type))).select("alert_type", "alert_sent_date").unionByName(sent)


def listing(rows: DataFrame, item: Column, alert_name: str, intro: str, outro: str, recipients: str) -> DataFrame:
    """Plain list messages (one line per row, in bounded parts) for alerts without routing config."""
    lines = rows.select("instance", F.concat(F.lit("* "), item, F.lit("\n")).alias("_line"))
    m = rt.route_by_audience(lines, "instance", F.col("_line"), keys=[], order_col="_line", distinct_names=True)
    none = F.lit(None).cast("string")
    return m.select(F.lit(alert_name).alias("alert_name"), F.lit(255).alias("alert_type"), F.lit(recipients).alias("audience"),
                    F.lit(f"{intro}\n##TABLE##{outro}").alias("email_alert_template"), none.alias("webhook"),
                    none.alias("webhook_alert_template"), "instances", "table_html", "n_rows", F.lit(alert_name).alias("subject"))


def critical_wait_messages(rates: DataFrame, minutes: int, threshold: int, delay: int, recipients: str) -> DataFrame:
    item = F.concat_ws(" ", "instance", "wait_type", tx.fmt_n(F.col("wait_ms_per_sec"), 1), F.lit("ms/sec"))
    return listing(rates, item, "Critical waits", "Waits above the limit on:",
                   f"Limit: {threshold:,.1f} ms/sec over {minutes} minutes. Next alert not before {delay} minutes.", recipients)


def counter_messages(breaches: DataFrame, k: int, recipients: str) -> DataFrame:
    item = F.concat(F.col("instance"), F.lit(" "), F.col("counter"), F.lit(": "), F.col("current_value").cast("string"))
    return listing(breaches, item, "Performance counters",
                   f"Counters inside their alert band in each of the last {k} collections:", "", recipients)


# ---------------------------------------------------------------------------------------
# critical waits: weighted wait rate per (instance, wait type)
# ---------------------------------------------------------------------------------------
def critical_wait_rates(run: Run, minutes: int = 5, threshold: int = 1000,
                        tag: tuple[str, str] | None = None) -> DataFrame:
    """sum(wait ms) * 1000 / sum(sample ms) per (instance, wait type) above `threshold` ms/sec.

    Sums stay exact (decimal cents, bigint samples); the rate is compared exactly and
    reported truncated to 3 decimals.
    """
    w = sel.window_half_open(run.tm.waits(), "snapshot_date", run.now - dt.timedelta(minutes=minutes),
                             run.now + dt.timedelta(minutes=1)).filter(F.col("is_critical_wait"))
    inst = run.targets(tag)
    w = w.join(inst.select("instance_id", F.col("instance_display_name").alias("instance")), "instance_id")
    g = w.groupBy("instance", "wait_type").agg(
        (F.sum("wait_time_ms") * F.lit(100)).cast("bigint").alias("cents"),
        F.sum("sample_ms_diff").cast("bigint").alias("samples"))
    g = g.filter(F.col("cents") * F.lit(10) > F.lit(threshold) * F.col("samples"))
    milli = F.expr("(cents * 10000) div samples")
    return g.select("instance", "wait_type",
                    (milli.cast("decimal(38,0)") / F.lit(1000)).cast("decimal(20,3)").alias("wait_ms_per_sec"))


# ---------------------------------------------------------------------------------------
# performance counters: banded thresholds, last k collections all in breach
# ---------------------------------------------------------------------------------------
def counter_targets(run: Run, rules: DataFrame, tag: tuple[str, str] | None = None) -> DataFrame:
    """Counter samples of active instances matched to rules (NULL rule instance = any)."""
    r = rules.select(F.col("object_name").alias("r_object"), F.col("counter_name").alias("r_counter"),
                     F.col("instance_name").alias("r_instance"), "threshold_from", "threshold_to")
    pc = run.tm.performance_counters()
    cond = ((F.col("object_name") == F.col("r_object")) & (F.col("counter_name") == F.col("r_counter"))
            & ((F.col("instance_name") == F.col("r_instance")) | F.col("r_instance").isNull()))
    inst = run.targets(tag)
    inst = inst.filter(F.col("is_active")).select("instance_id", "connection_id")
    j = pc.join(F.broadcast(r), cond).join(inst, "instance_id")
    return j.withColumn("counter", tx.counter_path(F.col("object_name"), F.col("counter_name"), F.col("instance_name")))


def counter_breaches(run: Run, rules: DataFrame, minutes: int = 10, k: int = 3,
                     tag: tuple[str, str] | None = None, require_all: bool = True) -> DataFrame:
    """(instance, counter, current value) where each of the last k samples is inside the band."""
    t = counter_targets(run, rules, tag)
    t = sel.window_half_open(t, "snapshot_date", run.now - dt.timedelta(minutes=minutes), run.now)
    last = sel.last_k_per_key(t, ["instance_id", "counter"], ["snapshot_date", "event_id"], k)
    inband = th.band_check(F.col("value"), F.col("threshold_from"), F.col("threshold_to"))
    g = last.filter(inband).groupBy(F.col("connection_id").alias("instance"), "counter").agg(
        F.count(F.lit(1)).alias("n_breaching"),
        F.max(F.when(F.col("rn") == 1, F.col("value"))).cast("decimal(28,9)").alias("current_value"))
    if require_all:
        g = g.filter(F.col("n_breaching") == k)
    return g


# ---------------------------------------------------------------------------------------
# running-query summary: masked multi-metric statistics per instance
# ---------------------------------------------------------------------------------------
SUMMARY_METRICS = [  # (column, threshold name, label, unit)
    ("longest_running_query_ms", "LRPThreshold", "LongQueries", "ms"),
    ("tempdb_wait_count", "TDBWaitCountThreshold", "TempDBWaitCount", ""),
    ("tempdb_wait_time_ms", "TDBWaitTimeThreshold", "TempDBWaitTime", "ms"),
    ("critical_wait_count", "CriticalWaitCountThreshold", "CriticalWaitCount", ""),
    ("critical_wait_time", "CriticalWaitTimeThreshold", "CriticalWaitTime", "ms"),
]


def summary_masked(run: Run, thresholds: str, tag: tuple[str, str] | None = None) -> DataFrame:
    """Summary rows after the instance's last collection minus N minutes, metrics not above
    their threshold set to NULL, rows with no surviving metric dropped."""
    kv = pm.parse_thresholds(thresholds)
    minutes = int(kv.get("LastMinutes", 15))
    rqs = run.tm.running_queries_summary()
    inst = run.targets(tag).select("instance_id")
    anchors = run.tm.summary_anchors().join(inst, "instance_id", "left_semi")
    near = sel.anchor_lookback(rqs, anchors, "instance_id", "snapshot_date", "anchor", minutes, strict=True)
    masked = [F.when(F.col(c) > F.lit(int(kv[t])), F.col(c)).alias(c) for c, t, _, _ in SUMMARY_METRICS]
    m = near.select("instance_id", "snapshot_date", "event_id", *masked)
    any_left = sum((F.coalesce(F.col(c), F.lit(0)) for c, _, _, _ in SUMMARY_METRICS), F.lit(0)) > 0
    return m.filter(any_left)


def summary_stats(masked: DataFrame) -> DataFrame:
    aggs = []
    for c, _, _, _ in SUMMARY_METRICS:
        aggs += [F.count(c).alias(f"n_{c}"), F.coalesce(F.max(c), F.lit(0)).alias(f"max_{c}"),
                 F.coalesce(F.min(c), F.lit(0)).alias(f"min_{c}"),
                 F.coalesce(tx.int_avg(F.sum(c), F.count(c)), F.lit(0)).alias(f"avg_{c}")]
    return masked.groupBy("instance_id").agg(*aggs)


def summary_text(stats: DataFrame) -> DataFrame:
    parts = []
    for i, (c, _, label, unit) in enumerate(SUMMARY_METRICS):
        if i:
            parts.append(F.lit("<br/>"))
        parts += [F.lit(f"{label}:"), F.col(f"n_{c}"), F.lit("(M:"), F.col(f"max_{c}"), F.lit(f"{unit}; m:"),
                  F.col(f"min_{c}"), F.lit(f"{unit}; A:"), F.col(f"avg_{c}"), F.lit(f"{unit})")]
    return stats.select("instance_id", F.concat(*[p.cast("string") for p in parts]).alias("counter"))


def alert_query_summary(run: Run, thresholds: str, alert_id: int = 10, tag: tuple[str, str] | None = None) -> DataFrame:
    txt = summary_text(summary_stats(summary_masked(run, thresholds, tag)))
    inst = run.instances.filter(F.col("is_active")).select("instance_id", F.col("instance_display_name").alias("instance"))
    return txt.join(inst, "instance_id").select(F.lit(alert_id).alias("alert_id"), "instance_id", "instance", "counter")


# ---------------------------------------------------------------------------------------
# long-running queries (latest summary per instance vs threshold)
# ---------------------------------------------------------------------------------------
def _near_summary(run: Run, anchor_minutes: int) -> DataFrame:
    """Summary rows of active instances near their last collection."""
    inst = run.instances.filter(F.col("is_active")).select("instance_id", F.col("instance_display_name").alias("instance"))
    anchors = run.tm.summary_anchors().join(inst.select("instance_id"), "instance_id", "left_semi")
    near = sel.anchor_lookback(run.tm.running_queries_summary(), anchors, "instance_id", "snapshot_date", "anchor", anchor_minutes)
    return near.join(inst, "instance_id")


def long_queries(run: Run, anchor_minutes: int = 2, threshold: int = 100000) -> DataFrame:
    """Per active instance: the latest summary row over the threshold near its last collection and the
    number of such rows in that window (count next to latest, as an aggregate)."""
    near = _near_summary(run, anchor_minutes).filter(F.col("longest_running_query_ms") > threshold)
    return near.groupBy("instance_id", "instance").agg(
        F.max_by("longest_running_query_ms", F.struct("snapshot_date", "event_id")).alias("counter"),
        F.count(F.lit(1)).alias("metric"))


LONG_QUERY_LIMITS = "Blocking - Duration"  # its limits, in milliseconds too, stand for long queries unless another alert is named


def long_queries_now(run: Run, anchor_minutes: int = 2, threshold: int | None = None, alert: str = LONG_QUERY_LIMITS) -> DataFrame:
    """Active instances whose latest summary row near the last collection is over the threshold; one
    that has recovered since does not alert. The threshold is resolved per instance (overrides, then the alert's
    default) unless one is given."""
    latest = _near_summary(run, anchor_minutes).groupBy("instance_id", "instance").agg(
        F.max_by("longest_running_query_ms", F.struct("snapshot_date", "event_id")).alias("counter"))
    if threshold is not None:
        return latest.filter(F.col("counter") > threshold)
    limits = th.resolve_threshold(latest, run.cfg.overrides, run.cfg.alerts, run.cfg.alert(alert)["alert_id"])
    return th.threshold_breach(limits, "counter").select("instance_id", "instance", "counter")


# ---------------------------------------------------------------------------------------
# blocking for any of several tags, thresholds per matched tag
# ---------------------------------------------------------------------------------------
def blocking_multi_tag(run: Run, tags: str | None, minutes: int = 15) -> DataFrame:
    cur = al.blocking_latest(run, minutes)
    it = run.tm.instance_tags()
    if tags is None:
        j = cur.withColumn("tag_name", F.lit(None).cast("string")).withColumn("tag_value", F.lit(None).cast("string"))
    else:
        pairs = run.spark.range(1).select(F.explode(pm.tag_pairs(F.lit(tags))).alias("p")).select(
            F.lower("p.tag_name").alias("_n"), F.lower("p.tag_value").alias("_v"))
        hit = it.join(F.broadcast(pairs), (F.lower("tag_name") == F.col("_n")) & (F.lower("tag_value") == F.col("_v")))
        j = cur.join(hit.select("instance_id", "tag_name", "tag_value"), "instance_id")
    j = th.resolve_threshold_per_tag(j, run.cfg.overrides, run.cfg.alerts, 1, out="threshold_duration")
    j = th.resolve_threshold_per_tag(j, run.cfg.overrides, run.cfg.alerts, 2, out="threshold_processes")
    return j.select("instance_id", "instance", "blocked_wait_time", "blocked_session_count", "tag_name", "tag_value",
                    "threshold_duration", "threshold_processes").distinct()
