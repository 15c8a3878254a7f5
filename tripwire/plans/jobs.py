"""Run an alert or report end to end: evaluate, render the outbox, persist state.

    python -m tripwire.plans.jobs <job> <data dir> <output dir> [lookback minutes] [config dir] [tag name] [tag value]

Jobs: blocking (duration, then processes, each followed by the blocker report where the parameter
Reports/TopBlockers/IncludeWithAlert is 1 and blocking was found), blocking-duration,
blocking-processes, cpu, freespace, db-growth, top-blockers-report, top-blockers-alert,
critical-waits, perf-counters, query-summary, long-queries, blocking-multi-tag.
`deliveries <receipts dir> <output dir>` takes a sender's receipts in (sources/deliveries.py).

Outputs: <out>/outbox/run=<n>-<step>, <out>/history/alert=<id> (commits and data), <out>/delays/v=<n>-... (when
each type of list alert was last sent), <out>/deliveries and <out>/event_log (append-only), <out>/pending/v=<n>-... (what
a sender has to try next). The first run of an alert starts from the config's history.
Config and state tables are read from the config folder (sources/config.py); missing ones are seeded.
"""

from __future__ import annotations

import sys
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tripwire.operators import render as rd
from tripwire.operators import routing as rt
from tripwire.plans import alerts as al
from tripwire.plans import tags as tg
from tripwire.plans import wip
from tripwire.plans.context import Run
from tripwire.session import materialized
from tripwire.sources import deliveries as dl
from tripwire.sources import sinks

BLOCKERS = "Top Head Blockers"
ALERT_OF = {"blocking-duration": "Blocking - Duration", "blocking-processes": "Blocking - Processes", "cpu": "High CPU",
            "freespace": "Disk Free Space", "db-growth": "DB Growths", "top-blockers-report": BLOCKERS, "top-blockers-alert": BLOCKERS}
DELAY_MINUTES = 10
RECIPIENTS = "ops@example.com"
SUMMARY = ("@LastMinutes int=15;@LRPThreshold int=60000;@TDBWaitCountThreshold int=10;@TDBWaitTimeThreshold int=10000;"
           "@CriticalWaitCountThreshold int=10;@CriticalWaitTimeThreshold int=10000")


def evaluate(run: Run, alert: str, minutes: int | None = None, history: DataFrame | None = None,
             tag: tuple[str, str] | None = None) -> al.AlertOutput:
    """One routed alert or report. Unknown tags are an error, not an empty result."""
    tg.check_tag(run.tm.instance_tags(), *(tag or (None, None)))
    given = lambda default: default if minutes is None else minutes
    if alert == "blocking-duration":
        return al.alert_blocking(run, "duration", given(3), tag, history)
    if alert == "blocking-processes":
        return al.alert_blocking(run, "processes", given(3), tag, history)
    if alert == "cpu":
        return al.alert_cpu(run, given(2), tag, history)
    if alert == "freespace":
        return al.alert_freespace(run, tag, history)
    if alert == "db-growth":
        return al.alert_db_growth(run, given(60), history)
    if alert == "top-blockers-report":
        return al.report_top_blockers(run, "Report", history=history)
    if alert == "top-blockers-alert":
        return al.report_top_blockers(run, "Alert", history=history)
    raise KeyError(alert)


def list_alert(run: Run, alert: str, delays: DataFrame, minutes: int | None = None, tags: str | None = None,
               tag: tuple[str, str] | None = None, thresholds: str | None = None) -> tuple[DataFrame, str | None]:
    """(messages, delay type to mark as sent) of the alerts that send plain lists."""
    tg.check_tag(run.tm.instance_tags(), *(tag or (None, None)))
    given = lambda default: default if minutes is None else minutes
    if alert == "critical-waits":
        rows = run.keep(wip.critical_wait_rates(run, given(5), 1000, tag)).withColumn("alert_type", F.lit("CriticalWait"))
        rows = wip.delay_gate(rows, delays, "alert_type", run.now, DELAY_MINUTES)
        return wip.critical_wait_messages(rows, given(5), 1000, DELAY_MINUTES, RECIPIENTS), "CriticalWait"
    if alert == "perf-counters":
        rows = run.keep(wip.counter_breaches(run, run.cfg.counter_rules, given(10), 3, tag)).withColumn("alert_type", F.lit("PerformanceCounterAlert"))
        rows = wip.delay_gate(rows, delays, "alert_type", run.now, DELAY_MINUTES)
        return wip.counter_messages(rows, 3, RECIPIENTS), "PerformanceCounterAlert"
    if alert == "query-summary":
        rows = wip.alert_query_summary(run, thresholds or SUMMARY, tag=tag)
        return wip.listing(rows, F.concat_ws(" ", "instance", "counter"), "Query summary", "Running queries:", "", RECIPIENTS), None
    if alert == "long-queries":
        rows = wip.long_queries_now(run, given(2))
        return wip.listing(rows, F.concat_ws(" ", "instance", F.col("counter").cast("string"), F.lit("ms")), "Long queries",
                           "Queries run longer than the limit on:", "", RECIPIENTS), None
    if alert == "blocking-multi-tag":
        rows = wip.blocking_multi_tag(run, tags, given(15))
        over = ((F.col("blocked_wait_time") > F.col("threshold_duration").try_cast("int"))
                | (F.col("blocked_session_count") > F.col("threshold_processes").try_cast("int")))
        rows = rows.filter(over).groupBy("instance").agg(F.max("blocked_wait_time").alias("w"), F.max("blocked_session_count").alias("n"))
        item = F.concat_ws(" ", "instance", F.col("w").cast("string"), F.lit("ms,"), F.col("n").cast("string"), F.lit("blocked"))
        return wip.listing(rows, item, "Blocking (tags)", "Blocking above the limit of a matching tag on:", "", RECIPIENTS), None
    raise KeyError(alert)


def _outbox(run: Run, messages: DataFrame) -> DataFrame:
    view = rt.all_alerts_view(run.cfg.alerts, run.cfg.environment, run.cfg.overrides, run.cfg.levels, run.cfg.webhooks)
    return rd.outbox(messages, view, run.cfg.blackouts, run.now)


def _routed(run: Run, alert: str, out: str, version: str, minutes: int | None, tag) -> tuple[dict, bool]:
    """Run one routed alert; (paths, whether it found anything)."""
    aid = run.cfg.alert(ALERT_OF[alert])["alert_id"]
    stored = sinks.alert_history(run.spark, f"{out}/history", aid)
    prev = stored if stored is not None else run.cfg.history.filter(F.col("alert_id") == aid)
    res = evaluate(run, alert, minutes, prev, tag)
    paths = {"outbox": sinks.write_outbox(_outbox(run, res.messages), f"{out}/outbox", f"{version}-{alert}", run.now),
             "history": sinks.commit_alert_history(run.spark, f"{out}/history", aid, prev, res.change)}
    return paths, not res.rows.isEmpty()


def run_job(spark: SparkSession, alert: str, sf_dir: str, out: str, minutes: int | None = None, config=None,
            tag: tuple[str, str] | None = None, now=None, tags: str | None = None, thresholds: str | None = None) -> dict:
    """Run a job; returns the paths written, by step for the chained job."""
    run = Run(spark, sf_dir, now=now, config=config, reuse=True)
    version = f"{len(sinks.folders(spark, f'{out}/outbox', 'run=', complete=False)) + 1:09d}-{uuid.uuid4().hex[:8]}"
    if alert in ALERT_OF:
        return _routed(run, alert, out, version, minutes, tag)[0]
    if alert == "blocking":
        done = {}
        include = (run.cfg.param("Reports/TopBlockers/IncludeWithAlert", "0") or "0").strip() == "1"
        for i, step in enumerate(("blocking-duration", "blocking-processes")):
            if step == "blocking-processes" and run.cfg.alerts.filter(F.col("alert_name") == ALERT_OF[step]).isEmpty():
                break
            done[step], found = _routed(run, step, out, f"{version}-{i}", minutes, tag)
            if found and include:
                done[f"{step}/top-blockers-alert"] = _routed(run, "top-blockers-alert", out, f"{version}-{i}b", None, None)[0]
        return done
    stored = sinks.latest(spark, f"{out}/delays")
    delays = run.cfg.delay_by_type if stored is None else stored
    messages, kind = list_alert(run, alert, delays, minutes, tags, tag, thresholds)
    messages = run.keep(messages)
    paths = {"outbox": sinks.write_outbox(_outbox(run, messages), f"{out}/outbox", f"{version}-{alert}", run.now)}
    if kind is not None and not messages.isEmpty():
        paths["delays"] = sinks.write_snapshot(wip.mark_sent(delays, kind, run.now), f"{out}/delays")
    return paths


def run_deliveries(spark: SparkSession, out: str, receipts: DataFrame | None = None, since=None, max_attempts: int = 3) -> dict:
    """Log a sender's receipts, add failed webhook tries to the event log, list what is to be sent; returns the paths.

    `since` (a date) leaves out messages of older evaluations. Run again with the same receipts it adds nothing, and a run
    that died between the two logs is made whole by the next one with these receipts."""
    paths = {"deliveries": f"{out}/deliveries", "event_log": f"{out}/event_log"}
    messages = dl.stored_messages(spark, out, since)
    if messages is None:
        return paths
    if receipts is not None:
        entries = materialized(dl.log_entries(messages, receipts))
        dl.append_once(entries, paths["deliveries"], dl.TRY)
        dl.append_once(dl.failure_events(entries), paths["event_log"], dl.TRY)
    log = dl.appended(spark, paths["deliveries"])
    if log is not None and since is not None:
        log = log.filter(F.col("day") >= F.lit(since))
    paths["pending"] = sinks.write_snapshot(dl.pending(messages, log, max_attempts), f"{out}/pending")
    return paths


if __name__ == "__main__":
    from tripwire.session import get_spark

    job, data, target, *more = sys.argv[1:]
    if job == "deliveries":
        spark = get_spark()
        print(run_deliveries(spark, target, spark.read.parquet(data)))
        sys.exit()
    more += [None] * (4 - len(more))
    print(run_job(get_spark(), job, data, target, None if more[0] is None else int(more[0]), more[1],
                  (more[2], more[3]) if more[2] else None))
