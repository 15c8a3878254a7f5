"""Registered queries: each takes a `Run` and returns a DataFrame.

Parameters used on the test data: event-based lookbacks are days rather than minutes (the
test event log is sparse), and they are explicit arguments of the jobs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from tripwire.operators import select as sel
from tripwire.operators import thresholds as th
from tripwire.plans.context import Run
from tripwire.plans.tags import matching_instances

REGISTRY: dict[str, Callable[[Run], DataFrame]] = {}

WEEK_MIN = 7 * 24 * 60
YEAR_MIN = 365 * 24 * 60


def query(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


# ---------------------------------------------------------------------------------------
# minimum slice
# ---------------------------------------------------------------------------------------
@query("latest_per_key")
def q_latest_per_key(run: Run) -> DataFrame:
    return al.blocking_latest(run, WEEK_MIN).select(
        "instance_id", "instance", "snapshot_date", "blocked_wait_time", "blocked_session_count")


@query("resolve_threshold")
def q_resolve_threshold(run: Run) -> DataFrame:
    tagged = matching_instances(run.instances, run.tm.instance_tags(), "segment", "BUILDING")
    a = th.resolve_threshold(tagged.select("instance_id"), run.cfg.overrides, run.cfg.alerts, 1,
                             "segment", "BUILDING").withColumn("alert_id", F.lit(1))
    b = th.resolve_threshold(run.instances.select("instance_id"), run.cfg.overrides, run.cfg.alerts, 3
                             ).withColumn("alert_id", F.lit(3))
    return a.unionByName(b).select("alert_id", "instance_id", "threshold")


@query("threshold_breach")
def q_threshold_breach(run: Run) -> DataFrame:
    b = th.resolve_threshold(al.blocking_latest(run, WEEK_MIN), run.cfg.overrides, run.cfg.alerts, 1)
    b = th.threshold_breach(b, "blocked_wait_time")
    return b.select("instance_id", "instance", "blocked_wait_time", F.col("threshold").cast("int").alias("threshold"))


# ---------------------------------------------------------------------------------------
# composite alerts (test parameters: lookbacks widened to the sparse test event log)
# ---------------------------------------------------------------------------------------
from tripwire.plans import alerts as al  # noqa: E402
from tripwire.operators import render as rd  # noqa: E402
from tripwire.operators import routing as rt  # noqa: E402
from tripwire.operators import state as st  # noqa: E402
from tripwire.functions import text as tx  # noqa: E402

MSG_COLS = ["alert_name", "alert_type", "audience", "email_alert_template", "webhook", "webhook_alert_template",
            "instances", "table_html", "n_rows", "subject"]


@query("alert_blocking_duration")
def q_alert_blocking_duration(run: Run) -> DataFrame:
    return al.alert_blocking(run, "duration", WEEK_MIN).messages.select(*MSG_COLS)


@query("alert_blocking_processes")
def q_alert_blocking_processes(run: Run) -> DataFrame:
    return al.alert_blocking(run, "processes", WEEK_MIN).messages.select(*MSG_COLS)


@query("alert_cpu")
def q_alert_cpu(run: Run) -> DataFrame:
    return al.alert_cpu(run, 2).messages.select(*MSG_COLS)


@query("alert_freespace")
def q_alert_freespace(run: Run) -> DataFrame:
    return al.alert_freespace(run).messages.select(*MSG_COLS)


@query("alert_db_growth")
def q_alert_db_growth(run: Run) -> DataFrame:
    return al.alert_db_growth(run, YEAR_MIN).messages.select(*MSG_COLS)


@query("report_top_blockers")
def q_report_top_blockers(run: Run) -> DataFrame:
    return al.report_top_blockers(run, "Report").messages.select(*MSG_COLS)


@query("alert_top_blockers")
def q_alert_top_blockers(run: Run) -> DataFrame:
    return al.report_top_blockers(run, "Alert").messages.select(*MSG_COLS)


@query("history_upsert")
def q_history_upsert(run: Run) -> DataFrame:
    return al.alert_blocking(run, "duration", WEEK_MIN).history


@query("history_state_write")
def q_history_state_write(run: Run) -> DataFrame:
    return al.alert_cpu(run, 2).history


@query("notification_outbox")
def q_notification_outbox(run: Run) -> DataFrame:
    msgs = al.alert_blocking(run, "duration", WEEK_MIN).messages.unionByName(al.alert_cpu(run, 2).messages)
    view = rt.all_alerts_view(run.cfg.alerts, run.cfg.environment, run.cfg.overrides, run.cfg.levels, run.cfg.webhooks)
    return rd.outbox(msgs, view, run.cfg.blackouts, run.now)


# ---------------------------------------------------------------------------------------
# 2.1 sources and sinks
# ---------------------------------------------------------------------------------------
from tripwire.operators import params as pm  # noqa: E402
from tripwire.plans.tags import tag_filter  # noqa: E402
from tripwire.session import materialized  # noqa: E402
from tripwire.sources import deliveries as dl  # noqa: E402

DAY = 24 * 60


@query("inline_values")
def q_inline_values(run: Run) -> DataFrame:
    """CPU samples per weekday, labelled through an inline VALUES table of day names."""
    per_day = run.tm.cpu().groupBy((F.weekday("event_time") + 1).alias("day_code")).agg(
        F.count(F.lit(1)).alias("n_samples"), F.max("total_cpu").alias("max_cpu"))
    return per_day.join(F.broadcast(run.cfg.day_names), "day_code").select(
        "day_code", "day_name", "n_samples", "max_cpu")


@query("param_lookup")
def q_param_lookup(run: Run) -> DataFrame:
    """Root-blocker samples per instance above the configured minimum wait (default when absent)."""
    mw = pm.param_value(run.cfg.parameters, "Reports/TopBlockers/MinBlockedWaitTimeMs", "10000")
    top = pm.param_value(run.cfg.parameters, "Reports/TopBlockers/NotConfigured", "5")
    p = mw.select(F.col("value").try_cast("bigint").alias("min_wait")).crossJoin(
        top.select(F.col("value").try_cast("int").alias("fallback_n")))
    rq = run.tm.running_queries().filter(F.col("is_root_blocker"))
    j = rq.crossJoin(F.broadcast(p)).filter(F.col("block_wait_recursive_ms") > F.col("min_wait"))
    return j.groupBy("instance_id", "min_wait", "fallback_n").agg(F.count(F.lit(1)).alias("n_over"))


@query("seed_insert_missing")
def q_seed_insert_missing(run: Run) -> DataFrame:
    """Seed a default CPU history row (status OFF) for every active instance that has none."""
    hist = run.cfg.history.withColumn("_k", F.lower("instance"))
    seeds = run.instances.filter(F.col("is_active")).select(
        F.col("instance_display_name").alias("instance"), F.lit(3).alias("alert_id"),
        F.lit(None).cast("timestamp_ntz").alias("last_occurrence"), F.lit(None).cast("string").alias("last_value"),
        F.lit("OFF").alias("status"), F.lower("instance_display_name").alias("_k"))
    return st.insert_missing(hist, seeds, ["_k", "alert_id"]).drop("_k")


@query("seed_upsert_params")
def q_seed_upsert_params(run: Run) -> DataFrame:
    """MERGE new CPU overrides: insert missing, update the audience only when it differs."""
    target = run.cfg.overrides.filter(F.col("alert_id") == 3)
    iid = F.col("instance_id")
    src = run.instances.filter(iid % 4 == 0).select(
        (F.lit(300000) + iid).cast("int").alias("override_id"), F.lit(3).alias("alert_id"),
        F.lit(None).cast("string").alias("webhook_alert_template"), F.lit(None).cast("string").alias("email_alert_template"),
        F.lit(None).cast("short").alias("alert_level"), F.lit("cpu-oncall@example.com").alias("audience"),
        F.lit(True).alias("override_audience"), F.lit(None).cast("string").alias("emoji"),
        F.lit(None).cast("string").alias("webhook"), F.lit(None).cast("string").alias("tag_name"),
        F.lit(None).cast("string").alias("tag_value"), iid.alias("instance_id"), F.lit("45").alias("threshold"))
    return st.merge_upsert(target, src, ["override_id"], ["audience"])


@query("event_log_append")
def q_event_log_append(run: Run) -> DataFrame:
    """ERROR events for failed deliveries, read from the event log: an event is one delivery to its
    user's endpoint, an `error` event a failed one; `props` is the endpoint's answer."""
    ev = run.tm.events.filter(F.col("event_type").isin("error", "purchase"))
    deliveries = ev.select(
        F.lit("Blocking - Duration").alias("alert_name"), F.col("ts").alias("delivered_at"),
        F.when(F.col("event_type") == "error", F.lit("Status: 500 (Internal Server Error)")).otherwise(F.lit(rd.OK_STATUS)).alias("status"),
        F.col("props").alias("response"), F.concat(F.lit('{"text":"user '), F.col("user_id"), F.lit('"}')).alias("body"))
    return rd.failed_delivery_events(deliveries)


@query("delivery_log")
def q_delivery_log(run: Run) -> DataFrame:
    """Delivery state of every message, after its receipts were logged in two runs of which the second repeats the first.

    Stand-in input: a message per user and day, an event as the receipt of a try (numbered by its hour), failed if an
    `error` event; `props` is the answer."""
    ev = run.tm.events.filter(F.col("event_type").isin("error", "purchase"))
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    text = lambda s: F.lit(s).cast("string")
    said = ev.select(
        text("Blocking - Duration").alias("alert_name"), F.lit(1).alias("alert_type"), text("webhook").alias("channel"),
        text(None).alias("audience"), F.concat(F.lit("https://hooks.example.com/"), "user_id").alias("recipient"),
        text(None).alias("subject"), F.concat(F.lit('{"text":"user '), "user_id", F.lit('"}')).alias("body"),
        F.col("user_id").cast("string").alias("instances"), day.alias("run_at"), F.lit(True).alias("send"))
    messages = dl.with_message_id(said)
    tries = ev.select(
        F.concat(F.lit("https://hooks.example.com/"), "user_id").alias("recipient"), day.alias("run_at"),
        (F.hour("ts") + 1).alias("attempt"), F.col("ts").alias("delivered_at"),
        F.when(F.col("event_type") == "error", F.lit("Status: 500 (Internal Server Error)")).otherwise(F.lit(rd.OK_STATUS)).alias("status"),
        F.col("props").alias("response"))
    receipts = tries.join(messages.select("recipient", "run_at", "message_id"), ["recipient", "run_at"])
    base = sj.run_folder(run.spark, "deliveries")
    entries = materialized(dl.log_entries(messages, receipts))
    dl.append_once(entries.filter(F.dayofmonth("day") <= 15), base, dl.TRY)
    dl.append_once(entries, base, dl.TRY)
    return dl.delivery_status(messages, dl.appended(run.spark, base), max_attempts=2).select(
        "alert_name", "recipient", "run_at", "attempts", "failed", "delivered", "last_response", "next_attempt")


@query("json_properties")
def q_json_properties(run: Run) -> DataFrame:
    """JSON text of every event parsed by path; text that is no JSON counts as such."""
    doc = F.col("props")
    e = run.tm.events.select("event_type", F.get_json_object(doc, "$.k").try_cast("int").alias("k"),
                             F.get_json_object(doc, "$").isNotNull().alias("is_json"))
    return e.groupBy("event_type").agg(F.count_if("is_json").alias("n_json"), F.count("k").alias("n_k"), F.sum("k").alias("sum_k"),
                                       F.count_distinct("k").alias("n_distinct"))


# ---------------------------------------------------------------------------------------
# 2.2 projections, filters, predicates
# ---------------------------------------------------------------------------------------
@query("filter_active")
def q_filter_active(run: Run) -> DataFrame:
    inst = run.instances.filter(F.col("is_active")).select("instance_id")
    files = run.tm.db_files().filter(F.col("database_is_active") & F.col("file_is_active"))
    return files.join(inst, "instance_id").groupBy("instance_id").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("total_pages"))


@query("lookback_now")
def q_lookback_now(run: Run) -> DataFrame:
    b = sel.lookback(run.tm.blocking_snapshot(), "snapshot_date", run.now, 3 * DAY)
    return b.select("instance_id", "snapshot_date", "event_id", "blocked_wait_time")


@query("window_half_open")
def q_window_half_open(run: Run) -> DataFrame:
    import datetime as _dt
    w = sel.window_half_open(run.tm.waits(), "snapshot_date", run.now - _dt.timedelta(days=5),
                             run.now + _dt.timedelta(minutes=1))
    return w.groupBy("wait_type").agg(F.count(F.lit(1)).alias("n"), F.sum("wait_time_ms").alias("total_wait_ms"))


@query("optional_predicate")
def q_optional_predicate(run: Run) -> DataFrame:
    rq = run.tm.running_queries().filter(F.col("is_root_blocker"))

    def variant(min_wait):
        r = rq if min_wait is None else rq.filter(F.col("block_wait_recursive_ms") > min_wait)
        return r.groupBy("instance_id").agg(F.count(F.lit(1)).alias("n")).withColumn(
            "min_wait", F.lit(min_wait).cast("bigint"))
    return variant(None).unionByName(variant(50000))


@query("tag_target_resolve")
def q_tag_target_resolve(run: Run) -> DataFrame:
    m = matching_instances(run.instances, run.tm.instance_tags(), "Nation", "nation_3")
    return m.select("instance_id", "instance_display_name")


@query("band_check")
def q_band_check(run: Run) -> DataFrame:
    v = F.col("value")
    n = F.lit(None).cast("decimal(28,9)")
    d = lambda x: F.lit(x).cast("decimal(28,9)")
    return run.tm.performance_counters().groupBy("counter_name").agg(
        F.count_if(th.band_check(v, d(5), n)).alias("n_from_5"),
        F.count_if(th.band_check(v, n, d(3))).alias("n_to_3"),
        F.count_if(th.band_check(v, d(10), d(40))).alias("n_10_40"),
        F.count(F.lit(1)).alias("n"))


@query("pages_to_mb")
def q_pages_to_mb(run: Run) -> DataFrame:
    return al.growth_rows(run, YEAR_MIN)


@query("flag_label")
def q_flag_label(run: Run) -> DataFrame:
    return run.tm.db_files().groupBy(tx.flag_label(F.col("is_percent_growth")).alias("is_percent_growth")).agg(
        F.count(F.lit(1)).alias("n_files"))


@query("state_action")
def q_state_action(run: Run) -> DataFrame:
    return al.alert_cpu(run, 2).rows.select("instance_id", "instance", "counter", "threshold", "status", "action")


@query("audience_merge")
def q_audience_merge(run: Run) -> DataFrame:
    o = run.cfg.overrides.filter(F.col("instance_id").isNotNull())
    a = run.cfg.alerts.select(F.col("alert_id").alias("_aid"), F.col("audience").alias("_default"))
    j = o.join(F.broadcast(a), F.col("alert_id") == F.col("_aid"))
    return j.select("alert_id", "instance_id",
                    rt.merge_audience(F.col("_default"), F.col("audience"), F.col("override_audience")).alias("audience"))


@query("computed_columns")
def q_computed_columns(run: Run) -> DataFrame:
    """Webhook computed columns (sender name, webhook id) for each webhook delivery of the outbox."""
    ob = q_notification_outbox(run).filter(F.col("channel") == "webhook")
    wh = run.cfg.webhooks.select(F.col("webhook").alias("recipient"), "username", "webhook_id")
    return ob.join(F.broadcast(wh), "recipient", "left").select(
        "alert_name", "audience", "recipient", "username", "webhook_id")


# ---------------------------------------------------------------------------------------
# 2.3 joins
# ---------------------------------------------------------------------------------------
@query("join_inner_chain")
def q_join_inner_chain(run: Run) -> DataFrame:
    inst = run.instances.filter(F.col("is_active")).select("instance_id", F.col("instance_display_name").alias("instance"))
    files = run.tm.db_files()
    dbs = files.select("instance_id", "database_name").distinct()
    return inst.join(dbs, "instance_id").join(files, ["instance_id", "database_name"]).select(
        "instance", "database_name", "file_name", "size")


@query("join_anchor_lookback")
def q_join_anchor_lookback(run: Run) -> DataFrame:
    anchors = run.tm.collection_dates().filter(F.col("reference") == "view")
    j = sel.anchor_lookback(run.tm.cpu(), anchors, "instance_id", "event_time", "snapshot_date", 2 * DAY)
    return j.select("instance_id", "event_time", "event_id", "total_cpu", F.col("_anchor").alias("anchor"))


@query("join_exact_snapshot")
def q_join_exact_snapshot(run: Run) -> DataFrame:
    anchors = run.tm.collection_dates().filter(F.col("reference") == "error")
    return sel.exact_snapshot(run.tm.blocking_snapshot(), anchors, "instance_id", "snapshot_date", "snapshot_date")


@query("asof_first_in_window")
def q_asof_first_in_window(run: Run) -> DataFrame:
    import datetime as _dt
    return sel.first_in_window(run.tm.db_file_snapshot(), "file_id", "snapshot_date",
                               run.li_now - _dt.timedelta(days=365), ["l_orderkey", "l_linenumber", "size"], [])


@query("join_left_coalesce")
def q_join_left_coalesce(run: Run) -> DataFrame:
    br = al.alert_blocking(run, "duration", WEEK_MIN).rows.select("instance_id", "instance")
    o = run.cfg.overrides.filter((F.col("alert_id") == 1) & F.col("instance_id").isNotNull()).select(
        F.col("instance_id").alias("_oid"), F.col("audience").alias("_oa"), F.col("threshold").alias("_ot"))
    d = run.cfg.alerts.filter(F.col("alert_id") == 1).select(F.col("audience").alias("_da"),
                                                             F.col("default_threshold").alias("_dt"))
    j = br.join(o, F.col("instance_id") == F.col("_oid"), "left").crossJoin(F.broadcast(d))
    return j.select("instance_id", "instance", F.coalesce("_oa", "_da").alias("audience"),
                    F.coalesce("_ot", "_dt").alias("threshold"))


@query("join_cross_broadcast")
def q_join_cross_broadcast(run: Run) -> DataFrame:
    br = al.alert_blocking(run, "duration", WEEK_MIN, tag=("segment", "BUILDING")).rows
    tag_rows = th.tag_level(run.cfg.overrides, 1, "segment", "BUILDING").select("override_id", "audience", "threshold")
    return br.select("instance_id").distinct().crossJoin(F.broadcast(tag_rows))


@query("join_wildcard")
def q_join_wildcard(run: Run) -> DataFrame:
    rules = run.cfg.counter_rules.select(
        F.col("object_name").alias("r_object"), F.col("counter_name").alias("r_counter"),
        F.col("instance_name").alias("r_instance"), "threshold_from", "threshold_to")
    pc = run.tm.performance_counters()
    cond = ((F.col("object_name") == F.col("r_object")) & (F.col("counter_name") == F.col("r_counter"))
            & ((F.col("instance_name") == F.col("r_instance")) | F.col("r_instance").isNull()))
    j = pc.join(F.broadcast(rules), cond)
    return j.groupBy("instance_id", "r_object", "r_counter").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(th.band_check(F.col("value"), F.col("threshold_from"), F.col("threshold_to"))).alias("n_in_band"))


@query("semi_tag_filter")
def q_semi_tag_filter(run: Run) -> DataFrame:
    ids = tag_filter(run.tm.instance_tags(), "nation", "NATION_7")
    return run.tm.blocking_snapshot().join(ids, "instance_id", "left_semi").select(
        "instance_id", "snapshot_date", "event_id", "blocked_wait_time")


MULTI_TAGS = "segment:BUILDING,MACHINERY;nation:NATION_3"


@query("multi_tag_match")
def q_multi_tag_match(run: Run) -> DataFrame:
    pairs = run.spark.range(1).select(F.explode(pm.tag_pairs(F.lit(MULTI_TAGS))).alias("p")).select(
        F.lower("p.tag_name").alias("_n"), F.lower("p.tag_value").alias("_v"))
    it = run.tm.instance_tags()
    j = it.join(F.broadcast(pairs), (F.lower("tag_name") == F.col("_n")) & (F.lower("tag_value") == F.col("_v")))
    return j.select("instance_id", "tag_name", "tag_value").distinct()


@query("suppress_recent")
def q_suppress_recent(run: Run) -> DataFrame:
    cur = al.blocking_latest(run, WEEK_MIN)
    return st.suppress_recent(cur, run.cfg.history, 1, 5, run.now).select("instance_id", "instance", "blocked_wait_time")


@query("scalar_subquery")
def q_scalar_subquery(run: Run) -> DataFrame:
    """Per breaching instance: the local environment id and that environment's webhook."""
    local = run.cfg.environment.filter(F.col("is_local")).agg(F.min("id").alias("env_id"))
    hook = rt.env_webhook(run.cfg.webhooks)
    one = local.join(hook, F.col("env_id") == F.col("_env"), "left").select("env_id", F.col("_env_webhook").alias("webhook"))
    br = al.alert_blocking(run, "duration", WEEK_MIN).rows.select("instance_id", "instance")
    return br.crossJoin(F.broadcast(one))


@query("exists_gate")
def q_exists_gate(run: Run) -> DataFrame:
    br = al.alert_blocking(run, "duration", WEEK_MIN).rows.select("instance_id")
    return run.instances.join(br, "instance_id", "left_semi").select("instance_id", "instance_display_name")


@query("join_collated")
def q_join_collated(run: Run) -> DataFrame:
    h = run.cfg.history
    i = run.instances.select("instance_id", "instance_display_name")
    return i.join(h, F.lower(F.col("instance_display_name")) == F.lower(F.col("instance"))).select(
        "instance_id", "instance_display_name", "instance", "alert_id")


# ---------------------------------------------------------------------------------------
# 2.4 aggregations
# ---------------------------------------------------------------------------------------
from tripwire.plans import wip  # noqa: E402

CRIT_MIN, CRIT_THRESHOLD = 7 * DAY, 500
COUNTER_MIN = 30 * DAY
SUMMARY_THRESHOLDS = ("@LastMinutes int=10080;@LRPThreshold int=20000;@TDBWaitCountThreshold int=1;"
                      "@TDBWaitTimeThreshold int=1000;@CriticalWaitCountThreshold int=1;@CriticalWaitTimeThreshold int=2000")


@query("count_conditional")
def q_count_conditional(run: Run) -> DataFrame:
    return al.freespace_rows(run).select("instance", "instance_id", "drives_in_critical", "drives_in_warning")


@query("agg_multi")
def q_agg_multi(run: Run) -> DataFrame:
    return al.top_blocker_groups(run, YEAR_MIN, None).select(
        "instance_id", "sql_handle", "occurrences", "total_block_count", "total_block_wait_ms",
        "total_block_wait_recursive_ms", "avg_duration_ms")


@query("rate_having")
def q_rate_having(run: Run) -> DataFrame:
    return wip.critical_wait_rates(run, CRIT_MIN, CRIT_THRESHOLD)


@query("consecutive_breach")
def q_consecutive_breach(run: Run) -> DataFrame:
    return wip.counter_breaches(run, run.cfg.counter_rules, COUNTER_MIN, 3).select("instance", "counter", "current_value")


@query("max_conditional")
def q_max_conditional(run: Run) -> DataFrame:
    return wip.counter_breaches(run, run.cfg.counter_rules, COUNTER_MIN, 3, require_all=False)


@query("count_distinct")
def q_count_distinct(run: Run) -> DataFrame:
    rq = run.tm.running_queries().filter(F.col("is_root_blocker"))
    return rq.groupBy("instance_id", "sql_handle").agg(F.count_distinct("session_id").alias("n_sessions"))


@query("multi_stat_summary")
def q_multi_stat_summary(run: Run) -> DataFrame:
    return wip.summary_stats(wip.summary_masked(run, SUMMARY_THRESHOLDS))


@query("mask_and_any")
def q_mask_and_any(run: Run) -> DataFrame:
    return wip.summary_masked(run, SUMMARY_THRESHOLDS)


@query("string_agg_ordered")
def q_string_agg_ordered(run: Run) -> DataFrame:
    it = run.tm.instance_tags().filter(F.col("tag_name") == "nation")
    j = it.join(run.instances.select("instance_id", "instance_display_name"), "instance_id")
    return j.groupBy("tag_value").agg(
        F.expr("listagg(instance_display_name, ',') WITHIN GROUP (ORDER BY instance_display_name)").alias("instances"))


@query("string_agg_parts")
def q_string_agg_parts(run: Run) -> DataFrame:
    """The ordered instance list of every tag value in parts of at most 40 names (messages take 20,000)."""
    it = run.tm.instance_tags()
    j = it.join(run.instances.select("instance_id", "instance_display_name"), "instance_id")
    return rt.ordered_list(j, ["tag_name", "tag_value"], "instance_display_name", max_items=40)


@query("string_agg_distinct")
def q_string_agg_distinct(run: Run) -> DataFrame:
    return al.with_texts(run, al.top_blocker_groups(run, YEAR_MIN, None)).select("instance_id", "sql_handle", "top_blocker_tsql")


@query("string_agg_struct")
def q_string_agg_struct(run: Run) -> DataFrame:
    return al.top_blocker_groups(run, YEAR_MIN, None).select("instance_id", "sql_handle", "additional_info")


@query("drive_details")
def q_drive_details(run: Run) -> DataFrame:
    return al.freespace_rows(run).select("instance_id", "details_critical", "details_warning")


@query("html_rows")
def q_html_rows(run: Run) -> DataFrame:
    r = al.alert_blocking(run, "duration", WEEK_MIN).rows
    return r.select("instance_id", tx.tr(F.col("instance"), tx.fmt_n(F.col("blocked_session_count"), 0),
                                         tx.fmt_n(F.col("blocked_wait_time") / F.lit(1000), 1)).alias("row_html"))


@query("distinct_rows")
def q_distinct_rows(run: Run) -> DataFrame:
    return al.alert_cpu(run, 2).rows.select("audience", "webhook").distinct()


# ---------------------------------------------------------------------------------------
# 2.5 windows
# ---------------------------------------------------------------------------------------
@query("last_k_per_key")
def q_last_k_per_key(run: Run) -> DataFrame:
    pc = run.tm.performance_counters()
    return sel.last_k_per_key(pc, ["instance_id", "counter_name"], ["snapshot_date", "event_id"], 3).select(
        "instance_id", "counter_name", "snapshot_date", "event_id", "value", "rn")


@query("rank_global")
def q_rank_global(run: Run) -> DataFrame:
    return al.top_n_ranked(al.top_blocker_groups(run, YEAR_MIN, 10000), 10).select(
        "rank", "instance_id", "sql_handle", "total_block_wait_recursive_ms")


@query("precedence_pick")
def q_precedence_pick(run: Run) -> DataFrame:
    rows = al.cpu_latest(run, 2, ("segment", "BUILDING"))
    r = rt.resolve_overrides(rows, run.cfg.overrides, run.cfg.alerts, run.cfg.webhooks, 3, "segment", "BUILDING")
    return r.select("instance_id", *rt.ROUTE_FIELDS)


@query("window_count_latest")
def q_window_count_latest(run: Run) -> DataFrame:
    return wip.long_queries(run, 2 * DAY, 30000)


@query("state_replay")
def q_state_replay(run: Run) -> DataFrame:
    cpu = run.tm.cpu().join(run.instances.select("instance_id"), "instance_id")
    cpu = th.resolve_threshold(cpu, run.cfg.overrides, run.cfg.alerts, 3).withColumn(
        "threshold", F.col("threshold").try_cast("int"))
    out = st.state_replay(cpu, "instance_id", "event_time", "event_id", F.col("total_cpu") >= F.col("threshold"))
    return out.select("instance_id", "event_time", "event_id", "total_cpu", "threshold", "action")


# ---------------------------------------------------------------------------------------
# 2.6 sort / limit / set
# ---------------------------------------------------------------------------------------
@query("topn_blockers")
def q_topn_blockers(run: Run) -> DataFrame:
    return al.report_top_blockers(run, "Report").rows.drop(*rt.ROUTE_FIELDS)


@query("order_by_derived")
def q_order_by_derived(run: Run) -> DataFrame:
    return al.growth_rows(run, YEAR_MIN).orderBy(F.col("autogrow_count").desc(), "instance", "db", "file")


@query("union_all")
def q_union_all(run: Run) -> DataFrame:
    ids = run.instances.select("instance_id")
    o = run.cfg.overrides.filter(F.col("alert_id") == 1)
    lvl1 = ids.join(o.filter(F.col("instance_id").isNotNull() & F.col("tag_name").isNull() & F.col("tag_value").isNull())
                    .select("instance_id", "override_id", "threshold"), "instance_id").select(
        "instance_id", F.lit(1).alias("rnk"), F.col("override_id").alias("tie"), "threshold")
    tag = th.tag_level(run.cfg.overrides, 1, "segment", "BUILDING").select(
        F.lit(2).alias("rnk"), F.col("override_id").alias("tie"), "threshold")
    dflt = run.cfg.alerts.filter(F.col("alert_id") == 1).select(
        F.lit(3).alias("rnk"), F.lit(0).alias("tie"), F.col("default_threshold").alias("threshold"))
    rest = ids.crossJoin(F.broadcast(tag.unionByName(dflt)))
    return lvl1.unionByName(rest)


# ---------------------------------------------------------------------------------------
# 2.8 domain operators
# ---------------------------------------------------------------------------------------
def _view(run: Run) -> DataFrame:
    return rt.all_alerts_view(run.cfg.alerts, run.cfg.environment, run.cfg.overrides, run.cfg.levels, run.cfg.webhooks)


def _outbox(run: Run, msgs: DataFrame) -> DataFrame:
    return rd.outbox(msgs, _view(run), run.cfg.blackouts, run.now)


def _more_messages(run: Run) -> DataFrame:
    return (al.alert_blocking(run, "processes", WEEK_MIN).messages
            .unionByName(al.alert_freespace(run).messages)
            .unionByName(al.alert_db_growth(run, YEAR_MIN).messages)
            .unionByName(al.report_top_blockers(run, "Report").messages))


@query("resolve_overrides")
def q_resolve_overrides(run: Run) -> DataFrame:
    r = al.alert_blocking(run, "duration", WEEK_MIN, tag=("segment", "BUILDING")).rows
    return r.select("instance_id", "instance", "threshold", *rt.ROUTE_FIELDS)


@query("all_alerts_view")
def q_all_alerts_view(run: Run) -> DataFrame:
    """The alerts view as each routed message sees it (one view row per message and fan-out)."""
    msgs = al.alert_blocking(run, "duration", WEEK_MIN).messages.unionByName(_more_messages(run))
    v = _view(run).drop("aw_id", "override_id", "audience", "webhook", "email_alert_template", "webhook_alert_template")
    return msgs.select("alert_name", "audience", "instances").join(F.broadcast(v), "alert_name").drop(
        "last_notification")


@query("blackout_status")
def q_blackout_status(run: Run) -> DataFrame:
    ids = run.spark.range(1).select(F.explode(F.array(*[F.lit(i) for i in (3, 5, 6, -2)])).alias("alert_id"))
    ev = run.tm.cpu().select("event_id", "event_time").crossJoin(F.broadcast(ids))
    return rt.blackout_status(ev, run.cfg.blackouts, "event_time")


@query("counter_path")
def q_counter_path(run: Run) -> DataFrame:
    return wip.counter_targets(run, run.cfg.counter_rules).select("instance_id", "counter").distinct()


@query("delivery_gate")
def q_delivery_gate(run: Run) -> DataFrame:
    return _outbox(run, _more_messages(run)).select("alert_name", "audience", "channel", "recipient", "send", "reason")


@query("render_email")
def q_render_email(run: Run) -> DataFrame:
    return _outbox(run, _more_messages(run)).filter(F.col("channel") == "email").select(
        "alert_name", "audience", "subject", "body")


@query("render_webhook")
def q_render_webhook(run: Run) -> DataFrame:
    return _outbox(run, _more_messages(run)).filter(F.col("channel") == "webhook").select(
        "alert_name", "audience", "recipient", "body")


@query("route_by_audience")
def q_route_by_audience(run: Run) -> DataFrame:
    return al.alert_blocking(run, "duration", WEEK_MIN, tag=("segment", "BUILDING")).messages.select(*MSG_COLS)


@query("alert_critical_waits")
def q_alert_critical_waits(run: Run) -> DataFrame:
    rows = wip.critical_wait_rates(run, CRIT_MIN, CRIT_THRESHOLD).withColumn("alert_type", F.lit("CriticalWait"))
    return wip.delay_gate(rows, run.cfg.delay_by_type, "alert_type", run.now, 10)


@query("alert_perf_counters")
def q_alert_perf_counters(run: Run) -> DataFrame:
    """The counter alert's message: breaches past the delay gate of their type, as one list per recipient.

    Counters were last sent a day ago (open), critical waits five minutes ago: their rows pass the same gate and are held
    back, so only counters are listed.
    """
    counters = wip.counter_breaches(run, run.cfg.counter_rules, COUNTER_MIN, 3).withColumn("alert_type", F.lit("PerformanceCounterAlert"))
    waits = wip.critical_wait_rates(run, CRIT_MIN, CRIT_THRESHOLD).select(
        "instance", F.col("wait_type").alias("counter"), F.lit(3).cast("long").alias("n_breaching"),
        F.col("wait_ms_per_sec").cast("decimal(28,9)").alias("current_value"), F.lit("CriticalWait").alias("alert_type"))
    delays = wip.mark_sent(run.cfg.delay_by_type, "PerformanceCounterAlert", run.now - _dt.timedelta(days=1))
    delays = wip.mark_sent(delays, "CriticalWait", run.now - _dt.timedelta(minutes=5))
    br = wip.delay_gate(counters.unionByName(waits), delays, "alert_type", run.now, 10)
    return wip.counter_messages(br, 3, "ops@example.com").select("alert_name", "audience", "instances", "table_html", "n_rows")


@query("alert_query_summary")
def q_alert_query_summary(run: Run) -> DataFrame:
    return wip.alert_query_summary(run, SUMMARY_THRESHOLDS)


@query("alert_long_queries")
def q_alert_long_queries(run: Run) -> DataFrame:
    """Latest summary over the threshold that overrides and the alert's default give each instance."""
    return wip.long_queries_now(run, 2 * DAY)


@query("alert_blocking_multi_tag")
def q_alert_blocking_multi_tag(run: Run) -> DataFrame:
    return wip.blocking_multi_tag(run, MULTI_TAGS, WEEK_MIN)


@query("delay_by_type")
def q_delay_by_type(run: Run) -> DataFrame:
    cw = wip.critical_wait_rates(run, CRIT_MIN, CRIT_THRESHOLD).select(
        F.lit("CriticalWait").alias("alert_type"), "instance", F.col("wait_type").alias("item"),
        F.col("wait_ms_per_sec").cast("string").alias("value"))
    pc = wip.counter_breaches(run, run.cfg.counter_rules, COUNTER_MIN, 3).select(
        F.lit("PerformanceCounterAlert").alias("alert_type"), "instance", F.col("counter").alias("item"),
        F.col("current_value").cast("string").alias("value"))
    return wip.delay_gate(cw.unionByName(pc), run.cfg.delay_by_type, "alert_type", run.now, 10)


# ---------------------------------------------------------------------------------------
# 2.9 replay over history
# ---------------------------------------------------------------------------------------
from tripwire.operators import replay as rp  # noqa: E402


def blocking_breach_series(run: Run) -> DataFrame:
    """Every blocking snapshot over its instance's resolved duration threshold (whole history)."""
    b = run.tm.blocking_snapshot().join(run.instances.select("instance_id"), "instance_id")
    b = th.resolve_threshold(b, run.cfg.overrides, run.cfg.alerts, 1)
    return th.threshold_breach(b, "blocked_wait_time").select("instance_id", "snapshot_date", "event_id")


@query("suppress_replay")
def q_suppress_replay(run: Run) -> DataFrame:
    import datetime as _dt
    return rp.suppress_replay(blocking_breach_series(run), "instance_id", "snapshot_date", "event_id",
                              _dt.timedelta(days=2))


# ---------------------------------------------------------------------------------------
# streaming (each query runs its stream to completion with availableNow, then reads the
# result folder written under the checkpoint directory)
# ---------------------------------------------------------------------------------------
from tripwire.streaming import jobs as sj  # noqa: E402
from tripwire.streaming import state_machine as sm  # noqa: E402


@query("stream_poll")
def q_stream_poll(run: Run) -> DataFrame:
    return run.spark.read.parquet(sj.run_poll(run.spark, run.sf_dir, WEEK_MIN))


@query("stream_state_machine")
def q_stream_state_machine(run: Run) -> DataFrame:
    return sj.current_actions(run.spark, sm.run_keyed_state_machine(run.spark, run.sf_dir))


@query("stream_rate_window")
def q_stream_rate_window(run: Run) -> DataFrame:
    return sj.current_rates(run.spark, sj.run_rate_window(run.spark, run.sf_dir))


@query("validate_request")
def q_validate_request(run: Run) -> DataFrame:
    """Notification requests derived from the routed messages: as routed, as a custom alert
    without templates, and as an unknown alert type; each checked."""
    from tripwire.operators.validate import validate_request
    m = al.alert_blocking(run, "duration", WEEK_MIN).messages.unionByName(al.alert_cpu(run, 2).messages)
    base = m.select("alert_name", "alert_type", "audience", F.col("email_alert_template").alias("email_template"),
                    "webhook", F.col("webhook_alert_template").alias("webhook_template"), "instances")
    custom = base.select(F.lit("Custom").alias("alert_name"), F.lit(255).alias("alert_type"), "audience",
                         F.lit(None).cast("string").alias("email_template"), "webhook",
                         F.lit(None).cast("string").alias("webhook_template"), "instances")
    odd = base.select(F.concat(F.col("alert_name"), F.lit(" (copy)")).alias("alert_name"), F.lit(7).alias("alert_type"),
                      F.lit(None).cast("string").alias("audience"), "email_template", F.lit(None).cast("string").alias("webhook"),
                      "webhook_template", "instances")
    return validate_request(base.unionByName(custom).unionByName(odd), run.cfg.alerts).select(
        "alert_name", "alert_type", "audience", "instances", "errors", "webhook_enabled")


@query("thresholds_kv")
def q_thresholds_kv(run: Run) -> DataFrame:
    """Per instance: the top-blocker alert's resolved threshold text parsed into typed limits."""
    r = th.resolve_threshold(run.instances.select("instance_id"), run.cfg.overrides, run.cfg.alerts, 7)
    kv = pm.thresholds_kv(F.col("threshold"))
    return r.select("instance_id", "threshold",
                    kv["MinutesBack"].try_cast("int").alias("minutes_back"),
                    kv["MinBlockWaitTimeRecursive"].try_cast("bigint").alias("min_block_wait_ms"))


@query("wiki_link")
def q_wiki_link(run: Run) -> DataFrame:
    """The wiki link each routed message renders (alert name substituted, github dashes)."""
    msgs = al.alert_blocking(run, "duration", WEEK_MIN).messages.unionByName(_more_messages(run))
    a = run.cfg.alerts.select("alert_name", "alert_wiki")
    return msgs.select("alert_name", "audience").join(F.broadcast(a), "alert_name").select(
        "alert_name", "audience", tx.wiki_link(F.col("alert_wiki"), F.col("alert_name")).alias("wiki"))


@query("tags_json")
def q_tags_json(run: Run) -> DataFrame:
    """Per-instance tag documents in the JSON list form, parsed into (instance, tag, value) rows."""
    it = run.tm.instance_tags().join(run.instances.select("instance_id"), "instance_id", "left_semi")
    per_tag = it.groupBy("instance_id", "tag_name").agg(F.array_sort(F.collect_list("tag_value")).alias("values"))
    docs = per_tag.groupBy("instance_id").agg(F.to_json(F.collect_list(F.struct(
        F.struct(F.col("tag_name").alias("name"), F.col("values")).alias("tags")))).alias("doc"))
    rows = docs.select("instance_id", F.explode(pm.tags_from_json(F.col("doc"))).alias("p"))
    return rows.select("instance_id", F.col("p.tag_name").alias("tag_name"), F.col("p.tag_value").alias("tag_value"))


# ---------------------------------------------------------------------------------------
# the jobs at a past evaluation time: nothing after it is seen
# ---------------------------------------------------------------------------------------
import datetime as _dt  # noqa: E402

PAST_DAYS = 15


def past(run: Run) -> Run:
    """The same tables as of two weeks before the latest event and a year before the latest ship date."""
    if not hasattr(run, "past"):
        run.past = Run(run.spark, run.sf_dir, now=run.now - _dt.timedelta(days=PAST_DAYS), li_now=run.li_now - _dt.timedelta(days=365))
    return run.past


for _name in ("alert_blocking_duration", "alert_cpu", "alert_db_growth", "report_top_blockers", "alert_long_queries"):
    def _at(run: Run, _fn=REGISTRY[_name]) -> DataFrame:
        return _fn(past(run))
    query(_name + "_past")(_at)


@query("suppress_replay_dense")
def q_suppress_replay_dense(run: Run) -> DataFrame:
    """Repeat interval of a third of a second on one series of all breaches, squeezed to 50 ms steps or ties."""
    ev = blocking_breach_series(run).select(
        F.lit(1).alias("instance_id"), F.timestamp_add("MILLISECOND", (F.col("event_id") % 20000) * 50,
                                                        F.lit(run.now).cast("timestamp_ntz")).alias("snapshot_date"), "event_id")
    return rp.suppress_replay(ev, "instance_id", "snapshot_date", "event_id", _dt.timedelta(milliseconds=333))


@query("suppress_replay_hot")
def q_suppress_replay_hot(run: Run) -> DataFrame:
    """Repeat interval of a second on all events as one series, 9 ms apart: one key holds every row."""
    ev = run.tm.events.select(F.lit(1).alias("instance_id"), F.timestamp_add(
        "MICROSECOND", F.col("event_id") * 9000, F.lit(run.now).cast("timestamp_ntz")).alias("snapshot_date"), "event_id")
    return rp.suppress_replay(ev, "instance_id", "snapshot_date", "event_id", _dt.timedelta(seconds=1))


@query("suppress_replay_zero")
def q_suppress_replay_zero(run: Run) -> DataFrame:
    """Interval zero: every breach is notified."""
    return rp.suppress_replay(blocking_breach_series(run), "instance_id", "snapshot_date", "event_id", _dt.timedelta(0))
