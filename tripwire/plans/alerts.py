"""End-to-end alert and report jobs composed from the operators.

Each job returns an `AlertOutput`: the evaluated rows (one per instance or item, with routing
fields), the messages (one per audience/channel settings), and the new history snapshot.
Nothing is sent or written here; `outbox()` renders the messages and `write_*` persist.

Plan shape shared by all jobs: facts are filtered by literal time bounds (pushed into the
scan), reduced per instance by aggregation (partial, skew-safe), then joined with config
that is either reduced to one row (broadcast) or per-instance (AQE picks the join).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window, functions as F

from tripwire.functions import text as tx
from tripwire.operators import routing as rt
from tripwire.operators import select as sel
from tripwire.operators import state as st
from tripwire.operators import thresholds as th
from tripwire.operators.params import parse_thresholds
from tripwire.plans.context import Run
from tripwire.session import materialized


class AlertOutput:
    """Evaluated rows, routed messages and the change of the history: `change(history)` is the new snapshot."""

    def __init__(self, rows: DataFrame, messages: DataFrame, history: DataFrame, change):
        self.rows = rows
        self.messages = messages
        self.change = change
        self._history = history

    @property
    def history(self) -> DataFrame:
        """The new snapshot of the history that the alert was evaluated with."""
        return self.change(self._history)


def _messages(routed: DataFrame, alert_name: str, alert_type: int, row_html, order_col: str | None = None,
              distinct_names: bool = False, subject: str | None = None) -> DataFrame:
    m = rt.route_by_audience(routed, "instance", row_html, order_col=order_col, distinct_names=distinct_names)
    m = m.select(*rt.ROUTE_FIELDS, "instances", "table_html", "n_rows")
    return m.select(F.lit(alert_name).alias("alert_name"), F.lit(alert_type).alias("alert_type"), *m.columns,
                    F.lit(subject).cast("string").alias("subject"))


# ---------------------------------------------------------------------------------------
# blocking (interval-suppressed)
# ---------------------------------------------------------------------------------------
BLOCKING = {"duration": ("Blocking - Duration", "blocked_wait_time"),
            "processes": ("Blocking - Processes", "blocked_session_count")}


def blocking_latest(run: Run, minutes: int, tag: tuple[str, str] | None = None) -> DataFrame:
    b = sel.lookback(run.tm.blocking_snapshot(), "snapshot_date", run.now, minutes)
    latest = sel.latest_per_key(b, ["instance_id"], ["snapshot_date", "event_id"],
                                ["blocked_wait_time", "blocked_session_count"])
    inst = run.targets(tag)
    return latest.join(inst.select("instance_id", F.col("instance_display_name").alias("instance")), "instance_id")


def alert_blocking(run: Run, metric: str = "duration", minutes: int = 3, tag: tuple[str, str] | None = None,
                   history: DataFrame | None = None) -> AlertOutput:
    name, metric_col = BLOCKING[metric]
    a = run.cfg.alert(name)
    aid = a["alert_id"]
    tn, tv = tag or (None, None)
    hist = run.cfg.history if history is None else history
    cur = blocking_latest(run, minutes, tag)
    cur = st.suppress_recent(cur, hist, aid, a["repeat_notification_interval"], run.now)
    cur = rt.resolve_instance_config(cur, run.cfg.overrides, run.cfg.alerts, run.cfg.webhooks, aid, tn, tv)
    breach = run.keep(th.threshold_breach(cur, metric_col).withColumn("threshold", F.col("threshold").cast("int")))
    routed = breach
    row = tx.tr(F.col("instance"), tx.fmt_n(F.col("blocked_session_count"), 0),
                tx.fmt_n(F.col("blocked_wait_time") / F.lit(1000), 1))
    msgs = _messages(routed, name, 1, row)
    change = lambda h: st.history_upsert(h, breach, aid, run.now)
    return AlertOutput(routed, msgs, hist, change)


# ---------------------------------------------------------------------------------------
# CPU (ON/OFF state machine)
# ---------------------------------------------------------------------------------------
def cpu_latest(run: Run, anchor_minutes: int = 2, tag: tuple[str, str] | None = None) -> DataFrame:
    """Latest CPU sample per active instance, no older than N minutes before its last collection."""
    inst = run.targets(tag)
    inst = inst.filter(F.col("is_active")).select("instance_id", F.col("instance_display_name").alias("instance"))
    anchors = run.tm.collection_dates().filter(F.col("reference") == "view").join(inst.select("instance_id"), "instance_id", "left_semi")
    near = sel.anchor_lookback(run.tm.cpu(), anchors, "instance_id", "event_time", "snapshot_date", anchor_minutes)
    latest = sel.latest_per_key(near, ["instance_id"], ["event_time", "event_id"], ["total_cpu"])
    return latest.join(inst, "instance_id").select("instance_id", "instance", F.col("total_cpu").alias("counter"))


def alert_cpu(run: Run, anchor_minutes: int = 2, tag: tuple[str, str] | None = None,
              history: DataFrame | None = None) -> AlertOutput:
    a = run.cfg.alert("High CPU")
    aid = a["alert_id"]
    tn, tv = tag or (None, None)
    hist = run.cfg.history if history is None else history
    cur = cpu_latest(run, anchor_minutes, tag)
    cur = rt.resolve_instance_config(cur, run.cfg.overrides, run.cfg.alerts, run.cfg.webhooks, aid, tn, tv)
    cur = cur.withColumn("threshold", F.col("threshold").try_cast("int"))
    acted = run.keep(st.with_state_action(cur, hist, aid))
    routed = acted
    row = tx.tr(F.col("instance"), F.col("counter"), F.col("threshold"))
    # alarm and recovery messages in one aggregation, keyed by the message kind
    kind = (F.when(F.col("action").isin("NEW->ON", "OFF->ON"), F.lit("High CPU"))
            .when(F.col("action") == "ON->OFF", F.lit("High CPU - Recovery")))
    src = routed.withColumn("alert_name", kind).filter(F.col("alert_name").isNotNull())
    m = rt.route_by_audience(src, "instance", row, keys=["alert_name", *rt.ROUTE_FIELDS])
    msgs = m.select("alert_name", F.lit(0).alias("alert_type"), *rt.ROUTE_FIELDS, "instances", "table_html",
                    "n_rows", F.lit(None).cast("string").alias("subject"))
    change = lambda h: st.history_state_write(h, acted, aid, run.now)
    return AlertOutput(routed, msgs, hist, change)


# ---------------------------------------------------------------------------------------
# disk free space
# ---------------------------------------------------------------------------------------
def drive_detail(ds_name, total, free, pct):
    return F.concat(F.upper(ds_name), F.lit(" ("), tx.fmt_n(total, 2), F.lit("GB / "), tx.fmt_n(free, 2),
                    F.lit("GB / "), tx.fmt_n(pct * F.lit(100.0), 2), F.lit("% free)"))


def freespace_rows(run: Run, tag: tuple[str, str] | None = None) -> DataFrame:
    """Per instance: drives under the critical / warning level and their details."""
    ds = run.tm.drive_status()
    inst = run.targets(tag)
    ds = ds.join(inst.filter(F.col("is_active")).select("instance_id"), "instance_id", "left_semi")
    crit = F.col("pct_free_space") < F.col("critical_threshold")
    warn = F.col("pct_free_space") < F.col("warning_threshold")
    det = drive_detail(F.col("name"), F.col("total_gb"), F.col("free_gb"), F.col("pct_free_space"))

    def details(cond):
        lst = F.array_join(F.array_sort(F.collect_list(F.when(cond, det))), ";")
        return F.coalesce(F.nullif(lst, F.lit("")), F.lit("n/a"))

    g = ds.groupBy(F.col("instance_display_name").alias("instance"), "instance_id").agg(
        F.count_if(crit).cast("int").alias("drives_in_critical"),
        F.count_if(warn).cast("int").alias("drives_in_warning"),
        details(crit).alias("details_critical"),
        details(warn).alias("details_warning"),
    )
    return g.filter(F.col("drives_in_critical") + F.col("drives_in_warning") > 0)


def alert_freespace(run: Run, tag: tuple[str, str] | None = None, history: DataFrame | None = None) -> AlertOutput:
    a = run.cfg.alert("Disk Free Space")
    aid = a["alert_id"]
    tn, tv = tag or (None, None)
    hist = run.cfg.history if history is None else history
    rows = run.keep(freespace_rows(run, tag))
    routed = rt.resolve_instance_config(rows, run.cfg.overrides, run.cfg.alerts, run.cfg.webhooks, aid, tn, tv)
    br = F.lit("<br/>")
    row = tx.unescape_angles(tx.tr(
        F.col("instance"), tx.fmt_n(F.col("drives_in_warning"), 0), F.replace(F.col("details_warning"), F.lit(";"), br),
        tx.fmt_n(F.col("drives_in_critical"), 0), F.replace(F.col("details_critical"), F.lit(";"), br)))
    msgs = _messages(routed, a["alert_name"], 1, row)
    change = lambda h: st.history_upsert(h, rows, aid, run.now)
    return AlertOutput(routed, msgs, hist, change)


# ---------------------------------------------------------------------------------------
# database file growth
# ---------------------------------------------------------------------------------------
def growth_rows(run: Run, minutes: int = 60) -> DataFrame:
    """Files grown since their earliest snapshot in the window, with growth arithmetic in MB."""
    since = run.li_now - dt.timedelta(minutes=minutes)
    first = sel.first_in_window(run.tm.db_file_snapshot(), "file_id", "snapshot_date", since,
                                ["l_orderkey", "l_linenumber", "size"], [])
    first = first.select("file_id", F.col("size").alias("ss_size"))
    inst = run.instances.filter(F.col("is_active")).select(
        "instance_id", F.col("instance_display_name").alias("instance"))
    files = run.tm.db_files().filter(F.col("database_is_active") & F.col("file_is_active"))
    f = files.join(inst, "instance_id").join(first, "file_id")
    f = f.filter(F.col("size") - F.col("ss_size") > 0)
    d = "decimal(20,3)"
    size, ss = F.col("size").cast("decimal(20,0)"), F.col("ss_size").cast("decimal(20,0)")
    pct = F.col("is_percent_growth") == 1
    step = F.when(pct, F.col("growth").cast("decimal(20,0)") * F.lit(0.01).cast("decimal(3,2)") * ss
                  ).otherwise(F.col("growth").cast("decimal(20,0)"))
    return f.select(
        "instance", "instance_id", F.col("database_name").alias("db"), F.col("file_name").alias("file"),
        (size / F.lit(128)).cast(d).alias("size_mb"),
        ((size - ss) / F.lit(128)).cast(d).alias("total_growth"),
        tx.flag_label(F.col("is_percent_growth")).alias("is_percent_growth"),
        F.when(pct, F.col("growth")).cast("bigint").alias("auto_growth_pct"),
        (step / F.lit(128)).cast(d).alias("autogrowth_mb"),
        F.try_divide(size - ss, F.nullif(step, F.lit(0))).cast("int").alias("autogrow_count"),
    )


def alert_db_growth(run: Run, minutes: int = 60, history: DataFrame | None = None) -> AlertOutput:
    a = run.cfg.alert("DB Growths")
    aid = a["alert_id"]
    hist = run.cfg.history if history is None else history
    rows = run.keep(growth_rows(run, minutes))
    routed = rt.resolve_overrides(rows, run.cfg.overrides, run.cfg.alerts, run.cfg.webhooks, aid)
    row = tx.unescape_angles(tx.tr(
        F.col("instance"), F.col("db"), F.col("file"), tx.fmt_n(F.col("size_mb"), 3), tx.fmt_n(F.col("total_growth"), 3),
        F.col("is_percent_growth"), tx.fmt_n(F.coalesce(F.col("auto_growth_pct"), F.lit(0)), 3),
        tx.fmt_n(F.col("autogrowth_mb"), 3), tx.fmt_n(F.col("autogrow_count"), 0)))
    order = F.concat_ws("|", "instance", "db", "file")
    msgs = _messages(routed.withColumn("_ord", order), a["alert_name"], 1, row, order_col="_ord",
                     distinct_names=True)
    change = lambda h: st.history_upsert(h, rows, aid, run.li_now)
    return AlertOutput(routed, msgs, hist, change)


# ---------------------------------------------------------------------------------------
# top head blockers (report and alert modes)
# ---------------------------------------------------------------------------------------
def top_blocker_settings(run: Run, mode: str, rerun: bool, history: DataFrame | None) -> tuple[int, int | None, int]:
    """(minutes back, minimum recursive wait, top n) for a mode; single config values only."""
    a = run.cfg.alert("Top Head Blockers")
    if mode == "Report":
        hist = run.cfg.history if history is None else history
        last = hist.filter(F.col("alert_id") == a["alert_id"]).agg(F.max("last_occurrence")).first()[0]
        start = last if last is not None else run.li_now - dt.timedelta(days=7)
        minutes = 10080 if rerun else _minute_boundaries(start, run.li_now)
        min_wait = int(run.cfg.param("Reports/TopBlockers/MinBlockedWaitTimeMs", "10000"))
        top = int(run.cfg.param("Reports/TopBlockers/TopNRows", "10"))
        return minutes, min_wait, top
    kv = parse_thresholds(a["default_threshold"] or "")
    minutes = 10080 if rerun else int(kv.get("MinutesBack", 15))
    mw = kv.get("MinBlockWaitTimeRecursive")
    return minutes, (int(mw) if mw is not None else None), 5


def _minute_boundaries(start: dt.datetime, end: dt.datetime) -> int:
    a = start.replace(second=0, microsecond=0)
    b = end.replace(second=0, microsecond=0)
    return int((b - a).total_seconds() // 60)


BLOCKER_KEYS = ["instance_id", "instance", "sql_handle"]  # the display name depends on the instance only


def blocker_rows(run: Run, minutes: int, min_wait: int | None) -> DataFrame:
    """Root-blocker activity of active instances within N minutes of the last collection.

    The collection dates come from their own small table; statement texts are left to `with_texts`."""
    rq = run.tm.running_queries().filter(F.col("is_root_blocker") & F.col("is_active"))
    if min_wait is not None:
        rq = rq.filter(F.col("block_wait_recursive_ms") > min_wait)
    rq = sel.anchor_lookback(rq, run.tm.query_anchors(), "instance_id", "snapshot_date", "anchor", minutes)
    return rq.withColumnRenamed("instance_display_name", "instance")


def _sums() -> list:
    return [
        F.count("sql_handle").alias("occurrences"),
        F.sum("block_count").alias("total_block_count"),
        F.sum("block_wait_ms").alias("total_block_wait_ms"),
        F.sum("block_count_recursive").alias("total_block_count_recursive"),
        F.sum("block_wait_recursive_ms").alias("total_block_wait_recursive_ms"),
        tx.int_avg(F.sum("duration_ms"), F.count("duration_ms")).alias("avg_duration_ms"),
    ]


def _details():
    status_item = F.concat(F.lit("Status: "), F.col("status"), F.lit(";TxCnt: "), F.col("open_transaction_count").cast("string"))
    return F.concat(F.lit("SPIDs: "), F.count_distinct("session_id").cast("string"), F.lit("; "),
                    F.array_join(F.array_sort(F.collect_set(status_item)), ";")).alias("additional_info")


def top_blocker_groups(run: Run, minutes: int, min_wait: int | None) -> DataFrame:
    """Sums and details per (instance, sql handle), for all groups."""
    return blocker_rows(run, minutes, min_wait).groupBy(*BLOCKER_KEYS).agg(*_sums(), _details())


def top_blockers(run: Run, minutes: int, min_wait: int | None, n: int) -> DataFrame:
    """The n groups of the most recursive wait, ranked, with details and statement texts, in two passes.

    All groups are reduced to sums only; the distinct sessions and status texts are gathered in a second pass over the rows
    of the n groups alone. Those groups are n rows: they are broadcast, and their instances are a literal filter that
    reaches the scan.
    """
    rows = blocker_rows(run, minutes, min_wait)
    top = materialized(top_n_ranked(rows.groupBy(*BLOCKER_KEYS).agg(*_sums()), n))
    rows = rows.filter(F.col("instance_id").isin([r[0] for r in top.select("instance_id").distinct().collect()]))
    details = rows.join(F.broadcast(top.select(*BLOCKER_KEYS)), BLOCKER_KEYS, "left_semi").groupBy(*BLOCKER_KEYS).agg(_details())
    return with_texts(run, top.join(details, BLOCKER_KEYS))


def with_texts(run: Run, groups: DataFrame) -> DataFrame:
    """Adds the distinct texts of each group's handle, comma-joined in order (groups are read once)."""
    text = F.replace(F.col("query_text"), F.lit("\r"), F.lit(""))
    j = groups.join(run.tm.query_texts(), "sql_handle", "left")
    return j.groupBy(*groups.columns).agg(F.array_join(F.array_sort(F.collect_set(text)), ",").alias("top_blocker_tsql"))


def top_n_ranked(groups: DataFrame, n: int) -> DataFrame:
    """Top n groups by total recursive wait (ties by instance, handle), ranked 1..n.

    `orderBy().limit()` plans as TakeOrderedAndProject: each task keeps n rows, so the
    single-partition ranking window that follows sees at most n rows.
    """
    order = [F.col("total_block_wait_recursive_ms").desc(), F.col("instance_id"), F.col("sql_handle")]
    top = groups.orderBy(*order).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def report_top_blockers(run: Run, mode: str = "Report", rerun: bool = False,
                        history: DataFrame | None = None) -> AlertOutput:
    a = run.cfg.alert("Top Head Blockers")
    aid = a["alert_id"]
    hist = run.cfg.history if history is None else history
    minutes, min_wait, top = top_blocker_settings(run, mode, rerun, hist)
    ranked = run.keep(top_blockers(run, minutes, min_wait, top))
    routed = rt.resolve_overrides(ranked, run.cfg.overrides, run.cfg.alerts, run.cfg.webhooks, aid)
    sec = lambda c: tx.fmt_n(F.col(c) / F.lit(1000), 2)
    row = tx.tr(
        F.col("rank"), F.col("instance"), F.col("sql_handle"), F.col("occurrences"),
        F.concat(tx.fmt_n(F.col("total_block_count"), 0), F.lit("/"), sec("total_block_wait_ms")),
        F.concat(tx.fmt_n(F.col("total_block_count_recursive"), 0), F.lit("/"), sec("total_block_wait_recursive_ms")),
        tx.fmt_n(F.col("avg_duration_ms"), 0),
        F.coalesce(F.nullif(F.col("top_blocker_tsql"), F.lit("")), F.lit("n/a")),
        F.coalesce(F.col("additional_info"), F.lit("n/a")))
    subject = "Top Head Blockers report" if mode == "Report" else None
    msgs = _messages(routed.withColumn("_ord", F.format_string("%010d", F.col("rank"))), a["alert_name"], 1, row,
                     order_col="_ord", subject=subject)
    change = (lambda h: st.history_upsert(h, ranked, aid, run.li_now)) if mode == "Report" and not rerun else (lambda h: h)
    return AlertOutput(routed, msgs, hist, change)
