"""Evaluation time, config from tables, bounded messages, chained jobs and restarting streams."""

import datetime as dt
import os
import shutil
import threading
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tripwire.operators import params as pm
from tripwire.operators import render as rd
from tripwire.operators import routing as rt
from tripwire.operators import state as st
from tripwire.plans import alerts as al
from tripwire.plans import jobs, wip
from tripwire.plans.context import Run
from tripwire.plans.tags import TagNotFound
from tripwire.sources import config as C
from tripwire.sources import sinks
from tripwire.sources.bindings import cpu_percent
from tripwire.streaming import jobs as sj

WEEK = 7 * 24 * 60


@pytest.fixture(scope="module")
def base(spark):
    return Run(spark, SF_SMALL)


# ---------------------------------------------------------------- evaluation time
def test_nothing_after_the_evaluation_time_is_seen(spark, base):
    now = base.now - dt.timedelta(days=15)
    run = Run(spark, SF_SMALL, now=now)
    assert run.now == run.li_now == now
    for df, ts in ((run.tm.cpu(), "event_time"), (run.tm.blocking_snapshot(), "snapshot_date"), (run.tm.waits(), "snapshot_date"),
                   (run.tm.collection_dates(), "snapshot_date"), (al.blocking_latest(run, WEEK), "snapshot_date")):
        assert df.filter(F.col(ts) > F.lit(now).cast("timestamp_ntz")).count() == 0 and df.count() > 0
    past, present = al.alert_cpu(run, 2).rows, al.alert_cpu(base, 2).rows
    assert past.select("instance_id", "counter").exceptAll(present.select("instance_id", "counter")).count() > 0


def test_a_new_run_sees_new_data(spark, base, tmp_path):
    for t in ("customer", "nation"):
        shutil.copy(f"{SF_SMALL}/{t}.parquet", tmp_path / f"{t}.parquet")
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    cut = base.now - dt.timedelta(days=3)
    early = ev.filter(F.col("ts") < F.lit(cut).cast("timestamp_ntz"))
    early.write.parquet(f"{tmp_path}/events.parquet")
    first = Run(spark, str(tmp_path)).now
    ev.exceptAll(early).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    assert first < cut <= Run(spark, str(tmp_path)).now == base.now


# ---------------------------------------------------------------- config from tables
def _table(spark, name, rows):
    return spark.createDataFrame(C._normalize(C.FIXED[name][0], rows), C.FIXED[name][0])


def test_thresholds_and_intervals_come_from_the_given_tables(spark, tmp_path):
    rows = [tuple("500000000" if c == "10000" else c for c in r) if r[1] == "Blocking - Duration" else r for r in C.ALERT_ROWS]
    none = _table(spark, "alert_overrides_fixed", [])
    hist = spark.createDataFrame([], C.HISTORY_SCHEMA)
    high = Run(spark, SF_SMALL, config={"alerts": _table(spark, "alerts", rows), "alert_overrides": none, "alert_history": hist})
    assert al.alert_blocking(high, "duration", WEEK).rows.count() == 0
    # the same as a folder; tables that it lacks are seeded
    none.write.parquet(f"{tmp_path}/alert_overrides.parquet")
    hist.write.parquet(f"{tmp_path}/alert_history.parquet")
    seeded = Run(spark, SF_SMALL, config=str(tmp_path))
    got = al.alert_blocking(seeded, "duration", WEEK).rows
    assert got.count() > 0 and {r.threshold for r in got.collect()} == {10000}


def test_parameters_drive_the_report(spark):
    rows = [(i, n, "3" if n.endswith("TopNRows") else v, d) for i, n, v, d in C.PARAMETER_ROWS]
    run = Run(spark, SF_SMALL, config={"parameters": _table(spark, "parameters", rows)})
    assert al.top_blocker_settings(run, "Report", False, None)[2] == 3
    assert al.report_top_blockers(run, "Report", rerun=True).rows.count() <= 3
    assert run.cfg.param("no such name", "7") == "7"
    with pytest.raises(KeyError):
        run.cfg.alert("no such alert")


# ---------------------------------------------------------------- semantics
def test_long_queries_take_the_latest_row_first(base):
    now = {r.instance_id: r.counter for r in wip.long_queries_now(base, 2 * 24 * 60, 30000).collect()}
    over = {r.instance_id: r.counter for r in wip.long_queries(base, 2 * 24 * 60, 30000).collect()}
    assert set(now) < set(over) and all(now[i] == over[i] > 30000 for i in now)


def test_missing_cpu_reading_stays_missing(spark):
    df = spark.createDataFrame([(None,), (150.0,), (99.9,), (-1.5,)], "v double")
    assert [r[0] for r in df.select(cpu_percent(F.col("v"))).collect()] == [None, 100, 99, -2]


def test_last_duplicate_threshold_wins(spark):
    df = spark.createDataFrame([("A=1,A=2",), ("@A int=1;B=x;@A int=3",), ("",)], "t string")
    assert [r[0] for r in df.select(pm.thresholds_kv(F.col("t"))).collect()] == [{"A": "2"}, {"A": "3", "B": "x"}, {}]


def test_strict_json(spark):
    df = spark.createDataFrame([("not json",)], "t string")
    assert df.select(pm.tags_from_json(F.col("t"))).first()[0] is None
    for parse in (pm.tags_from_json, pm.thresholds_from_json):
        with pytest.raises(Exception, match="MALFORMED|malformed"):
            df.select(parse(F.col("t"), strict=True)).collect()


def test_inactive_databases_and_files_do_not_alert(base):
    names = {r[0] for r in al.growth_rows(base, 365 * 24 * 60).select("db").distinct().collect()}
    assert names and not any(n.endswith("5") for n in names)


# ---------------------------------------------------------------- messages
def test_large_audiences_become_several_messages(spark):
    """Parts are consecutive stretches with exact bounds; one instance with most rows is cut as well."""
    rows = spark.range(1000).select(
        F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("i"), F.col("id") % 40)).alias("instance"), F.lit("a").alias("audience"),
        F.lit(None).cast("string").alias("email_alert_template"), F.lit(None).cast("string").alias("webhook"),
        F.lit("w").alias("webhook_alert_template"), F.concat(F.lit("<"), "id", F.lit(">")).alias("html"))
    few = rows.limit(30).withColumn("audience", F.lit(None).cast("string"))
    whole = {r.audience: r for r in rt.route_by_audience(rows.unionByName(few), "instance", F.col("html")).collect()}
    got = rt.route_by_audience(rows.unionByName(few), "instance", F.col("html"), distinct_names=True, max_items=90).orderBy("part").collect()
    own = [r for r in got if r.audience == "a"]
    assert [r.part for r in own] == list(range(1, 13)) and [r.n_rows for r in own] == [90] * 11 + [10]
    assert "".join(r.table_html for r in own) == whole["a"].table_html
    assert [r.n_rows for r in got if r.audience is None] == [30]
    names = [r.instances.split(",") for r in own]
    assert all(p == sorted(set(p)) for p in names) and sum("hot" in p for p in names) >= 8


def test_ordered_lists_in_parts(spark):
    rows = spark.range(5000).select((F.col("id") % 7 == 0).alias("k"), F.concat(F.lit("n"), F.col("id") * 7919 % 5003).alias("v"))
    got = rt.ordered_list(rows, ["k"], "v", max_items=64).orderBy("k", "part").collect()
    for k in (False, True):
        own = [r for r in got if r.k == k]
        want = sorted(r.v for r in rows.filter(F.col("k") == k).collect())
        assert ",".join(r.items for r in own) == ",".join(want) and max(r.n for r in own) == 64
    assert rt.ordered_list(rows.limit(0), ["k"], "v").count() == 0


# ---------------------------------------------------------------- commit log
def test_concurrent_commits_lose_no_row(spark, tmp_path):
    """Four jobs read the same state and commit at the same time: each change arrives, whoever came first."""
    base, start, first = f"{tmp_path}/h", threading.Barrier(4), set()

    def job(i):
        def change(old):
            if i not in first:
                first.add(i)
                start.wait(60)  # all have read the state before any commits
            new = spark.createDataFrame([(f"i{i}", 1)], "instance string, n int")
            return new if old is None else old.unionByName(new)

        return sinks.commit(spark, base, change)

    with ThreadPoolExecutor(4) as pool:
        paths = list(pool.map(job, range(4)))
    assert len(set(paths)) == 4 and sinks.head(spark, base)[0] == 4
    assert sorted(r.instance for r in sinks.current(spark, base).collect()) == ["i0", "i1", "i2", "i3"]
    assert not sinks.put_if_absent(spark, f"{base}/commits/{4:09d}", "other") and sinks.head(spark, base)[1] in paths
    assert not [n for n in os.listdir(f"{base}/commits") if "draft" in n]


def test_two_runs_of_one_alert_keep_both_histories(spark, base, tmp_path):
    """Both were evaluated on the same stored history; the second commit merges into the first one's result."""
    res = al.alert_blocking(base, "duration", 7 * 24 * 60)
    aid = base.cfg.alert("Blocking - Duration")["alert_id"]
    mine = base.cfg.history.filter(F.col("alert_id") == aid)
    store = f"{tmp_path}/history"
    extra = spark.createDataFrame([("Only in the other run",)], "instance string")

    def other(h):
        return st.history_upsert(h, extra, aid, base.now)

    def late(h):  # between reading and committing, the other run commits
        if sinks.head(spark, f"{store}/alert={aid}")[0] == 0:
            sinks.commit_alert_history(spark, store, aid, mine, other)
        return res.change(h)

    sinks.commit_alert_history(spark, store, aid, mine, late)
    got = {r.instance for r in sinks.alert_history(spark, store, aid).collect()}
    assert "Only in the other run" in got and {r.instance for r in res.rows.collect()} <= got | {i.lower() for i in got} | {
        r.instance for r in res.rows.collect() if r.instance.lower() in {g.lower() for g in got}}


def test_custom_and_unknown_alerts(spark, base):
    cols = "alert_name string, alert_type int, audience string, webhook string, email_alert_template string, webhook_alert_template string, instances string, table_html string, custom_emoji string"
    msgs = spark.createDataFrame([("Custom", 255, "me", "http://h", "mail ##INSTANCES##", "hook##EMOJI##", "i1", None, ":x:"),
                                  ("Nobody's alert", 1, "me", "http://h", "t", "t", "i1", None, None)], cols)
    view = rt.all_alerts_view(base.cfg.alerts, base.cfg.environment, base.cfg.overrides, base.cfg.levels, base.cfg.webhooks)
    got = {(r.alert_name, r.channel): r for r in rd.outbox(msgs, view, base.cfg.blackouts, base.now).collect()}
    assert got["Custom", "webhook"].body == "hook:x:" and got["Custom", "webhook"].send and got["Custom", "email"].send
    assert {got["Nobody's alert", c].reason for c in ("email", "webhook")} == {"unknown_alert"}


# ---------------------------------------------------------------- jobs
def test_blocking_job_chains_processes_and_report(spark, tmp_path):
    rows = [(i, n, "1" if n.endswith("IncludeWithAlert") else v, d) for i, n, v, d in C.PARAMETER_ROWS]
    done = jobs.run_job(spark, "blocking", SF_SMALL, str(tmp_path), WEEK, config={"parameters": _table(spark, "parameters", rows)})
    assert list(done)[0] == "blocking-duration" and "blocking-duration/top-blockers-alert" in done and "blocking-processes" in done
    plain = jobs.run_job(spark, "blocking", SF_SMALL, f"{tmp_path}/b", WEEK)
    assert list(plain) == ["blocking-duration", "blocking-processes"]


def test_list_alerts_are_sent_once_per_delay(spark, base, tmp_path):
    first = jobs.run_job(spark, "critical-waits", SF_SMALL, str(tmp_path), WEEK)
    assert "delays" in first and spark.read.parquet(first["outbox"]).filter("channel = 'email' and send").count() >= 1
    sent = {r.alert_type: r.alert_sent_date for r in spark.read.parquet(first["delays"]).collect()}
    assert sent["CriticalWait"] == base.now and len(sent) == 2
    second = jobs.run_job(spark, "critical-waits", SF_SMALL, str(tmp_path), WEEK)
    assert "delays" not in second and spark.read.parquet(second["outbox"]).count() == 0


@pytest.mark.parametrize("job", ["perf-counters", "query-summary", "long-queries", "blocking-multi-tag"])
def test_list_alerts_run(spark, tmp_path, job):
    low = "@LastMinutes int=10080;@LRPThreshold int=1;@TDBWaitCountThreshold int=1;@TDBWaitTimeThreshold int=1;@CriticalWaitCountThreshold int=1;@CriticalWaitTimeThreshold int=1"
    done = jobs.run_job(spark, job, SF_SMALL, str(tmp_path), 30 * 24 * 60, tags="segment:BUILDING,MACHINERY", thresholds=low)
    assert spark.read.parquet(done["outbox"]).count() >= 0


def test_unknown_tag_and_zero_minutes(spark, base, tmp_path):
    with pytest.raises(TagNotFound):
        jobs.run_job(spark, "cpu", SF_SMALL, str(tmp_path), tag=("segment", "no such"))
    assert jobs.evaluate(base, "blocking-duration", 0).rows.count() <= jobs.evaluate(base, "blocking-duration", 3).rows.count()


def test_jobs_of_different_alerts_keep_each_others_state(spark, tmp_path):
    out = str(tmp_path)
    jobs.run_job(spark, "cpu", SF_SMALL, out)
    cpu = sinks.alert_history(spark, f"{out}/history", 3)
    before = sorted(map(tuple, cpu.collect()), key=repr)
    jobs.run_job(spark, "blocking-duration", SF_SMALL, out, WEEK)
    assert sorted(map(tuple, sinks.alert_history(spark, f"{out}/history", 3).collect()), key=repr) == before
    both = sinks.latest_history(spark, f"{out}/history")
    assert {r[0] for r in both.select("alert_id").distinct().collect()} == {1, 3}


# ---------------------------------------------------------------- streams
@pytest.fixture(scope="module")
def split(spark, tmp_path_factory, base):
    """The event log as files of five days each, and their order with one file arriving late."""
    root = tmp_path_factory.mktemp("split")
    for t in ("customer", "nation"):
        shutil.copy(f"{SF_SMALL}/{t}.parquet", root / f"{t}.parquet")
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet").toPandas()
    part = (ev.ts.max() - ev.ts).dt.days // 6
    return root, [ev[part == p] for p in sorted(part.unique(), reverse=True)]


def _deliver(root, frame, n):
    folder = root / "events.parquet"
    folder.mkdir(exist_ok=True)
    frame.to_parquet(folder / f"part-{n}.parquet", index=False, coerce_timestamps="us")


def _actions(spark, root):
    from tripwire.operators import state as st
    from tripwire.operators import thresholds as th

    run = Run(spark, str(root))
    cpu = th.resolve_threshold(run.tm.cpu().join(run.instances.select("instance_id"), "instance_id"), run.cfg.overrides, run.cfg.alerts, 3)
    cpu = cpu.withColumn("threshold", F.col("threshold").try_cast("int"))
    rows = st.state_replay(cpu, "instance_id", "event_time", "event_id", F.col("total_cpu") >= F.col("threshold"))
    return sorted(map(tuple, rows.select("instance_id", "event_time", "event_id", "total_cpu", "threshold", "action").collect()), key=repr)


@pytest.mark.parametrize("order", [[0, 1, 2, 3], [0, 2, 1, 3], [3, 0, 2, 1]])
def test_state_machine_equals_replay_in_any_order_and_after_a_restart(spark, split, tmp_path, order):
    root, files = split
    own = tmp_path / "data"
    shutil.copytree(root, own, ignore=shutil.ignore_patterns("events.parquet"))
    known = [files[i] for i in order if i < len(files)]
    for n, frame in enumerate(known):
        _deliver(own, frame, n)
        if n in (1, len(known) - 1):  # two files, a stop, a restart with the rest; one file a batch
            sj.run_state_machine(spark, str(own), max_files=1, out=str(tmp_path / "out"))
    got = sorted(map(tuple, sj.current_actions(spark, str(tmp_path / "out")).collect()), key=repr)
    ids = {r[0] for r in got}
    want = [r for r in _actions(spark, own) if r[0] in ids]
    assert got == want and len(got) > 50


def test_poll_goes_on_after_a_restart(spark, split, tmp_path):
    root, files = split
    own, out = tmp_path / "data", str(tmp_path / "out")
    shutil.copytree(root, own, ignore=shutil.ignore_patterns("events.parquet"))
    hist, seen = None, []
    for n, frame in enumerate(files):
        _deliver(own, frame, n)
        now = frame.ts.max().to_pydatetime()
        run = Run(spark, str(own))
        assert run.now == now
        ref = al.alert_blocking(run, "duration", WEEK, history=hist)
        hist = spark.createDataFrame(ref.history.collect(), ref.history.schema)
        path = sj.run_poll(spark, str(own), WEEK, out=out, max_files=1)
        got = spark.read.parquet(path)
        key = lambda df: sorted(map(tuple, df.select("instance", "alert_id", "last_occurrence", "last_value", "status").collect()), key=repr)
        assert key(got) == key(hist)
        seen.append(spark.read.parquet(f"{out}/outbox").count())
    assert seen == sorted(seen) and seen[-1] > 0
    assert {"send", "reason", "body"} <= set(spark.read.parquet(f"{out}/outbox").columns)
    before = len(sinks.folders(spark, f"{out}/events", "epoch="))
    live, index = (sinks.folders(spark, f"{out}/{p}", "epoch=") for p in (f"live/minutes={WEEK}", "index"))
    assert live == index and len(live) == 2  # the last poll's and, for its repeat, the one's before
    rows, ids = spark.read.parquet(f"{out}/live/minutes={WEEK}/{live[-1]}"), spark.read.parquet(f"{out}/index/{index[-1]}")
    ev = spark.read.parquet(str(own / "events*.parquet"))
    now = ev.agg(F.max("ts")).first()[0]
    assert rows.count() == ev.filter(F.col("ts") >= F.lit(now - dt.timedelta(minutes=WEEK)).cast("timestamp_ntz")).count() < ev.count()
    assert dict(map(tuple, ids.collect())) == dict(map(tuple, ev.groupBy("user_id").agg(F.max("ts")).collect()))
    sj.run_poll(spark, str(own), WEEK, out=out)  # nothing new: nothing is evaluated again
    assert len(sinks.folders(spark, f"{out}/events", "epoch=")) == before == len(files)


def test_rate_window_drops_late_rows_and_keeps_the_rest(spark, split, tmp_path):
    root, files = split
    own, out = tmp_path / "data", str(tmp_path / "out")
    shutil.copytree(root, own, ignore=shutil.ignore_patterns("events.parquet"))
    for n, frame in enumerate(files):
        _deliver(own, frame, n)
        sj.run_rate_window(spark, str(own), out=out, max_files=1)
    rates = sj.current_rates(spark, out)
    waits = Run(spark, str(own)).tm.waits().filter("is_critical_wait")
    assert rates.agg(F.sum("n")).first()[0] == waits.count()
    late = files[0].copy()
    late["event_id"] += 10_000_000
    _deliver(own, late, 99)
    sj.run_rate_window(spark, str(own), out=out, max_files=1)
    assert sj.current_rates(spark, out).agg(F.sum("n")).first()[0] == rates.agg(F.sum("n")).first()[0]


def test_poll_stores_carry_on_over_repeats_and_other_lookbacks(spark, tmp_path):
    out, t0 = str(tmp_path), dt.datetime(2024, 1, 1)

    def batch(epoch, rows, minutes=60):
        df = spark.createDataFrame([(u, None if m is None else t0 + dt.timedelta(minutes=m)) for u, m in rows], "user_id long, ts timestamp_ntz")
        sj._add(df, f"{out}/events", epoch)
        now, events, index = sj._carry_on(spark, out, epoch, minutes)
        key = lambda df: sorted((r[0], None if r[1] is None else int((r[1] - t0).total_seconds() // 60)) for r in df.collect())
        return None if now is None else int((now - t0).total_seconds() // 60), key(events), key(index)

    assert batch(0, [(1, None)]) == (None, [], [(1, None)])
    assert batch(1, [(1, 0), (2, 30)]) == (30, [(1, 0), (2, 30)], [(1, 0), (2, 30)])
    third = (80, [(1, 20), (2, 30), (3, 80)], [(1, 20), (2, 30), (3, 80)])
    assert batch(3, [(3, 80), (1, 20)]) == third  # the second batch was empty
    assert batch(3, [(3, 80), (1, 20)]) == third  # repeated after a failure
    assert batch(4, [(1, 85)], 120)[:2] == (85, [(1, 0), (1, 20), (1, 85), (2, 30), (3, 80)])  # a longer lookback: all received
    assert batch(5, [(2, 100)])[:2] == (100, [(1, 85), (2, 100), (3, 80)])  # the shorter one again, which missed a batch
    assert batch(6, [(4, 1)])[:2] == (100, [(1, 85), (2, 100), (3, 80)])  # late beyond the lookback
