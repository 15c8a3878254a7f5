"""Delivery log: receipts once, failed tries again, event log rows once, runs that race or die between the logs."""

import datetime as dt
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tripwire.operators.render import OK_STATUS
from tripwire.plans import jobs
from tripwire.sources import deliveries as dl
from tripwire.sources import sinks

BAD = "Status: 500 (Internal Server Error)"
RECEIPT = "message_id string, attempt int, delivered_at timestamp_ntz, status string, response string"
OUTBOX = ("alert_name string, alert_type int, channel string, audience string, recipient string, subject string, body string, "
          "instances string, send boolean, reason string")
T0 = dt.datetime(2024, 1, 2, 3, 4)


def _store(spark, out, run, rows, at=T0):
    sinks.write_outbox(spark.createDataFrame(rows, OUTBOX), f"{out}/outbox", run, at)


def _row(n, channel="webhook", send=True, body="b"):
    return (f"Alert {n}", 1, channel, "ops", f"https://hooks.example.com/{n}", None, body, "i", send, "sent" if send else "muted")


def _receipts(spark, rows):
    return spark.createDataFrame(rows, RECEIPT)


def _pending(spark, paths):
    return {(r.alert_name, r.attempt): r.message_id for r in spark.read.parquet(paths["pending"]).collect()}


def test_failed_messages_are_tried_again_until_they_arrive_or_run_out(spark, tmp_path):
    out = str(tmp_path)
    _store(spark, out, "1", [_row(1), _row(2), _row(3, "email"), _row(4, send=False)])
    first = _pending(spark, jobs.run_deliveries(spark, out))
    assert set(first) == {("Alert 1", 1), ("Alert 2", 1), ("Alert 3", 1)}
    ids = {name: i for (name, _), i in first.items()}
    got = _receipts(spark, [(ids["Alert 1"], 1, T0, OK_STATUS, "ok"), (ids["Alert 2"], 1, T0, BAD, None), (ids["Alert 3"], 1, T0, None, "x"),
                            (None, 1, T0, BAD, "no id"), (ids["Alert 2"], None, T0, BAD, "no attempt"), ("unknown", 1, T0, BAD, "?")])
    paths = jobs.run_deliveries(spark, out, got)
    assert set(_pending(spark, paths)) == {("Alert 2", 2), ("Alert 3", 2)}
    events = dl.appended(spark, paths["event_log"]).collect()
    assert [(e.message_id, e.event_type) for e in events] == [(ids["Alert 2"], "ERROR")]  # the failed mail is no webhook
    assert "Alert 2" in events[0].event_text and "Payload: b" in events[0].event_text
    paths = jobs.run_deliveries(spark, out, _receipts(spark, [(ids["Alert 2"], 2, T0, BAD, ""), (ids["Alert 2"], 3, T0, BAD, ""),
                                                              (ids["Alert 3"], 2, T0, OK_STATUS, "")]))
    assert _pending(spark, paths) == {}
    status = {r.alert_name: r for r in dl.delivery_status(dl.stored_messages(spark, out), dl.appended(spark, paths["deliveries"])).collect()}
    assert [(status[f"Alert {n}"].attempts, status[f"Alert {n}"].failed, status[f"Alert {n}"].delivered) for n in (1, 2, 3)] == [
        (1, 0, True), (3, 3, False), (2, 1, True)]


def test_a_repeated_run_adds_nothing(spark, tmp_path):
    out = str(tmp_path)
    _store(spark, out, "1", [_row(1), _row(1), _row(2)])
    _store(spark, out, "2", [_row(2), _row(1)])  # the same evaluation again
    _store(spark, out, "3", [_row(1)], T0 + dt.timedelta(days=1))  # another one
    ids = _pending(spark, jobs.run_deliveries(spark, out))
    assert dl.stored_messages(spark, out).count() == 3
    got = _receipts(spark, [(i, 1, T0, BAD, r) for i in ids.values() for r in ("late", "early")])
    a = jobs.run_deliveries(spark, out, got)
    rows = [sorted(map(tuple, dl.appended(spark, a[k]).collect())) for k in ("deliveries", "event_log")]
    assert list(map(len, rows)) == [len(ids)] * 2 and all("early" in r for r in rows[0])
    b = jobs.run_deliveries(spark, out, got.union(got))
    assert rows == [sorted(map(tuple, dl.appended(spark, b[k]).collect())) for k in ("deliveries", "event_log")]
    assert _pending(spark, a) == _pending(spark, b)


def test_a_run_that_died_between_the_logs_is_made_whole(spark, tmp_path):
    out = str(tmp_path)
    _store(spark, out, "1", [_row(1)])
    ids = list(_pending(spark, jobs.run_deliveries(spark, out)).values())
    got = _receipts(spark, [(ids[0], 1, T0, BAD, "x")])
    dl.append_once(dl.log_entries(dl.stored_messages(spark, out), got), f"{out}/deliveries", dl.TRY)
    assert dl.appended(spark, f"{out}/event_log") is None
    jobs.run_deliveries(spark, out, got)
    assert dl.appended(spark, f"{out}/deliveries").count() == dl.appended(spark, f"{out}/event_log").count() == 1


def test_runs_that_race_lose_and_double_nothing(spark, tmp_path):
    base = f"{tmp_path}/log"

    def add(n):
        rows = spark.range(n, n + 10).select(F.col("id").cast("string").alias("message_id"), F.lit(1).alias("attempt"),
                                             F.lit(T0.date()).alias("day"))
        return dl.append_once(rows, base, dl.TRY)

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(add, (0, 5, 10, 15)))
    assert sorted(int(r.message_id) for r in dl.appended(spark, base).collect()) == list(range(25))
    assert not add(3)


def test_only_the_days_of_new_rows_are_read_again(spark, tmp_path):
    base = f"{tmp_path}/log"
    rows = lambda day: spark.range(3).select(F.lit("m").alias("message_id"), F.col("id").cast("int").alias("attempt"), F.lit(day).alias("day"))
    assert dl.append_once(rows(dt.date(2024, 1, 1)), base, dl.TRY)
    assert dl.append_once(rows(dt.date(2024, 1, 2)), base, dl.TRY)  # ids hold their day, so days share no id
    assert dl.appended(spark, base).count() == 6


def test_nothing_to_do(spark, tmp_path):
    out = str(tmp_path)
    assert "pending" not in jobs.run_deliveries(spark, out, _receipts(spark, [("m", 1, T0, BAD, "x")]))
    _store(spark, out, "1", [])
    paths = jobs.run_deliveries(spark, out, _receipts(spark, []))
    assert _pending(spark, paths) == {} and dl.appended(spark, paths["deliveries"]) is None


def test_messages_of_a_job_reach_the_sender(spark, tmp_path):
    out = str(tmp_path)
    jobs.run_job(spark, "blocking-duration", SF_SMALL, out, 7 * 24 * 60)
    sent = spark.read.parquet(f"{out}/outbox").filter("send").count()
    got = _pending(spark, jobs.run_deliveries(spark, out))
    assert sent > 0 and spark.read.parquet(f"{out}/pending").count() == sent and len(set(got.values())) <= sent
