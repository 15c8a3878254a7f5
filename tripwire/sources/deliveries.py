"""Delivery log: what became of the outbox messages, and which of them a sender has to try (again).

Sending is a sender's work outside Spark. It takes the rows of <out>/pending, tries each once and leaves one receipt per
try: message_id, attempt (as given in the pending row), delivered_at, status, response. `run_deliveries` in plans/jobs.py
joins receipts to the outbox, adds them to the log, adds an event per failed webhook try to the event log and lists what
is to be sent next.

Both logs are append-only: a commit adds one folder of rows whose keys the log lacks (`append_once`), so a repeated run or
a receipt that arrives twice adds nothing. Of two different receipts for one try the earlier counts, then the smaller
status and response. A receipt without message_id or attempt, or one that names no outbox message, is no delivery.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tripwire.operators.render import OK_STATUS, failed_delivery_events
from tripwire.session import materialized
from tripwire.sources import sinks

MESSAGE = ["alert_name", "alert_type", "channel", "audience", "recipient", "subject", "body", "instances", "run_at"]
TRY = ["message_id", "attempt"]


def with_message_id(outbox: DataFrame) -> DataFrame:
    """Outbox rows with message_id (what the message says and the evaluation it belongs to) and day, each message once.

    A job that is run again for the same evaluation writes the same messages into another folder: they keep their ids.
    """
    keyed = outbox.select(*MESSAGE, "send", F.sha2(F.to_json(F.struct(*MESSAGE)), 256).alias("message_id"))
    rest = [c for c in MESSAGE if c != "run_at"]
    once = keyed.groupBy("message_id", "run_at").agg(F.max("send").alias("send"), *[F.first(c).alias(c) for c in rest])  # equal in a group
    return once.withColumn("day", F.to_date("run_at"))


def stored_messages(spark: SparkSession, out: str, since: dt.date | None = None) -> DataFrame | None:
    """The messages of all runs under <out>/outbox (of evaluations from `since` on), or None before the first run."""
    if not sinks.folders(spark, f"{out}/outbox", "run=", complete=False):
        return None
    rows = spark.read.parquet(f"{out}/outbox")
    return with_message_id(rows if since is None else rows.filter(F.col("run_at") >= F.lit(since).cast("timestamp_ntz")))


def log_entries(messages: DataFrame, receipts: DataFrame) -> DataFrame:
    """One log row per (message, attempt) that has a receipt."""
    tries = receipts.filter(F.col("message_id").isNotNull() & F.col("attempt").isNotNull()).select(
        "message_id", F.col("attempt").cast("int").alias("attempt"),
        F.struct("delivered_at", F.coalesce("status", F.lit("Status: unknown")).alias("status"),
                 F.coalesce("response", F.lit("")).alias("response")).alias("r"))
    one = tries.groupBy(*TRY).agg(F.min("r").alias("r"))
    said = messages.select("message_id", "day", "run_at", "alert_name", "channel", "recipient", F.coalesce("body", F.lit("")).alias("body"))
    return one.join(said, "message_id").select(*TRY, "day", "run_at", "alert_name", "channel", "recipient", "body", "r.*")


def failure_events(entries: DataFrame) -> DataFrame:
    """Event-log rows of failed webhook tries, with the try's key."""
    return failed_delivery_events(entries.filter(F.col("channel") == "webhook"), keep=[*TRY, "day"])


def appended(spark: SparkSession, base: str) -> DataFrame | None:
    """All rows of an append-only log, or None when there are none."""
    return _read(spark, base, _commits(spark, base))


def append_once(rows: DataFrame, base: str, keys: list[str], tries: int = 50) -> bool:
    """Add the rows whose keys the log lacks as one commit; False when there is none. Rows are unique by key.

    Only log rows of the new rows' days are read again. A run that loses the race for a commit number looks at the rows
    which the winner added and tries again; one that dies before its commit leaves a folder that no commit names.
    """
    spark = rows.sparkSession
    rows = materialized(rows)
    first, last = rows.agg(F.min("day"), F.max("day")).first()
    if first is None:
        return False
    for _ in range(tries):
        names = _commits(spark, base)
        old, new = _read(spark, base, names), rows
        if old is not None:
            new = rows.join(old.filter(F.col("day").between(F.lit(first), F.lit(last))).select(*keys), keys, "left_anti")
        if new.isEmpty():
            return False
        folder = f"data-{uuid.uuid4().hex}"
        new.write.parquet(f"{base}/{folder}")
        if sinks.put_if_absent(spark, f"{base}/commits/{len(names) + 1:09d}", folder):
            return True
    raise RuntimeError(f"{tries} commits to {base} met newer ones")


def _commits(spark: SparkSession, base: str) -> list[str]:
    return [n for n in sinks.folders(spark, f"{base}/commits", "", complete=False) if n.isdigit()]


def _read(spark: SparkSession, base: str, names: list[str]) -> DataFrame | None:
    if not names:
        return None
    parts = spark.read.text([f"{base}/commits/{n}" for n in names]).collect()  # one folder name per commit
    return spark.read.parquet(*[f"{base}/{p.value}" for p in parts])


def delivery_status(messages: DataFrame, log: DataFrame | None, max_attempts: int = 3) -> DataFrame:
    """Messages to be sent with attempts, failed, delivered, last_response and, where a try is due, next_attempt.

    A try is due while no try was answered with the OK status and fewer than `max_attempts` were made."""
    m = messages.filter("send")
    if log is None:
        none = {"attempts": "long", "failed": "long", "last_attempt": "int", "delivered": "boolean", "last_response": "string"}
        m = m.withColumns({c: F.lit(None).cast(t) for c, t in none.items()})
    else:
        ok: Column = F.col("status") == OK_STATUS
        m = m.join(log.groupBy("message_id").agg(
            F.count(F.lit(1)).alias("attempts"), F.count_if(~ok).alias("failed"), F.max("attempt").alias("last_attempt"),
            F.bool_or(ok).alias("delivered"), F.max_by("response", "attempt").alias("last_response")), "message_id", "left")
    m = m.withColumns({"attempts": F.coalesce("attempts", F.lit(0).cast("long")), "failed": F.coalesce("failed", F.lit(0).cast("long")),
                       "delivered": F.coalesce("delivered", F.lit(False))})
    due = ~F.col("delivered") & (F.col("attempts") < max_attempts)
    return m.withColumn("next_attempt", F.when(due, F.coalesce("last_attempt", F.lit(0)) + 1)).drop("last_attempt")


def pending(messages: DataFrame, log: DataFrame | None, max_attempts: int = 3) -> DataFrame:
    """What a sender has to try next: new messages and failed ones that have tries left."""
    rows = delivery_status(messages, log, max_attempts).filter(F.col("next_attempt").isNotNull())
    return rows.select("message_id", F.col("next_attempt").alias("attempt"), *MESSAGE)
