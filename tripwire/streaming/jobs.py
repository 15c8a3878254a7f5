"""Structured Streaming drivers for the alert jobs; every stream can stop and start again.

* `run_poll`: each micro-batch of new telemetry is one poll of the blocking alert. Two small stores go
  on from poll to poll: the events that the lookback can still reach, and the latest event of every
  instance. The alert is evaluated on them as of the latest event, the gated outbox is written, and the
  alert's history goes on as a versioned snapshot that the next poll, also one after a restart, reads
  from storage. What a poll reads depends on the lookback and the instances, not on the polls before it.
* `run_state_machine`: the ON/OFF action of every CPU sample. A batch is replayed together with the
  stored samples of its instances from the day of their earliest new sample on; what came before is
  one small summary per instance and day. Late samples therefore correct the actions after them.
* `run_rate_window`: critical-wait totals per (window, instance, wait type) in update mode: a
  watermark drops late rows and frees the state of closed windows, and each batch adds the
  windows that it changed.

Each stream keeps outputs and checkpoint under `out`. The same `out` resumes the stream; without one
a fresh folder under the cluster's checkpoint directory is used. Batches write into folders of their
own number, so a batch that is repeated after a failure replaces its first attempt. `max_files`
bounds the files of one batch.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tripwire.operators import render as rd
from tripwire.operators import routing as rt
from tripwire.operators import state as st
from tripwire.operators import thresholds as th
from tripwire.plans import alerts as al
from tripwire.plans.context import Run
from tripwire.session import checkpoint_dir, materialized
from tripwire.sources import sinks
from tripwire.sources.bindings import cpu_percent
from tripwire.sources.tables import Tables


def run_folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"


def table_stream(spark: SparkSession, sf_dir: str, table: str, max_files: int | None = None) -> DataFrame:
    """A table's Parquet files (a file or a folder of files) as a file stream, schema from the batch reader."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    r = spark.readStream.schema(schema).option("basePath", sf_dir)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(f"{sf_dir}/{table}*.parquet")


def _drain(stream, sink, out: str, mode: str = "append") -> None:
    q = (stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{out}/_chk")
         .trigger(availableNow=True).start())
    q.awaitTermination()


def _epochs(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """All complete batches under `path` (numbers below `before`, where given), with their number."""
    names = [n for n in sinks.folders(spark, path, "epoch=") if before is None or int(n[6:]) < before]
    return spark.read.option("basePath", path).parquet(*[f"{path}/{n}" for n in names]) if names else None


def _add(df: DataFrame, path: str, epoch: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/epoch={epoch:09d}")


def _newest(df: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the row of the latest batch."""
    rest = [c for c in df.columns if c not in keys and c != "epoch"]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("_r")).select(*keys, "_r.*")


# ---------------------------------------------------------------------------------------
# one poll per micro-batch
# ---------------------------------------------------------------------------------------
class _Stored(Tables):
    """Input tables where `events` is what a lookback can reach of the stream and `index` names every instance received."""

    def __init__(self, spark: SparkSession, root: str, events: DataFrame, index: DataFrame):
        super().__init__(spark, root)
        self._frames["events"] = events
        self._index = index

    def event_instances(self) -> DataFrame:
        return self._index.select(F.col("instance_id").alias("c_custkey"))


def _store(spark: SparkSession, path: str, epoch: int) -> DataFrame:
    return spark.read.parquet(f"{path}/epoch={epoch:09d}")


def _carry_on(spark: SparkSession, out: str, epoch: int, minutes: int):
    """Bring both stores to this batch: (evaluation time, events within the lookback of it, latest event per instance).

    The evaluation time never falls, so an event that is older than the lookback now will not be seen again. Where the
    poll before kept no events for this lookback (the first poll, another lookback than before), they are taken from all
    that was received. A repeated batch starts from the same earlier stores and replaces its own.
    """
    live, index = f"{out}/live/minutes={minutes}", f"{out}/index"
    name = sinks.newest(spark, index, "epoch=", epoch)
    batch = _store(spark, f"{out}/events", epoch)
    known = name is not None and sinks.newest(spark, live, "epoch=", epoch) == name
    events = batch.unionByName(spark.read.parquet(f"{live}/{name}")) if known else _epochs(spark, f"{out}/events", epoch + 1).drop("epoch")
    seen = (batch if name is not None else events).groupBy(F.col("user_id").alias("instance_id")).agg(F.max("ts").alias("last"))
    if name is not None:
        seen = seen.unionByName(spark.read.parquet(f"{index}/{name}")).groupBy("instance_id").agg(F.max("last").alias("last"))
    _add(seen, index, epoch)
    seen = _store(spark, index, epoch)
    now = seen.agg(F.max("last")).first()[0]  # one value
    since = None if now is None else now - dt.timedelta(minutes=minutes)
    _add(events.filter(F.col("ts") >= F.lit(since).cast("timestamp_ntz")), live, epoch)
    if name is not None:
        for path in (live, index):  # the poll before stays, for a repeat of this one
            sinks.drop_older(spark, path, "epoch=", name)
    return now, _store(spark, live, epoch), seen


def run_poll(spark: SparkSession, sf_dir: str, minutes: int, metric: str = "duration", out: str | None = None,
             max_files: int | None = None, config=None) -> str:
    """Run the blocking alert once per micro-batch; returns the folder of the latest history.

    <out>/events holds the received events (written, not read again), <out>/live and <out>/index the two stores,
    <out>/outbox the gated messages of each poll and <out>/history/alert=<id> the history after each poll.
    A batch is evaluated from the first one on that has an event with a time.
    """
    out = out or run_folder(spark, "poll")

    def poll(batch: DataFrame, epoch: int) -> None:
        if batch.isEmpty():
            return
        _add(batch, f"{out}/events", epoch)
        now, events, index = _carry_on(spark, out, epoch, minutes)
        if now is None:
            return
        run = Run(spark, sf_dir, now=now, tables=_Stored(spark, sf_dir, events, index), config=config, reuse=True)
        aid = run.cfg.alert(al.BLOCKING[metric][0])["alert_id"]
        stored = sinks.alert_history(spark, f"{out}/history", aid, before=epoch)
        res = al.alert_blocking(run, metric, minutes, history=run.cfg.history if stored is None else stored)
        view = rt.all_alerts_view(run.cfg.alerts, run.cfg.environment, run.cfg.overrides, run.cfg.levels, run.cfg.webhooks)
        _add(rd.outbox(res.messages, view, run.cfg.blackouts, now), f"{out}/outbox", epoch)
        # the first poll also hands on the other alerts' rows that the config's history has
        sinks.write_snapshot(res.history, f"{out}/history/alert={aid}", epoch)

    _drain(table_stream(spark, sf_dir, "events", max_files), poll, out)
    base = f"{out}/history"
    alert = sinks.folders(spark, base, "alert=", complete=False)[-1]
    return f"{base}/{alert}/{sinks.newest(spark, f'{base}/{alert}', 'v=')}"


# ---------------------------------------------------------------------------------------
# ON/OFF actions per sample
# ---------------------------------------------------------------------------------------
def run_state_machine(spark: SparkSession, sf_dir: str, alert_id: int = 3, max_files: int | None = None,
                      out: str | None = None, config=None) -> str:
    """Actions of the CPU series under <out>/actions (read them with `current_actions`)."""
    out = out or run_folder(spark, "state")
    run = Run(spark, sf_dir, config=config)
    limits = materialized(th.resolve_threshold(run.instances.select("instance_id"), run.cfg.overrides, run.cfg.alerts, alert_id)
                          .select("instance_id", F.col("threshold").try_cast("int").alias("threshold")))
    sample = ["instance_id", "event_time", "event_id", "total_cpu", "threshold"]
    breach = F.col("total_cpu") >= F.col("threshold")

    def advance(batch: DataFrame, epoch: int) -> None:
        new = materialized(batch.join(limits, "instance_id").select(*sample, F.to_date("event_time").alias("day")))
        if new.isEmpty():
            return
        start = materialized(new.groupBy(F.col("instance_id").alias("_i")).agg(F.min("day").alias("_from")))
        first = start.agg(F.min("_from")).first()[0]  # prunes the stored days of all instances
        again, before = new.select(*sample, "day"), None
        stored, days = _epochs(spark, f"{out}/actions", epoch), _epochs(spark, f"{out}/days", epoch)
        if stored is not None:
            old = _newest(stored.filter(F.col("day") >= F.lit(first)).drop("action"), ["instance_id", "event_id"])
            old = old.join(start, (F.col("instance_id") == F.col("_i")) & (F.col("day") >= F.col("_from")))
            again = old.select(*sample, "day").unionByName(again)
            past = _newest(days, ["instance_id", "day"]).join(start, (F.col("instance_id") == F.col("_i")) & (F.col("day") < F.col("_from")))
            before = past.groupBy("instance_id").agg(
                F.max_by("last", F.when(F.col("last").isNotNull(), F.col("day"))).alias("last"), F.max("some").alias("some"))
        again = materialized(again)
        samples = again.withColumn("br", breach).withColumn("real", F.lit(True))
        if before is not None:  # what came before, as one or two samples at the beginning of time
            seeds = before.select("instance_id", F.explode(F.array(F.struct(F.lit(0).alias("n"), F.col("some").alias("br")),
                                                                   F.struct(F.lit(1).alias("n"), F.col("last").alias("br")))).alias("s"))
            empty = {c: F.lit(None).cast(again.schema[c].dataType) for c in ("total_cpu", "threshold", "day")}
            seeds = seeds.select("instance_id", F.lit("1900-01-01").cast("timestamp_ntz").alias("event_time"),
                                 F.col("s.n").cast("long").alias("event_id"), F.col("s.br").alias("br"), F.lit(False).alias("real"))
            samples = samples.unionByName(seeds.withColumns(empty))
        acted = st.state_replay(samples, "instance_id", "event_time", "event_id", F.col("br")).filter("real")
        _add(acted.select(*sample, "action", "day"), f"{out}/actions", epoch)
        flagged = F.when(breach.isNotNull(), F.struct("event_time", "event_id"))
        _add(again.groupBy("instance_id", "day").agg(F.max_by(breach, flagged).alias("last"), F.max(breach).alias("some")), f"{out}/days", epoch)

    ev = table_stream(spark, sf_dir, "events", max_files)
    cpu = ev.filter(F.col("event_type") == "view").select(
        F.col("user_id").alias("instance_id"), F.col("ts").alias("event_time"), "event_id", cpu_percent(F.col("value")).alias("total_cpu"))
    _drain(cpu, advance, out)
    return out


def current_actions(spark: SparkSession, out: str) -> DataFrame:
    """The action of every sample received so far."""
    return _newest(_epochs(spark, f"{out}/actions"), ["instance_id", "event_id"]).select(
        "instance_id", "event_time", "event_id", "total_cpu", "threshold", "action")


# ---------------------------------------------------------------------------------------
# windowed critical-wait rate with a watermark
# ---------------------------------------------------------------------------------------
def run_rate_window(spark: SparkSession, sf_dir: str, window: str = "1 day", watermark: str = "1 hour",
                    out: str | None = None, max_files: int | None = None) -> str:
    """Critical-wait totals per (window, instance, wait type) under <out>/rates (`current_rates`).

    A row later than `watermark` behind the latest event of the earlier batches is dropped."""
    out = out or run_folder(spark, "rate")
    ev = table_stream(spark, sf_dir, "events", max_files)
    waits = ev.filter(F.col("event_type").isin("error", "purchase")).select(
        # watermarks need a session-zone timestamp; the session zone is UTC so wall clock is unchanged
        F.col("user_id").alias("instance_id"), F.col("ts").cast("timestamp").alias("snapshot_date"),
        F.col("event_type").alias("wait_type"),
        F.col("value").cast("decimal(18,2)").alias("wait_time_ms"),
        (F.regexp_extract(F.col("props"), "([0-9]+)", 1).cast("int") + 1).alias("sample_ms_diff"))
    agg = (waits.withWatermark("snapshot_date", watermark)
           .groupBy(F.window("snapshot_date", window).alias("w"), "instance_id", "wait_type")
           .agg(F.count(F.lit(1)).alias("n"), F.sum("wait_time_ms").alias("total_wait_ms"),
                F.sum("sample_ms_diff").alias("total_sample_ms")))

    def sink(batch: DataFrame, epoch: int) -> None:
        _add(batch.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "instance_id", "wait_type", "n",
                          "total_wait_ms", "total_sample_ms"), f"{out}/rates", epoch)

    _drain(agg, sink, out, "update")
    return out


def current_rates(spark: SparkSession, out: str) -> DataFrame:
    """The latest totals of every window."""
    return _newest(_epochs(spark, f"{out}/rates"), ["window_start", "instance_id", "wait_type"])
