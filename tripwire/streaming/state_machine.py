"""ON/OFF actions per sample from keyed state: nothing that was received before is read again.

State per instance (RocksDB): the machine at the watermark (last flag, whether any sample breached) and the samples after
it, each with the action that was last emitted. A batch adds its samples, replays the ones after the watermark in time
order and emits an action for every new sample and for every stored one whose action a late sample has changed. What
the watermark has passed is folded into the machine and leaves the state; a timer does that for instances that have
gone quiet. So state and work per batch follow the watermark's delay, not the length of the history.

A sample that is later than `delay` behind the latest one of the earlier batches is dropped, as in any watermarked
aggregation (`jobs.run_state_machine` takes samples of any age and re-reads the days after them).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor

from tripwire.operators import thresholds as th
from tripwire.plans.context import Run
from tripwire.session import materialized
from tripwire.sources.bindings import cpu_percent
from tripwire.streaming import jobs

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "instance_id long, at long, event_id long, total_cpu int, threshold int, action string"


def step(machine: "tuple[bool | None, bool]", breach: "bool | None") -> "tuple[tuple[bool | None, bool], str | None]":
    """(machine, action) after a sample; a sample without a flag has no action and changes nothing."""
    last, some = machine
    if breach is None:
        return machine, None
    if not some:
        action = "NEW->ON" if breach else "IGNORE"
    else:
        action = "IGNORE" if last == breach else "OFF->ON" if breach else "ON->OFF"
    return (breach, some or breach), action


class OnOffMachine(StatefulProcessor):
    def init(self, handle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", "last boolean, some boolean")
        self.pending = handle.getMapState("pending", "at long, event_id long", "total_cpu int, threshold int, action string")

    def handleInputRows(self, key, rows, timerValues):
        known = {tuple(k): tuple(v) for k, v in self.pending.iterator()}
        fresh = {}
        for pdf in rows:
            for at, event, cpu, limit in zip(pdf["at"], pdf["event_id"], pdf["total_cpu"], pdf["threshold"]):
                fresh[int(at), int(event)] = tuple(None if pd.isna(x) else int(x) for x in (cpu, limit))
        machine, out = self._machine(), []
        for at in sorted({*known, *fresh}):
            cpu, limit = fresh[at] if at in fresh else known[at][:2]
            machine, action = step(machine, None if cpu is None or limit is None else cpu >= limit)
            if at in fresh or known[at][2] != action:
                self.pending.updateValue(at, (cpu, limit, action))
                out.append((key[0], *at, cpu, limit, action))
            known[at] = (cpu, limit, action)
        self._settle(known, timerValues.getCurrentWatermarkInMs())
        if out:
            yield pd.DataFrame(dict(zip(("instance_id", "at", "event_id", "total_cpu", "threshold", "action"), map(list, zip(*out)))), dtype=object)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self._settle({tuple(k): tuple(v) for k, v in self.pending.iterator()}, timerValues.getCurrentWatermarkInMs())
        return iter(())

    def close(self) -> None:
        pass

    def _machine(self):
        return tuple(self.settled.get()) if self.settled.exists() else (None, False)

    def _settle(self, known: dict, watermark_ms: int) -> None:
        """Fold samples up to the watermark into the machine; wake up when the rest has been passed."""
        machine, done = self._machine(), [at for at in sorted(known) if at[0] <= watermark_ms * 1000]
        for at in done:
            cpu, limit, _ = known[at]
            machine, _ = step(machine, None if cpu is None or limit is None else cpu >= limit)
            self.pending.removeKey(at)
        if done:
            self.settled.update(machine)
        if len(done) < len(known):
            self.handle.registerTimer(max(known)[0] // 1000 + 1)


def run_keyed_state_machine(spark: SparkSession, sf_dir: str, delay: str = "1 day", alert_id: int = 3, max_files: int | None = None,
                            out: str | None = None, config=None) -> str:
    """Actions of the CPU series under <out>/actions, one folder per batch (read them with `jobs.current_actions`)."""
    out = out or jobs.run_folder(spark, "keyed-state")
    run = Run(spark, sf_dir, config=config)
    limits = materialized(th.resolve_threshold(run.instances.select("instance_id"), run.cfg.overrides, run.cfg.alerts, alert_id)
                          .select("instance_id", F.col("threshold").try_cast("int").alias("threshold")))
    events = jobs.table_stream(spark, sf_dir, "events", max_files).filter(F.col("event_type") == "view")
    samples = events.select(F.col("user_id").alias("instance_id"), F.col("ts").cast("timestamp").alias("event_time"),
                            F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id", cpu_percent(F.col("value")).alias("total_cpu"))
    samples = samples.withWatermark("event_time", delay).join(limits, "instance_id")
    acted = samples.groupBy("instance_id").transformWithStateInPandas(OnOffMachine(), OUT, "Update", "EventTime")

    def sink(batch: DataFrame, epoch: int) -> None:
        jobs._add(batch.select("instance_id", F.timestamp_micros("at").cast("timestamp_ntz").alias("event_time"), "event_id",
                               "total_cpu", "threshold", "action"), f"{out}/actions", epoch)

    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)  # a running query keeps the settings of its start
    try:
        jobs._drain(acted, sink, out, "update")
    finally:
        spark.conf.set(name, before)
    return out
