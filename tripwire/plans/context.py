"""One evaluation run: input tables, telemetry bindings, config and the evaluation time."""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from tripwire.session import apply_session_conf, materialized
from tripwire.sources.bindings import Telemetry
from tripwire.sources.config import Config
from tripwire.sources.tables import Tables


class Run:
    """Everything a job needs for one (session, data directory) at one evaluation time.

    `now` is the explicit evaluation time: no fact, anchor or collection date after it is seen,
    and nothing in the jobs reads the wall clock, so a run can be replayed over history and
    compared against the SQL oracle. Without it the latest event (or, for lineitem-based
    telemetry, the latest ship date) is the evaluation time. One explicit `now` serves both
    clocks unless `li_now` names the second one.

    `config` names the config and state tables (see sources/config.py). With `reuse` a job's
    evaluated rows are written once to the shared folder and read by all its outputs. `anchors` names the
    folder of the maintained collection dates: a run at the latest time then reads only files new to it.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, now: dt.datetime | None = None,
                 tables: Tables | None = None, li_now: dt.datetime | None = None,
                 config: "str | dict[str, DataFrame] | None" = None, reuse: bool = False, anchors: str | None = None):
        apply_session_conf(spark)
        self.spark = spark
        self.sf_dir = sf_dir
        self.tables = tables if tables is not None else Tables(spark, sf_dir)
        self._now, self._li_now = now, li_now if li_now is not None else now
        self.tm = Telemetry(self.tables, self._now, self._li_now, anchors)
        self._config, self._reuse = config, reuse

    @cached_property
    def now(self) -> dt.datetime:
        """Evaluation time of event-based telemetry (the latest event, unless given)."""
        return self._now if self._now is not None else self.tables.events_now()

    @cached_property
    def li_now(self) -> dt.datetime:
        """Evaluation time of lineitem-based telemetry (the latest ship date, unless given)."""
        return self._li_now if self._li_now is not None else self.tables.lineitem_now()

    def keep(self, df: DataFrame) -> DataFrame:
        """The frame, written once where several outputs of this run read it."""
        return materialized(df) if self._reuse else df

    @cached_property
    def instances(self) -> DataFrame:
        return self.tm.instances()

    def targets(self, tag: tuple[str, str] | None = None) -> DataFrame:
        """Instances the job runs for: all, or those carrying the tag (case-insensitive)."""
        if tag is None or tag[0] is None or tag[1] is None:
            return self.instances
        from tripwire.plans.tags import matching_instances
        return matching_instances(self.instances, self.tm.instance_tags(), *tag)

    @cached_property
    def cfg(self) -> Config:
        return Config(self.spark, self.instances, self.now, self._config)
