"""Alerting configuration and state tables.

The config tables are small and owned by the alerting system (alerts, overrides, blackouts,
webhooks, environments, levels, parameters). They are built with an explicit schema; their
row count is known on the driver, which is the size bound that allows broadcasting them.

Parts of the config that grow with the fleet (instance-level overrides, alert history) are
derived from the telemetry in `derived_*` so the jobs are exercised at every scale.
"""

from __future__ import annotations

import datetime as dt
import weakref
from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tripwire.operators.params import param_value

S, I, L, B, SH = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.ShortType()
TS = T.TimestampNTZType()


def _schema(*cols) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in cols])


ALERTS_SCHEMA = _schema(
    ("alert_id", I), ("alert_name", S), ("alert_env", I), ("alert_wiki", S),
    ("repeat_notification_interval", I), ("escalation_interval", I), ("last_notification", TS),
    ("send_to_webhook", B), ("webhook_alert_template", S), ("email_alert_template", S),
    ("audience", S), ("alarm_emoji", S), ("normal_emoji", S), ("continue_emoji", S),
    ("is_muted", B), ("default_threshold", S),
)
OVERRIDES_SCHEMA = _schema(
    ("override_id", I), ("alert_id", I), ("webhook_alert_template", S), ("email_alert_template", S),
    ("alert_level", SH), ("audience", S), ("override_audience", B), ("emoji", S), ("webhook", S),
    ("tag_name", S), ("tag_value", S), ("instance_id", L), ("threshold", S),
)
HISTORY_SCHEMA = _schema(
    ("instance", S), ("alert_id", I), ("last_occurrence", TS), ("last_value", S), ("status", S),
)
BLACKOUTS_SCHEMA = _schema(
    ("blackout_id", I), ("alert_id", I), ("day_of_week", SH), ("start_time", S), ("end_time", S),
)
WEBHOOKS_SCHEMA = _schema(
    ("id", I), ("name", S), ("type", S), ("environment", I), ("environment_name", S), ("webhook", S),
)
ENVIRONMENT_SCHEMA = _schema(("id", I), ("name", S), ("is_local", B))
LEVELS_SCHEMA = _schema(("level_id", SH), ("name", S))
PARAMETERS_SCHEMA = _schema(("id", I), ("name", S), ("value", S), ("description", S))
EVENTS_LOG_SCHEMA = _schema(
    ("event_id", L), ("event_datetime", TS), ("event_source", S), ("event_type", S), ("event_text", S),
)
DELAY_SCHEMA = _schema(("alert_type", S), ("alert_sent_date", TS))
COUNTER_RULES_SCHEMA = _schema(
    ("object_name", S), ("counter_name", S), ("instance_name", S),
    ("threshold_from", T.DecimalType(28, 9)), ("threshold_to", T.DecimalType(28, 9)),
)

# ---------------------------------------------------------------------------------------
# Fixed values (must equal the alerting system's seeds: names, ids, thresholds, intervals,
# emojis, webhook templates, level names, parameter names and defaults). Audiences, URLs, the
# wording and captions of the e-mails and the descriptions are this library's own.
# ---------------------------------------------------------------------------------------
NEVER = dt.datetime(1900, 1, 1)
AUDIENCE = "ops@example.com"
EMOJI_ALARM = ',"icon_emoji": ":bell_red:"'
EMOJI_NORMAL = ',"icon_emoji": ":bell_green:"'
EMOJI_CONTINUE = ',"icon_emoji": ":bell_orange:"'


def _email(intro: str, headers: list[str]) -> str:
    ths = "".join(f"<th>{h}</th>" for h in headers)
    return (
        f"<html><body>{intro}<br/><table id=\"payload\"><tr>{ths}</tr>"
        "##TABLE##</table>##WIKILINK##</body></html>"
    )


def _hook(text: str) -> str:
    return '{"text":"##ALERTNAME##: ' + text + ' ##WIKILINK##"##EMOJI####USERNAME##}'


BLOCKING_HEADERS = ["Server", "Blocked", "Seconds waited"]
CPU_HEADERS = ["Server", "CPU %", "Limit %"]

ALERT_ROWS = [
    (-2, "Template Alert", 1, "http://url_to_alert_wiki", 5, None, NEVER, True,
     _hook("Alert text for ##INSTANCES##."),
     "<html><body>##INSTANCES## raised this alert.<table id=\"payload\">##TABLE##</table>##WIKILINK##</body></html>",
     AUDIENCE, EMOJI_ALARM, EMOJI_NORMAL, EMOJI_CONTINUE, False, "10"),
    (-1, "Catch-All", 0, None, None, None, None, False, None,
     "<html><body>A notification could not be built from its arguments:<br/>##PARAMS##</body></html>",
     AUDIENCE, None, None, None, False, None),
    (0, "Custom", 0, None, None, None, None, False, None, None, None, None, None, None, False, None),
    (1, "Blocking - Duration", 1, "https://github.com/example/wiki/##alertname## alerts", 5, None, NEVER, True,
     _hook("Excessive blocking detected on ##INSTANCES##."),
     _email("Sessions are blocked beyond the limit on these servers.", BLOCKING_HEADERS),
     AUDIENCE, EMOJI_ALARM, EMOJI_NORMAL, EMOJI_CONTINUE, False, "10000"),
    (2, "Blocking - Processes", 1, None, 5, None, NEVER, False,
     _hook("Excessive blocking detected on ##INSTANCES##."),
     _email("Sessions are blocked beyond the limit on these servers.", BLOCKING_HEADERS),
     AUDIENCE, EMOJI_ALARM, EMOJI_NORMAL, EMOJI_CONTINUE, False, "2"),
    (3, "High CPU", 1, "http://wiki.example.com/##alertname##", 0, None, NEVER, True,
     _hook("High CPU on ##INSTANCES##."),
     _email("These servers use more CPU than their limit.", CPU_HEADERS),
     AUDIENCE, EMOJI_ALARM, EMOJI_NORMAL, EMOJI_CONTINUE, False, "80"),
    (4, "High CPU - Recovery", 1, None, 0, None, NEVER, False,
     _hook("CPU recovered on ##INSTANCES##."),
     _email("These servers are back under their CPU limit.", CPU_HEADERS),
     AUDIENCE, EMOJI_ALARM, EMOJI_NORMAL, EMOJI_CONTINUE, False, None),
    (5, "Disk Free Space", 1, None, 0, None, NEVER, False,
     _hook("Some of the disks on the following instances are low on free space: ##INSTANCES##."),
     _email("These servers have drives that are running full.",
            ["Server", "Drives to watch", "Which", "Drives nearly full", "Which"]),
     AUDIENCE, EMOJI_ALARM, EMOJI_NORMAL, EMOJI_CONTINUE, True, None),
    (6, "DB Growths", 1, None, 0, None, NEVER, False,
     _hook("One or more databases on the following instances have grown since last check: ##INSTANCES##."),
     _email("Data files grew on these servers.",
            ["Server", "Database", "Data file", "Now (MB)", "Grown by (MB)", "Grows by percent",
             "Step (%)", "Step (MB)", "Steps taken"]),
     AUDIENCE, EMOJI_ALARM, EMOJI_NORMAL, EMOJI_CONTINUE, False, None),
    (7, "Top Head Blockers", 1, None, 0, None, NEVER, False, None,
     _email("Statements that blocked others most.",
            ["No.", "Server", "Statement", "Seen", "Directly blocked / seconds",
             "Blocked in all / seconds", "Mean duration (ms)", "Text", "Sessions"]),
     AUDIENCE, EMOJI_ALARM, EMOJI_NORMAL, EMOJI_CONTINUE, False,
     "@MinutesBack int=15,@MinBlockWaitTimeRecursive int=10000"),
    (8, "Idle Sessions", 1, None, 0, None, NEVER, True,
     _hook("Idle sessions with open transaction found on ##INSTANCES##."),
     _email("Sessions sit idle with an open transaction on these servers.",
            ["Server", "Web server", "Idle", "Blocked in all", "Seconds waited in all"]),
     None, EMOJI_ALARM, EMOJI_NORMAL, EMOJI_CONTINUE, False,
     "@Sessions int=1,@MaxBlockWaitTimeRecursive int=10000"),
]

# Untargeted and tag-level overrides (instance-level ones are derived from the fleet).
OVERRIDE_ROWS = [
    (1, 1, None, None, 3, "building-team@example.com", True, None, None, "segment", "BUILDING", None, "15000"),
    (2, 3, None, None, 2, None, False, None, None, "segment", "BUILDING", None, "60"),
    (3, 5, None, None, 3, "storage@example.com", False, ":floppy_disk:", None, None, None, None, None),
    (4, 6, None, None, 2, "growth@example.com", True, None, "https://hooks.example.com/growth", None, None, None, None),
    (5, 2, None, None, 1, None, False, None, None, None, None, None, None),
]

BLACKOUT_ROWS = [
    (1, -2, 0, "20:00:00", "23:00:00"),
    (2, 3, 0, "23:00:00", "23:59:00"),
    (3, 5, 2, "10:10:00", "10:20:00"),
    (4, 6, 0, "22:00:00", "02:00:00"),
]

WEBHOOK_ROWS = [
    (1, "Ops Channel", "Slack", 1, "production", "https://hooks.example.com/ops"),
    (2, "Second Channel", "Teams", 1, "production", "https://hooks.example.com/second"),
    (3, "Stage Channel", "Slack", 3, "stage", "https://hooks.example.com/stage"),
]

ENVIRONMENT_ROWS = [(0, "*", False), (1, "production", True), (2, "internal", False), (3, "stage", False)]

LEVEL_ROWS = [(0, "Normal"), (1, "Informational"), (2, "Warning"), (3, "Critical"), (4, "Fatal")]

PARAMETER_ROWS = [
    (1, "Alert/DBMailProfile", "Mail Profile", "Sender profile of the e-mails"),
    (2, "Repository/DatabaseName", "telemetry", "Database that holds the telemetry"),
    (3, "Reports/TopBlockers/MinBlockedWaitTimeMs", "10000", "Least recursive wait, in ms, of a reported blocker"),
    (4, "Reports/TopBlockers/TopNRows", "10", "Rows of the report; its alert form always has 5"),
    (5, "Reports/TopBlockers/IncludeWithAlert", "0", "1: a blocking alert is followed by the blocker report"),
]

# Performance counter rules: NULL bound = open band, NULL instance_name = any instance.
COUNTER_RULE_ROWS = [
    ("App", "error", None, 5, None),
    ("App", "view", None, None, 3),
    ("App", "click", "", 10, 40),
    ("App", "purchase", "other", 1, None),
    ("Other", "signup", None, 1, 1),
]

DELAY_ROWS = [("CriticalWait", NEVER), ("PerformanceCounterAlert", dt.datetime(2100, 1, 1))]

DAY_NAMES = [(1, "Monday"), (2, "Tuesday"), (3, "Wednesday"), (4, "Thursday"), (5, "Friday"),
             (6, "Saturday"), (7, "Sunday")]

FIXED = {
    "alerts": (ALERTS_SCHEMA, ALERT_ROWS),
    "alert_overrides_fixed": (OVERRIDES_SCHEMA, OVERRIDE_ROWS),
    "alert_blackouts": (BLACKOUTS_SCHEMA, BLACKOUT_ROWS),
    "alert_webhooks": (WEBHOOKS_SCHEMA, WEBHOOK_ROWS),
    "environment": (ENVIRONMENT_SCHEMA, ENVIRONMENT_ROWS),
    "enum_alert_levels": (LEVELS_SCHEMA, LEVEL_ROWS),
    "parameters": (PARAMETERS_SCHEMA, PARAMETER_ROWS),
    "counter_rules": (COUNTER_RULES_SCHEMA, COUNTER_RULE_ROWS),
    "delay_by_type": (DELAY_SCHEMA, DELAY_ROWS),
    "day_names": (_schema(("day_code", I), ("day_name", S)), DAY_NAMES),
}


def _normalize(schema: T.StructType, rows: list[tuple]) -> list[tuple]:
    from decimal import Decimal

    out = []
    for r in rows:
        vals = []
        for f, v in zip(schema.fields, r):
            if v is not None and isinstance(f.dataType, T.DecimalType):
                v = Decimal(v)
            vals.append(v)
        out.append(tuple(vals))
    return out


_FIXED_CACHE: "weakref.WeakKeyDictionary[SparkSession, dict]" = weakref.WeakKeyDictionary()


def fixed_table(spark: SparkSession, name: str) -> DataFrame:
    """A fixed config table, built once per session and kept in memory (it is tiny)."""
    cache = _FIXED_CACHE.setdefault(spark, {})
    if name not in cache:
        schema, rows = FIXED[name]
        cache[name] = spark.createDataFrame(_normalize(schema, rows), schema).cache()
    return cache[name]


def with_blackout_parts(bo: DataFrame) -> DataFrame:
    """Hour/minute parts of the window bounds (computed columns of the blackout table)."""
    def part(c, i):
        return F.split(F.col(c), ":").getItem(i).cast("int")

    return bo.select(
        "*",
        part("start_time", 0).alias("start_h"), part("start_time", 1).alias("start_m"),
        part("end_time", 0).alias("end_h"), part("end_time", 1).alias("end_m"),
    )


def with_webhook_parts(wh: DataFrame) -> DataFrame:
    """Computed columns of the webhook table: sender user name and webhook id."""
    return wh.select(
        "*",
        F.concat(F.lit("sql@cms-"), F.lower("environment_name")).alias("username"),
        F.concat(F.col("environment_name"), F.lit("-"), F.replace(F.col("name"), F.lit(" "), F.lit(""))).alias("webhook_id"),
    )


def derived_instance_overrides(instances: DataFrame) -> DataFrame:
    """Instance-level overrides for a share of the fleet (grows with the fleet)."""
    iid = F.col("instance_id")

    def rows(alert_id: int, base: int, modulo: int, threshold: F.Column, audience: F.Column,
             replace: F.Column = F.lit(True)) -> DataFrame:
        return instances.filter(iid % modulo == 0).select(
            (F.lit(base) + iid).cast("int").alias("override_id"),
            F.lit(alert_id).alias("alert_id"),
            F.lit(None).cast("string").alias("webhook_alert_template"),
            F.lit(None).cast("string").alias("email_alert_template"),
            F.lit(None).cast("short").alias("alert_level"),
            audience.alias("audience"),
            replace.alias("override_audience"),
            F.lit(None).cast("string").alias("emoji"),
            F.lit(None).cast("string").alias("webhook"),
            F.lit(None).cast("string").alias("tag_name"),
            F.lit(None).cast("string").alias("tag_value"),
            iid.alias("instance_id"),
            threshold.alias("threshold"),
        )

    none = F.lit(None).cast("string")
    return (
        rows(1, 100000, 7, F.when(iid % 49 != 0, F.lit("20000")).otherwise(none),
             F.when(iid % 14 == 0, F.lit("dba-oncall@example.com")).otherwise(none))
        .unionByName(rows(2, 200000, 6, F.lit("5"), none))
        .unionByName(rows(3, 300000, 5, F.lit("30"),
                          F.when(iid % 10 == 0, F.lit("cpu-team@example.com")).otherwise(none), iid % 20 != 0))
        .unionByName(rows(7, 400000, 11, F.lit("@MinutesBack int=30;@MinBlockWaitTimeRecursive int=5000"), none))
    )


def derived_history(instances: DataFrame, now: dt.datetime) -> DataFrame:
    """Alert history for the even-numbered instances (blocking and CPU alerts).

    Names of every third instance are stored lower-cased: names compare case-insensitively.
    """
    iid = F.col("instance_id")
    name = F.when(iid % 3 == 0, F.lower("instance_display_name")).otherwise(F.col("instance_display_name"))
    occ = F.timestamp_add("MINUTE", -(iid % 10), F.lit(now).cast("timestamp_ntz"))
    even = instances.filter(iid % 2 == 0)
    blocking = even.select(
        name.alias("instance"), F.lit(1).alias("alert_id"), occ.alias("last_occurrence"),
        F.lit(None).cast("string").alias("last_value"), F.lit(None).cast("string").alias("status"),
    )
    cpu = even.select(
        name.alias("instance"), F.lit(3).alias("alert_id"), occ.alias("last_occurrence"),
        (iid % 100).cast("string").alias("last_value"),
        F.when(iid % 4 == 0, F.lit("ON")).otherwise(F.lit("OFF")).alias("status"),
    )
    return blocking.unionByName(cpu)


class Config:
    """All config and state tables of one run.

    `source` is a folder of Parquet tables or a dict of frames, by the names in TABLES; a table
    that it lacks is built from the seeds in this module. With an own `alert_overrides` or
    `alert_history` nothing is derived from the fleet.
    """

    TABLES = ("alerts", "alert_overrides", "alert_history", "alert_blackouts", "alert_webhooks", "environment",
              "enum_alert_levels", "parameters", "counter_rules", "delay_by_type")

    def __init__(self, spark: SparkSession, instances: DataFrame | None = None, now: dt.datetime | None = None,
                 source: "str | dict[str, DataFrame] | None" = None):
        self.spark = spark
        self._instances = instances
        self._now = now
        self._source = source
        self._given: dict[str, DataFrame | None] = {}
        self._alerts: dict[str, dict] = {}

    def given(self, name: str) -> DataFrame | None:
        """The user's own table, or None."""
        if self._source is None:
            return None
        if isinstance(self._source, dict):
            return self._source.get(name)
        if name not in self._given:
            try:
                self._given[name] = self.spark.read.parquet(f"{self._source}/{name}.parquet")
            except AnalysisException as e:
                if e.getCondition() != "PATH_NOT_FOUND":
                    raise
                self._given[name] = None
        return self._given[name]

    def fixed(self, name: str) -> DataFrame:
        own = self.given(name)
        return fixed_table(self.spark, name) if own is None else own

    def alert(self, name: str) -> dict:
        """One alert's config row by name (a single row is read on the driver, once per run)."""
        if name not in self._alerts:
            row = self.alerts.filter(F.lower("alert_name") == name.lower()).orderBy("alert_id").first()
            if row is None:
                raise KeyError(f"no alert named {name}")
            self._alerts[name] = row.asDict()
        return self._alerts[name]

    def param(self, name: str, default: str | None = None) -> str | None:
        """A parameter's value, or the default where the table has no such name or no value."""
        return param_value(self.parameters, name, default).first()[0]

    @property
    def alerts(self) -> DataFrame:
        return self.fixed("alerts")

    @cached_property
    def overrides(self) -> DataFrame:
        own = self.given("alert_overrides")
        if own is not None:
            return own
        base = self.fixed("alert_overrides_fixed")
        if self._instances is None:
            return base
        return base.unionByName(derived_instance_overrides(self._instances))

    @cached_property
    def history(self) -> DataFrame:
        own = self.given("alert_history")
        if own is not None:
            return own
        if self._instances is None:
            return self.spark.createDataFrame([], HISTORY_SCHEMA)
        return derived_history(self._instances, self._now)

    @cached_property
    def blackouts(self) -> DataFrame:
        return with_blackout_parts(self.fixed("alert_blackouts"))

    @cached_property
    def webhooks(self) -> DataFrame:
        return with_webhook_parts(self.fixed("alert_webhooks"))

    @property
    def environment(self) -> DataFrame:
        return self.fixed("environment")

    @property
    def levels(self) -> DataFrame:
        return self.fixed("enum_alert_levels")

    @property
    def parameters(self) -> DataFrame:
        return self.fixed("parameters")

    @property
    def counter_rules(self) -> DataFrame:
        return self.fixed("counter_rules")

    @property
    def delay_by_type(self) -> DataFrame:
        return self.fixed("delay_by_type")

    @property
    def day_names(self) -> DataFrame:
        return self.fixed("day_names")
