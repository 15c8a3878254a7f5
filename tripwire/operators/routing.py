"""Who is told, through which channel: overrides, the alerts view, blackouts, audiences.

Config frames here are small (their row count is known on the driver); per-alert defaults
are reduced to one row before they meet the per-instance data, so they broadcast.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from tripwire.operators.segments import numbered
from tripwire.operators.thresholds import instance_level, tag_level
from tripwire.session import materialized

ROUTE_FIELDS = ["audience", "email_alert_template", "webhook", "webhook_alert_template"]


def env_webhook(webhooks: DataFrame) -> DataFrame:
    """One webhook per environment: the lowest id wins when several exist."""
    return webhooks.groupBy(F.col("environment").alias("_env")).agg(
        F.min_by("webhook", "id").alias("_env_webhook"))


def alert_defaults(alerts: DataFrame, webhooks: DataFrame, alert_id: int) -> DataFrame:
    """The alert's own routing fields (one row): audience, templates, environment webhook."""
    a = alerts.filter(F.col("alert_id") == alert_id)
    j = a.join(env_webhook(webhooks), F.col("alert_env") == F.col("_env"), "left")
    return j.select(
        F.col("audience").alias("_d_audience"),
        F.col("email_alert_template").alias("_d_email_alert_template"),
        F.col("_env_webhook").alias("_d_webhook"),
        F.col("webhook_alert_template").alias("_d_webhook_alert_template"),
        F.col("default_threshold").alias("_d_threshold"),
    )


def resolve_overrides(targets: DataFrame, overrides: DataFrame, alerts: DataFrame, webhooks: DataFrame,
                      alert_id: int, tag_name: str | None = None, tag_value: str | None = None,
                      instance_col: str = "instance_id") -> DataFrame:
    """Add audience / e-mail template / webhook / webhook template per target row.

    The best override row (instance level, then tag level, then the alert itself; ties to the
    lowest override_id) supplies the fields; any field it leaves NULL comes from the alert.
    """
    inst = instance_level(overrides, alert_id, ROUTE_FIELDS)
    tag = tag_level(overrides, alert_id, tag_name, tag_value).agg(
        F.min_by(F.struct(*ROUTE_FIELDS), F.col("override_id")).alias("_t"),
        F.count(F.lit(1)).alias("_t_n"))
    dflt = alert_defaults(alerts, webhooks, alert_id)
    one_row = tag.crossJoin(dflt)  # 1 x (0 or 1) rows
    j = targets.join(inst, F.col(instance_col) == F.col("_oid"), "left").crossJoin(F.broadcast(one_row))
    cols = []
    for f in ROUTE_FIELDS:
        chosen = (F.when(F.col("_oid").isNotNull(), F.col("_o_" + f))
                  .when(F.col("_t_n") > 0, F.col("_t." + f)))
        cols.append(F.coalesce(chosen, F.col("_d_" + f)).alias(f))
    drop = ["_oid", "_t", "_t_n", "_d_threshold"] + ["_o_" + f for f in ROUTE_FIELDS] + ["_d_" + f for f in ROUTE_FIELDS]
    return j.select(*[c for c in j.columns if c not in drop], *cols)


def resolve_instance_config(targets: DataFrame, overrides: DataFrame, alerts: DataFrame, webhooks: DataFrame,
                            alert_id: int, tag_name: str | None = None, tag_value: str | None = None,
                            instance_col: str = "instance_id") -> DataFrame:
    """Threshold and routing fields in one pass (what `resolve_threshold` followed by
    `resolve_overrides` give): both take the same winning override row, so one
    instance-level aggregation and one broadcast row serve both. The threshold keeps a
    winning NULL; routing fields fall back to the alert's own values."""
    cols = ["threshold", *ROUTE_FIELDS]
    inst = instance_level(overrides, alert_id, cols)
    tag = tag_level(overrides, alert_id, tag_name, tag_value).agg(
        F.min_by(F.struct(*cols), F.col("override_id")).alias("_t"), F.count(F.lit(1)).alias("_t_n"))
    one_row = tag.crossJoin(alert_defaults(alerts, webhooks, alert_id))  # 1 x (0 or 1) rows
    j = targets.join(inst, F.col(instance_col) == F.col("_oid"), "left").crossJoin(F.broadcast(one_row))
    has_inst, has_tag = F.col("_oid").isNotNull(), F.col("_t_n") > 0
    out = [F.when(has_inst, F.col("_o_threshold")).when(has_tag, F.col("_t.threshold"))
           .otherwise(F.col("_d_threshold")).alias("threshold")]
    for f in ROUTE_FIELDS:
        chosen = F.when(has_inst, F.col("_o_" + f)).when(has_tag, F.col("_t." + f))
        out.append(F.coalesce(chosen, F.col("_d_" + f)).alias(f))
    drop = {"_oid", "_t", "_t_n", *["_o_" + c for c in cols], *["_d_" + c for c in cols]}
    return j.select(*[c for c in j.columns if c not in drop], *out)


def merge_audience(default: Column, extra: Column, override_flag: Column) -> Column:
    """NULL extra keeps the default; flag 1 replaces it; flag 0 appends `;extra`."""
    return (F.when(extra.isNull(), default)
            .when(override_flag, extra)
            .when(~override_flag, F.concat(default, F.lit(";"), extra))
            .otherwise(default))


def all_alerts_view(alerts: DataFrame, environment: DataFrame, overrides: DataFrame, levels: DataFrame,
                    webhooks: DataFrame) -> DataFrame:
    """Local-environment alerts with their untargeted overrides applied.

    Targeted overrides are excluded inside the join condition, so an alert that only has
    targeted overrides is still listed. Several untargeted overrides or webhooks fan out.
    """
    local = environment.filter(F.col("is_local")).select(F.col("id").alias("_env_id"), F.col("name").alias("environment"))
    ao = overrides.filter(F.col("tag_name").isNull() & F.col("tag_value").isNull() & F.col("instance_id").isNull())
    ao = ao.select(*[F.col(c).alias("ao_" + c) for c in ao.columns])
    lv = levels.select(F.col("level_id").alias("_lvl"), F.col("name").alias("alert_level_desc"))
    wh = webhooks.select(F.col("id").alias("aw_id"), F.col("environment").alias("_aw_env"),
                         F.col("webhook").alias("aw_webhook"), F.col("username").alias("username"))
    a = alerts.join(F.broadcast(local), F.col("alert_env") == F.col("_env_id"))
    # untargeted overrides come from a table that also holds fleet-sized instance rows: no
    # hint, AQE broadcasts them from their runtime size
    a = a.join(ao, F.col("alert_id") == F.col("ao_alert_id"), "left")
    a = a.join(F.broadcast(lv), F.col("ao_alert_level") == F.col("_lvl"), "left")
    a = a.join(F.broadcast(wh), F.col("alert_env") == F.col("_aw_env"), "left")
    return a.select(
        "alert_id", "alert_name", "alert_env", "environment", "alert_wiki", "repeat_notification_interval",
        "escalation_interval", "last_notification", "send_to_webhook",
        F.coalesce("ao_webhook_alert_template", "webhook_alert_template").alias("webhook_alert_template"),
        F.coalesce("ao_email_alert_template", "email_alert_template").alias("email_alert_template"),
        merge_audience(F.col("audience"), F.col("ao_audience"), F.col("ao_override_audience")).alias("audience"),
        F.coalesce("ao_webhook", "aw_webhook").alias("webhook"),
        F.coalesce("ao_emoji", "alarm_emoji").alias("alarm_emoji"),
        F.coalesce("ao_emoji", "normal_emoji").alias("normal_emoji"),
        F.coalesce("ao_emoji", "continue_emoji").alias("continue_emoji"),
        "is_muted",
        F.col("ao_alert_level").alias("alert_level"),
        "alert_level_desc",
        F.col("ao_override_audience").alias("override_audience"),
        F.col("ao_emoji").alias("emoji"),
        "username",
        F.col("ao_override_id").alias("override_id"),
        "aw_id",
    )


def alert_meta(view: DataFrame) -> DataFrame:
    """One metadata row per alert name from the (fanned-out) view: lowest override, then webhook id."""
    cols = [c for c in view.columns if c not in ("alert_name",)]
    order = F.struct(F.coalesce("override_id", F.lit(-1)), F.coalesce("aw_id", F.lit(-1)))
    return view.groupBy("alert_name").agg(F.min_by(F.struct(*cols), order).alias("_m")).select(
        "alert_name", *[F.col("_m." + c).alias(c) for c in cols])


def blackout_status(events: DataFrame, blackouts: DataFrame, ts_col: str, alert_col: str = "alert_id",
                    out: str = "in_blackout") -> DataFrame:
    """Add whether each event falls inside a blackout window of its alert.

    Window rule, per blackout row (minute resolution, end minute inclusive):
      h = start_h and m >= start_m, or start_h < h < end_h, or h = end_h and m <= end_m,
    restricted to start_h <= h <= end_h and to the row's weekday (0 = every day, 1 = Monday).
    Windows that wrap past midnight never match. Several windows: inside any of them.
    Blackout rows are config (broadcast); the event side is joined on alert id and filtered.
    """
    windows = blackouts.groupBy(F.col("alert_id").alias("_bo_alert")).agg(F.collect_list(
        F.struct("day_of_week", "start_h", "start_m", "end_h", "end_m")).alias("_bo_windows"))
    h, m = F.hour(F.col(ts_col)), F.minute(F.col(ts_col))
    dow = F.weekday(F.col(ts_col)) + 1

    def inside(w: Column) -> Column:
        sh, sm, eh, em = w["start_h"], w["start_m"], w["end_h"], w["end_m"]
        return (((w["day_of_week"] == 0) | (w["day_of_week"] == dow)) & (h >= sh) & (h <= eh)
                & (((h == sh) & (m >= sm)) | ((h > sh) & ((h < eh) | ((h == eh) & (m <= em))))))

    j = events.join(F.broadcast(windows), F.col(alert_col) == F.col("_bo_alert"), "left")
    flag = F.coalesce(F.exists(F.col("_bo_windows"), inside), F.lit(False))
    return j.withColumn(out, flag).drop("_bo_alert", "_bo_windows")


MAX_ITEMS = 20_000  # rows of one message at most


def ordered_parts(items: DataFrame, keys: list[str], order: list[str], max_items: int = MAX_ITEMS, part: str = "part") -> DataFrame:
    """items with the number (from 1) of their part: consecutive rows of a group in the given order, at most `max_items` each.

    A group of up to `max_items` rows is one part. Rows of larger groups are numbered by ranges of equal row counts
    (segments.py), so no task holds a group, and the parts one after another are the group in order. `items` is read
    twice: pass a frame that is written already.
    """
    sizes = items.groupBy(*[F.col(k).alias("_k_" + k) for k in keys]).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > max_items)
    sizes = materialized(sizes)  # one row per large group
    one = items.withColumn(part, F.lit(1).cast("int"))
    if not sizes.take(1):
        return one
    same = reduce(and_, [F.col(k).eqNullSafe(F.col("_k_" + k)) for k in keys], F.lit(True))
    large = numbered(items.join(sizes, same, "left_semi"), keys, order, "_pos")
    large = large.withColumn(part, (F.floor((F.col("_pos") - 1) / F.lit(max_items)) + 1).cast("int")).drop("_pos")
    return one.join(sizes, same, "left_anti").unionByName(large)


def route_by_audience(rows: DataFrame, instance_col: str, row_html: Column | None, keys: list[str] | None = None,
                      order_col: str | None = None, distinct_names: bool = False, max_items: int = MAX_ITEMS) -> DataFrame:
    """Messages per (audience, webhook, e-mail template, webhook template), or per the given keys.

    `instances` is the comma list of instance names in name order; `table_html` the
    concatenated table rows in (name, row) order. A routing group of more than `max_items`
    rows becomes several messages of at most that many rows, numbered by `part`: consecutive stretches of
    the group in its order, so their tables one after another are the table of the whole group. The input
    is evaluated once and written to the shared folder.
    """
    keys = ROUTE_FIELDS if keys is None else keys
    order = F.col(order_col) if order_col else F.col(instance_col)
    html = row_html if row_html is not None else F.lit(None).cast("string")
    items = materialized(rows.select(*keys, order.alias("_o"), F.col(instance_col).alias("_i"), html.alias("_r")))
    parted = ordered_parts(items, keys, ["_o", "_i", "_r"], max_items)
    g = parted.groupBy(*keys, "part").agg(F.collect_list(F.struct("_o", "_i", "_r")).alias("_items"))
    srt = F.array_sort("_items")
    names = F.array_sort(F.transform(F.col("_items"), lambda x: x["_i"]))
    if distinct_names:
        names = F.array_distinct(names)
    return g.select(
        *keys,
        F.array_join(names, ",").alias("instances"),
        F.array_join(F.transform(srt, lambda x: x["_r"]), "").alias("table_html"),
        F.size("_items").alias("n_rows"),
        "part",
    )


def ordered_list(rows: DataFrame, keys: list[str], value: str, sep: str = ",", max_items: int = MAX_ITEMS) -> DataFrame:
    """(keys, part, items, n): the values of each group in order, joined, in parts of at most `max_items` values.

    Two levels: values are numbered over ranges, then joined per part, so no row holds more than `max_items` values
    however large a group is; the parts joined by `sep` are the list of the whole group. NULL values are left out.
    """
    items = materialized(rows.select(*keys, F.col(value).alias("_v")).filter(F.col("_v").isNotNull()))
    parted = ordered_parts(items, keys, ["_v"], max_items)
    return parted.groupBy(*keys, "part").agg(
        F.array_join(F.array_sort(F.collect_list("_v")), sep).alias("items"), F.count(F.lit(1)).alias("n"))
