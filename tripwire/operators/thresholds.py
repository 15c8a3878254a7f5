"""Layered threshold resolution and breach predicates.

Precedence: an instance-level override wins over a tag-level override, which wins over the
alert's default. A winning override with a NULL threshold yields NULL (never alerts). Equal
precedence ties go to the lowest override_id.

Plan shape: the per-instance level is a join with the instance-level overrides of one alert
(reduced to one row per instance first); the tag and default levels do not depend on the
instance, so they are reduced to a single row and broadcast. No instance x candidates
product is formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def ci_equal(a: Column, b: Column) -> Column:
    """Case-insensitive text equality (the alerting database compares text that way)."""
    return F.lower(a) == F.lower(b)


def instance_level(overrides: DataFrame, alert_id: int, cols: list[str]) -> DataFrame:
    """Best instance-level override row per instance (lowest override_id)."""
    o = overrides.filter(
        (F.col("alert_id") == alert_id)
        & F.col("tag_name").isNull() & F.col("tag_value").isNull()
        & F.col("instance_id").isNotNull()
    )
    best = F.min_by(F.struct(*cols), F.col("override_id")).alias("_o")
    return o.groupBy(F.col("instance_id").alias("_oid")).agg(best).select(
        "_oid", *[F.col("_o." + c).alias("_o_" + c) for c in cols]
    )


def tag_level(overrides: DataFrame, alert_id: int, tag_name: str | None, tag_value: str | None) -> DataFrame:
    """Tag-level override rows of one alert for the job's tag (none when no tag is given)."""
    o = overrides.filter((F.col("alert_id") == alert_id) & F.col("instance_id").isNull())
    if tag_name is None or tag_value is None:
        return o.filter(F.lit(False))
    return o.filter(ci_equal(F.col("tag_name"), F.lit(tag_name)) & ci_equal(F.col("tag_value"), F.lit(tag_value)))


def resolve_threshold(
    targets: DataFrame,
    overrides: DataFrame,
    alerts: DataFrame,
    alert_id: int,
    tag_name: str | None = None,
    tag_value: str | None = None,
    instance_col: str = "instance_id",
    out: str = "threshold",
) -> DataFrame:
    """Add the resolved threshold text for each target row's instance."""
    inst = instance_level(overrides, alert_id, ["threshold"])
    tag = tag_level(overrides, alert_id, tag_name, tag_value).select(
        F.lit(2).alias("_rank"), F.col("override_id").alias("_tie"), "threshold")
    dflt = alerts.filter(F.col("alert_id") == alert_id).select(
        F.lit(3).alias("_rank"), F.lit(0).alias("_tie"), F.col("default_threshold").alias("threshold"))
    # One row by construction (global aggregate): safe to broadcast.
    fallback = tag.unionByName(dflt).agg(
        F.min_by("threshold", F.struct("_rank", "_tie")).alias("_fallback"))
    j = targets.join(inst, F.col(instance_col) == F.col("_oid"), "left").crossJoin(F.broadcast(fallback))
    th = F.when(F.col("_oid").isNotNull(), F.col("_o_threshold")).otherwise(F.col("_fallback"))
    return j.withColumn(out, th).drop("_oid", "_o_threshold", "_fallback")


def threshold_breach(df: DataFrame, metric: Column | str, threshold: str = "threshold", strict: bool = True,
                     cast_to: str = "int") -> DataFrame:
    """Keep rows whose metric passes the threshold (text cast to a number; NULL never passes)."""
    m = F.col(metric) if isinstance(metric, str) else metric
    t = F.col(threshold).try_cast(cast_to)
    return df.filter((t < m) if strict else (m >= t))


def band_check(value: Column, lo: Column, hi: Column) -> Column:
    """value within [lo, hi]; a NULL bound is open."""
    return (value >= F.coalesce(lo, value)) & (value <= F.coalesce(hi, value))


def precedence_pick(df: DataFrame, key: str | list[str], precedence: str, tie: str, cols: list[str]) -> DataFrame:
    """Per key, the row with the smallest (precedence, tie) -- an aggregate, not a sort."""
    keys = [key] if isinstance(key, str) else list(key)
    best = F.min_by(F.struct(*cols), F.struct(precedence, tie)).alias("_b")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col("_b." + c).alias(c) for c in cols])


def resolve_threshold_per_tag(df: DataFrame, overrides: DataFrame, alerts: DataFrame, alert_id: int,
                              tag_name_col: str = "tag_name", tag_value_col: str = "tag_value",
                              instance_col: str = "instance_id", out: str = "threshold") -> DataFrame:
    """Threshold when each row carries its own (tag name, tag value): instance > row's tag > default.

    Tag-level overrides are reduced to one row per (tag name, tag value) and joined on the
    lower-cased pair; instance-level ones as in `resolve_threshold`; the default is one row.
    """
    inst = instance_level(overrides, alert_id, ["threshold"])
    tags = overrides.filter((F.col("alert_id") == alert_id) & F.col("instance_id").isNull()
                            & F.col("tag_name").isNotNull() & F.col("tag_value").isNotNull())
    tags = tags.groupBy(F.lower("tag_name").alias("_tn"), F.lower("tag_value").alias("_tv")).agg(
        F.min_by("threshold", "override_id").alias("_t_threshold"))
    dflt = alerts.filter(F.col("alert_id") == alert_id).agg(F.max("default_threshold").alias("_d_threshold"))
    j = (df.join(inst, F.col(instance_col) == F.col("_oid"), "left")
         .join(tags, (F.lower(F.col(tag_name_col)) == F.col("_tn"))
               & (F.lower(F.col(tag_value_col)) == F.col("_tv")), "left")
         .crossJoin(F.broadcast(dflt)))
    th = (F.when(F.col("_oid").isNotNull(), F.col("_o_threshold"))
          .when(F.col("_tn").isNotNull(), F.col("_t_threshold"))
          .otherwise(F.col("_d_threshold")))
    return j.withColumn(out, th).drop("_oid", "_o_threshold", "_tn", "_tv", "_t_threshold", "_d_threshold")
