"""Alert state: repeat suppression, ON/OFF transitions, history writes, config upserts.

The history table is keyed by (instance name, alert id); names compare case-insensitively.
Writes produce a complete new snapshot of the table (write it to a new location, never over
the path being read); on a catalog with MERGE support the same frames feed a MERGE.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from tripwire.operators.segments import SEG, cut, inside, with_carry


def _ts(v: dt.datetime) -> Column:
    return F.lit(v).cast("timestamp_ntz")


def suppress_recent(df: DataFrame, history: DataFrame, alert_id: int, delay_minutes: int | None,
                    as_of: dt.datetime, instance_col: str = "instance") -> DataFrame:
    """Drop instances notified less than `delay` minutes ago (strict: exactly `delay` ago is kept).

    No suppression when the delay is NULL or 0. Anti-join on the lower-cased name.
    """
    delay = delay_minutes or 0
    if delay <= 0:
        return df
    recent = history.filter(
        (F.col("alert_id") == alert_id) & (F.col("last_occurrence") > _ts(as_of - dt.timedelta(minutes=delay)))
    ).select(F.lower("instance").alias("_hk")).distinct()
    return df.join(recent, F.lower(F.col(instance_col)) == F.col("_hk"), "left_anti")


def state_action(counter: Column, threshold: Column, in_history: Column, status: Column) -> Column:
    """Transition of the ON/OFF machine for one evaluation (NULL when undecidable)."""
    above, below = counter >= threshold, counter < threshold
    return (
        F.when(~in_history & above, "NEW->ON")
        .when(~in_history & below, "IGNORE")
        .when(in_history & (status == "ON") & below, "ON->OFF")
        .when(in_history & (status == "ON") & above, "IGNORE")
        .when(in_history & (status == "OFF") & above, "OFF->ON")
        .when(in_history & (status == "OFF") & below, "IGNORE")
    )


def with_state_action(df: DataFrame, history: DataFrame, alert_id: int, counter: str = "counter",
                      threshold: str = "threshold", instance_col: str = "instance") -> DataFrame:
    """Left-join the alert's history row (by lower-cased name) and add `status` and `action`."""
    h = history.filter(F.col("alert_id") == alert_id).select(
        F.lower("instance").alias("_hk"), F.col("alert_id").alias("_hid"), F.col("status").alias("status"))
    j = df.join(h, F.lower(F.col(instance_col)) == F.col("_hk"), "left")
    act = state_action(F.col(counter), F.col(threshold), F.col("_hid").isNotNull(), F.col("status"))
    return j.withColumn("action", act).drop("_hk", "_hid")


def _split(history: DataFrame, alert_id: int) -> tuple[DataFrame, DataFrame]:
    mine = F.col("alert_id") == alert_id
    return history.filter(mine), history.filter(~mine | F.col("alert_id").isNull())


def history_upsert(history: DataFrame, src: DataFrame, alert_id: int, as_of: dt.datetime,
                   instance_col: str = "instance") -> DataFrame:
    """MERGE last_occurrence := as_of for the source instances of one alert (insert when absent).

    The source is made distinct on the key first (one grown instance may appear many times).
    Status and last value are left as they are.
    """
    keys = src.groupBy(F.lower(F.col(instance_col)).alias("_sk")).agg(F.min(instance_col).alias("_sname"))
    mine, others = _split(history, alert_id)
    m = mine.withColumn("_hk", F.lower("instance"))
    j = m.join(keys, m["_hk"] == keys["_sk"], "full_outer")
    hit = F.col("_sk").isNotNull()
    out = j.select(
        F.coalesce(F.col("instance"), F.col("_sname")).alias("instance"),
        F.lit(alert_id).alias("alert_id"),
        F.when(hit, _ts(as_of)).otherwise(F.col("last_occurrence")).alias("last_occurrence"),
        F.col("last_value"),
        F.col("status"),
    )
    return others.unionByName(out)


def history_state_write(history: DataFrame, actions: DataFrame, alert_id: int, as_of: dt.datetime,
                        instance_col: str = "instance", counter: str = "counter") -> DataFrame:
    """Apply ON/OFF transitions: insert NEW->ON rows, update OFF->ON / ON->OFF rows."""
    a = actions.filter(F.col("action").isin("NEW->ON", "OFF->ON", "ON->OFF")).select(
        F.lower(F.col(instance_col)).alias("_ak"), F.col(instance_col).alias("_aname"),
        F.col(counter).cast("string").alias("_val"), "action")
    mine, others = _split(history, alert_id)
    m = mine.withColumn("_hk", F.lower("instance"))
    j = m.join(a, m["_hk"] == a["_ak"], "full_outer")
    # NEW->ON rows only insert when no history row exists; updates only touch existing rows.
    j = j.filter(F.col("_hk").isNotNull() | (F.col("action") == "NEW->ON"))
    upd = F.col("_hk").isNotNull() & F.col("action").isin("OFF->ON", "ON->OFF")
    ins = F.col("_hk").isNull()
    out = j.select(
        F.coalesce(F.col("instance"), F.col("_aname")).alias("instance"),
        F.lit(alert_id).alias("alert_id"),
        F.when(upd | ins, _ts(as_of)).otherwise(F.col("last_occurrence")).alias("last_occurrence"),
        F.when(upd | ins, F.col("_val")).otherwise(F.col("last_value")).alias("last_value"),
        F.when(ins, F.lit("ON"))
        .when(upd, F.when(F.col("action") == "ON->OFF", F.lit("OFF")).otherwise(F.lit("ON")))
        .otherwise(F.col("status")).alias("status"),
    )
    return others.unionByName(out)


def insert_missing(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Insert source rows whose natural key is absent from the target (left anti + union)."""
    new = source.join(target.select(*keys).distinct(), keys, "left_anti")
    return target.unionByName(new.select(*target.columns))


def merge_upsert(target: DataFrame, source: DataFrame, keys: list[str], update_when_different: list[str]) -> DataFrame:
    """MERGE: insert missing source rows; for matched rows overwrite only the listed columns,
    and only when the source value differs; every other target column is kept."""
    s = source.select(*[F.col(c).alias("_s_" + c) for c in source.columns])
    cond = None
    for k in keys:
        c = F.col(k) == F.col("_s_" + k)
        cond = c if cond is None else cond & c
    j = target.join(s, cond, "full_outer")
    matched = F.col(keys[0]).isNotNull() & F.col("_s_" + keys[0]).isNotNull()
    t_only = F.col("_s_" + keys[0]).isNull()
    cols = []
    for c in target.columns:
        src = F.col("_s_" + c) if ("_s_" + c) in s.columns else F.lit(None)
        if c in update_when_different:
            v = F.when(matched & (F.col(c) != src), src).when(t_only | matched, F.col(c)).otherwise(src)
        else:
            v = F.when(t_only | matched, F.col(c)).otherwise(src)
        cols.append(v.alias(c))
    return j.select(*cols)


def state_replay(samples: DataFrame, key: str, ts: str, tie: str, breach: Column, ranges: int | None = None) -> DataFrame:
    """Replay the ON/OFF machine over every sample of each key's series (action per sample).

    The action at a sample depends on the breach flag of the last earlier sample that has one
    and on whether any earlier sample breached; a sample without a flag (NULL) has no action
    and changes nothing. Each range of the series is thus a function of two flags, and what the
    ranges before a range hand over is the composition of theirs. Ranges hold about equally many
    rows (segments.py), so a key's dense hour or a key with a third of all rows uses all tasks.
    """
    order = [F.col(ts), F.col(tie)]
    rows = cut(samples.withColumn("_br", breach), [key], order, ranges)
    before = inside([key], *order).rowsBetween(Window.unboundedPreceding, -1)
    any_flag = F.max(F.col("_br").cast("int"))
    rows = rows.withColumn("_prev", F.last("_br", ignorenulls=True).over(before)).withColumn("_any", any_flag.over(before))
    flagged = F.when(F.col("_br").isNotNull(), F.struct(*order))  # rows without a flag never win
    rows = with_carry(rows, [key], {"_sl": F.max_by("_br", flagged), "_sa": any_flag},
                      {"_cl": F.last("_sl", ignorenulls=True), "_ca": F.max("_sa")})
    prev = F.coalesce("_prev", "_cl")
    any_before = F.greatest(F.coalesce(F.col("_any"), F.lit(0)), F.coalesce(F.col("_ca"), F.lit(0))) > 0
    cur = F.col("_br")
    action = (F.when(cur.isNull(), F.lit(None))
              .when(~any_before, F.when(cur, "NEW->ON").otherwise("IGNORE"))
              .when(prev & ~cur, "ON->OFF")
              .when(~prev & cur, "OFF->ON")
              .otherwise("IGNORE"))
    return rows.withColumn("action", action).drop(SEG, "_br", "_prev", "_any", "_cl", "_ca")
