"""Truth tables and edge rows for the column rules and small operators."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tripwire.functions import text as tx
from tripwire.operators import params as pm
from tripwire.operators import routing as rt
from tripwire.operators import state as st
from tripwire.operators import thresholds as th
from tripwire.sources import config as C

NOW = dt.datetime(2024, 1, 30, 12, 0, 0)


# -- ON/OFF action table -------------------------------------------------------------------
@pytest.mark.parametrize("hist,status,counter,threshold,expected", [
    (False, None, 10, 20, "IGNORE"), (False, None, 20, 20, "NEW->ON"), (False, None, 30, 20, "NEW->ON"),
    (False, None, 30, None, None),
    (True, "ON", 10, 20, "ON->OFF"), (True, "ON", 20, 20, "IGNORE"), (True, "ON", 30, 20, "IGNORE"),
    (True, "ON", 30, None, None),
    (True, "OFF", 10, 20, "IGNORE"), (True, "OFF", 20, 20, "OFF->ON"), (True, "OFF", 30, 20, "OFF->ON"),
    (True, "OFF", 30, None, None),
    (True, None, 30, 20, None), (True, None, 10, 20, None),
])
def test_state_action(spark, hist, status, counter, threshold, expected):
    df = spark.createDataFrame([(hist, status, counter, threshold)], "h boolean, s string, c int, t int")
    got = df.select(st.state_action(F.col("c"), F.col("t"), F.col("h"), F.col("s")).alias("a")).first()["a"]
    assert got == expected


# -- blackout windows ----------------------------------------------------------------------
def _blackouts(spark, rows):
    return C.with_blackout_parts(spark.createDataFrame(rows, C.BLACKOUTS_SCHEMA))


@pytest.mark.parametrize("ts,start,end,dow,expected", [
    ("2024-01-30 19:59:00", "20:00:00", "23:00:00", 0, False),
    ("2024-01-30 20:00:00", "20:00:00", "23:00:00", 0, True),
    ("2024-01-30 23:00:00", "20:00:00", "23:00:00", 0, True),
    ("2024-01-30 23:00:59", "20:00:00", "23:00:00", 0, True),
    ("2024-01-30 23:01:00", "20:00:00", "23:00:00", 0, False),
    ("2024-01-30 10:05:00", "10:10:00", "10:20:00", 0, False),
    ("2024-01-30 10:15:00", "10:10:00", "10:20:00", 0, True),
    ("2024-01-30 10:40:00", "10:10:00", "10:20:00", 0, True),   # same-hour window ignores the end minute
    ("2024-01-30 23:00:00", "22:00:00", "02:00:00", 0, False),  # over midnight never matches
    ("2024-01-30 10:15:00", "10:00:00", "11:00:00", 2, True),   # 2024-01-30 is a Tuesday
    ("2024-01-30 10:15:00", "10:00:00", "11:00:00", 3, False),
    ("2024-01-28 10:15:00", "10:00:00", "11:00:00", 7, True),   # Sunday = 7
])
def test_blackout_boundaries(spark, ts, start, end, dow, expected):
    bo = _blackouts(spark, [(1, 9, dow, start, end)])
    ev = spark.createDataFrame([(9, dt.datetime.fromisoformat(ts))], "alert_id int, at timestamp_ntz")
    assert rt.blackout_status(ev, bo, "at").first()["in_blackout"] is expected


def test_blackout_any_window_and_no_window(spark):
    bo = _blackouts(spark, [(1, 9, 0, "01:00:00", "02:00:00"), (2, 9, 0, "10:00:00", "11:00:00")])
    ev = spark.createDataFrame([(9, dt.datetime(2024, 1, 1, 10, 30)), (8, dt.datetime(2024, 1, 1, 10, 30))],
                               "alert_id int, at timestamp_ntz")
    got = {r["alert_id"]: r["in_blackout"] for r in rt.blackout_status(ev, bo, "at").collect()}
    assert got == {9: True, 8: False}


# -- suppression boundary ------------------------------------------------------------------
def test_suppress_recent_boundary(spark):
    hist = spark.createDataFrame([
        ("A", 1, NOW - dt.timedelta(minutes=5), None, None),                          # exactly delay ago: kept
        ("b", 1, NOW - dt.timedelta(minutes=5) + dt.timedelta(seconds=1), None, None),  # inside: suppressed
        ("C", 1, NOW - dt.timedelta(minutes=5, seconds=1), None, None),               # outside: kept
        ("D", 2, NOW, None, None),                                                    # other alert
    ], C.HISTORY_SCHEMA)
    cur = spark.createDataFrame([("A",), ("B",), ("C",), ("D",)], "instance string")
    kept = {r["instance"] for r in st.suppress_recent(cur, hist, 1, 5, NOW).collect()}
    assert kept == {"A", "C", "D"}
    assert st.suppress_recent(cur, hist, 1, 0, NOW).count() == 4


# -- threshold precedence ------------------------------------------------------------------
def _overrides(spark, rows):
    full = [(oid, aid, None, None, None, aud, True, None, None, tn, tv, iid, thr)
            for oid, aid, aud, tn, tv, iid, thr in rows]
    return spark.createDataFrame(full, C.OVERRIDES_SCHEMA)


def test_threshold_precedence(spark):
    alerts = spark.createDataFrame([r for r in C.ALERT_ROWS if r[0] == 1], C.ALERTS_SCHEMA)
    ov = _overrides(spark, [
        (10, 1, None, None, None, 1, "100"), (9, 1, None, None, None, 1, "90"),   # tie -> lowest id
        (11, 1, None, None, None, 2, None),                                        # NULL wins by rank
        (12, 1, None, "Role", "Prod", None, "300"),                                 # tag level
        (13, 1, None, "Role", "Prod", 3, "999"),                                    # mixed row: ignored
    ])
    t = spark.createDataFrame([(1,), (2,), (3,), (4,)], "instance_id bigint")
    got = {r["instance_id"]: r["threshold"] for r in th.resolve_threshold(t, ov, alerts, 1, "role", "PROD").collect()}
    assert got == {1: "90", 2: None, 3: "300", 4: "300"}
    got = {r["instance_id"]: r["threshold"] for r in th.resolve_threshold(t, ov, alerts, 1).collect()}
    assert got == {1: "90", 2: None, 3: "10000", 4: "10000"}


def test_threshold_breach_strict(spark):
    df = spark.createDataFrame([(1, 10, "10"), (2, 11, "10"), (3, 50, None), (4, 50, "abc")], "i int, m int, threshold string")
    assert [r["i"] for r in th.threshold_breach(df, "m").collect()] == [2]
    assert sorted(r["i"] for r in th.threshold_breach(df, "m", strict=False).collect()) == [1, 2]


def test_band_check(spark):
    df = spark.createDataFrame([(5,), (10,), (15,)], "v int")
    b = lambda lo, hi: df.filter(th.band_check(F.col("v"), F.lit(lo), F.lit(hi))).count()
    assert (b(None, None), b(10, None), b(None, 10), b(6, 14)) == (3, 2, 2, 1)


# -- routing fields ------------------------------------------------------------------------
def test_audience_merge(spark):
    df = spark.createDataFrame([("d", None, True), ("d", "x", True), ("d", "x", False), ("d", "x", None)],
                               "d string, x string, f boolean")
    got = [r[0] for r in df.select(rt.merge_audience(F.col("d"), F.col("x"), F.col("f"))).collect()]
    assert got == ["d", "x", "d;x", "d"]


def test_resolve_overrides_fill_from_alert(spark):
    alerts = spark.createDataFrame([r for r in C.ALERT_ROWS if r[0] == 1], C.ALERTS_SCHEMA)
    hooks = C.with_webhook_parts(spark.createDataFrame(C.WEBHOOK_ROWS, C.WEBHOOKS_SCHEMA))
    ov = _overrides(spark, [(20, 1, "inst@x", None, None, 7, None), (21, 1, "tag@x", "Role", "Prod", None, None)])
    t = spark.createDataFrame([(7,), (8,)], "instance_id bigint")
    got = {r["instance_id"]: (r["audience"], r["webhook"])
           for r in rt.resolve_overrides(t, ov, alerts, hooks, 1, "Role", "Prod").collect()}
    assert got == {7: ("inst@x", "https://hooks.example.com/ops"), 8: ("tag@x", "https://hooks.example.com/ops")}


# -- arithmetic, formatting, text ----------------------------------------------------------
def test_pages_to_mb_golden_counts(spark):
    """The one published sample: growth MB / step MB -> autogrow count."""
    rows = [(109760 * 128, 64 * 128, 1715), (501 * 128, 1 * 128, 501), (18880 * 128, 64 * 128, 295)]
    df = spark.createDataFrame(rows, "delta bigint, step bigint, expected int")
    out = df.select(F.try_divide(F.col("delta").cast("decimal(20,0)"),
                                 F.nullif(F.col("step").cast("decimal(20,0)"), F.lit(0))).cast("int").alias("n"),
                    "expected").collect()
    assert all(r["n"] == r["expected"] for r in out)


def test_fmt_n_half_away_from_zero(spark):
    df = spark.createDataFrame([(2.25, 1234567.125, 2.5, 1234567)], "a double, b double, c double, d bigint")
    r = df.select(tx.fmt_n(F.col("a"), 1), tx.fmt_n(F.col("b"), 2), tx.fmt_n(F.col("c"), 0), tx.fmt_n(F.col("d"), 0)).first()
    assert tuple(r) == ("2.3", "1,234,567.13", "3", "1,234,567")


def test_tr_escapes_and_skips_null(spark):
    df = spark.createDataFrame([("a&b<c>", None, 3)], "x string, y string, z int")
    assert df.select(tx.tr(F.col("x"), F.col("y"), F.col("z"))).first()[0] == "<tr><td>a&amp;b&lt;c&gt;</td><td>3</td></tr>"


def test_flag_label_and_counter_path(spark):
    df = spark.createDataFrame([(0, "o", "c", ""), (1, "o", "c", "i")], "f int, o string, c string, i string")
    got = [tuple(r) for r in df.select(tx.flag_label(F.col("f")), tx.counter_path(F.col("o"), F.col("c"), F.col("i"))).collect()]
    assert got == [("No ", "o\\c"), ("Yes", "o\\c\\i")]


def test_wiki_link(spark):
    df = spark.createDataFrame([("https://github.com/x/##alertname## a", "High CPU"), ("http://w/##alertname##", "A B"),
                                (None, "A")], "w string, n string")
    got = [r[0] for r in df.select(tx.wiki_link(F.col("w"), F.col("n"))).collect()]
    assert got == ["https://github.com/x/High-CPU-a", "http://w/A B", None]


def test_minutes_between_counts_boundaries(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 10, 0, 59), dt.datetime(2024, 1, 1, 10, 1, 0))], "a timestamp_ntz, b timestamp_ntz")
    assert df.select(tx.minutes_between(F.col("a"), F.col("b"))).first()[0] == 1


def test_int_avg_truncates(spark):
    df = spark.createDataFrame([(7, 2), (-7, 2), (1, 0)], "s bigint, n bigint")
    assert [r[0] for r in df.select(tx.int_avg(F.col("s"), F.col("n"))).collect()] == [3, -3, None]


# -- parameter and tag text ----------------------------------------------------------------
def test_parse_thresholds():
    assert pm.parse_thresholds("@MinutesBack int=15,@MinBlockWaitTimeRecursive int=10000") == {
        "MinutesBack": "15", "MinBlockWaitTimeRecursive": "10000"}
    assert pm.parse_thresholds("@LastMinutes int=15;@LRPThreshold int=100000")["LRPThreshold"] == "100000"


def test_thresholds_kv_column(spark):
    df = spark.createDataFrame([("@A int=1,@B int=2;@C int=3",)], "t string")
    assert df.select(pm.thresholds_kv(F.col("t"))).first()[0] == {"A": "1", "B": "2", "C": "3"}


def test_tag_pairs(spark):
    df = spark.createDataFrame([("Tag1:v1,v2;Tag2:v3",)], "t string")
    got = [tuple(x) for x in df.select(pm.tag_pairs(F.col("t"))).first()[0]]
    assert got == [("Tag1", "v1"), ("Tag1", "v2"), ("Tag2", "v3")]


def test_tags_and_thresholds_json(spark):
    tags = '[{ "tags": {"name": "Role", "values": ["SQL", "C#", "Azure"]} }]'
    thr = ('[{ "thresholds": {"name": "MinBlockedSessions", "value": "10"}}, '
           '{ "thresholds": {"name": "MinBlockedWaitTimeMs", "value": "10000"}}]')
    df = spark.createDataFrame([(tags, thr)], "a string, b string")
    r = df.select(pm.tags_from_json(F.col("a")), pm.thresholds_from_json(F.col("b"))).first()
    assert [tuple(x) for x in r[0]] == [("Role", "SQL"), ("Role", "C#"), ("Role", "Azure")]
    assert [tuple(x) for x in r[1]] == [("MinBlockedSessions", "10"), ("MinBlockedWaitTimeMs", "10000")]


def test_param_value_default(spark):
    p = spark.createDataFrame(C.PARAMETER_ROWS, C.PARAMETERS_SCHEMA)
    assert pm.param_value(p, "Reports/TopBlockers/TopNRows", "5").first()[0] == "10"
    assert pm.param_value(p, "missing", "5").first()[0] == "5"


# -- state writes --------------------------------------------------------------------------
def test_history_state_write(spark):
    hist = spark.createDataFrame([("a", 3, NOW, "1", "ON"), ("B", 3, NOW, "2", "OFF"), ("c", 3, NOW, "3", "ON"),
                                  ("a", 1, NOW, None, None)], C.HISTORY_SCHEMA)
    acts = spark.createDataFrame([("A", 5, "ON->OFF"), ("b", 90, "OFF->ON"), ("C", 95, "IGNORE"), ("d", 99, "NEW->ON")],
                                 "instance string, counter int, action string")
    later = NOW + dt.timedelta(minutes=1)
    got = {(r["instance"], r["alert_id"]): (r["last_value"], r["status"], r["last_occurrence"])
           for r in st.history_state_write(hist, acts, 3, later).collect()}
    assert got == {("a", 3): ("5", "OFF", later), ("B", 3): ("90", "ON", later), ("c", 3): ("3", "ON", NOW),
                   ("d", 3): ("99", "ON", later), ("a", 1): (None, None, NOW)}


def test_history_upsert_distinct_source(spark):
    hist = spark.createDataFrame([("a", 1, NOW, "x", "ON")], C.HISTORY_SCHEMA)
    src = spark.createDataFrame([("A",), ("a",), ("n",), ("n",)], "instance string")
    later = NOW + dt.timedelta(minutes=3)
    got = sorted((r["instance"], r["last_occurrence"], r["last_value"]) for r in st.history_upsert(hist, src, 1, later).collect())
    assert got == [("a", later, "x"), ("n", later, None)]


def test_merge_upsert_and_insert_missing(spark):
    t = spark.createDataFrame([(1, "a", "v1"), (2, "b", "v2")], "id int, description string, value string")
    s = spark.createDataFrame([(2, "B", "new"), (3, "c", "v3")], "id int, description string, value string")
    got = sorted(tuple(r) for r in st.merge_upsert(t, s, ["id"], ["description"]).collect())
    assert got == [(1, "a", "v1"), (2, "B", "v2"), (3, "c", "v3")]
    got = sorted(tuple(r) for r in st.insert_missing(t, s, ["id"]).collect())
    assert got == [(1, "a", "v1"), (2, "b", "v2"), (3, "c", "v3")]


def test_validate_request(spark):
    from tripwire.operators.validate import validate_request
    alerts = spark.createDataFrame(C.ALERT_ROWS, C.ALERTS_SCHEMA)
    req = spark.createDataFrame([
        ("High CPU", 1, None, None, None, None),
        ("Custom", 255, "a@x", "<t/>", "http://h", None),
        ("High CPU", 255, None, None, None, None),
        ("Nope", 9, None, None, None, None),
        ("custom", 255, None, "<t/>", None, "{}"),
    ], "alert_name string, alert_type int, audience string, email_template string, webhook string, webhook_template string")
    got = [(r["errors"], r["webhook_enabled"]) for r in validate_request(req, alerts).orderBy("alert_type", "alert_name").collect()]
    assert ([], False) in got
    assert (["custom_email_needs_audience"], False) in got
    assert (["invalid_alert_type", "unknown_alert"], False) in got
    assert (["name_type_mismatch", "custom_needs_template"], False) in got
    assert ([], False) in got


def test_tag_not_found(spark):
    from tripwire.plans.tags import TagNotFound, check_tag
    tags = spark.createDataFrame([(1, "Role", "Prod")], "instance_id bigint, tag_name string, tag_value string")
    check_tag(tags, "role", "PROD")
    check_tag(tags, None, "x")
    with pytest.raises(TagNotFound):
        check_tag(tags, "Role", "Dev")


def test_config_values_are_fixed():
    levels = dict(C.LEVEL_ROWS)
    assert levels == {0: "Normal", 1: "Informational", 2: "Warning", 3: "Critical", 4: "Fatal"}
    by_name = {r[1]: r for r in C.ALERT_ROWS}
    assert by_name["Blocking - Duration"][-1] == "10000" and by_name["Blocking - Processes"][-1] == "2"
    assert by_name["High CPU"][-1] == "80" and by_name["Blocking - Duration"][4] == 5
    assert Decimal(1) == Decimal("1")
