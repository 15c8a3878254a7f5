"""DuckDB SQL building blocks for the oracle: telemetry bindings, config tables, as-of time.

Only the driver-registered input tables are referenced; everything else is a CTE.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import types as T

from tripwire.sources import config as C

BINDINGS = {
    "instances": """SELECT c_custkey AS instance_id, c_name AS instance_display_name, lower(c_name) AS connection_id,
       c_acctbal >= 0 AS is_active FROM customer WHERE c_custkey IN (SELECT user_id FROM events)""",
    "instance_tags": """SELECT c_custkey AS instance_id, 'segment' AS tag_name, c_mktsegment AS tag_value FROM customer
       UNION ALL SELECT c_custkey, 'nation', n_name FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "as_of": "SELECT max(ts) AS now FROM events",
    "li_as_of": "SELECT max(l_shipdate) AS now FROM lineitem",
    "collection_dates": """SELECT user_id AS instance_id, event_type AS reference, max(ts) AS snapshot_date
       FROM events GROUP BY user_id, event_type""",
    "cpu": """SELECT user_id AS instance_id, ts AS event_time, event_id, CAST(floor(CASE WHEN value > 100 THEN 100 ELSE value END) AS INT) AS total_cpu
       FROM events WHERE event_type = 'view'""",
    "blocking_snapshot": """SELECT user_id AS instance_id, ts AS snapshot_date, event_id,
       CAST(CAST(value AS DECIMAL(18,2)) * 1000 AS BIGINT) AS blocked_wait_time,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 10 AS blocked_session_count
       FROM events WHERE event_type = 'error'""",
    "waits": """SELECT user_id AS instance_id, ts AS snapshot_date, event_type AS wait_type,
       event_type IN ('error','purchase') AS is_critical_wait, CAST(value AS DECIMAL(18,2)) AS wait_time_ms,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) + 1 AS sample_ms_diff FROM events""",
    "performance_counters": """SELECT user_id AS instance_id, event_type AS counter_name, 'App' AS object_name,
       '' AS instance_name, ts AS snapshot_date, event_id, CAST(value AS DECIMAL(18,2)) AS value FROM events""",
    "running_queries": """SELECT l_suppkey AS instance_id, s_name AS instance_display_name, s_acctbal >= 0 AS is_active,
       l_shipdate AS snapshot_date, concat('h', CAST(l_partkey AS VARCHAR)) AS sql_handle, p_name AS query_text,
       l_orderkey AS session_id, CASE l_linestatus WHEN 'O' THEN 'running' ELSE 'suspended' END AS status,
       l_linenumber AS open_transaction_count, CAST(floor(l_quantity) AS BIGINT) AS block_count,
       CAST(floor(l_quantity) AS BIGINT) * l_linenumber AS block_count_recursive,
       CAST(floor(l_extendedprice) AS BIGINT) AS block_wait_ms,
       CAST(floor(l_extendedprice) AS BIGINT) * (1 + l_linenumber) AS block_wait_recursive_ms,
       CAST(floor(l_quantity) AS BIGINT) * 100 AS duration_ms, l_returnflag = 'R' AS is_root_blocker
       FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey""",
    "running_queries_summary": """SELECT user_id AS instance_id, ts AS snapshot_date, event_id,
       CAST(CAST(value AS DECIMAL(18,2)) * 1000 AS BIGINT) AS longest_running_query_ms,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 5 AS tempdb_wait_count,
       CAST(floor(value) AS BIGINT) * 50 AS tempdb_wait_time_ms,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 3 AS critical_wait_count,
       CAST(floor(value) AS BIGINT) * 80 AS critical_wait_time
       FROM events WHERE event_type IN ('click','signup')""",
    "drive_status": """SELECT CAST(c_custkey - c_custkey % 4 AS BIGINT) AS instance_id,
       'Host#' || CAST(c_custkey - c_custkey % 4 AS VARCHAR) AS instance_display_name, c_name AS name,
       11000 AS total_gb, CAST(floor(c_acctbal + 1000) AS BIGINT) AS free_gb,
       CAST(floor(c_acctbal + 1000) AS BIGINT) / CAST(11000 AS DOUBLE) AS pct_free_space,
       CAST(0.1 AS DOUBLE) AS critical_threshold, CAST(0.2 AS DOUBLE) AS warning_threshold FROM customer""",
    "db_files": """SELECT p_partkey AS file_id, p_name AS file_name, p_brand AS database_name,
       p_brand NOT LIKE '%5' AS database_is_active, p_size % 7 <> 0 AS file_is_active,
       p_partkey % 100 AS instance_id, CAST(floor(p_retailprice) AS BIGINT) AS size,
       p_size % 2 AS is_percent_growth, CASE WHEN p_size % 2 = 1 THEN 10 ELSE 64 END AS growth FROM part""",
    "db_file_snapshot": """SELECT l_partkey AS file_id, l_shipdate AS snapshot_date,
       CAST(floor(l_quantity * 25) AS BIGINT) AS size, l_orderkey, l_linenumber FROM lineitem""",
    # derived config -----------------------------------------------------------------------
    "alert_overrides": """SELECT * FROM alert_overrides_fixed
       UNION ALL SELECT CAST(100000 + instance_id AS INTEGER), 1, NULL, NULL, NULL,
         CASE WHEN instance_id % 14 = 0 THEN 'dba-oncall@example.com' END, TRUE, NULL, NULL, NULL, NULL,
         instance_id, CASE WHEN instance_id % 49 <> 0 THEN '20000' END FROM instances WHERE instance_id % 7 = 0
       UNION ALL SELECT CAST(200000 + instance_id AS INTEGER), 2, NULL, NULL, NULL, NULL, TRUE, NULL, NULL, NULL,
         NULL, instance_id, '5' FROM instances WHERE instance_id % 6 = 0
       UNION ALL SELECT CAST(300000 + instance_id AS INTEGER), 3, NULL, NULL, NULL,
         CASE WHEN instance_id % 10 = 0 THEN 'cpu-team@example.com' END, instance_id % 20 <> 0, NULL, NULL, NULL, NULL,
         instance_id, '30' FROM instances WHERE instance_id % 5 = 0
       UNION ALL SELECT CAST(400000 + instance_id AS INTEGER), 7, NULL, NULL, NULL, NULL, TRUE, NULL, NULL, NULL,
         NULL, instance_id, '@MinutesBack int=30;@MinBlockWaitTimeRecursive int=5000' FROM instances
         WHERE instance_id % 11 = 0""",
    "alert_history": """SELECT CASE WHEN instance_id % 3 = 0 THEN lower(instance_display_name) ELSE instance_display_name END
         AS instance, 1 AS alert_id, now - to_minutes(CAST(instance_id % 10 AS BIGINT)) AS last_occurrence,
         CAST(NULL AS VARCHAR) AS last_value, CAST(NULL AS VARCHAR) AS status
       FROM instances, as_of WHERE instance_id % 2 = 0
       UNION ALL SELECT CASE WHEN instance_id % 3 = 0 THEN lower(instance_display_name) ELSE instance_display_name END,
         3, now - to_minutes(CAST(instance_id % 10 AS BIGINT)), CAST(instance_id % 100 AS VARCHAR),
         CASE WHEN instance_id % 4 = 0 THEN 'ON' ELSE 'OFF' END
       FROM instances, as_of WHERE instance_id % 2 = 0""",
    "alert_blackouts": """SELECT *, CAST(split_part(start_time, ':', 1) AS INTEGER) AS start_h,
         CAST(split_part(start_time, ':', 2) AS INTEGER) AS start_m,
         CAST(split_part(end_time, ':', 1) AS INTEGER) AS end_h,
         CAST(split_part(end_time, ':', 2) AS INTEGER) AS end_m FROM alert_blackouts_fixed""",
    "alert_webhooks": """SELECT *, 'sql@cms-' || lower(environment_name) AS username,
         environment_name || '-' || replace(name, ' ', '') AS webhook_id FROM alert_webhooks_fixed""",
}

DEPENDS = {
    "alert_overrides": ["alert_overrides_fixed", "instances"],
    "alert_history": ["instances", "as_of"],
    "alert_blackouts": ["alert_blackouts_fixed"],
    "alert_webhooks": ["alert_webhooks_fixed"],
}

_FIXED_ALIASES = {
    "alert_overrides_fixed": "alert_overrides_fixed",
    "alert_blackouts_fixed": "alert_blackouts",
    "alert_webhooks_fixed": "alert_webhooks",
}


def _sql_type(t: T.DataType) -> str:
    if isinstance(t, T.IntegerType):
        return "INTEGER"
    if isinstance(t, T.LongType):
        return "BIGINT"
    if isinstance(t, T.ShortType):
        return "SMALLINT"
    if isinstance(t, T.BooleanType):
        return "BOOLEAN"
    if isinstance(t, T.StringType):
        return "VARCHAR"
    if isinstance(t, (T.TimestampNTZType, T.TimestampType)):
        return "TIMESTAMP"
    if isinstance(t, T.DecimalType):
        return f"DECIMAL({t.precision},{t.scale})"
    if isinstance(t, T.DoubleType):
        return "DOUBLE"
    raise TypeError(t)


def _lit(v, t: T.DataType) -> str:
    st = _sql_type(t)
    if v is None:
        return f"CAST(NULL AS {st})"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float, Decimal)):
        return f"CAST({v} AS {st})"
    if isinstance(v, dt.datetime):
        return f"CAST('{v.isoformat(sep=' ')}' AS TIMESTAMP)"
    return "CAST('" + str(v).replace("'", "''") + f"' AS {st})"


def values_sql(name: str) -> str:
    """A fixed config table as a VALUES list with explicit column types."""
    schema, rows = C.FIXED[name]
    cols = ", ".join(f.name for f in schema.fields)
    body = ",\n  ".join("(" + ", ".join(_lit(v, f.dataType) for f, v in zip(schema.fields, r)) + ")" for r in rows)
    return f"SELECT * FROM (VALUES\n  {body}) AS v({cols})"


def cte_sql(name: str) -> str:
    if name in BINDINGS:
        return BINDINGS[name]
    fixed = _FIXED_ALIASES.get(name, name)
    if fixed in C.FIXED:
        return values_sql(fixed)
    raise KeyError(name)


def _deps(name: str) -> list[str]:
    return DEPENDS.get(name, [])


def with_views(*names: str) -> str:
    """`WITH` clause defining the named views (and what they depend on), in dependency order."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in _deps(n):
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS (\n{cte_sql(n)}\n)" for n in order)


def query(views: list[str], ctes: list[tuple[str, str]], final: str) -> str:
    """Compose: views + extra named CTEs + final SELECT."""
    head = with_views(*views)
    extra = "".join(f",\n{n} AS (\n{s}\n)" for n, s in ctes)
    return f"{head}{extra}\n{final}"
