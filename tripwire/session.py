"""SparkSession construction and cluster-safe scratch locations."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on. AQE re-plans joins from runtime sizes (auto-broadcast is
# size-checked there, with sort-merge as the fallback), coalesces small shuffle partitions
# and splits skewed ones. UTC keeps timestamp arithmetic identical to the SQL oracle.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Local session for tests and the bench; on a cluster the caller's session is used as is."""
    builder = SparkSession.builder.appName("tripwire")
    if master:
        builder = builder.master(master)
    for k, v in BASE_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_session_conf(spark)
    return spark


def apply_session_conf(spark: SparkSession) -> None:
    """Runtime SQL settings the jobs need; safe to call on a shared session."""
    for k, v in BASE_CONF.items():
        if k == "spark.sql.execution.arrow.pyspark.enabled":
            continue
        try:
            spark.conf.set(k, v)
        except Exception:  # static conf on a running cluster session: keep the cluster's value
            pass


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder, as the cluster names it in spark.checkpoint.dir.

    Without that setting only a local master (one process, so one file system) gets a fresh
    temporary folder; on a cluster a missing setting is an error, because a folder of the
    driver's machine would be invisible to the executors.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if re.fullmatch(r"local(\[[^\]]*\])?", sc.master) is None:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="tripwire-checkpoints-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def materialized(df: DataFrame) -> DataFrame:
    """Write the frame to the shared checkpoint folder and cut its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
