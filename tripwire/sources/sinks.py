"""Sinks: outbox and event log (append), alert state (versioned snapshots).

State is never overwritten in place: each write goes to a new folder `<base>/v=<version>-<unique>`
and readers take the newest complete version, so a job that dies mid-write leaves the previous
state intact. The alert history is kept per alert (`<base>/alert=<id>/v=...`): a job writes only the
rows of its own alert, so jobs of different alerts that run at the same time cannot undo each other's
state. Two jobs of the same alert are serialized by a commit log (`commit`): a new state is written to a
folder of its own and becomes the state when its number is put into `<base>/commits`, which fails if
another job took that number first; the change is then merged into that job's state and tried again.
"""

from __future__ import annotations

import datetime as dt
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F


def write_outbox(outbox: DataFrame, path: str, run: str, run_at: dt.datetime) -> str:
    """Write one run's outbox rows into its own folder `<path>/run=<run>`.

    Overwriting only that folder makes a retried run idempotent; earlier runs are kept."""
    target = f"{path}/run={run}"
    outbox.withColumn("run_at", F.lit(run_at).cast("timestamp_ntz")).write.mode("overwrite").parquet(target)
    return target


def folders(spark: SparkSession, base: str, prefix: str, complete: bool = True) -> list[str]:
    """Names of the sub-folders of `base` that begin with `prefix` (complete ones), in order."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(base)
    fs = p.getFileSystem(conf)
    if not fs.exists(p):
        return []
    out = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if name.startswith(prefix) and (not complete or fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS"))):
            out.append(name)
    return sorted(out)


def _number(name: str) -> int:
    return int(name.split("=")[1].split("-")[0])


def newest(spark: SparkSession, base: str, prefix: str, before: int | None = None) -> str | None:
    """Name of the newest complete folder `<prefix><number>...` under `base` (with a number below `before`), or None.

    One listing; only the newest folders are looked into, until one is complete."""
    for name in reversed(folders(spark, base, prefix, complete=False)):
        if before is None or _number(name) < before:
            done, fs = _file_system(spark, f"{base}/{name}/_SUCCESS")
            if fs.exists(done):
                return name
    return None


def latest(spark: SparkSession, base: str, before: int | None = None) -> DataFrame | None:
    """The newest complete snapshot under `base` (with a number below `before`, where given), or None."""
    name = newest(spark, base, "v=", before)
    return None if name is None else spark.read.parquet(f"{base}/{name}")


def drop_older(spark: SparkSession, base: str, prefix: str, than: str) -> None:
    """Remove the folders of `base` that were replaced by newer ones: those that sort before `than`."""
    for name in folders(spark, base, prefix, complete=False):
        if name < than:
            old, fs = _file_system(spark, f"{base}/{name}")
            fs.delete(old, True)


def write_snapshot(df: DataFrame, base: str, version: int | None = None) -> str:
    """Write a complete snapshot as a new version; a retry of the same version gets a folder of its own."""
    spark = df.sparkSession
    if version is None:
        version = max([0, *map(_number, folders(spark, base, "v="))]) + 1
    path = f"{base}/v={version:09d}-{dt.datetime.now(dt.timezone.utc):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(path)
    return path


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file with its whole content, unless there is one of that name already (then False).

    The file is written under another name and published in one step that fails if the name is taken: a hard link on a
    local file system, a rename elsewhere (HDFS refuses to rename onto an existing file).
    """
    jvm = spark.sparkContext._jvm
    target, fs = _file_system(spark, path)
    draft = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.draft")
    fs.mkdirs(target.getParent())
    stream = fs.create(draft, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    try:
        if fs.getScheme() != "file":
            return not fs.exists(target) and bool(fs.rename(draft, target))
        local = [jvm.java.nio.file.Path.of(jvm.java.net.URI("file://" + x.toUri().getPath())) for x in (target, draft)]
        try:
            jvm.java.nio.file.Files.createLink(*local)
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in str(e.java_exception):
                return False
            raise
    finally:
        if fs.exists(draft):
            fs.delete(draft, False)


def head(spark: SparkSession, base: str) -> tuple[int, str | None]:
    """(number of the newest commit, its data folder); (0, None) when there is none."""
    names = [n for n in folders(spark, f"{base}/commits", "", complete=False) if n.isdigit()]
    if not names:
        return 0, None
    path, fs = _file_system(spark, f"{base}/commits/{names[-1]}")
    stream = fs.open(path)
    try:
        text = bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
    return int(names[-1]), f"{base}/{text}"


def current(spark: SparkSession, base: str) -> DataFrame | None:
    """The committed state; where nothing was committed yet, the newest complete version, or None."""
    _, path = head(spark, base)
    return latest(spark, base) if path is None else spark.read.parquet(path)


def commit(spark: SparkSession, base: str, change, tries: int = 50) -> str:
    """Replace the state by change(state) without losing a change of another job; returns the data folder.

    `change` gets the committed state (None at first) and returns the whole new one. It runs again, on the newer state,
    whenever another job committed in between. A job that dies before its commit leaves an unnamed folder and no change.
    """
    for _ in range(tries):
        number, path = head(spark, base)
        new = change(latest(spark, base) if path is None else spark.read.parquet(path))
        folder = f"data-{uuid.uuid4().hex}"
        new.write.parquet(f"{base}/{folder}")
        if put_if_absent(spark, f"{base}/commits/{number + 1:09d}", folder):
            return f"{base}/{folder}"
    raise RuntimeError(f"{tries} commits to {base} met newer ones")


def alert_history(spark: SparkSession, base: str, alert_id: int, before: int | None = None) -> DataFrame | None:
    """The stored history rows of one alert, or None when none were written yet."""
    base = f"{base}/alert={alert_id}"
    return current(spark, base) if before is None else latest(spark, base, before)


def latest_history(spark: SparkSession, base: str) -> DataFrame | None:
    """The stored history of all alerts, or None when there is none yet."""
    found = [current(spark, f"{base}/{name}") for name in folders(spark, base, "alert=", complete=False)]
    out = None
    for df in found:
        if df is not None:
            out = df if out is None else out.unionByName(df)
    return out


def commit_alert_history(spark: SparkSession, base: str, alert_id: int, first: DataFrame, change) -> str:
    """Commit change(history rows of the alert); `first` are its rows before anything was stored."""
    mine = F.col("alert_id") == alert_id
    return commit(spark, f"{base}/alert={alert_id}", lambda old: change(first if old is None else old).filter(mine))
