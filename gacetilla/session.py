"""Spark session helpers.

The library never creates a session behind the caller's back: every operator
takes DataFrames.  These helpers are for tests, the bench and the scripts.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "gacetilla") -> SparkSession:
    """Session with the settings the library is tuned for.

    AQE stays on so the runtime can coalesce small shuffles and split skewed
    join partitions; the UI is off (no server is opened).
    """
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # CPU-heavy stages (tokenising, bigrams) follow small shuffles; keep
        # them spread over the cores instead of coalescing to one task.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "256KB")
        # small local files are split too, as far as their row groups allow
        .config("spark.sql.files.maxPartitionBytes", os.environ.get("SPARK_SPLIT_BYTES", "4m"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
        .config("spark.sql.ansi.enabled", "false")

    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: scratch folders of local sessions that name none, by application
_LOCAL_SCRATCH: dict[str, str] = {}


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process."""
    master = spark.sparkContext.master
    return master.startswith("local") and not master.startswith("local-cluster")


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for materialised tables and checkpoints.

    This is what ``spark.checkpoint.dir`` (or the context's checkpoint folder)
    names.  A purely local session without one gets a scratch folder of its
    own; a cluster without one is an error, because a folder on one machine
    would not be seen by the others.  The session's settings are not changed.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        return conf_dir.rstrip("/")
    try:
        sc = spark.sparkContext
    except Exception as error:  # a remote (Connect) session has no context here
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share") from error
    if sc.getCheckpointDir():
        return sc.getCheckpointDir().rstrip("/")
    if not is_local(spark):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[sc.applicationId] = tempfile.mkdtemp(prefix="gacetilla-scratch-")
    return _LOCAL_SCRATCH[sc.applicationId]


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob names something, on any file system Spark reads."""
    return bool(existing_paths(spark, path))


def existing_paths(spark: SparkSession, path: str) -> list[str]:
    """The paths that a path or glob names (names only, nothing is read)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(p)
    return [x.getPath().toString() for x in found] if found is not None else []


def delete_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def make_folder(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).mkdirs(p)


def rename_path(spark: SparkSession, source: str, target: str) -> None:
    """One rename inside a file system; an error when the target exists."""
    old, new = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (source, target))
    fs = old.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if fs.exists(new) or not fs.rename(old, new):
        raise FileExistsError(f"{source} could not become {target}")


#: folders of materialised tables that go at the end, by application
_OWN: dict[str, str] = {}


def _own_folder(spark: SparkSession) -> str:
    """The application's folder of materialised tables."""
    base = f"{checkpoint_dir(spark)}/materialized"
    app = spark.sparkContext.applicationId
    if _OWN.get(app) != f"{base}/{app}":
        _OWN[app] = f"{base}/{app}"
        make_folder(spark, _OWN[app])
        p = spark._jvm.org.apache.hadoop.fs.Path(_OWN[app])
        p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(p)
    return _OWN[app]


#: tables materialised in the open ``scratch`` block of this thread or task
_SCOPE: ContextVar[list[str] | None] = ContextVar("gacetilla_scratch", default=None)


@contextmanager
def scratch(spark: SparkSession):
    """Tables materialised inside the block, by its own thread, are deleted at
    its end: for callers that have written their results by then."""
    mine: list[str] = []
    token = _SCOPE.set(mine)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        for path in mine:
            delete_path(spark, path)


def materialize(df, name: str = "table", row_group: int | None = None):
    """Write an intermediate result once to the shared folder and read it back:
    cuts the lineage, so reuses do not recompute it, and survives the loss of
    any executor.  Inside ``scratch`` the files go at the end of the block;
    otherwise they stay as long as the returned DataFrame may be read, and go
    when the driver's JVM ends.  ``row_group``: bytes of a row group, for wide
    rows, as writers and readers hold a group of them."""
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    write = df.write.mode("overwrite")
    if row_group is not None:
        write = write.option("parquet.block.size", row_group)
    write.parquet(path)
    mine = _SCOPE.get()
    if mine is not None:
        mine.append(path)
    return spark.read.parquet(path)
