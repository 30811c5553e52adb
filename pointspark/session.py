"""Session helpers: the shared folder for intermediate tables and worker-side caches."""

from __future__ import annotations

import atexit
import shutil
import sys
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "pointspark", cpus: str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings the engine is tested with."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local session that names none gets a temporary folder, which is
    removed when the process ends. Anywhere else a missing setting is an error,
    as executors do not see each other's disks.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if jvm_dir.isDefined():
        return jvm_dir.get().rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="pointspark-")
    atexit.register(shutil.rmtree, own, True)
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    Cuts the lineage: later jobs read the files, and a lost executor costs
    nothing that was computed before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


#: What materialize wrote, by application.
_written: dict[str, list[str]] = {}


def discard(*tables: DataFrame) -> None:
    """Remove the files of tables that materialize gave, if release has not done so; nothing may read them any more."""
    for df in tables:
        known = _written.get(df.sparkSession.sparkContext.applicationId, [])
        if df.written_path in known:
            _remove(df.sparkSession, df.written_path)
            known.remove(df.written_path)


def release(spark: SparkSession) -> int:
    """Remove all that materialize wrote in this application, and say how many tables that were.

    To be called when the results that were computed from them are stored.
    """
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        _remove(spark, path)
    return len(paths)


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def worker_cache(key: str, build: Callable[[], Any]) -> Any:
    """One object per Python worker process, whichever task asks first."""
    store = sys.__dict__.setdefault("_pointspark_cache", {})
    if key not in store:
        store[key] = build()
    return store[key]
