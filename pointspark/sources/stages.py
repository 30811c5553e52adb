"""Stage tables: where results lie, what is complete, and versions of what is overwritten."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Stages:
    """Parquet tables of a pipeline under one folder, written once and read by later runs."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def complete(self, name: str) -> bool:
        """Whether a stage's write has ended (its marker is there)."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path(name)}/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def get(self, name: str, make, partition_by: tuple[str, ...] = ()) -> DataFrame:
        """The stage's table, made if it is not complete."""
        if not self.complete(name):
            writer = make().write.mode("overwrite")
            (writer.partitionBy(*partition_by) if partition_by else writer).parquet(self.path(name))
        return self.spark.read.parquet(self.path(name))

    def missing(self, name: str, wanted: DataFrame, key: str = "frame") -> DataFrame:
        """Keys of wanted for which a stage has no rows yet."""
        if not self.complete(name):
            return wanted.select(key).distinct()
        return wanted.select(key).distinct().join(self.spark.read.parquet(self.path(name)).select(key).distinct(), key, "left_anti")

    def replace(self, name: str, df: DataFrame) -> str:
        """Write df as the stage's table; the former one is kept under a name with the time, which is returned."""
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path
        old, kept = fs_path(self.path(name)), ""
        fs = old.getFileSystem(self.spark._jsc.hadoopConfiguration())
        new = fs_path(f"{self.path(name)}.new")
        df.write.mode("overwrite").parquet(str(new))
        if fs.exists(old):
            kept = f"{self.path(name)}.{int(time.time() * 1000)}"
            fs.rename(old, fs_path(kept))
        fs.rename(new, old)
        return kept


def content(df: DataFrame) -> list:
    """Aggregates that tell what rows df has, in whatever order: their number and two sums of hashes."""
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), *df.columns).cast("decimal(38,0)")).cast("string")
    return [F.count("*").cast("string").alias("n"), total(1).alias("h1"), total(2).alias("h2")]


def named(*what: Any) -> str:
    return hashlib.sha256(json.dumps(what, sort_keys=True, default=str).encode()).hexdigest()[:16]


class Manifest:
    """Stages whose tables are named after what they are made from, so that a run reads what an earlier one has made of the same.

    A stage depends on its parameters and on inputs and stages before it. An
    input is known by its content, a stage by its own dependencies, so a changed
    parameter makes anew its stage and those after it, and no others.
    """

    def __init__(self, stages: Stages, **inputs: DataFrame):
        self.stages, self.known = stages, {}
        for name, df in inputs.items():
            self.add(name, df)

    def add(self, name: str, df: DataFrame) -> None:
        self.known[name] = named(df.dtypes, list(df.agg(*content(df)).first()))

    def get(self, name: str, make: Callable[[], DataFrame], after: tuple[str, ...], **parameters: Any) -> DataFrame:
        """The stage's table, made if there is none of these dependencies that is complete."""
        self.known[name] = named(name, [self.known[a] for a in after], parameters)
        return self.stages.get(f"{name}-{self.known[name]}", make)

    def by_frame(self, name: str, rows: DataFrame, make: Callable[[DataFrame], DataFrame], **parameters: Any) -> DataFrame:
        """make(rows) for rows with a column frame, frame by frame: what was made of equal rows of a frame is read, the rest is made and kept.

        Rows of a frame that no longer are as they were are made anew. Each run
        writes a part of its own and then which frames it holds, so one that was
        broken off counts for nothing and is written over.
        """
        spark, folder = self.stages.spark, f"{name}-{named(name, parameters)}"
        prints = rows.groupBy("frame").agg(*content(rows)).select("frame", F.concat_ws(":", "n", "h1", "h2").alias("print"))
        run = 0
        while self.stages.complete(f"{folder}/done/run={run}"):
            run += 1
        done = None
        for k in range(run):
            part = spark.read.parquet(self.stages.path(f"{folder}/done/run={k}")).withColumn("run", F.lit(k))
            done = part if done is None else done.unionByName(part)
        wanted = prints if done is None else prints.join(done, ["frame", "print"], "left_anti")
        if done is None or wanted.limit(1).count():
            wanted.write.mode("overwrite").parquet(self.stages.path(f"{folder}/wanted"))
            wanted = spark.read.schema(prints.schema).parquet(self.stages.path(f"{folder}/wanted"))
            make(rows.join(wanted.select("frame"), "frame", "left_semi")).write.mode("overwrite").parquet(self.stages.path(f"{folder}/rows/run={run}"))
            wanted.write.mode("overwrite").parquet(self.stages.path(f"{folder}/done/run={run}"))
            new = wanted.withColumn("run", F.lit(run))
            done = new if done is None else done.unionByName(new)
        else:
            run -= 1
        last = prints.join(done, ["frame", "print"]).groupBy("frame").agg(F.max("run").alias("run"))
        out = None
        for k in range(run + 1):
            part = spark.read.parquet(self.stages.path(f"{folder}/rows/run={k}")).join(last.where(F.col("run") == k).select("frame"), "frame", "left_semi")
            out = part if out is None else out.unionByName(part)
        self.known[name] = named(name, parameters, list(prints.agg(*content(prints)).first()))
        return out


def progress(done: int, total: int, info: str = "") -> str:
    """A line of the progress protocol."""
    return f"Info: {info}" if info else f"Progress: {100 * done // max(1, total)}%"


def write_errors(errors: DataFrame, path: str) -> None:
    """Trajectory errors as text tables: every segment, and means by length and by speed."""
    from pointspark.operators.ordered import errors_by

    fmt = lambda df: df.coalesce(1).write.mode("overwrite").option("sep", " ").csv
    errors.select("seq", "first", "r_err", "t_err", "len", "speed").write.mode("overwrite").option("sep", " ").csv(f"{path}/segments")
    # each segment's length is a bucket of its own, however many there are
    by_length = errors.groupBy(F.col("len").cast("double").alias("bucket")).agg(F.count("*").alias("n"), F.avg("r_err").alias("r_err"), F.avg("t_err").alias("t_err"))
    fmt(by_length.where("n >= 3").orderBy("bucket"))(f"{path}/by_length")
    fmt(errors_by(errors, [float(v) for v in range(2, 25, 2)], "speed", 2.0).orderBy("bucket"))(f"{path}/by_speed")
    fmt(errors.agg(F.avg("t_err").alias("t_err"), F.avg("r_err").alias("r_err")))(f"{path}/mean")
