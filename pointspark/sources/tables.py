"""Steps over tables of files: what is missing, what is wrong, what is there already."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_moving(taxonomy: DataFrame) -> DataFrame:
    """Taxonomy rows, and one for each moving class: its id, and the name with a mark."""
    moving = taxonomy.where("moving_id is not null").withColumns({"id": F.col("moving_id"), "name": F.concat("name", F.lit(" (moving)")), "moving_id": F.lit(None).cast("int")})
    return taxonomy.unionByName(moving)


def repair_states(scans: DataFrame, labels: DataFrame) -> DataFrame:
    """(frame, n_points, n_labels, state): ok, missing or wrong length."""
    both = scans.join(labels, "frame", "left").withColumn("n_labels", F.coalesce("n_labels", F.lit(0)))
    return both.withColumn("state", F.when(F.col("n_labels") == F.col("n_points"), "ok").when(F.col("n_labels") == 0, "missing").otherwise("wrong length"))


def zero_labels(scans: DataFrame) -> DataFrame:
    """One label 0 for each point of scans (frame, n_points) that need new labels."""
    return scans.where("n_points > 0").select("frame", F.explode(F.sequence(F.lit(0), (F.col("n_points") - 1).cast("int"))).alias("point_idx"), F.lit(0).cast("bigint").alias("label"))


def not_done(wanted: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """What of wanted has no output yet."""
    return wanted.join(done, list(keys) or ["frame"], "left_anti")


def image_paths(frames: DataFrame, first: DataFrame, second: DataFrame, placeholder: str) -> DataFrame:
    """(frame, image): the path in first, else in second, else a placeholder."""
    a, b = first.select("frame", F.col("path").alias("a")), second.select("frame", F.col("path").alias("b"))
    return frames.join(a, "frame", "left").join(b, "frame", "left").select("frame", F.coalesce("a", "b", F.lit(placeholder)).alias("image"))


def mask_names(paths: DataFrame, column: str = "path") -> DataFrame:
    """(cam, frame, obj_id) from names cam_<c>/<frame>_<obj>.npy; others are left out."""
    name = r"([0-9]+)_([0-9]+)\.npy$"
    hit = paths.where(F.col(column).rlike(r"cam_[0-9]+/" + name))
    part = lambda p, i: F.regexp_extract(column, p, i)
    return hit.select(part(r"cam_([0-9]+)/", 1).cast("int").alias("cam"), part(name, 1).cast("int").alias("frame"), part(name, 2).cast("bigint").alias("obj_id"))
