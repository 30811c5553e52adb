"""Composite steps: label fusion of a scan, automatic instances, evaluation of odometry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointspark.functions import scalars as S
from pointspark.operators import cluster, ordered, spatial
from pointspark.session import materialize


def auto_instances(points: DataFrame, instanceable: list[int], least: int = 30, by: tuple[str, ...] = ()) -> DataFrame:
    """points (frame, point_idx, sem, segment) with a new label.

    Segments of an instanceable class with enough points in a frame get a number
    by first appearance in their class, from 1; smaller ones get instance 0;
    other classes keep their class alone.
    """
    able = F.col("sem").isin(instanceable)
    counted = points.where(able).groupBy(*by, "frame", "sem", "segment").agg(F.count("*").alias("cnt"), F.min("point_idx").alias("first_idx"))
    big = counted.where(F.col("cnt") >= least)
    numbers = ordered.dense_ids(big.withColumn("k", F.col("segment") + 1), "k", ("frame", "first_idx"), 1, (*by, "sem")).select(*by, "sem", (F.col("k") - 1).alias("segment"), F.col("dense").alias("inst"))
    known = big.select(*by, "frame", "sem", "segment").join(numbers, [*by, "sem", "segment"])
    out = points.join(known, [*by, "frame", "sem", "segment"], "left")
    return out.withColumn("label", S.pack(F.col("sem"), F.coalesce("inst", F.lit(0)))).drop("inst")


def odometry_errors(truth: DataFrame, result: DataFrame, lengths: tuple[float, ...] = (100, 200, 300, 400, 500, 600, 700, 800)) -> DataFrame:
    """Errors of result's poses for segments of truth's path (W02 to W04). Poses: seq, frame, m00 .. m23."""
    from pyspark.sql import Window

    w = Window.partitionBy("seq").orderBy("frame")
    move = F.sqrt(sum((F.pow(F.col(c) - F.lag(c).over(w), 2) for c in ("m13", "m23")), F.pow(F.col("m03") - F.lag("m03").over(w), 2)))
    path = truth.withColumn("step", F.coalesce(move, F.lit(0.0))).withColumn("dist", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return ordered.pose_errors(ordered.segment_ends(path, lengths), truth, result)


def fuse_labels(voxels: DataFrame, votes: DataFrame, prompts: DataFrame | None, radius: float = 4.0, threshold: float = 0.5, z_grow: float = 3.5) -> DataFrame:
    """(frame, vx, vy, vz, label) for the voxels of scans, from the votes of masks.

    voxels: frame, vx, vy, vz. votes: frame, vx, vy, vz, obj_id, cam, sf, cnt.
    prompts: frame, obj_id and the voxel at which the prompt stands in that
    frame (spatial.prompt_voxels). Voxels are joined to regions; an object in
    several regions of a frame keeps the one nearest to its prompt there, and
    all of them where it has no prompt; objects that overlap from different
    cameras become one in that frame; then suppression, growth and painting. 0
    stands for no object.
    """
    return fuse_with_sets(voxels, votes, prompts, radius, threshold, z_grow)[0]


def fuse_with_sets(voxels: DataFrame, votes: DataFrame, prompts: DataFrame | None, radius: float = 4.0, threshold: float = 0.5, z_grow: float = 3.5) -> tuple[DataFrame, DataFrame]:
    """fuse_labels, and (frame, root, member): the objects that became one in a frame, by equivalence or suppression."""
    keyed = voxels.select("frame", *cluster.VOXEL).distinct().withColumn("key", F.struct("frame", *cluster.VOXEL))
    # regions are named by their first voxel, and numbered in that order
    named = materialize(cluster.regions(keyed, radius, "key", ("frame",)).withColumnRenamed("region", "first"), "region-names")
    numbers = ordered.numbered(named.select("first").distinct(), ("first",), 0, "region")
    cells = materialize(keyed.join(named, "key").join(numbers, "first").select("frame", *cluster.VOXEL, "region"), "regions")
    own = votes.join(cells, ["frame", *cluster.VOXEL])
    if prompts is not None:
        key = ["frame", "obj_id"]
        own = materialize(own, "region-votes")
        near = cluster.nearest_cluster(own, prompts, tuple(key)).withColumnRenamed("region", "near")
        own = own.join(near, key, "left").where("near is null or near = region").drop("near")
    placed = materialize(own, "votes")
    same = cluster.equivalence_sets(placed)
    rooted = placed.join(same, ["frame", "region", "obj_id"], "left").withColumn("member", F.col("obj_id")).withColumn("obj_id", F.coalesce("root", "obj_id")).drop("root")
    joined = materialize(rooted, "rooted")
    heads = materialize(cluster.nms(joined, threshold=threshold), "heads")
    sets = joined.join(heads, ["frame", "region", "obj_id"]).select("frame", "root", "member").distinct()
    final = joined.join(heads, ["frame", "region", "obj_id"]).select("frame", "region", *cluster.VOXEL, F.col("root").alias("obj_id"))
    size = final.groupBy("frame", "region", "obj_id").agg(F.count("*").alias("size"))
    painted = materialize(ordered.last_writer(final.join(size, ["frame", "region", "obj_id"]), ("frame", "region", *cluster.VOXEL), "obj_id", "size"), "painted")
    free = cells.join(painted, ["frame", "region", *cluster.VOXEL], "left")
    grown = cluster.grow(free, eps=z_grow).withColumnRenamed("obj_id", "taken")
    out = free.join(grown, ["frame", "region", *cluster.VOXEL], "left")
    return out.select("frame", *cluster.VOXEL, F.coalesce("obj_id", "taken", F.lit(0)).alias("label")), sets


def point_labels(points: DataFrame, voxel_labels: DataFrame, size: float) -> DataFrame:
    """points with the label of their voxel, 0 where it has none."""
    keyed = points.select("*", *spatial.voxel_keys(size))
    return keyed.join(voxel_labels, ["frame", *cluster.VOXEL], "left").withColumn("label", F.coalesce("label", F.lit(0))).drop(*cluster.VOXEL)
