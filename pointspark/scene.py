"""A scene: the points, labels and poses of a sequence, and what a user does with them."""

from __future__ import annotations

import dataclasses

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointspark.config import SceneConfig
from pointspark.functions import geometry as G
from pointspark.operators import aggregates as A
from pointspark.operators import fusion
from pointspark.operators import joins as J
from pointspark.operators import selection as O
from pointspark.operators import spatial as P
from pointspark.schema import require
from pointspark.sources import scans


class TileCache:
    """The tiles of a scene that were asked for last, kept in memory and on disk of the executors; the one asked for longest ago goes first."""

    def __init__(self, scene: Scene, most: int = 4):
        self.scene, self.most = scene, most
        self.held: dict[tuple[float, float], Scene] = {}

    def get(self, x: float, y: float) -> Scene:
        found = self.held.pop((x, y), None)
        if found is None:
            tile = self.scene.tile(x, y)
            found = dataclasses.replace(tile, points=tile.points.persist(StorageLevel.MEMORY_AND_DISK))
        self.held[x, y] = found
        while len(self.held) > self.most:
            self.held.pop(next(iter(self.held))).points.unpersist()
        return found

    def clear(self) -> None:
        for tile in self.held.values():
            tile.points.unpersist()
        self.held.clear()


@dataclasses.dataclass(frozen=True)
class Scene:
    """points: frame, point_idx, x, y, z, intensity, label. poses: frame, m00 .. m23. Every step gives a new scene."""

    points: DataFrame
    poses: DataFrame
    config: SceneConfig = dataclasses.field(default_factory=SceneConfig)
    seq: str = "00"

    def __post_init__(self) -> None:
        require(self.points, "frame", "point_idx", "x", "y", "z", "intensity", "label")
        require(self.poses, "frame", *G.names("m"))

    @classmethod
    def load(cls, spark: SparkSession, path: str, config: SceneConfig | None = None) -> Scene:
        """A sequence's folder; points without a label file have label 0."""
        points, labels = scans.read_scans(spark, path), scans.read_labels(spark, path)
        joined = points.join(labels, ["seq", "frame", "point_idx"], "left").withColumn("label", F.coalesce("label", F.lit(0)))
        poses = scans.read_poses(spark, f"{path}/poses.txt", scans.read_calibration(spark, f"{path}/calib.txt"))
        return cls(joined.drop("seq"), poses, config or SceneConfig(), path.rstrip("/").rpartition("/")[2])

    def where(self, condition: Column | str) -> Scene:
        return dataclasses.replace(self, points=self.points.where(condition))

    def frames(self, first: int, last: int) -> Scene:
        return self.where(F.col("frame").between(first, last))

    def tile(self, x: float, y: float) -> Scene:
        """The points in reach of a tile's middle, from the scans whose circle meets the tile."""
        c = self.config
        one = self.points.sparkSession.createDataFrame([(0, 0, x, y, c.tile_size)], "i int, j int, x double, y double, size double")
        near = J.tile_scans(one, self.poses.select("frame", F.col("m03").alias("px"), F.col("m13").alias("py")), c.max_range, c.tile_size)
        own = P.with_poses(self.points.join(near.select("frame"), "frame", "left_semi"), self.poses)
        world = list(G.apply(G.columns("m"), *P.xyz()))
        keep = O.in_tile(F.lit(x), F.lit(y), F.lit(c.tile_size), c.tile_boundary, c.min_range, c.max_range, world, P.xyz())
        return dataclasses.replace(self, points=own.where(keep).drop(*G.names("m")))

    def relabel(self, gesture: O.Relabel, polygon: list[tuple[float, float]] | None = None, hidden: list[int] | None = None) -> Scene:
        """Labels after a gesture inside a polygon of the map (everywhere, without one)."""
        # points of a scan without a pose are nowhere on the map
        p = self.points.join(self.poses, "frame", "left") if polygon else self.points
        x, y, _ = G.apply(G.columns("m"), *P.xyz())
        inside = F.coalesce(O.in_polygon(x, y, polygon), F.lit(False)) if polygon else F.lit(True)
        label = O.relabel(F.col("label"), O.visible(F.col("label"), hidden or []), inside, gesture)
        return dataclasses.replace(self, points=p.withColumn("label", label).drop(*G.names("m")))

    def superframes(self) -> DataFrame:
        return P.superframe_voxels(self.points, self.poses, self.config.window, self.config.voxel_size)

    def boxes(self) -> DataFrame:
        world = P.to_world(self.points.where(F.col("label") >= 1 << 16), self.poses)
        return A.bounding_boxes(world, "label")

    def labelled_ratio(self) -> float:
        """The share of points that have a class; 0 for no points."""
        r = A.labelled_ratio(self.points).first()
        return r.ratio or 0.0

    def auto_instances(self, instanceable: list[int], segments: DataFrame, least: int = 30) -> Scene:
        """Instances from a table of segments (frame, point_idx, segment)."""
        p = self.points.join(segments, ["frame", "point_idx"]).withColumn("sem", F.col("label").bitwiseAND(F.lit(0xFFFF)))
        return dataclasses.replace(self, points=fusion.auto_instances(p, instanceable, least).drop("sem", "segment"))

    def write(self, path: str) -> None:
        """Label files of the scene's frames that are whole: a frame of which points were filtered away keeps the file it has."""
        scans.write_labels(self.points.withColumn("seq", F.lit(self.seq)), path)
