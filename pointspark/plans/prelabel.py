"""Pre-labelling of a sequence: the stages from scans and poses to dense labels."""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointspark.functions import geometry as G
from pointspark.functions.udtf import ground_split, masks_from, video_masks
from pointspark.operators import aggregates as A
from pointspark.operators import cluster as C
from pointspark.operators import fusion, ordered
from pointspark.operators import joins as J
from pointspark.operators import spatial as P
from pointspark.session import materialize
from pointspark.sources.stages import Manifest, Stages


def mask_votes(points: DataFrame, masks: DataFrame, poses: DataFrame, pixels: list[tuple], width: int, voxel: float, cells: DataFrame | None = None) -> DataFrame:
    """(frame, vx, vy, vz, obj_id, cam, sf, cnt): what masks of the scans around a frame say about its voxels.

    pixels: for each camera, or for some at once, expressions for cam, row and col of a point.
    cells: frame, vx, vy, vz, the voxels of frames that can have votes; all can where none are given.

    Points of a scan that share a pixel and a voxel of the centre vote alike, so
    they are counted before they meet the masks: what is shuffled has at most
    the voxels along each pixel's ray, however many points there are. Points
    that no mask of their picture can hold are left out first.
    """
    own = masks.select("frame", "cam", "obj_id", "row", "col")
    # written, so that the planner knows how small they are: a row a picture, and a row for each pair of frames
    ends = materialize(own.groupBy("frame", "cam").agg(*[f(c).alias(f"{n}_{c}") for c in ("row", "col") for f, n in ((F.min, "lo"), (F.max, "hi"))]), "pictures")
    pairs = materialize(P.relative_poses(P.frame_window(poses, width), poses), "frame-pairs")
    views = F.array(*[F.struct(cam.cast("int").alias("cam"), row.cast("int").alias("row"), col.cast("int").alias("col")) for cam, row, col in pixels])
    seen = points.select("frame", *P.XYZ, F.explode(views).alias("view")).select("frame", *P.XYZ, "view.*")
    held = seen.join(ends, ["frame", "cam"]).where(F.col("row").between(F.col("lo_row"), F.col("hi_row")) & F.col("col").between(F.col("lo_col"), F.col("hi_col")))
    moved = P.transform(held.select("frame", *P.XYZ, "cam", "row", "col").join(pairs, "frame"), [F.col(n) for n in P.G.names("m")])
    placed = moved.select("frame", "centre", *P.voxel_keys(voxel), "cam", "row", "col")
    if cells is not None:
        # 64 voxels along y in a number, so that those of all frames are few rows, and points meet them before they are shuffled
        part = F.shiftright("vy", 6)
        bits = materialize(cells.groupBy(F.col("frame").alias("centre"), "vx", part.alias("y"), "vz").agg(F.expr("bit_or(shiftleft(1L, int(vy & 63)))").alias("bits")), "cell-bits")
        placed = placed.withColumn("y", part).join(bits, ["centre", "vx", "y", "vz"]).where(F.getbit("bits", F.expr("int(vy & 63)")) == 1)
    spots = placed.groupBy("frame", "centre", *C.VOXEL, "cam", "row", "col").agg(F.count("*").alias("n"))
    # dealt by picture: where the masks are few enough to be sent to all tasks, votes are summed without a further shuffle
    claimed = spots.repartition("frame", "cam").join(own, ["frame", "cam", "row", "col"])
    votes = claimed.groupBy("frame", "cam", "centre", *C.VOXEL, "obj_id").agg(F.sum("n").alias("cnt"))
    return votes.select(F.col("centre").alias("frame"), *C.VOXEL, "obj_id", "cam", (F.col("frame") - F.col("centre")).cast("int").alias("sf"), "cnt")


def default_pixels() -> list[tuple]:
    """Cameras 0 to 3 that look along x, y, -x and -y from 30 behind."""
    out = []
    for cam, (ahead, aside) in enumerate(((F.col("x"), F.col("y")), (F.col("y"), -F.col("x")), (-F.col("x"), -F.col("y")), (-F.col("y"), F.col("x")))):
        depth = ahead + 30.0
        col, row = P.pinhole(aside, F.col("z") * 8.0, depth, 50.0, 50.0, 32.0, 24.0)
        out.append((F.lit(cam), F.when(depth > 0, row), F.when(depth > 0, col)))
    return out


@dataclasses.dataclass(frozen=True)
class Views:
    """Pictures from some places about a scan, all towards its middle; matrices go from the scan to each camera, row by row."""

    matrices: tuple[tuple[float, ...], ...]
    focal: float = 60.0
    width: int = 96
    height: int = 72

    @classmethod
    def ring(cls, spark: SparkSession, n: int = 4, pitch: float = math.pi / 4, base: float = 15.0) -> Views:
        """n places on a circle; a row each comes to the driver, so that plans hold numbers."""
        fixed = lambda *v: [F.lit(float(x)) for x in v]
        found = P.camera_ring(spark, n, 0.0, pitch, base).select("cam", *G.look_at(P.xyz(), fixed(0, 0, 0), fixed(0, 0, 1))).orderBy("cam").collect()
        return cls(tuple(tuple(r)[1:] for r in found))

    def matrix(self, cam: int) -> list[Column]:
        return [F.lit(v) for v in self.matrices[cam]]

    def pixel(self, cam: int) -> tuple[Column, Column, Column, Column]:
        """cam, row, col and depth of a point; row and col are null outside the picture."""
        x, y, z = G.apply(self.matrix(cam), *P.xyz())
        col, row = P.pinhole(x, y, z, self.focal, self.focal, self.width / 2, self.height / 2)
        inside = (z > 0) & P.in_picture(col, row, self.width, self.height)
        return F.lit(cam), F.when(inside, row), F.when(inside, col), z


def prompt_places(cells: DataFrame, keys: DataFrame, voxel: float, scales: tuple[tuple[float, int], ...]) -> tuple[DataFrame, DataFrame]:
    """(prompts, negatives): places (obj_id, scale, keyframe, x, y, z) in the voxels of keyframes, and the objects that are not a prompt's."""
    prompts, negatives = C.prompt_objects(cells.join(keys, "frame", "left_semi").withColumnRenamed("frame", "kf"), scales, voxel)
    middle = [((F.col(f"v{c}") + 0.5) * F.lit(voxel)).alias(c) for c in P.XYZ]
    return materialize(prompts.select("obj_id", "scale", F.col("kf").alias("keyframe"), *middle), "prompts"), materialize(negatives, "negatives")


def clicks(cells: DataFrame, prompts: DataFrame, poses: DataFrame, views: Views, width: int, voxel: float, tolerance: float = 2.0) -> DataFrame:
    """(frame, cam, obj_id, row, col, depth): where the pictures of every frame show the prompts.

    cells: superframes (frame, vx, vy, vz, intensity) of all frames. prompts:
    obj_id, keyframe, x, y, z. A frame shows the prompts of all keyframes whose
    windows meet its own, moved by the poses, unless something stands before
    them.
    """
    keys = prompts.select(F.col("keyframe").alias("frame")).distinct()
    moves = P.relative_poses(P.shown_keyframes(poses, keys, width), poses, "frame", "keyframe")
    placed = P.transform(prompts.select("obj_id", "keyframe", *P.XYZ).join(moves, "keyframe"), G.columns("m"))
    names = ("cam", "row", "col", "depth")
    each = F.array(*[F.struct(*[v.cast("double" if n == "depth" else "int").alias(n) for v, n in zip(views.pixel(k), names, strict=True)]) for k in range(len(views.matrices))])
    seen = placed.select("frame", "obj_id", F.explode(each).alias("p")).select("frame", "obj_id", "p.*").where("row is not null")
    raster = None
    for k in range(len(views.matrices)):
        one = P.rasterise(cells, views.matrix(k), voxel, views.focal, views.focal, views.width / 2, views.height / 2, views.width, views.height)
        one = one.select("frame", F.lit(k).alias("cam"), "row", "col", "depth")
        raster = one if raster is None else raster.unionByName(one)
    return P.occlusion(seen, raster, tolerance, ("frame", "cam")).select("frame", "cam", "obj_id", "row", "col", "depth")


def prelabel_scans(
    points: DataFrame, poses: DataFrame, model: Callable | None = None, views: Views | None = None, width: int = 7, voxel: float = 0.2,
    scales: tuple[tuple[float, int], ...] = ((0.6, 30), (1.2, 50)), video: Callable | None = None, stages: Stages | None = None, **how,
) -> DataFrame:
    """(frame, point_idx, label) from scans and poses alone: ground apart, keyframes, prompts, pictures, clicks, masks, then prelabel.

    model is an applyInPandas function from a picture's clicks to masks (frame,
    cam, obj_id, row, col); video starts a session that follows an object
    through pictures (udtf.video_masks), with the clicks of its negatives. One
    of them is needed.

    With stages, what an earlier run made of the same rows and parameters is
    read: stage by stage, and the masks of single pictures frame by frame. A
    model is known by its name, so a changed one needs another.
    """
    if (model is None) == (video is None):
        raise ValueError("give a model for single pictures or one for pictures in sequence")
    views = views or Views.ring(points.sparkSession)
    done = None if stages is None else Manifest(stages, points=points, poses=poses)
    split = step(done, "split", lambda: ground_split(points), ("points",))
    cells = step(done, "superframes", lambda: P.superframe_voxels(split.where("part = 'other'"), poses, width, voxel), ("split", "poses"), width=width, voxel=voxel)
    keys = ordered.keyframes(poses.withColumn("seq", F.lit(0)), width).select("frame")
    found: list[DataFrame] = []

    def places(i: int) -> DataFrame:
        if not found:
            found.extend(prompt_places(cells, keys, voxel, scales))
        return found[i]

    prompts, negatives = (step(done, name, lambda i=i: places(i), ("superframes",), scales=scales) for i, name in enumerate(("prompts", "negatives")))
    asked = step(done, "clicks", lambda: clicks(cells, prompts, poses, views, width, voxel), ("superframes", "prompts", "poses"), views=views)
    name = getattr(model or video, "__qualname__", str(model or video))
    if model is None:
        masks = step(done, "masks", lambda: video_masks(asked, negatives, video), ("clicks", "negatives"), model=name)
    elif done is None:
        masks = materialize(masks_from(asked, model), "masks")
    else:
        masks = done.by_frame("masks", asked, lambda rows: masks_from(rows, model), model=name)
    return prelabel(points, poses, masks, prompts, width=width, voxel=voxel, pixel=[views.pixel(k)[:3] for k in range(len(views.matrices))], split=split, done=done, **how)


def step(done: Manifest | None, name: str, make: Callable[[], DataFrame], after: tuple[str, ...], **parameters) -> DataFrame:
    """A written stage: by the manifest, or for this run alone."""
    return materialize(make(), name) if done is None else done.get(name, make, after, **parameters)


def prelabel(
    points: DataFrame, poses: DataFrame, masks: DataFrame, prompts: DataFrame | None = None, width: int = 7, voxel: float = 0.2,
    pixel: tuple | list[tuple] | None = None, radius: float = 2.0, threshold: float = 0.7, split: DataFrame | None = None, done: Manifest | None = None,
) -> DataFrame:
    """(frame, point_idx, label) for every point of a sequence.

    Ground is split off and keeps 0; the rest is voxelised, masks vote, labels
    are fused in every frame, objects seen together most of their time become
    one, labels are tracked from frame to frame and numbered from 1025 by first
    appearance. prompts (obj_id, keyframe, x, y, z) say where an object was asked
    for: of its parts that stand apart in a frame, the nearest to that place
    stays; without prompts all do. split is points after ground_split, where
    that was done before. Stages are written, so a lost executor costs one of
    them.
    """
    if done is not None:
        for given, df in (("points", points), ("poses", poses), ("masks", masks), ("prompts", prompts), ("split", split)):
            if given not in done.known and df is not None:
                done.add(given, df)
    asked = () if prompts is None else ("prompts",)
    split = split if split is not None else step(done, "split", lambda: ground_split(points), ("points",))
    rest = split.where("part = 'other'").drop("part")
    cells = step(done, "voxels", lambda: rest.select("frame", *P.voxel_keys(voxel)).distinct(), ("split",), voxel=voxel)
    pixels = [pixel] if isinstance(pixel, tuple) else pixel or default_pixels()
    votes = step(done, "mask-votes", lambda: mask_votes(rest, masks, poses, pixels, width, voxel, cells), ("voxels", "split", "masks", "poses"), width=width, pixels=pixels)
    found: list[DataFrame] = []

    def fuse(i: int) -> DataFrame:
        if not found:
            placed = None if prompts is None else P.prompt_voxels(prompts, votes, poses, voxel)
            found.extend(fusion.fuse_with_sets(cells, votes, placed, radius=radius))
        return found[i]

    fused, sets = (step(done, name, lambda i=i: fuse(i), ("voxels", "mask-votes", "poses", *asked), radius=radius) for i, name in enumerate(("fused", "sets")))

    def unify() -> DataFrame:
        pairs = A.temporal_jaccard(A.pair_frames(sets), A.lifetimes(masks.select("obj_id", "frame"), half=width // 2), threshold=threshold)
        return J.remap(fused, C.unified_ids(pairs.select("a", "b")), "label")

    unified = step(done, "unified", unify, ("fused", "sets", "masks"), width=width, threshold=threshold)
    labelled = step(done, "labelled", lambda: fusion.point_labels(rest, unified, voxel), ("split", "unified"), voxel=voxel)

    def tracked() -> DataFrame:
        world = P.to_world(labelled.where("label >= 1000"), poses)
        boxes = A.bounding_boxes(world, "frame", "label").withColumn("seq", F.lit(0))
        # written, a row for each object of a frame, so that the planner knows how small it is
        tracks = materialize(ordered.track(boxes).select("frame", "label", "new_label"), "tracks")
        final = labelled.join(tracks, ["frame", "label"], "left").select("frame", "point_idx", F.coalesce("new_label", "label").alias("label"))
        ground = split.where("part <> 'other'").select("frame", "point_idx", F.lit(0).cast("bigint").alias("label"))
        return final.unionByName(ground)

    whole = step(done, "tracked", tracked, ("labelled", "split", "poses"))
    # a row an object
    dense = materialize(ordered.dense_ids(whole, "label", ("frame", "point_idx"), 1025), "dense")
    return whole.join(dense, "label").select("frame", "point_idx", F.col("dense").alias("label"))
