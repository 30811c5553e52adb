"""Frames, voxels and pictures: transforms, multi-scan merging, projection and rasters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointspark.functions import geometry as G
from pointspark.functions.scalars import truncate

XYZ = ("x", "y", "z")


def xyz(prefix: str = "") -> list[Column]:
    return [F.col(f"{prefix}{c}") for c in XYZ]


def with_poses(points: DataFrame, poses: DataFrame, on: str = "frame") -> DataFrame:
    """points with its frame's transform; the smaller side is left to the planner, which knows its size."""
    return points.join(poses, on)


def transform(points: DataFrame, m: list[Column]) -> DataFrame:
    """points with x, y, z moved by m; plain arithmetic, no function calls."""
    x, y, z = G.apply(m, *xyz())
    return points.withColumns({"x": x, "y": y, "z": z})


def to_world(points: DataFrame, poses: DataFrame) -> DataFrame:
    """Each point in the common frame of the poses."""
    moved = transform(with_poses(points, poses), G.columns("m"))
    return moved.drop(*G.names("m"))


def frame_window(frames: DataFrame, width: int, frame: str = "frame") -> DataFrame:
    """(centre, frame) for every frame and the centres whose window holds it.

    A band join by equality (J01): each frame lists the centres in reach, and
    those that exist are kept by an equi-join.
    """
    h = width // 2
    known = frames.select(F.col(frame).alias("centre")).distinct()
    near = frames.select(frame).distinct().select(F.explode(F.sequence(F.col(frame) - h, F.col(frame) + h)).alias("centre"), F.col(frame).alias("frame"))
    return near.join(known, "centre")


def relative_poses(pairs: DataFrame, poses: DataFrame, a: str = "centre", b: str = "frame") -> DataFrame:
    """pairs with the transform from frame b to frame a, inverse(a) . b; the identity where they are the same."""
    left = poses.select(F.col("frame").alias(a), *[F.col(n).alias("a" + n[1:]) for n in G.names("m")])
    right = poses.select(F.col("frame").alias(b), *[F.col(n).alias("b" + n[1:]) for n in G.names("m")])
    both = pairs.join(left, a).join(right, b)
    m = G.multiply(G.invert(G.columns("a")), G.columns("b"))
    same = F.col(a) == F.col(b)
    return both.select(a, b, *[F.when(same, i).otherwise(v).alias(n) for n, v, i in zip(G.names("m"), m, G.identity(), strict=True)])


def prompt_voxels(prompts: DataFrame, seen: DataFrame, poses: DataFrame, size: float) -> DataFrame:
    """(frame, obj_id, vx, vy, vz): where each prompt (obj_id, keyframe, x, y, z) stands in the frames of seen (frame, obj_id).

    A prompt is a place in its keyframe; it is moved to every frame by the poses
    of both. Pairs of frames are few and get their transform once.
    """
    met = seen.select("frame", "obj_id").distinct().join(prompts.select("obj_id", "keyframe", *XYZ), "obj_id")
    moves = relative_poses(met.select("frame", "keyframe").distinct(), poses, "frame", "keyframe")
    return transform(met.join(moves, ["frame", "keyframe"]), G.columns("m")).select("frame", "obj_id", *voxel_keys(size))


def shown_keyframes(frames: DataFrame, keys: DataFrame, width: int) -> DataFrame:
    """(frame, keyframe): the keyframes whose prompts a frame's pictures show, those whose window meets its own.

    frames and keys have a column frame. A frame's window ends before its last
    frame, as a keyframe's does not. Both windows list their frames, and meet by
    an equi-join.
    """
    h = width // 2
    last = frames.agg(F.max("frame").alias("last"))
    listed = frames.select("frame").distinct().crossJoin(F.broadcast(last))  # one row
    end = F.greatest(F.col("frame"), F.least(F.col("frame") + h, "last") - 1)
    own = listed.select("frame", F.explode(F.sequence(F.col("frame") - h, end)).alias("at"))
    other = keys.select(F.col("frame").alias("keyframe"), F.explode(F.sequence(F.col("frame") - h, F.col("frame") + h)).alias("at"))
    real = frames.select(F.col("frame").alias("at")).distinct()
    return own.join(real, "at").join(other, "at").select("frame", "keyframe").distinct()


def voxel_keys(size: float, prefix: str = "") -> list[Column]:
    """vx, vy, vz: floor(coordinate / size)."""
    return [F.floor(F.col(f"{prefix}{c}") / F.lit(size)).cast("bigint").alias(f"v{c}") for c in XYZ]


def voxel_max(points: DataFrame, size: float, *by: str, value: str = "intensity") -> DataFrame:
    """The largest value of each voxel, by the given columns; partial aggregation before the shuffle."""
    keys = points.select(*by, *voxel_keys(size), value)
    return keys.groupBy(*by, "vx", "vy", "vz").agg(F.max(value).alias(value))


def superframe_voxels(points: DataFrame, poses: DataFrame, width: int, size: float) -> DataFrame:
    """Scans of each window merged into their centre's frame: (frame, vx, vy, vz, intensity).

    Points go through one join with the table of frame pairs, which holds width
    rows a frame, and are reduced to voxels before they are shuffled.
    """
    pairs = relative_poses(frame_window(poses, width), poses)
    moved = transform(points.select("frame", *XYZ, "intensity").join(pairs, "frame"), G.columns("m"))
    return voxel_max(moved, size, "centre").withColumnRenamed("centre", "frame")


#: Corners of a voxel, in the order of the data model.
CORNERS = ((0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 0), (1, 0, 1), (0, 1, 1), (1, 1, 1))


def corners(voxels: DataFrame, size: float) -> DataFrame:
    """Eight rows a voxel: corner (0 to 7) and its x, y, z."""
    each = F.array(*[F.struct(F.lit(k).alias("corner"), *[(F.col(f"v{c}") + d).alias(c) for c, d in zip(XYZ, offset, strict=True)]) for k, offset in enumerate(CORNERS)])
    return voxels.withColumn("c", F.explode(each)).select(*voxels.columns, "c.corner", *[(F.col(f"c.{c}") * F.lit(size)).alias(c) for c in XYZ])


def pinhole(x: Column, y: Column, z: Column, fx: float, fy: float, cx: float, cy: float) -> tuple[Column, Column]:
    """Column and row of a point in a picture, truncated toward zero; null on the camera's plane."""
    u = F.try_divide(F.lit(fx) * x + F.lit(cx) * z, z)
    v = F.try_divide(F.lit(fy) * y + F.lit(cy) * z, z)
    return truncate(u).alias("col"), truncate(v).alias("row")


def in_picture(col: Column, row: Column, width: int, height: int) -> Column:
    return (col >= 0) & (col < width) & (row >= 0) & (row < height)


def zbuffer(pixels: DataFrame, *by: str, depth: str = "depth", order: str = "point_idx", keep: tuple[str, ...] = ("intensity",)) -> DataFrame:
    """The nearest row of each pixel; at equal depth the first in order."""
    best = F.min_by(F.struct(depth, order, *keep), F.struct(depth, order)).alias("b")
    return pixels.groupBy(*by, "row", "col").agg(best).select(*by, "row", "col", f"b.{depth}", f"b.{order}", *[f"b.{k}" for k in keep])


def occlusion(prompts: DataFrame, raster: DataFrame, tolerance: float = 2.0, by: tuple[str, ...] = ("cam",)) -> DataFrame:
    """Projected prompts (by, row, col, depth) that are not behind what the picture shows there."""
    seen = raster.where("depth > 0").select(*by, "row", "col", F.col("depth").alias("seen_depth"))
    return prompts.join(seen, [*by, "row", "col"]).where(F.abs(F.col("depth") - F.col("seen_depth")) < tolerance)


def camera_ring(spark: SparkSession, n: int, start: float, pitch: float, base: float) -> DataFrame:
    """n cameras about the z axis at equal yaws, their distance from the axis set by the pitch."""
    yaw = F.col("id") * F.lit(2 * 3.141592653589793 / n)
    radius = -F.tan(F.lit(start + 3.141592653589793 - pitch)) * F.lit(abs(base))
    turn = F.lit(2 * 3.141592653589793) - yaw
    return spark.range(n).select(F.col("id").cast("int").alias("cam"), yaw.alias("yaw"), (F.cos(turn) * radius).alias("x"), (F.sin(turn) * radius).alias("y"), F.lit(base).alias("z"))


def ground_grid(points: DataFrame, *by: str, step: float = 1.0) -> DataFrame:
    """A grid over the extent of the points at their lowest z, intensity 0; made where there is no ground model (P25)."""
    box = points.groupBy(*by).agg(*[f(c).alias(f"{n}_{c}") for c in XYZ for f, n in ((F.min, "min"), (F.max, "max"))])
    steps = lambda c: F.sequence(F.lit(0), F.floor((F.col(f"max_{c}") - F.col(f"min_{c}")) / F.lit(step)).cast("int"))
    rows = box.withColumn("i", F.explode(steps("x"))).withColumn("j", F.explode(steps("y")))
    return rows.select(*by, (F.col("min_x") + F.col("i") * F.lit(step)).alias("x"), (F.col("min_y") + F.col("j") * F.lit(step)).alias("y"), F.col("min_z").alias("z"), F.lit(0.0).alias("intensity"))


def hull_fill(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Whole pixels inside or on the convex hull of pixels (x, y), by rows."""
    pts = sorted(set(points))
    if len(pts) <= 2:
        return pts

    def half(seq):
        out: list[tuple[int, int]] = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    ring = half(pts) + half(pts[::-1])
    if len(ring) < 3:
        return pts
    filled = []
    for y in range(min(p[1] for p in ring), max(p[1] for p in ring) + 1):
        xs = []
        for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
            if min(a[1], b[1]) <= y <= max(a[1], b[1]):
                xs += [a[0], b[0]] if a[1] == b[1] else [a[0] + (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1])]
        lo, hi = min(xs), max(xs)
        filled += [(x, y) for x in range(int(-(-lo // 1)), int(hi // 1) + 1)]
    return sorted(set(filled) | set(pts))


def hull_runs(xs: np.ndarray, ys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, x, y) of the pixels that hull_fill gives for each row of xs and ys (n x m whole pixels).

    At a height the hull reaches from the least to the largest crossing of the
    lines between any two of the points, so all rows are filled together.
    """
    n, m = xs.shape
    one, two = np.triu_indices(m, 1)
    x, y = xs.astype(np.int64), ys.astype(np.int64)
    # on one line: all points off the first one point the same way as the farthest
    dx, dy = x - x[:, :1], y - y[:, :1]
    far = np.argmax(dx * dx + dy * dy, axis=1)
    fx, fy = dx[np.arange(n), far][:, None], dy[np.arange(n), far][:, None]
    line = (fx * dy == fy * dx).all(axis=1)
    at = [np.repeat(np.flatnonzero(line), m)]
    px, py = [x[line].ravel()], [y[line].ravel()]
    rows = np.flatnonzero(~line)
    x, y = x[rows], y[rows]
    low, high = y.min(axis=1, initial=0 if not len(rows) else y.max()), y.max(axis=1, initial=y.min() if len(rows) else 0)
    for r in range(int((high - low).max(initial=-1)) + 1):
        some = np.flatnonzero(low + r <= high)
        h = (low[some] + r)[:, None].astype(np.float64)
        x1, x2, y1, y2 = (v[some].astype(np.float64) for v in (x[:, one], x[:, two], y[:, one], y[:, two]))
        meets = (np.minimum(y1, y2) <= h) & (h <= np.maximum(y1, y2))
        flat = y1 == y2
        with np.errstate(divide="ignore", invalid="ignore"):
            cut = x1 + (x2 - x1) * (h - y1) / (y2 - y1)
        left, right = np.where(flat, np.minimum(x1, x2), cut), np.where(flat, np.maximum(x1, x2), cut)
        lo = np.ceil(np.where(meets, left, np.inf).min(axis=1)).astype(np.int64)
        hi = np.floor(np.where(meets, right, -np.inf).max(axis=1)).astype(np.int64)
        count = np.maximum(hi - lo + 1, 0)
        first = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
        at.append(np.repeat(rows[some], count))
        px.append(first + np.arange(count.sum()))
        py.append(np.repeat(low[some] + r, count))
    return np.concatenate(at), np.concatenate(px), np.concatenate(py)


def rasterise(voxels: DataFrame, camera: list[Column], size: float, fx: float, fy: float, cx: float, cy: float, width: int, height: int) -> DataFrame:
    """Voxels (frame, vx, vy, vz, intensity) as one camera sees them: frame, row, col, depth, intensity, px, py, pz.

    A voxel counts if all its corners are in front and inside the picture; it
    covers the hull of its corners' pixels, at the depth of its first corner; the
    nearest wins, then the smaller voxel (P04 to P07, A02). Only the hull's fill
    runs in Python, on Arrow batches of eight pixels a voxel.
    """
    key = [F.col(f"v{c}") for c in XYZ]
    each = []
    for offset in CORNERS:
        x, y, z = G.apply(camera, *[(k + d) * F.lit(size) for k, d in zip(key, offset, strict=True)])
        each.append(F.struct(x.alias("x"), y.alias("y"), z.alias("z")))
    placed = voxels.select("frame", *key, "intensity", F.array(*each).alias("corners"))

    def pixel(p: Column) -> Column:
        col, row = pinhole(p["x"], p["y"], p["z"], fx, fy, cx, cy)
        return F.struct(col.alias("x"), row.alias("y"))

    seen = placed.where(F.forall("corners", lambda p: p["z"] > 0)).select("frame", *key, "intensity", F.get("corners", 0)["z"].alias("depth"), F.transform("corners", pixel).alias("pixels"))
    seen = seen.where(F.forall("pixels", lambda p: in_picture(p["x"], p["y"], width, height)))

    def fill(batches):
        for b in batches:
            # a slice's lists need not start at 0, flatten() heeds that
            xs, ys = (b.column(i).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(CORNERS)) for i in (6, 7))
            at, x, y = hull_runs(xs, ys)
            rows = pa.Table.from_batches([b]).select(list(range(6))).take(pa.array(at)).combine_chunks()
            for out in rows.append_column("row", pa.array(y.astype(np.int32))).append_column("col", pa.array(x.astype(np.int32))).to_batches():
                yield out

    # the fill costs more than its rows' size tells, so small inputs are spread too
    n = int(voxels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    split = seen.select("frame", *key, "intensity", "depth", F.transform("pixels", lambda p: p["x"]).alias("xs"), F.transform("pixels", lambda p: p["y"]).alias("ys"))
    filled = split.repartition(n, "frame", "vx", "vy", "vz").mapInArrow(fill, "frame int, vx long, vy long, vz long, intensity double, depth double, row int, col int")
    best = F.min_by(F.struct("depth", "intensity", "vx", "vy", "vz"), F.struct("depth", "vx", "vy", "vz")).alias("b")
    out = filled.groupBy("frame", "row", "col").agg(best)
    return out.select("frame", "row", "col", "b.depth", "b.intensity", *[(F.col(f"b.v{c}") * F.lit(size)).alias(f"p{c}") for c in XYZ])


def histogram_equalize(pixels: DataFrame, value: str = "intensity", levels: int = 256, out: str = "equalized") -> DataFrame:
    """pixels with value, first scaled to whole levels, replaced by the share of pixels up to it.

    Counts of at most levels rows are summed in order and joined back.
    """
    ends = pixels.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    level = F.coalesce(F.floor(F.try_divide(F.col(value) - F.col("lo"), F.col("hi") - F.col("lo")) * (levels - 1)), F.lit(0)).cast("int")
    scaled = pixels.crossJoin(F.broadcast(ends)).withColumn("level", level).drop("lo", "hi")
    counts = scaled.groupBy("level").agg(F.count("*").alias("n"))
    cdf = counts.select("level", (F.sum("n").over(Window.orderBy("level")) / F.sum("n").over(Window.partitionBy())).alias(out))
    return scaled.join(F.broadcast(cdf), "level")


def box_mean(pixels: DataFrame, value: str, height: int, width: int, *by: str) -> DataFrame:
    """(by, row, col, mean) of the 3 x 3 neighbourhood, the border repeated; absent pixels count 0."""
    shift = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    inside = (F.col("r") >= 0) & (F.col("r") < height) & (F.col("c") >= 0) & (F.col("c") < width)
    # a pixel at the border is its own neighbour beyond it, once for each way out
    spread = pixels.withColumn("s", F.explode(shift)).select(*by, "row", "col", value, (F.col("row") + F.col("s.i")).alias("r"), (F.col("col") + F.col("s.j")).alias("c"))
    straight = spread.where(inside).select(*by, F.col("r").alias("row"), F.col("c").alias("col"), value)
    back = lambda n, v: F.greatest(F.lit(0), F.least(F.lit(n - 1), v))
    ways = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(di).alias("di"), F.lit(dj).alias("dj")) for di in (-1, 0, 1) for dj in (-1, 0, 1) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    # target t reads position t + d beyond the border, which repeats pixel p = clamp(t + d)
    border = pixels.where((F.col("row") == 0) | (F.col("row") == height - 1) | (F.col("col") == 0) | (F.col("col") == width - 1))
    outs = border.withColumn("s", F.explode(ways)).select(*by, "row", "col", value, (F.col("row") + F.col("s.i")).alias("r"), (F.col("col") + F.col("s.j")).alias("c"), "s.di", "s.dj").where(inside)
    tr, tc = F.col("r") + F.col("di"), F.col("c") + F.col("dj")
    beyond = ((tr < 0) | (tr >= height) | (tc < 0) | (tc >= width)) & (back(height, tr) == F.col("row")) & (back(width, tc) == F.col("col"))
    repeated = outs.where(beyond).select(*by, F.col("r").alias("row"), F.col("c").alias("col"), value)
    return straight.unionByName(repeated).groupBy(*by, "row", "col").agg((F.sum(value) / 9).alias("mean"))
