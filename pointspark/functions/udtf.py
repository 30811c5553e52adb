"""Table functions for SQL, and the hooks where a model can be put in."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf


@udtf(returnType="corner int, x bigint, y bigint, z bigint")
class VoxelCorners:
    """Eight corners of a voxel."""

    def eval(self, vx: int, vy: int, vz: int):
        from pointspark.operators.spatial import CORNERS

        for k, (a, b, c) in enumerate(CORNERS):
            yield k, vx + a, vy + b, vz + c


@udtf(returnType="x bigint, y bigint, z bigint")
class NeighbourCells:
    """A cell and the cells around it."""

    def eval(self, x: int, y: int, z: int, reach: int):
        for i in range(-reach, reach + 1):
            for j in range(-reach, reach + 1):
                for k in range(-reach, reach + 1):
                    yield x + i, y + j, z + k


@udtf(returnType="x int, y int")
class ConvexFill:
    """Pixels inside the convex hull of pixels, given as arrays of x and of y."""

    def eval(self, xs: list, ys: list):
        from pointspark.operators.spatial import hull_fill

        yield from hull_fill(list(zip(xs, ys, strict=True)))


def register(spark: SparkSession) -> None:
    for name, f in (("voxel_corners", VoxelCorners), ("neighbour_cells", NeighbourCells), ("convex_fill", ConvexFill)):
        spark.udtf.register(name, f)


# ---- hooks: what a model would do, with a default that needs none


def ground_split(points: DataFrame, model: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]] | None = None, band: float = 0.3, cell: float = 0.5, flip: bool = False) -> DataFrame:
    """points with part: ground or other (U-A).

    Without a model a point is ground if it is within a band of the lowest z of
    its cell in its frame; flip looks from above, for ceilings. A model is a
    mapInPandas function that adds the column.
    """
    if model is not None:
        return points.mapInPandas(model, ", ".join(f"{n} {t}" for n, t in points.dtypes) + ", part string")
    z = -F.col("z") if flip else F.col("z")
    key = {f"h{c}": F.floor(F.col(c) / F.lit(cell)).cast("bigint") for c in ("x", "y")}
    keyed = points.withColumns(key)
    low = keyed.groupBy("frame", "hx", "hy").agg(F.min(z).alias("low"))
    name = "ceiling" if flip else "ground"
    return keyed.join(low, ["frame", "hx", "hy"]).withColumn("part", F.when(z <= F.col("low") + band, name).otherwise("other")).drop("hx", "hy", "low")


def masks_from(clicks: DataFrame, model: Callable | None, masks: DataFrame | None = None) -> DataFrame:
    """Masks (frame, cam, obj_id, row, col) for clicks (U-B, U-C): a model's answer for each frame and camera (each camera, where clicks have no frame), or a table made elsewhere."""
    if model is None:
        if masks is None:
            raise ValueError("there is no model; give a table of masks")
        return masks.join(clicks.select("obj_id").distinct(), "obj_id", "left_semi")
    return clicks.groupBy(*[c for c in ("frame", "cam") if c in clicks.columns]).applyInPandas(model, "frame int, cam int, obj_id bigint, row int, col int")


class VideoSession(Protocol):
    """What a model for pictures in sequence has to offer (U-B); made by start(cam, frames) for some frames of one camera."""

    def click(self, index: int, obj_id: int, points: np.ndarray, labels: np.ndarray) -> None:
        """Points (col, row) in the picture of frames[index] that belong to the object (label 1) or do not (0)."""

    def propagate(self, reverse: bool = False) -> Iterator[tuple[int, np.ndarray]]:
        """(index, mask of height by width) of pictures, from the first on, or from the last back."""


def video_masks(clicks: DataFrame, negatives: DataFrame, start: Callable[[int, list[int]], VideoSession], batch: int = 200) -> DataFrame:
    """Masks (frame, cam, obj_id, row, col) of objects followed through pictures (U-B, J08, J14).

    clicks: frame, cam, obj_id, row, col. negatives: obj_id, rank, neg_obj_id;
    the clicks of these objects in a frame where the object itself has one say
    what does not belong to it, by rank. From an object's first to its last
    frame in a camera its pictures are taken batch by batch, each a task of its
    own: all clicks are given, then masks go forward and back, those from the way
    back staying. What is kept are the masks of frames in which the object has
    a click.
    """
    own = clicks.select("cam", "obj_id", "frame", "row", "col")
    span = own.groupBy("cam", "obj_id").agg(F.min("frame").alias("first"), F.max("frame").alias("last"))
    placed = own.join(span, ["cam", "obj_id"]).withColumn("batch", F.floor((F.col("frame") - F.col("first")) / batch).cast("int")).withColumn("rank", F.lit(0))
    other = own.select("cam", "frame", F.col("obj_id").alias("neg_obj_id"), "row", "col")
    asked = placed.drop("row", "col", "rank").distinct().join(negatives.select("obj_id", "neg_obj_id", F.col("rank").cast("int").alias("rank")), "obj_id")
    rows = placed.unionByName(asked.join(other, ["cam", "frame", "neg_obj_id"]).drop("neg_obj_id"))

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        one = pdf.iloc[0]
        begin = int(one["first"]) + batch * int(one["batch"])
        session = start(int(one.cam), list(range(begin, min(begin + batch - 1, int(one["last"])) + 1)))
        pdf = pdf.sort_values(["frame", "rank", "row", "col"])
        for frame, g in pdf.groupby("frame"):
            session.click(int(frame) - begin, int(one.obj_id), g[["col", "row"]].to_numpy(np.int64), (g["rank"] == 0).to_numpy(np.int32))
        masks = dict(session.propagate())
        masks.update(session.propagate(reverse=True))
        out = []
        for frame in sorted(pdf["frame"].unique().tolist()):
            if (mask := masks.get(frame - begin)) is not None and mask.any():
                row, col = np.nonzero(mask)
                out.append(pd.DataFrame({"frame": frame, "cam": one.cam, "obj_id": one.obj_id, "row": row, "col": col}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("frame", "cam", "obj_id", "row", "col")}, dtype="int64")

    return rows.groupBy("cam", "obj_id", "batch").applyInPandas(follow, "frame int, cam int, obj_id bigint, row int, col int")


def spectrum(image: np.ndarray) -> np.ndarray:
    """Logarithms of the magnitudes of a picture's two-dimensional spectrum, zero frequency in the middle."""
    return np.log(np.abs(np.fft.fftshift(np.fft.fft2(image))) + 1e-8)


def radial_energy(image: np.ndarray, bins: int = 64) -> np.ndarray:
    """Mean spectrum by distance from the middle, at length 1 (U-D)."""
    s = spectrum(image)
    r = np.hypot(*np.indices(s.shape) - (np.array(s.shape)[:, None, None] // 2))
    k = np.minimum((r / (r.max() + 1e-9) * bins).astype(int), bins - 1).ravel()
    v = np.bincount(k, s.ravel(), bins) / np.maximum(np.bincount(k, minlength=bins), 1)
    n = np.linalg.norm(v)
    return v / n if n else v


def embed_images(pixels: DataFrame, height: int, width: int, by: tuple[str, ...] = ("frame", "cam"), value: str = "depth", model: Callable[[np.ndarray], np.ndarray] = radial_energy) -> DataFrame:
    """(by, vector) for pictures given as rows of pixels; a picture is one group of at most height * width rows."""
    kinds = dict(pixels.dtypes)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((height, width))
        image[pdf["row"], pdf["col"]] = pdf[value]
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in by}, "vector": [model(image).tolist()]})

    return pixels.select(*by, "row", "col", value).groupBy(*by).applyInPandas(fold, ", ".join(f"{c} {kinds[c]}" for c in by) + ", vector array<double>")
