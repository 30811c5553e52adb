"""Filters on points, and the conditional update of labels."""

from __future__ import annotations

import dataclasses
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointspark.functions import geometry as G
from pointspark.functions import scalars as S


def in_tile(tile_x: Column, tile_y: Column, size: Column, boundary: float, min_range: float, max_range: float, world: list[Column], own: list[Column], keep_vehicle: bool = False) -> Column:
    """Near a tile, at a distance from the sensor within limits, and not the vehicle itself.

    world is the point in the map, own in its sensor's frame.
    """
    half = (size + F.lit(boundary)) * F.lit(0.5)
    distance = G.length(own)
    near = (F.abs(world[0] - tile_x) < half) & (F.abs(world[1] - tile_y) < half) & (distance >= min_range) & (distance <= max_range)
    vehicle = (own[0] > -2.0) & (own[0] < 3.0) & (F.abs(own[1]) < 2.0)
    return near if keep_vehicle else near & ~vehicle


def visible(label: Column, hidden: list[int]) -> Column:
    """Whether a label's class is not among the hidden ones (P10)."""
    return ~S.semantic(label).isin(hidden) if hidden else F.lit(True)


def beyond_plane(p: list[Column], theta: float, phi: float, at: float, direction: int, origin: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> Column:
    """On the chosen side of a plane with normal (tan theta, tan phi, 1)."""
    raw = (math.tan(theta), math.tan(phi), 1.0)
    n = math.sqrt(sum(v * v for v in raw))
    d = G.dot([F.lit(v / n) for v in raw], [c - F.lit(o) for c, o in zip(p, origin, strict=True)])
    return F.lit(float(direction)) * (d - F.lit(at)) < 0


def under_brush(px: Column, py: Column, x: float, y: float, radius: float) -> Column:
    """Within a circle of the screen."""
    return (px - F.lit(x)) * (px - F.lit(x)) + (py - F.lit(y)) * (py - F.lit(y)) < radius * radius


def in_window(px: Column, py: Column, depth: Column, width: float, height: float) -> Column:
    """Inside the screen and between the clipping planes."""
    return (px >= 0) & (px < width) & (py >= 0) & (py < height) & (depth >= 0) & (depth <= 1)


def in_polygon(x: Column, y: Column, polygon: list[tuple[float, float]]) -> Column:
    """Strictly inside a triangle of the polygon."""
    return G.in_triangles(x, y, G.triangulate(polygon))


def selected_instance(label: Column, sem: int, inst: int) -> Column:
    """Points of one instance; class 0 selects nothing."""
    return (S.semantic(label) == sem) & (S.instance(label) == inst) & F.lit(sem > 0)


@dataclasses.dataclass
class Relabel:
    """One gesture: what it does, to which labels, and what it spares."""

    mode: str  # paint, polygon, merge; add, split, remove, create, join
    new_label: int = 0
    old_label: int = 0
    overwrite: bool = False
    removing: bool = False
    selected_class: int = 0
    selected_instance: int = 0
    new_instance: int = 0
    hide_instances: bool = False


def relabel(label: Column, shown: Column, inside: Column, g: Relabel) -> Column:
    """The label after a gesture (P21); shown and inside say which points it can see and reaches.

    A point label erases the instance. Instance modes change points of the
    selected class only, split and join those of the selected instance.
    """
    sem, inst = S.semantic(label), S.instance(label)
    new = F.lit(g.new_label).cast("bigint")
    if g.mode == "paint":
        erased = F.when(F.lit(g.overwrite) | (sem == g.new_label), F.lit(0).cast("bigint")).otherwise(label)
        painted = F.when(F.lit(g.overwrite) | (sem == 0), new).otherwise(label)
        changed = F.when(inside, erased if g.removing else painted).otherwise(label)
    elif g.mode == "polygon":
        changed = F.when(inside & (F.lit(g.overwrite) | (sem == 0)), new).otherwise(label)
    elif g.mode == "merge":
        changed = F.when(inside & F.lit(g.overwrite) & (sem == g.old_label), new).otherwise(label)
    elif g.mode in ("add", "split", "remove", "create", "join"):
        target = {"add": g.selected_instance, "split": g.new_instance, "remove": 0, "create": g.new_instance, "join": g.new_instance}[g.mode]
        hit = sem == g.selected_class
        if g.mode in ("split", "join"):
            hit = hit & (inst == g.selected_instance)
        if g.mode != "join":
            hit = hit & inside
        changed = F.when(hit, S.pack(sem, F.lit(target))).otherwise(label)
    else:
        raise ValueError(f"no such mode: {g.mode}")
    spared = shown & (inst == 0) if g.hide_instances else shown
    return F.when(spared, changed).otherwise(label)


def merge_labels(a: Column, b: Column) -> Column:
    """a, and where it is 0, b."""
    return F.when(a == 0, b).otherwise(a)


def zip_labels(keep: DataFrame, other: DataFrame) -> DataFrame:
    """Labels of two sets for the frames both have, point by point."""
    return keep.join(other.withColumnRenamed("label", "other"), ["frame", "point_idx"]).withColumn("label", merge_labels(F.col("label"), F.col("other"))).drop("other")


def visibility_delta(before: list[int], after: list[int]) -> tuple[list[int], list[int]]:
    """Classes to hide and to show again."""
    return sorted(set(after) - set(before)), sorted(set(before) - set(after))
