"""Operators on ordered rows: windows, islands, dense numbers, trajectories, folds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointspark.functions import geometry as G
from pointspark.session import materialize


def path_length(rows: DataFrame, by: tuple[str, ...], order: tuple[str, ...], step: Column, out: str = "dist") -> DataFrame:
    """The running sum of steps along each sequence; the first step counts nothing."""
    w = Window.partitionBy(*by).orderBy(*order)
    first = F.row_number().over(w) == 1
    return rows.withColumn(out, F.sum(F.when(first, F.lit(0).cast("decimal(20,6)")).otherwise(step)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def islands(frames: DataFrame, by: tuple[str, ...], frame: str, gap: int = 10) -> DataFrame:
    """(by, island, first, last, n): runs of frames with no gap above gap."""
    w = Window.partitionBy(*by).orderBy(frame)
    cut = (F.col(frame) - F.lag(frame).over(w) > gap).cast("int")
    run = frames.withColumn("cut", F.coalesce(cut, F.lit(0))).withColumn("island", F.sum("cut").over(w))
    return run.groupBy(*by, "island").agg(F.min(frame).alias("first"), F.max(frame).alias("last"), F.count("*").alias("n"))


def loops(frames: DataFrame, by: tuple[str, ...], frame: str, gap: int = 10) -> DataFrame:
    """islands of the sequences that have more than one."""
    found = islands(frames, by, frame, gap)
    return found.withColumn("runs", F.count("*").over(Window.partitionBy(*by))).where("runs > 1").drop("runs")


def numbered(rows: DataFrame, order: tuple[str, ...], start: int, out: str) -> DataFrame:
    """rows with consecutive numbers from start in the given total order.

    Rows are dealt by range and written; the sizes of the parts give each its
    first number, so no task holds more than a part.
    """
    part = "numbered_part"
    dealt = rows.repartitionByRange(*order).withColumn(part, F.spark_partition_id())
    dealt = materialize(dealt, "numbered")
    sizes = dealt.groupBy(part).agg(F.count("*").alias("n"))
    before = sizes.select(part, (F.sum("n").over(Window.orderBy(part)) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    # a row for each part of the range
    return dealt.join(F.broadcast(before), part).withColumn(out, (place + F.col("before") + (start - 1)).cast("bigint")).drop(part, "before")


def dense_ids(rows: DataFrame, value: str, order: tuple[str, ...], start: int, by: tuple[str, ...] = (), out: str = "dense") -> DataFrame:
    """(by, value, out): numbers from start by first appearance; the value 0 keeps 0.

    The numbering runs over distinct values only, by range where there are no
    groups to number in.
    """
    first = rows.where(F.col(value) != 0).groupBy(*by, value).agg(F.min(F.struct(*order)).alias("first"))
    if by:
        number = F.row_number().over(Window.partitionBy(*by).orderBy("first", value)) + (start - 1)
        done = first.select(*by, value, number.cast("bigint").alias(out))
    else:
        done = numbered(first.select(value, *[F.col(f"first.{c}").alias(f"first_{c}") for c in order]), tuple(f"first_{c}" for c in order) + (value,), start, out).select(value, out)
    zeros = rows.where(F.col(value) == 0).select(*by, value).distinct().withColumn(out, F.lit(0).cast("bigint"))
    return done.unionByName(zeros)


def buffer_offsets(points: DataFrame, frames: DataFrame) -> DataFrame:
    """(frame, start, size) of each frame in one long buffer; empty frames start where the last ended."""
    sizes = points.groupBy("frame").agg(F.count("*").alias("size"))
    all_ = frames.select("frame").distinct().join(sizes, "frame", "left").fillna(0, ["size"])
    return all_.select("frame", (F.sum("size").over(Window.orderBy("frame")) - F.col("size")).alias("start"), "size")


def last_writer(claims: DataFrame, key: tuple[str, ...], value: str, size: str) -> DataFrame:
    """Painting by ascending size: of those that claim a key the largest stays, then the larger value."""
    return claims.groupBy(*key).agg(F.max_by(value, F.struct(size, value)).alias(value))


def batches(frames: DataFrame, size: int = 200) -> DataFrame:
    """Frames with the number of their batch, counted from the first frame."""
    lo = frames.agg(F.min("frame").alias("lo"))
    return frames.crossJoin(F.broadcast(lo)).withColumn("batch", F.expr(f"(frame - lo) div {size}")).drop("lo")


def task_split(n: int, parts: int) -> list[tuple[int, int]]:
    """Contiguous ranges [a, b) of n tasks; the last takes what does not divide."""
    each = n // parts
    return [(i * each, (i + 1) * each if i < parts - 1 else n) for i in range(parts)]


def page(first: int, last: int, size: int, number: int) -> tuple[int, int]:
    """The frames [a, b] of a page, kept inside the range."""
    a = min(max(first, first + number * size), last)
    return a, min(a + size - 1, last)


def rebased(rows: DataFrame, by: tuple[str, ...], order: tuple[str, ...], columns: tuple[str, ...]) -> DataFrame:
    """columns less their value in the first row of each sequence."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumns({c: F.col(c) - F.first(c).over(w) for c in columns})


def local_peak(rows: DataFrame, by: tuple[str, ...], order: str, value: str) -> DataFrame:
    """Rows whose value is at least that of both neighbours, and the sum of the three."""
    w = Window.partitionBy(*by).orderBy(order)
    before, after = F.coalesce(F.lag(value).over(w), F.lit(0)), F.coalesce(F.lead(value).over(w), F.lit(0))
    around = rows.withColumns({"before": before, "after": after})
    return around.where((F.col(value) >= F.col("before")) & (F.col(value) >= F.col("after"))).withColumn("three", F.col("before") + F.col(value) + F.col("after")).drop("before", "after")


def narrowed(height_at, low: float, high: float, target: tuple[float, float], start: float, rounds: int = 30) -> float:
    """The angle between low and high at which height_at lies within target; start where it is there already.

    height_at falls as the angle rises, and is None where nothing is seen. The
    first try is the bound on the side of the target; each further one the
    middle. Without a hit, or without anything to see, the answer is start.
    """
    height = height_at(start)
    if height is None or target[0] <= height <= target[1]:
        return start
    angle = high if height > target[1] else low
    for _ in range(rounds):
        if height > target[1]:
            low = angle if angle != high else low
        else:
            high = angle if angle != low else high
        angle = (low + high) / 2
        height = height_at(angle)
        if height is None:
            return start
        if target[0] <= height <= target[1]:
            return angle
    return start


def bisect(f, low: float, high: float, rounds: int = 40) -> float:
    """Where a rising function passes zero, between low and high."""
    for _ in range(rounds):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return (low + high) / 2


# ---- keyframes


def keyframe_starts(poses: np.ndarray, width: int, shift: float = 10.0, angle: float = np.pi / 4) -> list[int]:
    """Indexes at which segments start: a segment ends at width frames, after so long a way or so wide a turn from its start."""
    if not len(poses):
        return []
    starts, count = [0], 1
    for i in range(1, len(poses)):
        m = poses[starts[-1]]
        rot = m[:3, :3].T @ poses[i][:3, :3]
        way = np.linalg.norm(m[:3, :3].T @ (poses[i][:3, 3] - m[:3, 3]))
        # the angle from sine and cosine keeps small turns exact
        sine = np.linalg.norm([rot[2, 1] - rot[1, 2], rot[0, 2] - rot[2, 0], rot[1, 0] - rot[0, 1]]) / 2
        turn = np.arctan2(sine, (np.trace(rot) - 1) / 2)
        if count > width - 1 or way >= shift or turn >= angle:
            starts.append(i)
            count = 1
        else:
            count += 1
    return starts


def keyframes(poses: DataFrame, width: int, by: str = "seq", shift: float = 10.0, angle: float = np.pi / 4) -> DataFrame:
    """(by, frame) of the keyframes: a fold over each sequence's poses, which are one row a scan."""
    cols = G.names("m")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        m = np.tile(np.eye(4), (len(pdf), 1, 1))
        m[:, :3, :] = pdf[cols].to_numpy(np.float64).reshape(-1, 3, 4)
        return pdf[[by, "frame"]].iloc[keyframe_starts(m, width, shift, angle)]

    kind = dict(poses.dtypes)[by]
    return poses.select(by, "frame", *cols).groupBy(by).applyInPandas(fold, f"{by} {kind}, frame int")


# ---- tracker


def track_boxes(frames: Iterator[tuple[int, list[tuple]]], reach: float = 2.0, ratio: float = 0.8) -> Iterator[tuple[int, int, int]]:
    """(frame, label, new label) for boxes (label, lo, hi) frame by frame.

    A label takes over the new label of the nearest box of the frame before, if
    their middles are less than reach apart and each side of the one is over
    ratio of the other's. Boxes of one new label are one box afterwards. Sides
    of length 0 on both never match.
    """
    before: list[tuple[int, np.ndarray, np.ndarray]] = []
    for frame, boxes in frames:
        found, before = track_frame(boxes, before, reach, ratio)
        for label, new in found:
            yield frame, label, new


def track_frame(boxes: list[tuple], before: list[tuple], reach: float = 2.0, ratio: float = 0.8) -> tuple[list[tuple[int, int]], list[tuple]]:
    """(label, new label) of a frame's boxes (label, lo, hi), and its boxes by new label, from those of the frame before."""
    found: list[tuple[int, int]] = []
    merged: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for label, lo, hi in sorted(boxes, key=lambda b: b[0]):
        new = label
        if before:
            d = [float(np.linalg.norm((lo + hi) / 2 - (a + b) / 2)) for _, a, b in before]
            i = int(np.argmin(d))
            one, two = hi - lo, before[i][2] - before[i][1]
            with np.errstate(divide="ignore", invalid="ignore"):
                alike = np.minimum(one / two, two / one)
            if d[i] < reach and (alike > ratio).all():
                new = before[i][0]
        found.append((label, new))
        if new in merged:
            merged[new] = np.minimum(merged[new][0], lo), np.maximum(merged[new][1], hi)
        else:
            merged[new] = lo, hi
    return found, [(k, *v) for k, v in sorted(merged.items())]


def track(boxes: DataFrame, by: str = "seq", least_label: int = 1000) -> DataFrame:
    """(by, frame, label, new_label) from boxes (by, frame, label, min_x .. max_z) in one frame of reference.

    Only the boxes go through the fold, not the points; frames that follow one
    another meet, whatever their numbers.
    """
    lo, hi = ["min_x", "min_y", "min_z"], ["max_x", "max_y", "max_z"]

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        key = pdf[by].iloc[0]
        frames = ((int(f), [(int(r.label), np.array([getattr(r, c) for c in lo]), np.array([getattr(r, c) for c in hi])) for r in g.itertuples()]) for f, g in pdf.sort_values("frame").groupby("frame"))
        out = list(track_boxes(frames))
        return pd.DataFrame({by: [key] * len(out), "frame": [a for a, _, _ in out], "label": [b for _, b, _ in out], "new_label": [c for _, _, c in out]})

    kind = dict(boxes.dtypes)[by]
    return boxes.where(F.col("label") >= least_label).select(by, "frame", "label", *lo, *hi).groupBy(by).applyInPandas(fold, f"{by} {kind}, frame int, label bigint, new_label bigint")


# ---- trajectory errors


def segment_ends(path: DataFrame, lengths: tuple[float, ...], every: int = 10, by: tuple[str, ...] = ("seq",), dist: str = "dist", frame: str = "frame") -> DataFrame:
    """(by, first, len, last): for each start and length the first frame that is further along than that.

    Distances never fall, so the frame is found by merging starts and frames by
    distance in one sorted pass of each sequence, from its end: what is further
    along is a running minimum.
    """
    start = path.where(F.col(frame) % every == 0).select(*by, F.col(frame).alias("first"), F.explode(F.array(*[F.lit(float(v)) for v in lengths])).alias("len"), F.col(dist).cast("double").alias("d0"))
    wants = start.select(*by, "first", "len", (F.col("d0") + F.col("len")).alias("d"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("f"))
    has = path.select(*by, F.lit(None).cast("int").alias("first"), F.lit(None).cast("double").alias("len"), F.col(dist).cast("double").alias("d"), F.lit(0).alias("kind"), F.col(frame).cast("int").alias("f"))
    # strictly further: rows at the same distance come after the wish
    after = Window.partitionBy(*by).orderBy(F.desc("d"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    found = wants.unionByName(has).withColumn("last", F.min("f").over(after))
    return found.where("kind = 1 and last is not null").select(*by, "first", "len", "last")


def pose_errors(segments: DataFrame, truth: DataFrame, result: DataFrame, by: tuple[str, ...] = ("seq",)) -> DataFrame:
    """segments with rotation error, shift error (both by length) and speed."""

    def at(df: DataFrame, frame: str, p: str) -> DataFrame:
        return df.select(*by, F.col("frame").alias(frame), *[F.col(n).alias(p + n[1:]) for n in G.names("m")])

    df = segments
    for poses, frame, p in ((truth, "first", "a"), (truth, "last", "b"), (result, "first", "c"), (result, "last", "d")):
        df = df.join(at(poses, frame, p), [*by, frame])
    g = G.multiply(G.invert(G.columns("a")), G.columns("b"))
    r = G.multiply(G.invert(G.columns("c")), G.columns("d"))
    e = G.multiply(G.invert(r), g)
    speed = F.col("len") / (F.lit(0.1) * (F.col("last") - F.col("first") + 1))
    return df.select(*by, "first", "len", "last", (G.rotation_angle(e) / F.col("len")).alias("r_err"), (G.shift_length(e) / F.col("len")).alias("t_err"), speed.alias("speed"))


def errors_by(errors: DataFrame, buckets: list[float], value: str, reach: float, least: int = 3) -> DataFrame:
    """(bucket, n, r_err, t_err): means over the errors near each bucket, which may overlap."""
    spread = F.explode(F.filter(F.array(*[F.lit(float(b)) for b in buckets]), lambda b: F.abs(F.col(value) - b) < reach))
    return errors.withColumn("bucket", spread).groupBy("bucket").agg(F.count("*").alias("n"), F.avg("r_err").alias("r_err"), F.avg("t_err").alias("t_err")).where(F.col("n") >= least)
