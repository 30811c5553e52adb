"""Grouped and focal aggregates: bird's-eye grids, histograms, boxes, majorities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointspark.functions import scalars as S


def range_intensity(x: Column, y: Column, z: Column, intensity: Column) -> Column:
    """Intensity times distance from the sensor."""
    return intensity * F.sqrt(x * x + y * y + z * z)


def bev_cells(points: DataFrame, resolution: float, *by: str) -> DataFrame:
    """points with row and col of their cell, counted from the lowest x and y of all."""
    ends = points.agg(F.min("x").alias("x0"), F.min("y").alias("y0"))
    cell = lambda c: S.truncate((F.col(c) - F.col(f"{c}0")) / F.lit(resolution))
    return points.crossJoin(F.broadcast(ends)).withColumns({"row": cell("y"), "col": cell("x")}).drop("x0", "y0")


def normalized(points: DataFrame, value: str = "intensity") -> DataFrame:
    """value scaled to [0, 1] by the ends of all; 0 where they are equal."""
    ends = points.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    scaled = F.coalesce(F.try_divide(F.col(value) - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))
    return points.crossJoin(F.broadcast(ends)).withColumn(value, scaled).drop("lo", "hi")


def bev_max(points: DataFrame, resolution: float, value: str = "intensity") -> DataFrame:
    """(row, col, val): the largest scaled value of each occupied cell."""
    return bev_cells(normalized(points, value), resolution).groupBy("row", "col").agg(F.max(value).alias("val"))


def quantile_edges(cells: DataFrame, value: str = "val", bins: int = 1000, edges: int = 10) -> DataFrame:
    """(k, edge) for k from 0 to edges: where the cumulative histogram of [0, 1] reaches k / edges, between bins by straight lines; edge 0 is 0; an empty table gives no rows."""
    bin_of = F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).cast("int")
    counts = cells.groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n"))
    order = Window.orderBy("bin")
    full = cells.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(F.broadcast(counts), "bin", "left").fillna(0, ["n"])
    c = full.select("bin", F.try_divide(F.sum("n").over(order), F.sum("n").over(Window.partitionBy())).alias("c"))
    seg = c.select(F.col("c").alias("c1"), ((F.col("bin") + 1) / F.lit(float(bins))).alias("x1"), F.lag("c").over(order).alias("c0"), (F.col("bin") / F.lit(float(bins))).alias("x0"))
    wanted = cells.sparkSession.range(edges + 1).select(F.col("id").cast("int").alias("k"), (F.col("id") / F.lit(float(edges))).alias("q"))
    # the first segment that reaches q; below the first bin's share its right edge holds
    hits = wanted.join(F.broadcast(seg), F.col("c1") >= F.col("q")).groupBy("k", "q").agg(F.min_by(F.struct("c0", "c1", "x0", "x1"), "x1").alias("s"))
    between = F.col("s.x0") + F.try_divide(F.col("q") - F.col("s.c0"), F.col("s.c1") - F.col("s.c0")) * (F.col("s.x1") - F.col("s.x0"))
    edge = F.when(F.col("k") == 0, F.lit(0.0)).when(F.col("s.c0").isNull() | (F.col("s.c0") >= F.col("q")), F.col("s.x1")).otherwise(between)
    return hits.select("k", edge.alias("edge"))


def focal_histogram(cells: DataFrame, edges: list[float], reach: int = 2, value: str = "val") -> DataFrame:
    """(row, col, bin, share): of the occupied cells around each, the share in each bin; empty bins are absent.

    Values outside the edges count in no bin; the last bin is closed. Each cell
    is sent to the cells around it, which meets it by equality.
    """
    n = len(edges) - 1
    bin_of = F.lit(None).cast("int")
    for k in range(n):
        inside = (F.col(value) >= edges[k]) & (F.col(value) <= edges[k + 1] if k == n - 1 else F.col(value) < edges[k + 1])
        bin_of = F.when(inside, F.lit(k)).otherwise(bin_of)
    shift = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)]))
    sent = cells.select("row", "col", bin_of.alias("bin"), shift.alias("s")).select((F.col("row") + F.col("s.i")).alias("row"), (F.col("col") + F.col("s.j")).alias("col"), "bin")
    counted = sent.groupBy("row", "col", "bin").agg(F.count("*").alias("n"))
    whole = counted.withColumn("all", F.sum("n").over(Window.partitionBy("row", "col")))
    return whole.where("bin is not null").join(cells.select("row", "col"), ["row", "col"], "left_semi").select("row", "col", "bin", (F.col("n") / F.col("all")).alias("share"))


def l2_normalized(rows: DataFrame, column: str) -> DataFrame:
    """An array column at length 1; a row of zeros stays."""
    v = F.transform(column, lambda x: x.cast("double"))
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return rows.withColumn(column, F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0))))


def mean_vector(rows: DataFrame, column: str, *by: str) -> DataFrame:
    """(by, pos, mean): the mean of an array column by position."""
    return rows.select(*by, F.posexplode(column).alias("pos", "v")).groupBy(*by, "pos").agg(F.avg(F.col("v").cast("double")).alias("mean"))


def bounding_boxes(points: DataFrame, *by: str) -> DataFrame:
    """min, max, size and middle of each axis."""
    ends = points.groupBy(*by).agg(*[f(c).alias(f"{n}_{c}") for c in "xyz" for f, n in ((F.min, "min"), (F.max, "max"))])
    size = {f"size_{c}": F.col(f"max_{c}") - F.col(f"min_{c}") for c in "xyz"}
    return ends.withColumns(size).withColumns({f"mid_{c}": F.col(f"min_{c}") + F.col(f"size_{c}") / F.lit(2.0) for c in "xyz"})


def max_instance(points: DataFrame, label: str = "label") -> DataFrame:
    """(sem, max_inst) by class."""
    return points.groupBy(S.semantic(F.col(label)).alias("sem")).agg(F.max(S.instance(F.col(label))).alias("max_inst"))


def cooccurrence(points: DataFrame, *by: str, least: int = 30) -> DataFrame:
    """Counts of (by) of at least so many points."""
    return points.groupBy(*by).agg(F.count("*").alias("cnt")).where(F.col("cnt") >= least)


def majority(rows: DataFrame, value: str, *by: str, out: str = "major") -> DataFrame:
    """The most frequent value of each group; ties go to the smaller one."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("cnt"))
    return counts.groupBy(*by).agg(F.max_by(F.struct(F.col(value), F.col("cnt")), F.struct("cnt", -F.col(value))).alias("b")).select(*by, F.col(f"b.{value}").alias(out), "b.cnt")


def labelled_ratio(points: DataFrame, *by: str, label: str = "label") -> DataFrame:
    """The share of points with a class, as counts and a ratio; null for no points."""
    done = F.count_if(S.semantic(F.col(label)) != 0)
    return points.groupBy(*by).agg(done.alias("labelled"), F.count("*").alias("n")).withColumn("ratio", F.try_divide("labelled", "n"))


def heightmap(points: DataFrame, cell: float = 0.5, outlier: int = 1) -> DataFrame:
    """(hx, hy, h): the lowest z of each cell, points of the outlier class left out."""
    key = lambda c: F.floor(F.col(c) / F.lit(cell)).cast("bigint").alias(f"h{c}")
    return points.where(S.semantic(F.col("label")) != outlier).groupBy(key("x"), key("y")).agg(F.min("z").alias("h"))


def smooth_diagonal(grid: DataFrame) -> DataFrame:
    """(hx, hy, h): the mean of a cell's diagonal neighbours that exist; its own height where none does."""
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 1) for j in (-1, 1)]))
    sent = grid.select("hx", "hy", "h", steps.alias("s")).select((F.col("hx") + F.col("s.i")).alias("hx"), (F.col("hy") + F.col("s.j")).alias("hy"), F.col("h").alias("near"))
    mean = sent.groupBy("hx", "hy").agg((F.sum("near") / F.count("*")).alias("mean"))
    return grid.join(mean, ["hx", "hy"], "left").select("hx", "hy", F.coalesce("mean", "h").alias("h"))


def above_ground(points: DataFrame, grid: DataFrame, threshold: float, cell: float = 0.5) -> DataFrame:
    """points higher than their cell of the grid plus the threshold."""
    key = lambda c: F.floor(F.col(c) / F.lit(cell)).cast("bigint")
    return points.withColumns({"hx": key("x"), "hy": key("y")}).join(grid, ["hx", "hy"]).where(F.col("z") > F.col("h") + threshold).drop("hx", "hy", "h")


def pair_frames(members: DataFrame, group: tuple[str, ...] = ("frame", "root"), member: str = "member") -> DataFrame:
    """(a, b, n): in how many frames two ids stand in one set, a < b."""
    left, right = members.select(*group, F.col(member).alias("a")), members.select(*group, F.col(member).alias("b"))
    both = left.join(right, list(group)).where("a < b").select(group[0], "a", "b").distinct()
    return both.groupBy("a", "b").agg(F.count("*").alias("n"))


def lifetimes(seen: DataFrame, obj: str = "obj_id", frame: str = "frame", half: int = 3) -> DataFrame:
    """(obj, born, gone): first and last frame, each half a window further out."""
    return seen.groupBy(obj).agg((F.min(frame) - half).alias("born"), (F.max(frame) + half).alias("gone"))


def temporal_jaccard(pairs: DataFrame, life: DataFrame, obj: str = "obj_id", threshold: float = 0.7) -> DataFrame:
    """Pairs seen together in more than a share of the time both live; lives that do not meet never match."""
    side = lambda s: life.select(F.col(obj).alias(s), F.col("born").alias(f"born_{s}"), F.col("gone").alias(f"gone_{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    time = F.least("gone_a", "gone_b") - F.greatest("born_a", "born_b") + 1
    return both.where(time > 0).select("a", "b", "n", (F.col("n") / time).alias("jaccard")).where(F.col("jaccard") > threshold)
