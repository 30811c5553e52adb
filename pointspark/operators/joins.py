"""Joins by distance, overlap and order, written as equi-joins with a remaining condition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointspark.functions import geometry as G
from pointspark.session import materialize


def neighbour_cells(cols: list[Column], reach: int = 1) -> Column:
    """An array of structs of the cells around a cell, itself included."""
    out = [F.struct(*[c.alias(f"g{i}") for i, c in enumerate(cols)])]
    n = len(cols)
    shifts = [()]
    for _ in range(n):
        shifts = [(*s, d) for s in shifts for d in range(-reach, reach + 1)]
    out = [F.struct(*[(c + d).alias(f"g{i}") for i, (c, d) in enumerate(zip(cols, s, strict=True))]) for s in shifts]
    return F.array(*out)


def radius_join(left: DataFrame, right: DataFrame, axes: tuple[str, ...], radius: float, by: tuple[str, ...] = (), right_prefix: str = "r_", inclusive: bool = True, spread: str = "right") -> DataFrame:
    """Pairs of rows at most radius apart (J09): left's columns, right's with a prefix, and d2.

    Space is cut into cells of the radius; the rows of one side (spread, best
    the smaller) are copied into the cells around theirs, so that a pair meets in
    the other row's cell and nowhere else.
    """
    names = [f"g{i}" for i in range(len(axes))]
    r = right.select(*by, *[F.col(c).alias(right_prefix + c) for c in right.columns if c not in by])

    def keyed(df: DataFrame, prefix: str, copied: bool) -> DataFrame:
        own = [F.floor(F.col(prefix + a) / F.lit(radius)).cast("bigint") for a in axes]
        if not copied:
            return df.withColumns(dict(zip(names, own, strict=True)))
        return df.withColumn("g", F.explode(neighbour_cells(own))).select(*df.columns, *[F.col(f"g.{n}").alias(n) for n in names])

    d2 = G.squared_distance([F.col(a) for a in axes], [F.col(right_prefix + a) for a in axes])
    near = keyed(left, "", spread == "left").join(keyed(r, right_prefix, spread == "right"), [*by, *names]).withColumn("d2", d2)
    return near.where(F.col("d2") <= radius * radius if inclusive else F.col("d2") < radius * radius).drop(*names)


def nearest_join(left: DataFrame, right: DataFrame, axes: tuple[str, ...], key: tuple[str, ...], order: str, radius: float, by: tuple[str, ...] = (), right_prefix: str = "r_", rings: tuple[float, ...] = (0.125, 0.5, 1.0)) -> DataFrame:
    """Each left row that has a right row within radius, with the nearest; ties go to the smaller order.

    key names columns that identify a left row. What is found in a small ring is
    the nearest there is, so only rows that found nothing look further. Rows that
    stand in the same place are met once: of right's the first in order counts.
    """
    at = [*by, *axes]
    other = [c for c in right.columns if c not in (*at, order)]
    if len(other) == 1:
        # numbers are aggregated without a sort
        spots = right.groupBy(*at).agg(F.min(order).alias(order), F.min_by(other[0], order).alias(other[0]))
    else:
        spots = right.groupBy(*at).agg(F.min_by(F.struct(order, *other), order).alias("s")).select(*at, "s.*")
    spots = materialize(spots.select(*right.columns), "spots")
    rest = materialize(left.select(*at).distinct(), "places")
    out = None
    for i, ring in enumerate(rings):
        pairs = radius_join(rest, spots, axes, radius * ring, by, right_prefix, spread="left")
        others = [c for c in pairs.columns if c not in at]
        best = F.min_by(F.struct(*others), F.struct("d2", right_prefix + order)).alias("b")
        found = pairs.groupBy(*at).agg(best).select(*at, *[f"b.{c}" for c in others])
        if i < len(rings) - 1:
            found = materialize(found, "ring")
            rest = materialize(rest.join(found.select(*at), at, "left_anti"), "rest")
        out = found if out is None else out.unionByName(found)
    kept = [c for c in left.columns if c not in key]
    return left.join(out, at).select(*key, *kept, *[c for c in out.columns if c not in left.columns])


def nearest_groups(left: DataFrame, right: DataFrame, axes: tuple[str, ...], key: tuple[str, ...], group: str, n: int, beyond: float, by: tuple[str, ...] = (), rings: tuple[float, ...] = (1.5, 3.0, 6.0)) -> DataFrame:
    """(key, group, d2, rank): for each left row the n nearest groups of right rows that are further off than beyond.

    A group is as far off as its nearest row; ties go to the smaller group. key
    names columns that identify a left row. Rings are multiples of beyond: who
    has n groups beyond it in a ring needs to look no further, as what is
    outside is further off; only the others do, the last of them among all
    rows of theirs. Rows that stand in the same place are met once.
    """
    places = left.select(*by, *axes).distinct()
    at = [*by, *axes]
    spots = materialize(right.select(*by, *axes, group).distinct(), "spots")
    rest = materialize(places, "places")
    out = None
    for ring in (*rings, None):
        if ring is None:
            theirs = spots.select(*by, *[F.col(c).alias(f"r_{c}") for c in (*axes, group)])
            d2 = G.squared_distance([F.col(a) for a in axes], [F.col(f"r_{a}") for a in axes])
            pairs = (rest.join(theirs, list(by)) if by else rest.crossJoin(theirs)).withColumn("d2", d2)
        else:
            pairs = radius_join(rest, spots, axes, beyond * ring, by, spread="left")
        far = pairs.groupBy(*at, F.col(f"r_{group}").alias(group)).agg(F.min("d2").alias("d2")).where(F.col("d2") > beyond * beyond)
        first = F.slice(F.array_sort(F.collect_list(F.struct("d2", group))), 1, n)
        found = far.groupBy(*at).agg(first.alias("near"))
        if ring is not None:
            found = materialize(found.where(F.size("near") == n), "ring")
            rest = materialize(rest.join(found.select(*at), at, "left_anti"), "rest")
        out = found if out is None else out.unionByName(found)
        if not rest.limit(1).count():
            break
    ranked = out.select(*at, F.posexplode("near").alias("pos", "g")).select(*at, F.col(f"g.{group}").alias(group), "g.d2", (F.col("pos") + 1).alias("rank"))
    return left.select(*key, *[c for c in at if c not in key]).join(ranked, at).select(*key, group, "d2", "rank")


def nearest_of_few(rows: DataFrame, centres: list[tuple[float, ...]], axes: tuple[str, ...]) -> tuple[Column, Column]:
    """Index of and distance to the nearest of a fixed list of centres; ties to the first."""
    best, at = None, F.lit(0)
    for i, c in enumerate(centres):
        d = G.squared_distance([F.col(a) for a in axes], [F.lit(float(v)) for v in c])
        if best is None:
            best = d
        else:
            at, best = F.when(d < best, F.lit(i)).otherwise(at), F.least(d, best)
    return at, F.sqrt(best)


def boxes(cells: DataFrame, *by: str, axes: tuple[str, ...] = ("vx", "vy", "vz")) -> DataFrame:
    """lo_ and hi_ of each axis, by the given columns."""
    return cells.groupBy(*by).agg(*[f(a).alias(f"{n}_{a}") for a in axes for f, n in ((F.min, "lo"), (F.max, "hi"))])


def box_pairs(b: DataFrame, by: tuple[str, ...], obj: str = "obj_id", cam: str = "cam", more_than: int = 9, axes: tuple[str, ...] = ("vx", "vy", "vz")) -> DataFrame:
    """Objects of a group seen by different cameras whose boxes share more than so many cells (J12): (by, a, b)."""
    left = b.select(*by, *[F.col(c).alias(f"l_{c}") for c in b.columns if c not in by])
    right = b.select(*by, *[F.col(c).alias(f"r_{c}") for c in b.columns if c not in by])
    ends = lambda s, e: [F.col(f"{s}_{e}_{a}") for a in axes]
    shared = G.box_overlap_cells(ends("l", "lo"), ends("l", "hi"), ends("r", "lo"), ends("r", "hi"))
    hit = (F.col(f"l_{obj}") < F.col(f"r_{obj}")) & (F.col(f"l_{cam}") != F.col(f"r_{cam}")) & (shared > more_than)
    return left.join(right, list(by)).where(hit).select(*by, F.col(f"l_{obj}").alias("a"), F.col(f"r_{obj}").alias("b")).distinct()


def cloud_overlap(points: DataFrame, other: DataFrame, a: str, b: str, axes: tuple[str, ...] = ("x", "y", "z"), digits: int = 6, least: int = 3, ratio: float = 0.7) -> DataFrame:
    """Pairs (a, b) of clouds with shared points: at least so many, or more than a share of a's.

    Points are equal where their coordinates, rounded, are.
    """
    keys = [F.round(F.col(x), digits).alias(x) for x in axes]
    left, right = points.select(a, *keys).distinct(), other.select(b, *keys).distinct()
    size = left.groupBy(a).agg(F.count("*").alias("size"))
    shared = left.join(right, list(axes)).groupBy(a, b).agg(F.count("*").alias("shared"))
    return shared.join(size, a).where((F.col("shared") >= least) | (F.col("shared") > ratio * F.col("size"))).select(a, b, "shared")


def tile_overlaps(tile_x: Column, tile_y: Column, size: Column, px: Column, py: Column, reach: float) -> Column:
    """Whether a circle of the given reach about a pose meets a square tile."""
    e = size / F.lit(2.0)
    qx, qy = F.abs(px - tile_x), F.abs(py - tile_y)
    near = ~(F.greatest(qx, qy) > e + F.lit(reach))
    corner = (qx - e) * (qx - e) + (qy - e) * (qy - e) < reach * reach
    return near & ((F.least(qx, qy) < e) | corner)


def tile_scans(tiles: DataFrame, poses: DataFrame, reach: float, size: float) -> DataFrame:
    """(i, j, frame) for the scans that may have points in a tile.

    Tiles and poses are dealt into cells of size + 2 * reach; a pose is copied
    to the cells around its own, where every tile it can meet has its centre.
    """
    cell = size + 2 * reach
    key = lambda x: F.floor(x / F.lit(cell)).cast("bigint")
    t = tiles.withColumns({"g0": key(F.col("x")), "g1": key(F.col("y"))})
    p = poses.select("frame", "px", "py", F.explode(neighbour_cells([key(F.col("px")), key(F.col("py"))])).alias("g")).select("frame", "px", "py", "g.g0", "g.g1")
    return t.join(p, ["g0", "g1"]).where(tile_overlaps(F.col("x"), F.col("y"), F.col("size"), F.col("px"), F.col("py"), reach)).select("i", "j", "frame")


def remap(rows: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """column replaced by its new value in mapping (old, new), where it has one."""
    m = mapping.select(F.col("old").alias(column), F.col("new").alias("new_value"))
    return rows.join(m, column, "left").withColumn(column, F.coalesce("new_value", column)).drop("new_value").select(*rows.columns)


def top_within(rows: DataFrame, by: tuple[str, ...], order: list, n: int) -> DataFrame:
    """The first n rows of each group; the planner keeps n a group before it shuffles."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= n)
