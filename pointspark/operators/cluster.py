"""Clustering: density clusters, region growing, fuzzy c-means and what label fusion builds on them."""

from __future__ import annotations

import itertools
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointspark.functions import geometry as G
from pointspark.operators.graph import connected_components
from pointspark.operators.joins import box_pairs, boxes, neighbour_cells, radius_join
from pointspark.session import materialize

VOXEL = ("vx", "vy", "vz")


def dbscan(points: DataFrame, eps: float, min_points: int, key: str, axes: tuple[str, ...] = VOXEL, by: tuple[str, ...] = ()) -> DataFrame:
    """(key, by, cluster) with cluster the smallest core key of a density cluster, or null for noise.

    key identifies a point over all groups. A point counts itself; a border
    point goes to the nearest core point, then the smaller key.

    Cells have a diagonal of eps, so the points of a cell with min_points or
    more are all core, and one node; only points of emptier cells are compared
    with those around them, of which each cell has less than min_points. Full
    cells are linked where a pair of theirs is within eps, which their boxes
    tell for most.
    """
    # as many cells each way as eps reaches; a hair smaller, so that rounding cannot make a diagonal longer
    side = eps / math.sqrt(len(axes)) * (1 - 1e-12)
    cell = [f"cell_{a}" for a in axes]
    p = points.select(key, *by, *axes, *[F.floor(F.col(a) / F.lit(side)).cast("bigint").alias(c) for a, c in zip(axes, cell, strict=True)])
    box = [f(a).alias(f"{n}_{a}") for a in axes for f, n in ((F.min, "lo"), (F.max, "hi"))]
    full = materialize(p.groupBy(*by, *cell).agg(F.count("*").alias("n"), F.min(key).alias("node"), *box).where(F.col("n") >= min_points), "full-cells")
    # the node of a point in a full cell, null elsewhere
    p = materialize(p.join(full.select(*by, *cell, "node"), [*by, *cell], "left"), "points")
    thin = p.where("node is null").select(key, *by, *axes)
    pairs = radius_join(thin, p.select(key, *by, *axes, "node"), axes, eps, by, spread="left")
    pairs = materialize(pairs.select(F.col(key).alias("a"), F.col(f"r_{key}").alias("b"), F.col("r_node").alias("b_node"), "d2"), "neighbours")
    core = materialize(pairs.groupBy(F.col("a").alias("c")).agg(F.count("*").alias("n")).where(F.col("n") >= min_points).select("c"), "core")
    # core neighbours by their node: a full cell's, or a core point itself
    in_full = pairs.where("b_node is not null").withColumn("to", F.col("b_node"))
    in_thin = pairs.where("b_node is null").join(core.withColumnRenamed("c", "b"), "b", "left_semi").withColumn("to", F.col("b"))
    near = materialize(in_full.unionByName(in_thin.select(*in_full.columns)), "core-neighbours")
    edges = near.join(core.withColumnRenamed("c", "a"), "a", "left_semi").select("a", F.col("to").alias("b"))
    alone = full.select(F.col("node").alias("a"), F.col("node").alias("b"))
    groups = materialize(connected_components(edges.unionByName(full_cell_links(p, full, eps, axes, cell, by)).unionByName(alone)), "groups")
    best = near.join(groups, near["to"] == groups["node"]).groupBy("a").agg(F.min_by("component", F.struct("d2", "b")).alias("cluster"))
    thin_found = thin.select(key, *by).join(best, F.col(key) == F.col("a"), "left").select(key, *by, "cluster")
    full_found = p.where("node is not null").select(key, *by, F.col("node").alias("of")).join(groups, F.col("of") == F.col("node")).select(key, *by, F.col("component").alias("cluster"))
    return thin_found.unionByName(full_found)


def full_cell_links(points: DataFrame, full: DataFrame, eps: float, axes: tuple[str, ...], cell: list[str], by: tuple[str, ...]) -> DataFrame:
    """(a, b): nodes of full cells with points at most eps apart.

    Cells whose boxes lie within eps whole, or beyond it, need no points. Of the
    others the points within eps of the other cell's box meet in one group for a
    pair of cells, and are compared block by block until one pair is near; no
    pair of points is written.
    """
    reach = math.ceil(math.sqrt(len(axes)))
    spans = [f"{n}_{a}" for a in axes for n in ("lo", "hi")]
    own = full.select(*by, *cell, "node", *spans)
    moved = [F.col(c).alias(f"at_{c}") for c in cell]
    here = own.select(*by, *moved, "node", *spans).withColumn("g", F.explode(neighbour_cells([F.col(f"at_{c}") for c in cell], reach)))
    here = here.select(*by, "node", *spans, *[F.col(f"g.g{i}").alias(c) for i, c in enumerate(cell)])
    met = here.join(own.select(*by, *cell, F.col("node").alias("other"), *[F.col(c).alias(f"o_{c}") for c in spans]), [*by, *cell]).where("node < other")
    col = F.col
    least = sum((F.pow(F.greatest(col(f"lo_{a}") - col(f"o_hi_{a}"), col(f"o_lo_{a}") - col(f"hi_{a}"), F.lit(0)), 2) for a in axes), F.lit(0.0))
    most = sum((F.pow(F.greatest(col(f"hi_{a}") - col(f"o_lo_{a}"), col(f"o_hi_{a}") - col(f"lo_{a}")), 2) for a in axes), F.lit(0.0))
    met = materialize(met.withColumns({"least": least, "most": most}).where(col("least") <= eps * eps), "cell-pairs")
    sure, open_ = met.where(col("most") <= eps * eps).select(col("node").alias("a"), col("other").alias("b")), met.where(col("most") > eps * eps)
    placed = points.where("node is not null").select("node", *axes)

    def reaching(mine: str, prefix: str, side: int) -> DataFrame:
        """Points of one cell of each open pair that the other's box has within eps."""
        to_box = sum((F.pow(F.greatest(col(f"b_lo_{a}") - col(a), col(a) - col(f"b_hi_{a}"), F.lit(0)), 2) for a in axes), F.lit(0.0))
        want = open_.select(col("node").alias("a"), col("other").alias("b"), col(mine).alias("node"), *[col(prefix + c).alias(f"b_{c}") for c in spans])
        return placed.join(want, "node").where(to_box <= eps * eps).select("a", "b", F.lit(side).alias("side"), *[col(a).cast("double").alias(a) for a in axes])

    def any_near(pdf: pd.DataFrame) -> pd.DataFrame:
        v, side = pdf[list(axes)].to_numpy(np.float64), pdf["side"].to_numpy()
        x, y = v[side == 0], v[side == 1]
        hit = any((((x[i : i + 256, None] - y[None, j : j + 256]) ** 2).sum(-1) <= eps * eps).any() for i in range(0, len(x), 256) for j in range(0, len(y), 256))
        return pdf[["pair"]].iloc[: int(hit)]

    both = reaching("node", "o_", 0).unionByName(reaching("other", "", 1))
    # a pair of cells goes by a number of its own, as nodes may be of any kind
    numbers = materialize(open_.select(col("node").alias("a"), col("other").alias("b")).withColumn("pair", F.monotonically_increasing_id()), "open-pairs")
    hits = both.join(numbers, ["a", "b"]).select("pair", "side", *axes).groupBy("pair").applyInPandas(any_near, "pair long")
    return sure.unionByName(numbers.join(hits, "pair", "left_semi").select("a", "b"))


def regions(voxels: DataFrame, radius: float, key: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(key, region): voxels joined by steps of at most radius; region is the smallest key.

    Voxels lie at whole numbers. Blocks of them are as wide as the radius links
    whole, and are one node each; blocks in reach of each other are compared by
    their boxes, and by their voxels where boxes do not tell.
    """
    from pointspark.operators.ordered import numbered

    side, r2 = 1, radius * radius
    while 3 * side * side <= r2:
        side += 1
    at, spans, col = [f"at_{a}" for a in VOXEL], [f"{n}_{a}" for a in VOXEL for n in ("lo", "hi")], F.col
    p = voxels.select(key, *by, *VOXEL, *[F.floor(col(a) / F.lit(side)).cast("bigint").alias(c) for a, c in zip(VOXEL, at, strict=True)])
    box = [f(a).alias(f"{n}_{a}") for a in VOXEL for n, f in (("lo", F.min), ("hi", F.max))]
    blocks = p.groupBy(*by, *at).agg(F.min(key).alias("first"), *box, F.collect_set(F.struct(*VOXEL)).alias("cells"))
    # numbered by their first voxel: whole numbers are joined by parts of their range
    blocks = materialize(numbered(blocks, ("first",), 0, "node"), "blocks")
    # of two blocks the later by place is asked for by the earlier
    reach = range(-int(radius // side) - 1, int(radius // side) + 2)
    gap = lambda d: (abs(d) - 1) * side + 1 if d else 0
    ahead = [s for s in itertools.product(reach, repeat=3) if s > (0, 0, 0) and sum(gap(d) ** 2 for d in s) <= r2]
    edges = blocks.select(col("node").alias("a"), col("node").alias("b"))
    if ahead:
        shifts = F.array(*[F.struct(*[F.lit(d).alias(c) for c, d in zip(at, s, strict=True)]) for s in ahead])
        here = blocks.withColumn("s", F.explode(shifts)).select(*by, *[(col(c) + col(f"s.{c}")).alias(c) for c in at], col("node").alias("a"), *spans)
        met = here.join(blocks.select(*by, *at, col("node").alias("b"), *[col(c).alias(f"o_{c}") for c in spans]), [*by, *at])
        least = {a: F.pow(F.greatest(col(f"lo_{a}") - col(f"o_hi_{a}"), col(f"o_lo_{a}") - col(f"hi_{a}"), F.lit(0)), 2) for a in VOXEL}
        most = {a: F.pow(F.greatest(col(f"hi_{a}") - col(f"o_lo_{a}"), col(f"o_hi_{a}") - col(f"lo_{a}")), 2) for a in VOXEL}
        # a box has a voxel at each of its sides: two sides that face each other, and at most so far off the other ways
        faces = {a: F.least(F.pow(col(f"o_lo_{a}") - col(f"hi_{a}"), 2), F.pow(col(f"lo_{a}") - col(f"o_hi_{a}"), 2)) for a in VOXEL}
        sure = F.least(*[faces[a] + sum((most[c] for c in VOXEL if c != a), F.lit(0.0)) for a in VOXEL]) <= r2
        met = materialize(met.where(sum(least.values(), F.lit(0.0)) <= r2).select("a", "b", sure.alias("sure")), "block-pairs")
        held = blocks.select("node", "cells")
        open_ = met.where(~col("sure")).join(held.select(col("node").alias("a"), col("cells").alias("own")), "a").join(held.select(col("node").alias("b"), col("cells").alias("other")), "b")
        near = open_.where(F.exists("own", lambda v: F.exists("other", lambda w: G.squared_distance([v[a] for a in VOXEL], [w[a] for a in VOXEL]) <= r2)))
        edges = edges.unionByName(met.where("sure").select("a", "b")).unionByName(near.select("a", "b"))
    groups = connected_components(edges)
    names = blocks.select(col("node").alias("component"), col("first").alias("region"))
    whole = blocks.select(*by, *at, "node").join(groups, "node").join(names, "component").select(*by, *at, "region")
    return p.join(whole, [*by, *at]).select(key, "region")


def representatives(members: DataFrame, by: tuple[str, ...], key: str, axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """The member of each cluster that is nearest to its mean, first by key on ties (A10)."""
    w = Window.partitionBy(*by)
    d2 = G.squared_distance([F.col(a) for a in axes], [F.avg(a).over(w) for a in axes])
    return members.withColumn("d2", d2).groupBy(*by).agg(F.min_by(F.struct(key, *axes), F.struct("d2", key)).alias("r")).select(*by, f"r.{key}", *[f"r.{a}" for a in axes])


def nearest_cluster(members: DataFrame, prompts: DataFrame, obj: str | tuple[str, ...] = "obj_id", cluster: str = "region", axes: tuple[str, ...] = VOXEL) -> DataFrame:
    """(obj, cluster): of the clusters an object has, the one nearest to its prompt; ties to the smaller (J13). obj may be several columns."""
    key = [obj] if isinstance(obj, str) else list(obj)
    p = prompts.select(*key, *[F.col(a).alias(f"p_{a}") for a in axes])
    d2 = G.squared_distance([F.col(a) for a in axes], [F.col(f"p_{a}") for a in axes])
    closest = members.join(p, key).groupBy(*key, cluster).agg(F.min(d2).alias("d2"))
    return closest.groupBy(*key).agg(F.min_by(cluster, F.struct("d2", cluster)).alias(cluster))


def without_bleeding(votes: DataFrame, prompts: DataFrame) -> DataFrame:
    """Votes of an object outside the region nearest to its prompt taken away."""
    return votes.join(nearest_cluster(votes, prompts), ["obj_id", "region"], "left_semi")


def equivalent_objects(votes: DataFrame, by: tuple[str, ...] = ("frame", "region", "sf")) -> DataFrame:
    """(obj_id, root): objects whose boxes of different cameras overlap in a scan, joined to the smallest id."""
    b = boxes(votes, *by, "obj_id", "cam")
    return connected_components(box_pairs(b, by).select("a", "b")).select(F.col("node").alias("obj_id"), F.col("component").alias("root"))


def equivalence_sets(votes: DataFrame, by: tuple[str, ...] = ("frame", "region")) -> DataFrame:
    """(by, obj_id, root): equivalent_objects within each group alone."""
    inside = (*by, "sf")
    pairs = box_pairs(boxes(votes, *inside, "obj_id", "cam"), inside)
    node = lambda c: F.struct(*by, F.col(c).alias("obj_id"))
    found = connected_components(pairs.select(node("a").alias("a"), node("b").alias("b")))
    return found.select("node.*", F.col("component.obj_id").alias("root"))


def vote_sums(votes: DataFrame, by: tuple[str, ...] = ("region", "obj_id")) -> DataFrame:
    """Votes and distinct voxels of each object in a region."""
    return votes.groupBy(*by).agg(F.sum("cnt").alias("votes"), F.countDistinct(*VOXEL).alias("voxels"))


def unified_ids(pairs: DataFrame) -> DataFrame:
    """(old, new) for the ids in matching pairs: the smallest id reachable."""
    return connected_components(pairs).select(F.col("node").alias("old"), F.col("component").alias("new"))


def pixel_components(pixels: DataFrame, by: tuple[str, ...] = ("frame", "cam")) -> DataFrame:
    """(by, row, col, component, first_row, first_col, size): 8-connected parts of masks, with the pixel that names them, their first pixel by row and their size."""
    p = pixels.select(*by, "row", "col").distinct().withColumn("key", F.struct(*by, "row", "col"))
    # each edge from one end only
    ahead = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 1), (1, -1), (1, 0), (1, 1))])
    sent = p.withColumn("s", F.explode(ahead)).select(*by, (F.col("row") + F.col("s.i")).alias("row"), (F.col("col") + F.col("s.j")).alias("col"), F.col("key").alias("from"))
    edges = sent.join(p, [*by, "row", "col"]).select(F.col("from").alias("a"), F.col("key").alias("b"))
    comps = connected_components(edges)
    found = p.join(comps, p["key"] == comps["node"], "left").withColumn("component", F.coalesce("component", "key"))
    size = found.groupBy("component").agg(F.count("*").alias("size"), F.min(F.struct("row", "col")).alias("first"))
    return found.join(size, "component").select(*by, "row", "col", "component", F.col("first.row").alias("first_row"), F.col("first.col").alias("first_col"), "size")


def prompt_objects(voxels: DataFrame, scales: tuple[tuple[float, int], ...] = ((0.6, 30), (1.2, 50)), size: float = 1.0, negatives: int = 5) -> tuple[DataFrame, DataFrame]:
    """(prompts, negatives) for the voxels of keyframes (kf, vx, vy, vz).

    At each scale (radius in the voxels' unit, members) the clusters' middle
    members are prompts, numbered from 1000 by keyframe, scale and place. A
    prompt's negatives are the nearest clusters of the last scale that are
    further off than its radius.
    """
    from pointspark.operators.ordered import numbered

    keyed = voxels.select(F.col("kf"), *VOXEL).distinct().withColumn("key", F.struct("kf", *VOXEL))
    found = None
    for i, (eps, least) in enumerate(scales):
        c = dbscan(keyed, eps / size, least, "key", by=("kf",)).where("cluster is not null")
        c = c.join(keyed, ["key", "kf"]).withColumn("scale", F.lit(i))
        found = c if found is None else found.unionByName(c)
    found = materialize(found, "clusters")
    r = representatives(found, ("kf", "scale", "cluster"), "key", VOXEL)
    w = Window.partitionBy("kf", "scale").orderBy(*VOXEL)
    placed = r.withColumn("j", F.row_number().over(w) - 1)
    prompts = numbered(placed.select("kf", "scale", "j", "cluster", *VOXEL), ("kf", "scale", "j"), 1000, "obj_id")
    last = found.where(F.col("scale") == len(scales) - 1).select("kf", F.col("cluster").alias("other"), *[F.col(a).alias(f"o{a}") for a in VOXEL])
    d2 = G.squared_distance([F.col(a) for a in VOXEL], [F.col(f"o{a}") for a in VOXEL])
    far = prompts.join(last, "kf").groupBy("kf", "obj_id", "other").agg(F.min(d2).alias("d2")).where(F.col("d2") > (scales[-1][0] / size) ** 2)
    names = prompts.where(F.col("scale") == len(scales) - 1).select("kf", F.col("cluster").alias("other"), F.col("obj_id").alias("neg_obj_id"))
    rank = F.row_number().over(Window.partitionBy("obj_id").orderBy("d2", "neg_obj_id"))
    neg = far.join(names, ["kf", "other"]).withColumn("rank", rank).where(F.col("rank") <= negatives).select("obj_id", "rank", "neg_obj_id")
    return prompts.drop("cluster"), neg


def ground_textures(points: DataFrame, resolution: float, clusters: int, reach: int = 2, rounds: int = 30) -> DataFrame:
    """(row, col, class): cells of the ground by the texture around them, classes from 1."""
    from pointspark.operators import aggregates as A

    scaled = points.withColumn("intensity", A.range_intensity(F.col("x"), F.col("y"), F.col("z"), F.col("intensity")))
    cells = materialize(A.bev_max(scaled, resolution), "cells")
    edges = [r.edge for r in A.quantile_edges(cells).orderBy("k").collect()]  # eleven rows
    if not edges:  # no points
        return cells.select("row", "col", F.lit(0).alias("class"))
    bins = len(edges) - 1
    shares = A.focal_histogram(cells, edges, reach)
    vector = F.array(*[F.coalesce(F.max(F.when(F.col("bin") == k, F.col("share"))), F.lit(0.0)) for k in range(bins)])
    rows = cells.select("row", "col").join(shares.groupBy("row", "col").agg(vector.alias("v")), ["row", "col"], "left")
    rows = rows.withColumn("v", F.coalesce("v", F.array(*[F.lit(0.0)] * bins)))
    rows = materialize(A.l2_normalized(rows, "v").withColumn("key", F.xxhash64("row", "col")), "textures")
    found, _ = fuzzy_cmeans(rows, "v", "key", clusters, rounds=rounds)
    return found.select("row", "col", (F.col("cluster") + 1).alias("class"))


# ---- fuzzy c-means


def fuzzy_cmeans(rows: DataFrame, vector: str, key: str, n: int, m: float = 2.0, rounds: int = 30, tolerance: float = 1e-4, centres: np.ndarray | None = None) -> tuple[DataFrame, np.ndarray]:
    """rows with the cluster of largest membership, and the centres.

    The start is the n rows whose key hashes lowest, or the given centres. A
    round is one pass that sums weights and weighted vectors for each cluster;
    n centres come to the driver. Rows without a vector get cluster 0, an empty
    table has no centres.
    """
    if centres is None:
        seeds = rows.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(F.col(key), F.lit(42)), key).limit(n).select(vector).collect()
        centres = np.array([r[0] for r in seeds], np.float64)
    if not len(centres):
        return rows.withColumn("cluster", F.lit(None).cast("int")), centres.reshape(0, 0)

    def distances(v: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.maximum(np.stack([((v - x) ** 2).sum(axis=1) for x in c], axis=1), 1e-12)

    slim = rows.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"))
    for _ in range(rounds):

        def partial(batches: Iterator[pa.RecordBatch], c: np.ndarray = centres) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(c), c.shape[1] + 1))
            for b in batches:
                v = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, c.shape[1])
                near = distances(v, c) ** (-1.0 / (m - 1))
                u = (near / near.sum(axis=1, keepdims=True)) ** m
                total += np.column_stack([u.sum(axis=0), u.T @ v])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["i", "t"])

        sums = slim.mapInArrow(partial, "i long, t double").groupBy("i").agg(F.sum("t").alias("t")).collect()
        total = np.array([r.t for r in sorted(sums)]).reshape(len(centres), -1)
        new = total[:, 1:] / total[:, :1]
        moved = float(np.abs(new - centres).max())
        centres = new
        if moved < tolerance:
            break

    @F.pandas_udf("int")
    def nearest(v: pd.Series) -> pd.Series:
        out = np.zeros(len(v), np.int32)
        known = v.notna().to_numpy()
        if known.any():
            out[known] = distances(np.stack(v[known].to_numpy()).astype(np.float64), centres).argmin(axis=1)
        return pd.Series(out)

    return rows.withColumn("cluster", nearest(vector)), centres


# ---- suppression and growth inside a component


def overlap(lo1: np.ndarray, hi1: np.ndarray, lo2: np.ndarray, hi2: np.ndarray) -> float:
    """Intersection over union of boxes of whole cells; 1 where one holds the other."""
    if (lo1 <= lo2).all() and (hi2 <= hi1).all() or (lo2 <= lo1).all() and (hi1 <= hi2).all():
        return 1.0
    both = np.maximum(np.minimum(hi1, hi2) - np.maximum(lo1, lo2) + 1, 0).prod()
    return float(both / ((hi1 - lo1 + 1).prod() + (hi2 - lo2 + 1).prod() - both))


def suppress(sizes: dict[int, int], lo: dict[int, np.ndarray], hi: dict[int, np.ndarray], threshold: float = 0.5) -> dict[int, int]:
    """label -> the label that absorbs it.

    Labels come by falling size, then id. A head takes in every later label
    whose box overlaps its own by more than threshold or is held by it; its box
    grows and the pass is repeated until nothing is taken in. Boxes are compared
    as they were at the start of a pass.
    """
    order = sorted(sizes, key=lambda k: (-sizes[k], k))
    into = {}
    while order:
        head, rest = order[0], order[1:]
        into[head] = head
        low, high = lo[head], hi[head]
        while True:
            taken = [k for k in rest if overlap(low, high, lo[k], hi[k]) > threshold]
            if not taken:
                break
            for k in taken:
                into[k] = head
                low, high = np.minimum(low, lo[k]), np.maximum(high, hi[k])
            rest = [k for k in rest if k not in into]
        order = rest
    return into


def nms(votes: DataFrame, by: tuple[str, ...] = ("frame", "region"), label: str = "obj_id", threshold: float = 0.5) -> DataFrame:
    """(by, label, root): greedy suppression in each group.

    Sizes and boxes are aggregated first; a group's task gets one row a label.
    """
    b = votes.groupBy(*by, label).agg(F.count("*").alias("size"), *[f(a).alias(f"{n}_{a}") for a in VOXEL for f, n in ((F.min, "lo"), (F.max, "hi"))])
    kinds = dict(b.dtypes)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        lo = {k: v for k, v in zip(pdf[label], pdf[[f"lo_{a}" for a in VOXEL]].to_numpy(), strict=True)}
        hi = {k: v for k, v in zip(pdf[label], pdf[[f"hi_{a}" for a in VOXEL]].to_numpy(), strict=True)}
        into = suppress(dict(zip(pdf[label], pdf["size"], strict=True)), lo, hi, threshold)
        out = pdf[[*by, label]].copy()
        out["root"] = out[label].map(into)
        return out

    schema = ", ".join(f"{c} {kinds[c]}" for c in (*by, label)) + ", root bigint"
    return b.groupBy(*by).applyInPandas(fold, schema)


def layer_cells(p: np.ndarray, side: float) -> dict[tuple[int, int], np.ndarray]:
    """Indexes of the points of a layer by square cells of the given side."""
    keys = np.floor(p[:, :2] / side).astype(np.int64)
    order = np.lexsort(keys.T)
    cut = np.flatnonzero(np.any(np.diff(keys[order], axis=0), axis=1)) + 1
    return {tuple(keys[i[0]].tolist()): i for i in np.split(order, cut)} if len(p) else {}


def around(cells: dict[tuple[int, int], np.ndarray], key: tuple[int, int]) -> np.ndarray:
    """Indexes in a cell and the eight about it."""
    found = [cells[k] for i in (-1, 0, 1) for j in (-1, 0, 1) if (k := (key[0] + i, key[1] + j)) in cells]
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def layer_dbscan(p: np.ndarray, eps: float, least: int) -> np.ndarray:
    """Cluster numbers of the points of a layer, -1 for noise, in order of first core member; a border point joins the first cluster that reaches it."""
    cells, near = layer_cells(p, eps), {}
    for key, own in cells.items():
        other = around(cells, key)
        # a cell's points against those about it, some at a time
        for at in range(0, len(own), 256):
            some = own[at : at + 256]
            hit = ((p[some, None, :2] - p[None, other, :2]) ** 2).sum(-1) <= eps * eps
            near.update((int(i), other[h]) for i, h in zip(some, hit, strict=True))
    out, number = np.full(len(p), -1), 0
    for i in range(len(p)):
        if out[i] < 0 and len(near[i]) >= least:
            out[i], queue = number, [i]
            while queue:
                for k in near[queue.pop()]:
                    if out[k] < 0:
                        out[k] = number
                        if len(near[int(k)]) >= least:
                            queue.append(int(k))
            number += 1
    return out


def layer_reach(p: np.ndarray, own: np.ndarray, eps: float) -> np.ndarray:
    """For each point of a layer, whether one of own is nearer than eps."""
    cells, out = layer_cells(own, eps), np.zeros(len(p), bool)
    for key, some in layer_cells(p, eps).items():
        other = around(cells, key)
        for at in range(0, len(some) if len(other) else 0, 256):
            i = some[at : at + 256]
            out[i] = (((p[i, None, :2] - own[None, other, :2]) ** 2).sum(-1) < eps * eps).any(axis=1)
    return out


def grow_layers(labels: dict[int, np.ndarray], free: np.ndarray, eps: float) -> list[tuple[tuple[int, int, int], int]]:
    """Free voxels that labels take: in each layer of a label, groups of free voxels nearer than eps to it.

    Labels come by falling size, then id; noise is one group. Distances are
    taken between neighbouring cells of side eps only.
    """
    out = []
    pool: dict[int, np.ndarray] = {int(z): free[free[:, 2] == z] for z in np.unique(free[:, 2])} if len(free) else {}
    groups: dict[int, np.ndarray] = {}
    for label in sorted(labels, key=lambda k: (-len(labels[k]), k)):
        for z in np.unique(labels[label][:, 2]).tolist():
            layer = pool.get(z)
            if layer is None or not len(layer):
                continue
            if z not in groups:
                groups[z] = layer_dbscan(layer, eps, 3)
            own = labels[label][labels[label][:, 2] == z]
            taken = np.isin(groups[z], np.unique(groups[z][layer_reach(layer, own, eps)]))
            if taken.any():
                out += [(tuple(m), label) for m in layer[taken].tolist()]
                pool[z] = layer[~taken]
                groups.pop(z)  # what stays is grouped anew
    return out


def grow(voxels: DataFrame, by: tuple[str, ...] = ("frame", "region"), label: str = "obj_id", eps: float = 3.5) -> DataFrame:
    """(by, vx, vy, vz, label) of unlabelled voxels (label null) that labels of their group take.

    Groups without a label, or with nothing to take, are left out before tasks get them.
    """
    kinds = dict(voxels.dtypes)
    count = voxels.groupBy(*by).agg(F.count(label).alias("own"), F.count("*").alias("all"))
    open_ = count.where("own > 0 and own < all").select(*by)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        cells = pdf[list(VOXEL)].to_numpy(np.int64)
        known: dict[int, list] = defaultdict(list)
        for c, k in zip(cells, pdf[label], strict=True):
            if not pd.isna(k):
                known[int(k)].append(c)
        free = cells[pdf[label].isna().to_numpy()]
        found = grow_layers({k: np.array(v) for k, v in known.items()}, free[np.lexsort(free.T)], eps)
        out = pd.DataFrame([c for c, _ in found], columns=list(VOXEL), dtype=np.int64)
        for c in by:
            out[c] = pdf[c].iloc[0]
        out[label] = [k for _, k in found]
        return out[[*by, *VOXEL, label]]

    schema = ", ".join(f"{c} {kinds[c]}" for c in by) + ", vx bigint, vy bigint, vz bigint, " + f"{label} bigint"
    return voxels.select(*by, *VOXEL, label).join(open_, [*by], "left_semi").groupBy(*by).applyInPandas(fold, schema)


# ---- votes of overlapping segments into a shared grid


def vote_segments(segments: list[tuple[int, list[tuple[int, int]]]], share: float = 0.7) -> tuple[dict[tuple[int, int], int], dict[int, int]]:
    """(cell -> id, segment -> id): segments in order, each with the cells of its points, one for every point.

    A segment takes the id that most of its points meet (ties: the one met
    first), if that id counts for more than share of all its points; where no
    point meets one, or none counts for so much, it takes a new id, from 1. Its
    cells then have its id, whatever they had.
    """
    grid: dict[tuple[int, int], int] = {}
    ids: dict[int, int] = {}
    number = 0
    for key, cells in segments:
        counts: dict[int, int] = {}
        for c in cells:
            if c in grid:
                counts[grid[c]] = counts.get(grid[c], 0) + 1
        best = max(counts, key=counts.get, default=None)
        if best is None or counts[best] <= share * len(cells):
            number += 1
            best = number
        ids[key] = best
        grid.update(dict.fromkeys(cells, best))
    return grid, ids


def vote_into_grid(rows: DataFrame, by: str, order: str, share: float = 0.7) -> DataFrame:
    """(by, order, id) for the points (by, order, row, col) of segments, decided in order within each sequence.

    Points are counted by cell before they meet, so a task of a sequence holds a
    row for each cell of a segment. Cells of a segment stand by row and column.
    """
    kind = dict(rows.dtypes)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([order, "row", "col"])
        segments = ((k, [c for c, n in zip(zip(g["row"].tolist(), g["col"].tolist(), strict=True), g["n"].tolist(), strict=True) for _ in range(n)]) for k, g in pdf.groupby(order))
        _, ids = vote_segments(segments, share)
        return pd.DataFrame({by: [pdf[by].iloc[0]] * len(ids), order: list(ids), "id": list(ids.values())})

    counted = rows.groupBy(by, order, "row", "col").agg(F.count("*").alias("n"))
    return counted.groupBy(by).applyInPandas(fold, f"{by} {kind[by]}, {order} {kind[order]}, id bigint")
