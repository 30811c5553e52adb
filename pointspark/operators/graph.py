"""Connected components over an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from pointspark.session import discard, materialize


def counted(edges: DataFrame, label: str) -> tuple[DataFrame, dict]:
    """edges written, and their number and a sum of their hashes, both taken while they are written."""
    seen = Observation()
    measures = F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
    return materialize(edges.observe(seen, *measures), label), seen.get


#: Edges that are joined at a time inside a part.
CHUNK = 1 << 20


def least_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges and the smallest node that each reaches by them."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        # each root takes the smallest root that its own nodes are linked to; then all go to their root's root
        x, y = root[a], root[b]
        open_ = x != y
        if not open_.any():
            return nodes, nodes[root]
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (u, v) of whole numbers by parts of their range: every node of a part with the smallest node (v) that it reaches there.

    Components stay as they are; a task holds CHUNK edges at a time.
    """

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def joined() -> pa.RecordBatch:
            u, v = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in (0, 1))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in least_reachable(u, v)], ["u", "v"])

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= CHUNK:
                yield joined()
        if sum(x.num_rows for x in held):
            yield joined()

    return edges.repartitionByRange("v").sortWithinPartitions("v").mapInArrow(stars, "u long, v long")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 64) -> DataFrame:
    """(node, component) for every node of edges, component being its smallest reachable node.

    Alternates two star operations until nothing changes: every node links its
    larger neighbours, then its smaller ones, to the smallest node it sees. The
    number of rounds grows with the logarithm of the longest chain. Each round
    is an aggregation with map-side combine and an equi-join on slim rows, and
    is written to the shared folder, so its lineage stays short.
    """
    u, v = F.col(a), F.col(b)
    e = edges.where(u.isNotNull() & v.isNotNull()).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct()
    # written once: what made the edges is not run again for the nodes
    first, state = counted(e, "edges")
    if e.schema["u"].dataType.typeName() in ("long", "integer", "short", "byte"):
        return by_parts(first, max_rounds)
    return starred(first, state, max_rounds)


def by_parts(edges: DataFrame, max_rounds: int) -> DataFrame:
    """connected_components of edges (u, v) of whole numbers."""
    kind = edges.schema["u"].dataType
    local = materialize(contracted(edges), "parts")
    # a node's smallest root of all parts
    top = materialize(local.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("most")), "roots")
    # what links roots: nodes of several parts, and roots that have a smaller one elsewhere
    several = local.join(top.where("m <> most").select("u", "m"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    roots = local.select(F.col("v").alias("u")).distinct()
    linked = top.where("m <> u").join(roots, "u", "left_semi").select("u", F.col("m").alias("v"))
    groups = materialize(starred(*counted(several.union(linked).distinct(), "root-edges"), max_rounds), "root-groups")
    found = top.join(groups.select(F.col("node").alias("m"), "component"), "m", "left")
    return found.select(F.col("u").cast(kind).alias("node"), F.coalesce("component", "m").cast(kind).alias("component"))


def starred(first: DataFrame, state: dict, max_rounds: int) -> DataFrame:
    """connected_components of edges (u, v), u the larger, that counted gave."""
    stars, known = first, None
    for _ in range(max_rounds):
        if not state["n"] or state == known:
            break
        known, before = state, stars
        both = stars.union(stars.select("v", "u")).where("u <> v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # large holds each edge as (larger, smaller) already
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(down.select("u", F.col("m").alias("v"))).distinct()
        stars, state = counted(small, "stars")
        if before is not first:
            discard(before)
    else:
        raise RuntimeError("the components did not settle")
    nodes = first.select("u").union(first.select("v")).distinct()
    ends = stars.where("u <> v").select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.select(F.col("u").alias("node")).join(ends, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
