"""Exact top-k search by inner product, with sorted lists and score bounds.

The candidates of a block are sorted by each component. A query reads each list
from the end that its own component favours, deeper and deeper. At a depth a
candidate's score is bounded from above by its read components and, for the
unread, by the value where reading stands; and from below by the far ends of the
lists. The k-th best known score, or lower bound while there are fewer, rules
out candidates whose upper bound is lower, also in later blocks: a block whose
first entries already bound it too low is not read. Reading stops when few more
than k can qualify, whose scores are then resolved, or where the lists end. From
one block to the next it starts a step before the depth where it last stopped.

Both bounds are sums over components of one factor of the query and one of the
candidate, so they are computed for many queries at once as matrix products.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCALE = 64
K = 20
QUERY_EVERY = 20
#: Vectors in a block, expected; a task holds one block of each kind.
QUERY_BLOCK = 4096
CANDIDATE_BLOCK = 4096
#: Candidates whose lists are read together, and queries that read them together.
LISTS = 4096
READERS = 512
#: Parts of the lists after which bounds are taken, one after the other; after the last, the lists are read to their ends.
DEPTHS = (0.0625, 0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875)
#: Reading stops when no more than so many times k candidates a query are left.
FEW = 2


def read_parts(x: np.ndarray, lists: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The candidates' sides of the lower and upper bounds after depth entries of every list.

    lists has x's columns sorted upwards; depth is below their length. The left
    half of the columns is read from above, the right half from below.
    """
    n = len(x)
    high, low = lists[n - depth], lists[depth - 1]  # where reading stands
    # an unread entry counts with the list's far end, or with the value where reading stands
    lower = np.concatenate([np.where(x >= high, x, lists[0]), np.where(x <= low, x, lists[-1])], axis=1)
    upper = np.concatenate([np.maximum(x, high), np.minimum(x, low)], axis=1)
    return lower, upper


def bounds(q: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Bounds (queries x candidates): a query reads each list from the end that its component favours."""
    return np.concatenate([np.maximum(q, 0), np.minimum(q, 0)], axis=1) @ parts.T


def best_of(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, depths=DEPTHS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query index, candidate index, score, depth) of each query's k best candidates, ties to the smaller id; ids ascend.

    depth is the part of its lists that was read when the candidate's score was
    resolved.
    """
    lowest = -np.inf
    pool_score = np.full((len(q), k), lowest, np.float64 if x.dtype != object else object)
    pool_at = np.full((len(q), k), -1, np.int64)
    pool_depth = np.zeros((len(q), k))
    last = 0
    for begin in range(0, len(x), LISTS):
        part, part_ids = x[begin : begin + LISTS], ids[begin : begin + LISTS]
        n, lists = len(part), np.sort(part, axis=0)
        steps = sorted({d for p in depths if 0 < (d := int(n * p)) < n})
        read: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        ends = np.concatenate([lists[-1], lists[0]])[None, :]
        for i in range(0, len(q), READERS):
            rows = i + np.flatnonzero(bounds(q[i : i + READERS], ends)[:, 0] >= pool_score[i : i + READERS, -1])
            if not len(rows):
                continue
            own, floor = q[rows], pool_score[rows, -1].copy()
            alive = part_ids[None, :] != q_ids[rows, None]
            step = max(0, last - 1)
            while step < len(steps):
                d = steps[step]
                if d not in read:
                    read[d] = read_parts(part, lists, d)
                lower, upper = read[d]
                if n > k and (floor == lowest).any():
                    low = bounds(own, lower)
                    low[~alive] = lowest
                    floor = np.maximum(floor, np.partition(low, n - k, axis=1)[:, n - k])
                alive &= bounds(own, upper) >= floor[:, None]
                if alive.sum() <= FEW * k * len(alive):
                    break
                step += 1
            last = step
            if step < len(steps):
                a, b = np.nonzero(alive)
                scores = np.empty(len(a), x.dtype)
                for j in range(0, len(a), 1 << 15):
                    s = slice(j, j + (1 << 15))
                    scores[s] = np.einsum("ij,ij->i", own[a[s]], part[b[s]]) if x.dtype != object else (own[a[s]] * part[b[s]]).sum(axis=1)
                fit = scores >= floor[a]
                a, b, scores = a[fit], b[fit], scores[fit]
            else:  # all lists are read: what is known is final
                whole = own @ part.T
                if n > k:
                    known = np.where(alive, whole, lowest)
                    floor = np.maximum(floor, np.partition(known, n - k, axis=1)[:, n - k])
                a, b = np.nonzero(alive & (whole >= floor[:, None]))
                scores = whole[a, b]
            if not len(a):
                continue
            # queries with something new; what was known comes first, so that equal scores stay in the order of ids
            new, of = np.unique(a, return_inverse=True)
            line = np.concatenate([np.repeat(np.arange(len(new)), k), of])
            score = np.concatenate([pool_score[rows[new]].ravel(), scores])
            at = np.concatenate([pool_at[rows[new]].ravel(), begin + b])
            depth = np.concatenate([pool_depth[rows[new]].ravel(), np.full(len(a), steps[step] / n if step < len(steps) else 1.0)])
            order = np.lexsort((at, -score, line))
            line = line[order]
            keep = order[np.arange(len(line)) - np.searchsorted(line, line) < k]
            for pool, values in ((pool_score, score), (pool_at, at), (pool_depth, depth)):
                pool[rows[new]] = values[keep].reshape(-1, k)
    a, b = np.nonzero(pool_at >= 0)
    return a, pool_at[a, b], pool_score[a, b], pool_depth[a, b]


def number_type(dim: int, largest: float) -> type:
    """A float type in which all inner products are exact; object (whole numbers of any size) if there is none."""
    most = dim * largest * largest * 2
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else object


def matrix(rows: list, dim: int, kind: type) -> np.ndarray:
    """rows as a matrix of whole numbers, shorter ones followed by zeros."""
    out = np.zeros((len(rows), dim), kind)
    for i, r in enumerate(rows):
        v = np.floor(np.asarray(r, np.float64) * SCALE)
        out[i, : len(v)] = [int(c) for c in v] if kind is object else v
    return out


def search(vectors: DataFrame, queries: DataFrame, k: int = K, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score, depth): for each row of queries its k best rows of vectors, both (vec_id, embedding).

    Components become floor(64 * x). Scores are whole inner products; ties go to
    the smaller vec_id; a candidate with the query's own id is left out. Rows
    with a null id, a null vector, or null or non-finite components take no
    part. A shorter vector counts as followed by zeros. Rows that share an id
    count as one, with their best score. Scores beyond 64 bits are cut to the
    largest or smallest long. depth is the part of its block's lists that was
    read when a score was resolved. Empty tables give no rows.

    Queries and candidates are dealt into blocks by hash, every pair of blocks
    meets once, and each gives k rows a query, which are ranked at the end.
    """

    def whole(df: DataFrame) -> DataFrame:
        v = F.col("embedding")
        bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
        return df.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & v.isNotNull() & ~bad)

    q, x = whole(queries), whole(vectors)
    n_q = max(1, math.ceil(queries.count() / query_block))
    n_x = max(1, math.ceil(vectors.count() / candidate_block))
    dealt = lambda df, n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = q.select("vec_id", "v", dealt(q, n_q).alias("qb"), every(n_x).alias("xb"))
    right = x.select("vec_id", "v", dealt(x, n_x).alias("xb"), every(n_q).alias("qb"))

    def pair(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64), "depth": np.zeros(0)})
        if not len(a) or not len(b):
            return empty
        rows = [*a["v"], *b["v"]]
        dim = max(map(len, rows))
        largest = max((float(np.abs(np.floor(np.asarray(r, np.float64) * SCALE)).max(initial=0)) for r in rows), default=0.0)
        kind = number_type(max(dim, 1), largest)
        qm, xm = matrix(list(a["v"]), max(dim, 1), kind), matrix(list(b["v"]), max(dim, 1), kind)
        q_ids, ids = a["vec_id"].to_numpy(), b["vec_id"].to_numpy()
        # the same candidate twice would take two of the k places
        order = np.argsort(ids, kind="stable")
        most = int(np.unique(ids, return_counts=True)[1].max())
        xm, ids = xm[order], ids[order]
        qa, xb, score, depth = best_of(qm, q_ids, xm, ids, k * most)
        score = score.astype(np.int64) if kind is not object else np.array([min(max(int(v), -(1 << 63)), (1 << 63) - 1) for v in score], np.int64)
        return pd.DataFrame({"query_id": q_ids[qa], "vec_id": ids[xb], "score": score, "depth": depth})

    found = left.groupBy("qb", "xb").cogroup(right.groupBy("qb", "xb")).applyInPandas(pair, "query_id long, vec_id long, score long, depth double")
    best = found.groupBy("query_id", "vec_id").agg(F.max(F.struct("score", "depth")).alias("b")).select("query_id", "vec_id", "b.score", "b.depth")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "depth")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(vectors, vectors.where(F.col("vec_id") % QUERY_EVERY == 0)).drop("depth")


QUERIES = {"op6_topk": op6_topk}
SQL = {
    "op6_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, x.vec_id, CAST(list_sum(list_transform(list_zip(q.v, x.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
}
