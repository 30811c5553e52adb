"""Pairs of texts whose shingle sets have a Jaccard similarity of at least a bound.

Candidates share a band: six of 192 min-hashes. A pair at 0.8 shares one of the
32 bands but for a chance of 6 in 100,000, a pair at 0.9 but for one below 1 in
10^10. A pair counts only by its exact Jaccard similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointspark.operators.graph import connected_components
from pointspark.session import materialize

BANDS = 32
ROWS = 6
#: Members of a bucket up to which all its pairs are compared at once; of larger ones, those that AHEAD leaves apart.
SMALL = 8
AHEAD = 2
#: Shingles ahead of a shared one in which a pair is looked for, so that it is made once and not for every shingle that it shares.
BEFORE = 8
#: A shingle of more sets than this, and of more than one in MOST_MANY of all shingles, is common; there are at most MOST_MANY of them.
MANY = 1000
MOST_MANY = 1000

_rng = np.random.default_rng(42)
_FLIP = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
_TIMES = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _rng.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _rng.integers(0, 1 << 63, BANDS, np.uint64)
_WORD = np.uint64(0x9E3779B97F4A7C15)
#: Shingles that are hashed at once, so that what they become stays in the cache.
STEP = 256


def shingles(text: str | None, n: int) -> tuple[int, np.ndarray]:
    """A hash of the words of text (0 without words) and its distinct shingles' hashes (uint64), sorted.

    A-Z in lower case, words by ASCII whitespace; a text of fewer words is one shingle.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0, np.zeros(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = min(n, len(words))
    h = np.full(len(words) - n + 1, n, np.uint64)
    for j in range(n):
        h = (h ^ each[j : j + len(h)]) * _WORD
        h ^= h >> np.uint64(29)
    return xxhash.xxh64_intdigest(b" ".join(words), 7), np.unique(h)


def bands(h: np.ndarray) -> np.ndarray:
    """The keys (uint64) of the buckets of a set of hashes, one a band; none for an empty set."""
    if not len(h):
        return np.zeros(0, np.uint64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    room = np.empty((min(STEP, len(h)), BANDS * ROWS), np.uint64)
    for i in range(0, len(h), STEP):
        part = h[i : i + STEP, None]
        found = np.bitwise_xor(part, _FLIP, out=room[: len(part)])
        np.minimum(least, np.multiply(found, _TIMES, out=found).min(axis=0), out=least)
    key = ((least.reshape(BANDS, ROWS) >> np.uint64(7)) * _MIX).sum(axis=1, dtype=np.uint64) ^ _BAND
    return key ^ (key >> np.uint64(32))


def sketched(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, fp, text_hash, bands) for every row of docs (doc_id, text, text_hash)."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(f, bands(h).view(np.int64)) for f, h in (shingles(t, shingle) for i in range(0, b.num_rows, 500) for t in b.column(1).slice(i, 500).to_pylist())]
            fp = np.array([f for f, _ in found], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), b.column(2), pa.array([k for _, k in found], pa.list_(pa.int64()))], ["doc_id", "fp", "text_hash", "bands"])

    return docs.mapInArrow(hashed, "doc_id long, fp long, text_hash long, bands array<long>")


def shingle_sets(docs: DataFrame, own: DataFrame, fps: DataFrame, shingle: int) -> DataFrame:
    """(fp, shingles) for each of fps, from one of the rows of docs that have it by own (sketched)."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # few at a time, as shingles take more room than their text
            for i in range(0, b.num_rows, 200):
                part = b.slice(i, 200)
                sets = [shingles(t, shingle)[1].view(np.int64) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["fp", "shingles"])

    one = own.join(fps, "fp", "left_semi").groupBy("fp").agg(F.min(F.struct("doc_id", "text_hash")).alias("r")).select("fp", F.col("r.doc_id").alias("i"), F.col("r.text_hash").alias("h"))
    found = docs.join(one, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_hash") == F.col("h")))
    return found.select("fp", "text").dropDuplicates(["fp"]).mapInArrow(hashed, "fp long, shingles array<long>")


def bucket_pairs(k: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, a, b) of sorted buckets: all pairs of small ones; of a large one each member with the AHEAD next, and its members as pairs of one."""
    start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    size = np.repeat(np.diff(np.concatenate([start, [len(k)]])), np.diff(np.concatenate([start, [len(k)]])))
    at = [np.zeros((2, 0), np.int64)]
    for d in range(1, SMALL):
        i = np.flatnonzero((k[d:] == k[:-d]) & ((size[d:] <= SMALL) | (d <= AHEAD)))
        at.append(np.stack([i, i + d]))
    large = np.flatnonzero(size > SMALL)
    i, j = np.concatenate([*at, np.stack([large, large])], axis=1)
    return k[i], np.minimum(fp[i], fp[j]), np.maximum(fp[i], fp[j])


def candidates(prints: DataFrame) -> DataFrame:
    """bucket_pairs of the distinct texts in prints (fp, bands)."""
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = prints.select("fp", F.explode("bands").alias("k"))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out(k: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            found = bucket_pairs(k, fp)
            for i in range(0, len(found[0]), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 50_000]) for c in found], ["k", "a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            k, fp = (np.concatenate([r, b.column(c).to_numpy(zero_copy_only=False)]) for r, c in zip(rest, ("k", "fp"), strict=True))
            # the last bucket may go on in the next batch
            cut = int(np.flatnonzero(k != k[-1]).max(initial=-1)) + 1
            rest = k[cut:], fp[cut:]
            yield from out(k[:cut], fp[:cut])
        yield from out(*rest)

    # members of a bucket in an order of its own, so that each bucket compares others
    spread = rows.repartition(n, "k").withColumn("o", F.xxhash64("k", "fp")).sortWithinPartitions("k", "o")
    return spread.select("k", "fp").mapInArrow(pairs, "k long, a long, b long")


def alike_pairs(pairs: DataFrame, sets: DataFrame, alike: float) -> DataFrame:
    """The pairs (a, b) whose sets (fp, shingles) have a Jaccard similarity of alike or more."""
    both = pairs.join(sets.select(F.col("fp").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("fp").alias("b"), F.col("shingles").alias("y")), "b")
    nx, ny, shared = F.size("x"), F.size("y"), F.size(F.array_intersect("x", "y"))
    near = both.where(F.least(nx, ny) / F.greatest(nx, ny) >= alike)
    return near.where(shared / (nx + ny - shared) >= alike).select("a", "b")


def prefix_pairs(sets: DataFrame, alike: float, once: bool = True) -> DataFrame:
    """Pairs (a, b) of sets (fp, g, shingles) of different g, with all that are alike or more.

    Shingles are put in order, the rarest first. Of sets of n <= m members that
    are alike, at least alike / (1 + alike) * (n + m) are shared, so the first
    shared one is among the first few of both, and enough follow in both. A
    pair that also shares one of the BEFORE shingles that stand ahead of a
    shared one was found there, and is not made again.
    """
    least = lambda share: F.col("n") - F.ceil(share * F.col("n") - 1e-6) + 1
    # dealt evenly, as a set becomes as many rows as it has shingles, and written, as they are read three times
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = materialize(sets.repartition(parts).select("fp", "g", F.size("shingles").alias("n"), F.explode("shingles").alias("s")), "set-shingles")
    # shingles of many sets are few; they come last, in an order of their own, and the others are counted where they meet
    many = max(MANY, each.count() // MOST_MANY)
    common = F.col("s").isin([r.s for r in each.groupBy("s").agg(F.count("*").alias("c")).where(F.col("c") > many).collect()])
    rare = each.where(~common).withColumn("c", F.count("*").over(Window.partitionBy("s")))
    rare = rare.unionByName(each.where(common).withColumn("c", F.lit(many + 1).cast("long")))
    ordered = rare.groupBy("fp", "g", "n").agg(F.sort_array(F.collect_list(F.struct("c", "s"))).alias("x"))
    prefix = F.filter(F.transform(F.slice("x", 1, least(alike).cast("int")), lambda x, p: F.struct(p.alias("p"), x["s"].alias("s"), x["c"].alias("c"))), lambda x: x["c"] > 1)
    listed = ordered.select("fp", "g", "n", prefix.alias("x"))
    ahead = F.transform("x", lambda x, i: F.struct(x["p"].alias("p"), x["s"].alias("s"), F.slice(F.col("x")["s"], F.greatest(i - BEFORE + 1, F.lit(1)), F.least(i, F.lit(BEFORE))).alias("before")))
    first = materialize(listed.select("fp", "g", "n", F.explode(ahead).alias("x")).select("fp", "g", "n", "x.p", "x.s", "x.before"), "prefixes")
    x = first.where(F.col("p") < least(2 * alike / (1 + alike)))
    y = first.select("s", *[F.col(c).alias(f"{c}2") for c in ("fp", "g", "n", "p", "before")])
    shared = F.least(F.col("n") - F.col("p"), F.col("n2") - F.col("p2")) >= alike / (1 + alike) * (F.col("n") + F.col("n2")) - 1e-6
    meets = F.expr("g <> g2 and (n < n2 or n = n2 and fp < fp2)") & shared & (F.col("n") >= alike * F.col("n2") - 1e-6)
    found = x.join(y, "s").where(meets & ~F.arrays_overlap("before", "before2")).select(F.least("fp", "fp2").alias("a"), F.greatest("fp", "fp2").alias("b"))
    return found.distinct() if once else found


def links(docs: DataFrame, own: DataFrame, shingle: int, alike: float) -> DataFrame:
    """Edges (a, b) that connect the distinct fp in own (docs sketched) as all pairs of a bucket do that are alike or more.

    The members of large buckets that are not all connected by some of their
    pairs are compared by prefixes.
    """
    found = materialize(candidates(own.select("fp", "bands").dropDuplicates(["fp"])), "candidates")
    pairs, members = found.where("a <> b").select("a", "b").distinct(), found.where("a = b").select("k", F.col("a").alias("fp"))
    met = found.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    sets = materialize(shingle_sets(docs, own, met, shingle), "shingles")
    first = materialize(alike_pairs(pairs, sets, alike), "links")
    if not members.limit(1).count():
        return first
    groups = connected_components(first)
    placed = members.join(groups, members["fp"] == groups["node"], "left").select("k", "fp", F.coalesce("component", "fp").alias("g"))
    apart = placed.groupBy("k").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo < hi")
    left = placed.join(apart, "k", "left_semi").select("fp", "g").distinct()
    rest = prefix_pairs(sets.join(left, "fp"), alike).join(pairs, ["a", "b"], "left_anti")
    return first.unionByName(alike_pairs(rest, sets, alike))
