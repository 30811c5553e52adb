"""Documents whose sets of word n-grams have a Jaccard similarity of at least a bound, by PartEnum signatures.

Sets are put into bands by size. In a band two sets that are alike differ in at
most k features, k following from the largest sizes. The features are dealt to
n1 parts, each part to n2 smaller ones; with enough parts, two such sets differ
in at most k2 features of some part, and then agree on n2 - k2 of its smaller
parts whole. So a set is given a signature for every such choice in every part,
and sets that are alike share one. A set whose size could meet the band below
has the signatures of that band too.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import ceil, floor, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointspark.llm import minhash
from pointspark.operators.graph import connected_components
from pointspark.session import materialize

SHINGLE = 4
#: Per cent.
ALIKE = 85
#: Differences up to which parts are enumerated by pairs out of three; sets that may differ in more have features enough for whole parts.
ENUMERATED = 12
#: Members of a bucket of which all pairs are candidates; of a larger one each with the next, and the rest as needed.
SMALL = 6
SALTS = 16

_MIX = np.uint64(0x9E3779B97F4A7C15)
_TURN = np.uint64(0xC2B2AE3D27D4EB4F)


@lru_cache(maxsize=4096)
def bands(size: int, alike: int = ALIKE) -> tuple[tuple[int, int], ...]:
    """(band, its largest size) for the bands in which a set of size has signatures: its own, and the one below where a set there could be alike.

    Each band reaches up to 1 / alike times its smallest size, so a set that is
    alike is in the same or the next one.
    """
    out, low, band = [], 1, 0
    while True:
        high = max(low, low * 100 // alike)
        if low <= size <= high or (size > high and high * 100 >= alike * size):
            out.append((band, high))
        if size <= high:
            return tuple(out)
        low, band = high + 1, band + 1


@lru_cache(maxsize=4096)
def scheme(high: int, alike: int = ALIKE) -> tuple[int, int, int, tuple[tuple[int, ...], ...]]:
    """(n1, n2, spare, choices) of a band up to size high: parts, smaller parts in each, parts more than are needed, and the smaller parts of each signature.

    spare + 1 parts at least have few enough differences. A signature over no
    feature says nothing; sets in which more than spare parts have one are rare.
    """
    # alike sets of sizes x <= y share alike / (100 + alike) of x + y, and y is at most 100 / alike of x
    larger = high * 100 // alike
    k = floor((100 - alike) * (high + larger) / (100 + alike) + 1e-9)
    k2, n2 = (1, 3) if 0 < k <= ENUMERATED else (0, 1)
    need = ceil((k + 1) / (k2 + 1))
    # features come to a part at random: as many parts without any as chance makes likely
    empty = need * n2 * (1 - (n2 - k2) / (need * n2)) ** (high * alike / 100) if need * n2 > n2 - k2 else 0.0
    spare = ceil(empty + 3 * sqrt(empty)) if empty > 0.01 else 0
    return need + spare, n2, spare, tuple(combinations(range(n2), n2 - k2))


def signatures(h: np.ndarray, alike: int = ALIKE) -> np.ndarray:
    """The signatures (uint64) of a set of hashes; sets with a Jaccard similarity of alike per cent share one."""
    out = []
    if not len(h):
        return np.zeros(0, np.uint64)
    for band, high in bands(len(h), alike):
        n1, n2, spare, choices = scheme(high, alike)
        mixed = (h ^ np.uint64(band + 1)) * _MIX
        mixed ^= mixed >> np.uint64(31)
        parts = n1 * n2
        cell = ((mixed >> np.uint64(40)) * np.uint64(parts) >> np.uint64(24)).astype(np.int64)
        value = mixed * _TURN
        value ^= value >> np.uint64(29)
        order = np.argsort(cell, kind="stable")
        held = np.bincount(cell, minlength=parts)
        sums = np.zeros(parts, np.uint64)
        start = np.cumsum(held) - held
        some = held > 0
        sums[some] = np.add.reduceat(value[order], start[some])
        sums, held = sums.reshape(n1, n2), held.reshape(n1, n2)
        empty = np.zeros(n1, bool)
        found, void = [], []
        for c, choice in enumerate(choices):
            x, filled = np.full(n1, band * 64 + c, np.uint64) * _TURN, np.zeros(n1, np.int64)
            for j in choice:
                x = (x ^ sums[:, j]) * _MIX
                x ^= x >> np.uint64(32)
                filled += held[:, j]
            x = (x ^ np.arange(n1, dtype=np.uint64)) * _TURN
            found.append(x ^ (x >> np.uint64(30)))
            void.append(filled == 0)
            empty |= filled == 0
        x, void = np.concatenate(found), np.concatenate(void)
        # enough parts that both must have something in, or else what has nothing counts as well
        out.append(x if empty.sum() > spare else x[~void])
    return np.unique(np.concatenate(out))


def shingled(docs: DataFrame, shingle: int, alike: int) -> DataFrame:
    """(doc_id, text_hash, key, n_shingles, row, signatures) for every row of docs (doc_id, text, text_hash).

    key (128 bits) is equal for equal sets, row is a number of the row's own.
    """
    names = ["doc_id", "text_hash", "key", "n_shingles", "row", "signatures"]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                sets = [minhash.shingles(t, shingle)[1] for t in part.column(1).to_pylist()]
                signed = [signatures(s, alike).view(np.int64) for s in sets]
                rows = pa.array(np.arange(row, row + len(sets)))
                row += len(sets)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(map(key, sets), pa.binary()), pa.array([len(s) for s in sets], pa.int64()), rows, pa.array(signed, pa.list_(pa.int64()))], names)

    return docs.mapInArrow(hashed, "doc_id long, text_hash long, key binary, n_shingles long, row long, signatures array<long>")


def key(h: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(h.tobytes())


def candidates(rows: DataFrame) -> DataFrame:
    """(s, a, b) for the members of buckets, rows (s, sid): candidate pairs a < b; the members of large buckets as pairs of one, a = b.

    Of a small bucket all pairs are candidates; of a large one each member with
    the next. Members are in the order of sid in every bucket, so those that
    share many buckets are the same pairs in most of them.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of a bucket that goes on in the next batch: whether it is large already, and its last members
        held, large = (np.zeros(0, np.int64), np.zeros(0, np.int64)), False

        def out(s: np.ndarray, sid: np.ndarray, old: int, large: bool) -> Iterator[pa.RecordBatch]:
            """Pairs of sorted buckets; the first old members, of the first bucket, were given before if that is large."""
            new = np.diff(s, prepend=s[:1] - 1) != 0
            start = np.flatnonzero(new)
            size = np.diff(start, append=len(s))
            if large:
                size[0] = max(size[0], SMALL + 1)
            each = np.repeat(size, np.diff(start, append=len(s)))
            at = []
            for d in range(1, SMALL):
                i = np.flatnonzero((s[d:] == s[:-d]) & ((each[d:] <= SMALL) | (d == 1)))
                at.append(np.stack([i, i + d]))
            single = np.flatnonzero(each > SMALL)
            i, j = np.concatenate([*at, np.stack([single, single])], axis=1)
            if old:
                i, j = i[j >= old], j[j >= old]
            for c in range(0, len(i), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(s[i[c : c + 50_000]]), pa.array(sid[i[c : c + 50_000]]), pa.array(sid[j[c : c + 50_000]])], ["s", "a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            old = len(held[0]) if large else 0
            s, sid = (np.concatenate([h, b.column(c).to_numpy()]) for h, c in zip(held, ("s", "sid"), strict=True))
            cut = int(np.flatnonzero(s != s[-1]).max(initial=-1)) + 1
            if cut:
                yield from out(s[:cut], sid[:cut], old, large)
                large, old = False, 0
            s, sid = s[cut:], sid[cut:]
            if large or len(s) > SMALL:  # a bucket of any size takes no more room than a batch
                yield from out(s, sid, old, True)
                s, sid, large = s[-1:], sid[-1:], True
            held = s, sid
        if len(held[0]):
            yield from out(*held, len(held[0]) if large else 0, large)

    return rows.repartition(n, "s").sortWithinPartitions("s", "sid").mapInArrow(pairs, "s long, a long, b long")


def sets_of(docs: DataFrame, chosen: DataFrame, shingle: int) -> DataFrame:
    """(sid, shingles) for each of chosen (sid, key, i, h), from a row of docs whose doc_id is i and text_hash h."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # few at a time, as shingles take more room than their text
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                sets = [minhash.shingles(t, shingle)[1] for t in part.column(2).to_pylist()]
                same = pa.array([key(x) == k for x, k in zip(sets, part.column(1).to_pylist(), strict=True)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], ["sid", "shingles"]).filter(same)

    found = docs.join(chosen, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_hash") == F.col("h")))
    return found.select("sid", "key", "text").dropDuplicates(["sid", "text"]).mapInArrow(hashed, "sid long, shingles array<long>").dropDuplicates(["sid"])


def alike_pairs(pairs: DataFrame, sets: DataFrame, alike: int) -> DataFrame:
    """The pairs (a, b) whose sets (sid, shingles) have a Jaccard similarity of alike per cent or more."""
    x, y = (sets.select(F.col("sid").alias(c), F.col("shingles").alias(v)) for c, v in (("a", "x"), ("b", "y")))
    both = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y", F.size("x").alias("nx"), F.size("y").alias("ny"))
    near = both.where(100 * F.least("nx", "ny") >= alike * F.greatest("nx", "ny")).withColumn("shared", F.size(F.array_intersect("x", "y")))
    return near.where(F.expr(f"100L * shared >= {alike}L * (nx + ny - shared)")).select("a", "b")


def links(docs: DataFrame, own: DataFrame, sets: DataFrame, shingle: int, alike: int) -> DataFrame:
    """Edges (a, b) that connect the sids in sets as all pairs that are alike do.

    Candidates share a signature. Each set is compared with the one before it
    with which it shares most first; pairs that these links do not connect
    follow. Members of large buckets that are then still apart are found by
    their rarest features, as minhash does; each pair counts by its sets alone.
    """
    gone = materialize(own.join(sets, "key").where("row <> sid").select("row"), "repeated-sets")
    rows = own.join(gone, "row", "left_anti").where("n_shingles > 0").select(F.col("row").alias("sid"), F.explode("signatures").alias("s"))
    met = materialize(candidates(rows), "signature-pairs")
    pairs = materialize(met.where("a <> b").groupBy("a", "b").agg(F.count("*").alias("n")), "candidates")
    if not pairs.limit(1).count():
        return pairs.select("a", "b")
    some = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    features = materialize(sets_of(docs, sets.join(some, "sid", "left_semi").select("sid", "key", F.col("r.doc_id").alias("i"), F.col("r.text_hash").alias("h")), shingle), "features")
    best = pairs.groupBy("b").agg(F.max(F.struct("n", F.col("a").alias("a"))).alias("x")).select(F.col("x.a").alias("a"), "b")
    edges = materialize(alike_pairs(best, features, alike), "links")

    def grouped(nodes: DataFrame, column: str, edges: DataFrame, name: str) -> DataFrame:
        groups = connected_components(edges).select(F.col("node").alias(column), F.col("component").alias(name))
        return nodes.join(groups, column, "left").withColumn(name, F.coalesce(name, column))

    groups = materialize(grouped(some, "sid", edges, "g"), "groups")
    ga, gb = (groups.select(F.col("sid").alias(c), F.col("g").alias(f"g{c}")) for c in "ab")
    rest = pairs.join(best, ["a", "b"], "left_anti").join(ga, "a").join(gb, "b").where("ga <> gb").select("a", "b")
    edges = materialize(edges.unionByName(alike_pairs(rest, features, alike)), "more-links")
    members = met.where("a = b").select("s", F.col("a").alias("sid"))
    if not members.limit(1).count():
        return edges
    placed = grouped(members, "sid", edges, "g")
    apart = placed.groupBy("s").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo < hi")
    left = materialize(placed.join(apart, "s", "left_semi").select(F.col("sid").alias("fp"), "g").distinct(), "apart")
    if not left.limit(1).count():
        return edges
    more = minhash.prefix_pairs(features.withColumnRenamed("sid", "fp").join(left, "fp"), alike / 100)
    return edges.unionByName(alike_pairs(more.join(pairs, ["a", "b"], "left_anti"), features, alike))


def ngram_components(docs: DataFrame, shingle: int = SHINGLE, alike: int = ALIKE) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs (doc_id, text).

    Texts are lower-cased (A-Z) and split at ASCII whitespace; a text's set
    holds its distinct runs of shingle words, one of all words where it has
    fewer. Rows link where 100 times the intersection is at least alike times
    the union. component_id is the smallest doc_id that links reach. Null texts
    and texts without words have empty sets and link with nothing: their
    component_id is their own doc_id. Repeated rows come out each. A null doc_id
    is carried; a component of null ids alone has a null component_id. Other
    columns are ignored; an empty table gives no rows. Texts are read whole; a
    worker holds the sets of 500 texts at a time.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    signed = materialize(shingled(slim, shingle, alike), "signatures")
    own = signed.drop("signatures")
    sets = own.where("n_shingles > 0").groupBy("key").agg(F.min("row").alias("sid"), F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.min(F.struct("doc_id", "text_hash")).alias("r"))
    sets = materialize(sets, "sets")
    groups = connected_components(links(slim, signed, sets, shingle, alike))
    linked = sets.join(groups, sets["sid"] == groups["node"]).select("key", "least", "component")
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = linked.join(least, "component").select("key", "component_id")
    whole = sets.join(linked, "key", "left").select("key", "sid", "copies", F.coalesce("component_id", "least").alias("component_id"))
    # copies of one set may be a third of all rows: their key is met in SALTS places, one that occurs once in its only one
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(SALTS)).cast("int")
    places = F.when(F.col("copies") == 1, F.array(salt("sid"))).otherwise(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    whole = whole.select("key", "component_id", F.explode(places).alias("salt"))
    joined = own.where("n_shingles > 0").withColumn("salt", salt("row")).join(whole, ["key", "salt"]).select("doc_id", "n_shingles", "component_id")
    return joined.unionByName(own.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op13_ngram_join": op13_ngram_join}
SQL: dict[str, str] = {}
