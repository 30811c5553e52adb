"""Near-duplicate documents by SimHash and covering locality-sensitive hashing.

Fingerprints within a radius of each other are found without missing any: every
bit position gets a non-zero vector of radius + 1 bits, and every non-zero such
vector is a mask that keeps the positions whose vectors have an odd product
with it. The positions in which a pair differs span at most radius dimensions,
so some mask drops them all, and under that mask the two agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointspark.llm import minhash
from pointspark.llm.names import free_names
from pointspark.operators.graph import connected_components
from pointspark.session import materialize

BITS = 64
RADIUS = 3
SHINGLE = 3
#: Members of a bucket beyond which it is divided by further masks over the bits that it leaves open.
BUCKET = 1024

#: Parts into which the rows of a repeated fingerprint are dealt.
SALTS = 16

LANES = np.uint64(0x0101010101010101)


def fingerprints(texts: list[str | None], shingle: int) -> np.ndarray:
    """A 64-bit fingerprint (uint64) for each text.

    A-Z in lower case, words by ASCII whitespace, shingles with repeats; a text
    of fewer words is one shingle; one without words has fingerprint zero.
    """
    out = np.zeros(len(texts), np.uint64)
    digest = xxhash.xxh64_intdigest
    for r, text in enumerate(texts):
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            continue
        n = len(words)
        if n <= shingle:
            h = np.array([digest(b" ".join(words), 42)], np.uint64)
        else:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter((len(w) + 1 for w in words), np.int64, n)) - 1
            starts = np.concatenate([[0], ends[:-1] + 1])
            spans = zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
            h = np.fromiter((digest(joined[a:b], 42) for a, b in spans), np.uint64, n - shingle + 1)
        out[r] = majority(h)
    return out


def majority(h: np.ndarray) -> np.uint64:
    """The bits set in over half of h, by byte lanes: eight counters in a word, emptied before they run over."""
    counts = np.zeros(BITS, np.int64)
    runs = np.arange(0, len(h), 255)
    for k in range(8):
        lanes = np.add.reduceat((h >> np.uint64(k)) & LANES, runs)
        counts[k::8] = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    bits = np.flatnonzero(2 * counts > len(h))
    return np.bitwise_or.reduce(np.uint64(1) << bits.astype(np.uint64)) if len(bits) else np.uint64(0)


def cover(positions: list[int], radius: int) -> list[int]:
    """Masks over the given bit positions, one of which is blind to any radius of them.

    Position i gets the i-th vector of radius + 1 bits, those with few bits
    first: radius + 1 positions then span all dimensions, and no mask is blind
    to every position. Fewer positions have the one mask that is.
    """
    if len(positions) <= radius:
        return [0]
    vectors = sorted(range(1, 1 << (radius + 1)), key=lambda v: (v.bit_count(), v))
    return [sum(1 << p for i, p in enumerate(positions) if (vectors[i % len(vectors)] & v).bit_count() & 1) for v in vectors]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def unsigned(x: int) -> int:
    return x & ((1 << 64) - 1)


def roots_in_buckets(bucket: np.ndarray, fp: np.ndarray, radius: int, width: int = 32) -> np.ndarray:
    """For sorted buckets, the index of the first member that each member reaches by links inside its bucket."""
    n = len(fp)
    root = np.arange(n)
    start = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    size = np.diff(np.concatenate([start, [n]]))
    # small buckets at once: neighbours at each distance
    few = np.repeat(size <= width, size)
    pairs = []
    for d in range(1, min(width, int(size.max(initial=1)))):
        i = np.flatnonzero((bucket[d:] == bucket[:-d]) & few[d:])
        i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= radius]
        pairs.append(np.stack([i, i + d]))
    if pairs:
        a, b = np.concatenate(pairs, axis=1)
        while len(a):
            least = np.minimum(root[a], root[b])
            if (root[a] == least).all() and (root[b] == least).all():
                break
            np.minimum.at(root, a, least)
            np.minimum.at(root, b, least)
            root = root[root]
    # larger ones by blocks of a matrix that is never kept
    for s, m in zip(start[size > width].tolist(), size[size > width].tolist(), strict=True):
        x, own = fp[s : s + m], np.arange(m)
        step = max(1, (1 << 20) // m)
        while True:
            new = own.copy()
            for i in range(0, m, step):
                near = np.bitwise_count(x[i : i + step, None] ^ x[None, :]) <= radius
                new[i : i + step] = np.where(near, own[None, :], m).min(axis=1)
            new = new[new]
            if (new == own).all():
                break
            own = new
        root[s : s + m] = own + s
    return root


def links(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints in prints (fp) as all links within radius do.

    Each mask of the cover is a table of buckets. A bucket of more than bucket
    members is divided by a cover of the bits that its mask leaves open, in
    which a pair of the bucket that is within radius must again agree under some
    mask; after that fourteen to sixteen bits are open, which bounds what one
    group can hold. From a group come the edges of a forest only.
    """
    first = cover(list(range(BITS)), radius)
    masks = F.array(*[F.lit(signed(m)) for m in first])
    table = F.transform(masks, lambda m, t: F.struct(t.alias("t"), F.col("fp").bitwiseAND(m).alias("k")))
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a fingerprint becomes as many rows as there are masks, which the size of its own row does not tell
    spread = prints.select("fp").repartition(n, F.xxhash64("fp"))
    rows = spread.select("fp", F.explode(table).alias("x")).select("fp", "x.t", "x.k")
    sizes = rows.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
    shared = rows.join(sizes, ["t", "k"])
    finer = F.array(*[F.array(*[F.lit(signed(m | x)) for x in cover([p for p in range(BITS) if not m >> p & 1], radius)]) for m in first])
    divided = F.transform(F.element_at(finer, F.col("t") + 1), lambda m, i: F.struct(((F.col("t") + 1) * 1024 + i).alias("t"), F.col("fp").bitwiseAND(m).alias("k")))
    whole = F.array(F.struct(F.col("t"), F.col("k")))
    dealt = shared.select("fp", F.explode(F.when(F.col("n") <= bucket, whole).otherwise(divided)).alias("x")).select("x.t", "x.k", "fp")

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: tuple | None = None

        def edges(t: np.ndarray, k: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            new = np.concatenate([[True], (t[1:] != t[:-1]) | (k[1:] != k[:-1])])
            root = roots_in_buckets(np.cumsum(new), fp.view(np.uint64), radius)
            at = np.flatnonzero(root != np.arange(len(fp)))
            return pa.RecordBatch.from_arrays([pa.array(fp[at]), pa.array(fp[root[at]])], ["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            t, k, fp = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            if rest:
                t, k, fp = (np.concatenate(x) for x in zip(rest, (t, k, fp), strict=True))
            # the last bucket may go on in the next batch
            cut = int(np.flatnonzero((t != t[-1]) | (k != k[-1])).max(initial=-1)) + 1
            rest = t[cut:], k[cut:], fp[cut:]
            if cut:
                yield edges(t[:cut], k[:cut], fp[:cut])
        if rest:
            yield edges(*rest)

    return dealt.repartition(n, "t", "k").sortWithinPartitions("t", "k", "fp").mapInArrow(forest, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fingerprint, component_id, text_hash) for every row of docs (doc_id, text).

    fingerprint has 16 hexadecimal digits; component_id is the smallest doc_id
    that links of at most radius differing bits reach. Null and empty texts
    have fingerprint zero and link like any other. Repeated rows come out each.
    A null doc_id is carried; a component of null ids alone has a null
    component_id. Texts are read whole, however long; a worker holds the hashes
    of one text at a time. An empty table gives no rows. Other columns are
    ignored.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.concatenate([fingerprints(b.column(1).slice(i, 500).to_pylist(), shingle) for i in range(0, b.num_rows, 500)] or [np.zeros(0, np.uint64)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64)), b.column(2)], ["doc_id", "fp", "text_hash"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    own = materialize(slim.mapInArrow(hashed, "doc_id long, fp long, text_hash long"), "fingerprints")
    return grouped(own, links(own.select("fp").distinct(), radius, bucket))


def grouped(own: DataFrame, edges: DataFrame) -> DataFrame:
    """near_duplicates of rows (doc_id, fp, text_hash) whose fp are linked by edges (a, b)."""
    own = own.select("doc_id", "fp", "text_hash")
    prints = own.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    groups = connected_components(edges)
    # fingerprints with a link, and the smallest id of their group; the others are alone
    linked = prints.join(groups, prints["fp"] == groups["node"]).select("fp", "least", "component")
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = linked.join(least, "component").select("fp", "component_id")
    whole = prints.join(linked, "fp", "left").select("fp", "least", "copies", F.coalesce("component_id", "least").alias("component_id"))
    # copies of one text may be a third of all rows: their fingerprint is met in SALTS places, one that occurs once in its only one
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(SALTS)).cast("int")
    places = F.when((F.col("copies") == 1) & F.col("least").isNotNull(), F.array(salt("least"))).otherwise(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    whole = whole.select("fp", "component_id", F.explode(places).alias("salt"))
    # rows without an id may all be copies: they are dealt by the part they stand in
    dealt = F.coalesce(F.when(F.col("doc_id").isNotNull(), salt("doc_id")), F.pmod(F.spark_partition_id(), F.lit(SALTS)).cast("int"))
    joined = own.withColumn("salt", dealt).join(whole, ["fp", "salt"])
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "text_hash")


def keep_one(docs: DataFrame, shingle: int = 5, alike: float = 0.8) -> DataFrame:
    """docs with one row of each near-duplicate group: the one of the smallest doc_id.

    Texts are linked where the Jaccard similarity of their sets of shingles is
    alike or more; texts without words are one group. Which row stays, see
    first_of_groups.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    own = materialize(minhash.sketched(slim, shingle), "sketches")
    return first_of_groups(docs, grouped(own, minhash.links(slim, own, shingle, alike)))


def keep_first(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """docs with one row of each group whose fingerprints links of at most radius differing bits join (near_duplicates); which one, see first_of_groups."""
    return first_of_groups(docs, near_duplicates(docs, shingle, radius))


def first_of_groups(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """docs with one row of each group in groups (doc_id, fingerprint, component_id, text_hash): the one of the smallest doc_id.

    Of rows that repeat that doc_id and text, the one stays whose columns hash
    lowest. Rows with a null doc_id stay only where their whole group has none,
    one of them. All columns are kept. Texts are read whole, however long.
    """
    text_hash, id_, hash_ = free_names(docs.columns, "text_hash", "dropped_id", "dropped_hash")
    found = materialize(groups, "near-duplicates")
    stay = found.where("doc_id <=> component_id").groupBy("fingerprint", "component_id").agg(F.min("text_hash").alias("text_hash"), F.count("*").alias("n"))
    # a group may hold its smallest id in several rows; the first fingerprint stands for it
    stay = stay.groupBy("component_id").agg(F.min_by(F.struct("text_hash"), F.struct("fingerprint", "text_hash")).alias("x"), F.sum("n").alias("n")).select(F.col("component_id").alias("_id"), F.col("x.text_hash").alias("_hash"), F.col("n").alias("_n"))
    stay = materialize(stay, "kept-ids")
    # fewer rows go than stay, so those are named; one that has no id is met by its text alone, wherever it is
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    gone = found.join(stay, same, "left_anti").select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_)).distinct()
    gone = materialize(gone, "dropped-ids")
    marked = docs.withColumn(text_hash, F.xxhash64("text"))
    lost = marked.join(gone, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(text_hash) == F.col(hash_)), "left_anti")
    if not stay.where("_n > 1").limit(1).count():
        return lost.select(*docs.columns)
    # repeated rows: slim ones tell which stays, so that texts are not sorted
    whole, row = free_names([*lost.columns, id_, hash_], "row_hash", "kept_row")
    hashed = lost.withColumn(whole, F.xxhash64(*docs.columns))
    slim = hashed.select(F.col("doc_id").alias(id_), F.col(text_hash).alias(hash_), F.col(whole).alias(row))
    twice = materialize(slim.groupBy(id_, hash_).agg(F.min(row).alias(row), F.count("*").alias("n")).where("n > 1").drop("n"), "repeated-rows")
    again = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(text_hash) == F.col(hash_))
    alone = hashed.join(twice, again, "left_anti").select(*docs.columns)
    # rows that are equal in every column are one
    kept = hashed.join(twice, again & (F.col(whole) == F.col(row)), "left_semi").dropDuplicates(["doc_id", text_hash, whole])
    return alone.unionByName(kept.select(*docs.columns))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).drop("text_hash")


QUERIES = {"op4_simhash": op4_simhash}
SQL: dict[str, str] = {}
