import random

import numpy as np
import pytest
import xxhash

from pointspark.llm import simhash
from tests.llm import common


def fingerprint(text, k=3):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(prints, radius=3):
    p = list(range(len(prints)))

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                p[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def check(spark, rows, bucket):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df, bucket=bucket).collect()}
    prints = [fingerprint(t) for _, t in rows]
    root = groups(prints)
    least = {}
    for (i, _), g in zip(rows, root, strict=True):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    assert got == {(i, f"{f:016x}", least.get(g)) for (i, _), f, g in zip(rows, prints, root, strict=True)}
    return root


@pytest.mark.parametrize("bucket", [1024, 3])
def test_equals_brute_force(spark, bucket):
    rng = random.Random(3)
    rows = []
    for g in range(25):
        words = common.prose(rng, 150).split()
        for c in range(rng.randint(1, 6)):
            w = list(words)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = f"new{rng.randrange(99)}"
            rows.append((100 * g + c, " ".join(w)))
    rng.shuffle(rows)
    assert len(set(check(spark, rows, bucket))) < len(rows)


def test_edge_cases(spark):
    docs = common.edge_docs(spark, clashes=True)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    check(spark, rows, 1024)
    assert simhash.near_duplicates(common.empty_docs(spark)).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    # one of the rows 4, 4 and 5; one of the rows without words
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(4) == 1 and 5 not in ids and ids.count(1) == 1 and 2 not in ids and 3 not in ids
    assert simhash.keep_one(common.empty_docs(spark)).count() == 0


@pytest.mark.parametrize("radius", [1, 3, 5])
def test_cover_misses_no_pair(radius):
    rng = random.Random(radius)
    masks = simhash.cover(list(range(64)), radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    for _ in range(2000):
        d = sum(1 << p for p in rng.sample(range(64), radius))
        assert any(not m & d for m in masks)
    assert simhash.cover([5], 3) == [0]  # fewer positions than dimensions


@pytest.mark.parametrize("radius", [1, 3, 5])
def test_finer_cover_misses_no_pair(radius):
    rng = random.Random(radius)
    for first in simhash.cover(list(range(64)), radius):
        open_ = [p for p in range(64) if not first >> p & 1]
        masks = simhash.cover(open_, radius)
        assert all(masks)
        for _ in range(50):
            d = sum(1 << p for p in rng.sample(open_, radius))
            assert any(not m & d for m in masks)


@pytest.mark.parametrize("radius", [1, 3, 5])
@pytest.mark.parametrize("bucket", [3, 1024])
def test_links_equal_brute_force(spark, radius, bucket):
    rng = random.Random(radius)
    flip = lambda f, n: f ^ sum(1 << p for p in rng.sample(range(64), n))
    prints = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        prints |= {base, *(flip(base, rng.randint(1, radius + 2)) for _ in range(8))}
    # many that share a bucket, and in it pairs as far apart as counts
    first = simhash.cover(list(range(64)), radius)[-1]
    open_, base = [p for p in range(64) if not first >> p & 1], rng.getrandbits(64)
    for i in range(150 if bucket == 3 else 1100):
        f = base ^ sum(1 << p for p in rng.sample(open_, len(open_) // 2))
        prints.add(f)
        if i < 40:
            prints.add(f ^ sum(1 << p for p in rng.sample(open_, radius)))
    prints = sorted(prints)
    df = spark.createDataFrame([(simhash.signed(f),) for f in prints], "fp long")
    place = {f: i for i, f in enumerate(prints)}
    got = list(range(len(prints)))

    def find(x):
        while got[x] != x:
            x = got[x]
        return x

    for a, b in simhash.links(df, radius, bucket).collect():
        a, b = simhash.unsigned(a), simhash.unsigned(b)
        assert (a ^ b).bit_count() <= radius * len(prints)
        x, y = find(place[a]), find(place[b])
        got[max(x, y)] = min(x, y)
    x = np.array(prints, np.uint64)
    want = list(range(len(prints)))
    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(x[:i] ^ x[i]) <= radius):
            a, b = i, int(j)
            while want[a] != a:
                a = want[a]
            while want[b] != b:
                b = want[b]
            want[max(a, b)] = min(a, b)
    root = lambda t, i: i if t[i] == i else root(t, t[i])
    assert [find(i) for i in range(len(prints))] == [root(want, i) for i in range(len(prints))]


def test_repeated_rows_of_an_id(spark):
    rows = [(1, "a b c d e f", "en", s, n) for s, n in (("x", 1), ("y", 2), ("x", 1), ("z", None))] + [(None, "g h i j k l", None, None, None)] * 40 + [(None, "g h i j k l", "en", None, 3)]
    docs = spark.createDataFrame(rows, common.SCHEMA)
    one = [tuple(r) for r in simhash.keep_one(docs).collect()]
    assert len(one) == 2 and sorted(one, key=str) == sorted((tuple(r) for r in simhash.keep_one(docs.repartition(7)).collect()), key=str)


def test_majority_counts_many():
    h = np.random.default_rng(0).integers(0, 1 << 63, 1000, np.uint64)
    want = sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in h) > 1000)
    assert int(simhash.majority(h)) == want


def test_roots_of_small_and_large_buckets():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 4, np.uint64)
    fp = np.array([int(base[i % 4]) ^ (1 << int(rng.integers(0, 64))) for i in range(200)], np.uint64)
    bucket = np.sort(rng.integers(0, 3, 200))
    for width in (32, 4, 1000):
        got = simhash.roots_in_buckets(bucket, fp, 3, width)
        for b in range(3):
            at = np.flatnonzero(bucket == b)
            assert got[at].tolist() == [int(at[g]) for g in groups([int(x) for x in fp[at]])]
