import random
from collections import defaultdict

import numpy as np
import pytest

from pointspark.llm import ngramjoin
from tests.llm import common


def word_set(text, n=4):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(rows, n=4, alike=85):
    """(doc_id, size, component) by comparing all that share a feature."""
    sets = [word_set(t, n) for _, t in rows]
    root, where = list(range(len(rows))), defaultdict(list)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        for j in {j for f in s for j in where[f]}:
            if find(i) != find(j) and 100 * len(s & sets[j]) >= alike * len(s | sets[j]):
                root[find(i)] = find(j)
        for f in s:
            where[f].append(i)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)] += [d] if d is not None else []
    return sorted(((d, len(s), min(least[find(i)], default=None)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def found(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


def edited(rng, words, edits):
    w = list(words)
    for _ in range(edits):
        m, i = rng.random(), rng.randrange(len(w))
        w[i : i + (m < 0.6)] = [] if m < 0.2 else [f"new{rng.randrange(10**6)}"]
    return w


@pytest.mark.parametrize("alike", [85, 60, 95])
def test_alike_sets_share_a_signature(alike):
    rng = np.random.default_rng(alike)
    close = 0
    for size in [*range(1, 40), 60, 100, 250, 700, 3000] * 3:
        base = rng.integers(0, 1 << 63, size, np.uint64)
        for _ in range(6):
            keep = base[rng.random(size) > rng.random() * 0.3]
            other = np.unique(np.concatenate([keep, rng.integers(0, 1 << 63, rng.integers(0, 1 + size // 5), np.uint64)]))
            a, b = set(base.tolist()), set(other.tolist())
            if 100 * len(a & b) >= alike * len(a | b):
                close += a != b
                assert {*ngramjoin.signatures(np.unique(base), alike).tolist()} & {*ngramjoin.signatures(other, alike).tolist()}
    assert close > 20


@pytest.mark.parametrize("high", [1, 5, 7, 9, 20, 60, 61, 300])
def test_worst_differences_still_leave_a_part(high):
    """As many differences as may be, each placed where it hurts most."""
    n1, n2, spare, choices = ngramjoin.scheme(high)
    larger = high * 100 // 85
    k = max(x + y - 2 * c for x in range(max(1, high * 85 // 100), high + 1) for y in range(x, min(larger, x * 100 // 85) + 1) for c in range(x + 1) if 100 * c >= 85 * (x + y - c))
    k2 = n2 - len(choices[0])
    assert k < (n1 - spare) * (k2 + 1)


def corpus(rng, families=12, size=6, words=120):
    rows = []
    for f in range(families):
        base = common.prose(rng, rng.choice([3, 12, 40, words])).split()
        for c in range(size):
            rows.append((100 * f + c, " ".join(edited(rng, base, rng.randint(0, max(1, len(base) // 30))))))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(random.Random(seed))
    want = brute(rows)
    assert len({c for *_, c in want}) < len(rows)
    assert found(ngramjoin.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"))) == want


def test_large_groups_equal_brute_force(spark):
    """Families of many members, some of them half alike, so that large buckets hold what does not link."""
    rng = random.Random(5)
    shared = common.prose(rng, 150).split()
    rows = []
    for f in range(4):
        base = shared + common.prose(rng, 60).split()
        rows += [(1000 * f + c, " ".join(edited(rng, base, rng.randint(1, 8)))) for c in range(30)]
    want = brute(rows)
    assert 4 <= len({c for *_, c in want}) < len(rows)
    assert found(ngramjoin.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"))) == want


@pytest.mark.parametrize("batch", [3, 10_000])
def test_candidates_of_buckets(spark, batch):
    rng = random.Random(batch)
    rows = [(s, i) for s in range(30) for i in rng.sample(range(200), rng.choice([1, 2, 5, 6, 7, 8, 40]))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = sorted(tuple(r) for r in ngramjoin.candidates(spark.createDataFrame(rows, "s long, sid long")).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for s in range(30):
        m = sorted(i for t, i in rows if t == s)
        large = len(m) > ngramjoin.SMALL
        want += [(s, a, b) for x, a in enumerate(m) for y, b in enumerate(m) if x < y and (not large or y == x + 1) or large and x == y]
    assert got == sorted(want)


def test_copies_and_edges(spark):
    rows = [(d, t) for d, t, *_ in common.edge_rows()]
    assert found(ngramjoin.ngram_components(common.edge_docs(spark, True))) == brute(rows)
    rows = [(None, "one two three four five")] * 3 + [(9, "a b"), (8, "A  b"), (7, "b a"), (None, "a b"), (3, None), (4, ""), (None, " ")]
    assert found(ngramjoin.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
    assert ngramjoin.ngram_components(common.empty_docs(spark)).count() == 0


def test_query_equals_brute_force(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    assert found(ngramjoin.op13_ngram_join(spark, data)) == brute(rows)
