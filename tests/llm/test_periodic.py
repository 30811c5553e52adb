import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointspark.llm import periodic
from tests.llm import common


def brute(w, least=6, times=4):
    """Runs by their definition: every period, every longest stretch, no smaller period."""
    n, out = len(w), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            part = w[i : j + q]
            if j > i and len(part) >= max(least, times * q) and not any(part[r:] == part[:-r] for r in range(1, q)):
                out.append((i, len(part), q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least,times", [(6, 4), (2, 2), (3, 3)])
def test_equals_brute_force(least, times):
    rng = random.Random(least)
    for _ in range(400):
        texts = []
        for _ in range(rng.randint(1, 5)):
            w = []
            while len(w) < rng.randint(0, 60):
                w += [rng.randrange(rng.choice([2, 3, 9])) for _ in range(rng.randint(1, 6))] * rng.choice([1, 1, 2, 5, 9])
            texts.append(w)
        assert periodic.find_runs([np.array(w, np.int64) for w in texts], least, times) == [brute(w, least, times) for w in texts]


def test_long_texts():
    rng = random.Random(1)
    block = [rng.randrange(300) for _ in range(700)]
    texts = [[0] * 9000, [0, 1] * 4000 + [1] * 7, block * 8 + block[:5], list(range(5000))]
    found = periodic.find_runs([np.array(t, np.int64) for t in texts])
    assert found == [[(0, 9000, 1)], [(0, 8000, 2), (7999, 8, 1)], [(0, 5605, 700)], []]


def test_a_text_longer_than_a_chunk(monkeypatch):
    monkeypatch.setattr(periodic, "CHUNK", 20)
    texts = [[1] * 7, [1, 2] * 30, [3], [5] * 9 + [6] * 6, []]
    assert periodic.find_runs([np.array(t, np.int64) for t in texts]) == [brute(t) for t in texts]


@pytest.mark.parametrize("clashes", [False, True])
def test_edges(spark, clashes):
    docs = common.edge_docs(spark, clashes).withColumn("runs", F.lit("mine"))
    out, (runs, collapsed) = periodic.collapse_runs(docs)
    assert out.columns == [*docs.columns, runs, collapsed] and "runs" in docs.columns and runs != "runs"
    got = sorted((repr((r.doc_id, r.text)), [tuple(x) for x in r[runs]], r[collapsed]) for r in out.collect())
    want = []
    for i, text, *_ in common.edge_rows():
        w = [x.decode() for x in (text or "").encode().split()]
        long = len(set(w)) == 1 and len(w) > 6
        want.append((repr((i, text)), [(0, len(w), 1)] if long else [], w[0] if long else " ".join(w)))
    assert got == sorted(want)
    assert periodic.collapse_runs(common.empty_docs(spark))[0].count() == 0


def test_query_equals_brute_force(spark, data):
    got = {r.doc_id: tuple(r) for r in periodic.op11_periodic_runs(spark, data).collect()}
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    changed = 0
    for i, text in docs:
        plain = (text or "").encode().split()
        w = periodic.repeated_tail(plain, i)
        changed += w != plain
        runs = brute(w)
        gone = {x for s, n, q in runs for x in range(s + q, s + n)}
        best = min(((-n, s, q) for s, n, q in runs), default=None)
        four = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
        told = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        assert got[i] == (i, len(runs), *four, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())
    assert changed


def test_tail_by_its_definition():
    import zlib

    for i in range(60):
        w = [b"%d" % k for k in range(i * 3)]
        h = zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            assert periodic.repeated_tail(w, i) == [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        else:
            assert periodic.repeated_tail(w, i) == w
