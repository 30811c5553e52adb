import random
import re
from collections import Counter

import numpy as np
import pytest

from pointspark.llm import collocation
from tests.llm import common


def brute(rows, most=3, least=10, inside=50, top=2000):
    """rows (lang, text) -> the result, by counting every phrase of every piece."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = [x for x in re.split("[ \t]", piece) if x]
            n[lang] += len(w)
            for k in range(1, most + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    found = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in found.items():
        longer = (b for (other, q), b in found.items() if other == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))))
        if any(100 * b >= inside * a for b in longer):
            continue
        s, _, l, r = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))  # noqa: E741
        out.append((lang, -s, -a, " ".join(p).encode(), l, r))
    ranked, place = [], Counter()
    for lang, s, a, p, l, r in sorted(out):  # noqa: E741
        place[lang] += 1
        if place[lang] <= top:
            ranked.append((lang, place[lang], p.decode(), -a, l, r, n[lang], -s))
    return sorted(ranked)


def found(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def corpus(seed, rows=60):
    rng = random.Random(seed)
    words = ["a", "B", "b", "the", "über", " x", "x\x1cy", "new", "york", "city", "Z9"]
    out = []
    for _ in range(rows):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r\n"]) for _ in range(rng.randrange(80)))
        out.append((rng.choice(["en", "en", "de", None, "und"]), text + rng.choice(["", "new york city " * 3])))
    return out


@pytest.mark.parametrize("most,least,inside,top", [(3, 10, 50, 2000), (4, 3, 80, 7), (2, 1, 50, 5)])
def test_equals_brute_force(spark, most, least, inside, top):
    rows = corpus(most)
    want = brute(rows, most, least, inside, top)
    assert want
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    assert found(collocation.collocations(df, most, least, inside, top)) == want


def test_many_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(collocation, "BLOCK", 97)
    rows = corpus(8)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    assert collocation.postings(df).select("block").distinct().count() > 10
    assert found(collocation.collocations(df, least := 3, 4)) == brute(rows, least, 4)


@pytest.mark.parametrize("clashes", [False, True])
def test_edges(spark, clashes):
    docs = common.edge_docs(spark, clashes)
    got = found(collocation.collocations(docs))
    assert got == brute([(lang, text) for _, text, lang, *_ in common.edge_rows()])
    assert ("en", 1, "word word word", 29_998, 30_000, 29_999) == next(g[:6] for g in got if g[0] == "en" and g[2] == "word word word")
    assert collocation.collocations(common.empty_docs(spark)).count() == 0


def test_exact_beyond_64_bits(spark):
    rng = random.Random(2)
    rows = []
    while len(rows) < 500:
        l, r = (rng.randrange(1, 10 ** rng.randint(1, 14)) for _ in range(2))  # noqa: E741
        rows.append((rng.randint(1, min(l, r)), l, r))
    df = spark.createDataFrame(rows, "a long, l long, r long")
    assert all(x.s == 10**6 * x.a * x.a // (x.l * x.r) for x in df.selectExpr("*", f"{collocation.score('a', 'l', 'r')} as s").collect())


def test_places_come_back():
    lists = [[0], [5, 6, 9], [0, 70_000, 70_001], [2_000_000_000]]
    flat = np.array([p for x in lists for p in x], np.int64)
    start = np.cumsum([0, *map(len, lists[:-1])])
    places, size = collocation.unpacked(collocation.packed(flat, start).slice(1))
    assert places.tolist() == flat[1:].tolist() and size.tolist() == [3, 3, 1]
