import random

import numpy as np
import pytest

from pointspark.llm import minhash, simhash
from tests.llm import common


def word_sets(texts, n=5):
    ws = [t.lower().split() for t in texts]
    return [{tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} for w in ws]


def roots(sets, alike=0.8):
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= alike and root[i] != root[j]:
                lo, hi = sorted((root[i], root[j]))
                root = [lo if r == hi else r for r in root]
    return root


def edited(rng, words, share):
    """words with single words changed until five-word Jaccard falls below share, and the text before that."""
    whole, w, last = word_sets([" ".join(words)])[0], list(words), list(words)
    while True:
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        s = word_sets([" ".join(w)])[0]
        if len(whole & s) / len(whole | s) < share:
            return " ".join(last), " ".join(w)
        last = list(w)


def test_edited_copies_go_and_others_stay(spark):
    rng = random.Random(4)
    texts = []
    for share in (0.8, 0.85, 0.9, 0.95):
        for _ in range(12):
            words = common.prose(rng, 300).split()
            near, _ = edited(rng, words, share)
            texts += [" ".join(words), near]
    for _ in range(20):
        words = common.prose(rng, 300).split()
        texts += [" ".join(words), edited(rng, words, 0.8)[1]]
    root = roots(word_sets(texts))
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], common.SCHEMA)
    assert len(set(root)) == len(texts) - 48
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == sorted(set(root))


def test_large_group_equals_brute_force(spark):
    rng = random.Random(6)
    words = common.prose(rng, 200).split()
    texts = [edited(rng, words, share)[0] for share in (0.6, 0.7, 0.85, 0.9) for _ in range(25)]
    root = roots(word_sets(texts))
    assert 1 < len(set(root)) < len(texts)
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], common.SCHEMA)
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == sorted(set(root))


@pytest.mark.parametrize("size", [1, 3, 8, 9, 30])
def test_pairs_of_a_bucket(size):
    k, fp = np.repeat([5, 6], size), np.arange(2 * size)
    found = list(zip(*(x.tolist() for x in minhash.bucket_pairs(k, fp)), strict=True))
    assert len(found) == len(set(found)) and all(a // size == b // size == q - 5 for q, a, b in found)
    if size <= minhash.SMALL:
        assert len(found) == size * (size - 1)
    else:
        assert sum(a == b for _, a, b in found) == 2 * size


@pytest.mark.parametrize("many", [1000, 4])
def test_prefixes_miss_no_pair(spark, monkeypatch, many):
    monkeypatch.setattr(minhash, "MANY", many)
    monkeypatch.setattr(minhash, "MOST_MANY", 10**6)
    rng = random.Random(9)
    words = common.prose(rng, 120).split()
    texts = [" ".join(rng.choices(words, k=4) + w.split()[rng.randrange(20) :]) for w in (edited(rng, words, s)[0] for s in (0.7, 0.8, 0.9) for _ in range(25))]
    sets = [minhash.shingles(t, 5)[1].view(np.int64).tolist() for t in texts]
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if len({*sets[i]} & {*sets[j]}) / len({*sets[i]} | {*sets[j]}) >= 0.8}
    df = spark.createDataFrame([(i, i, s) for i, s in enumerate(sets)], "fp long, g long, shingles array<long>")
    made = [(r.a, r.b) for r in minhash.prefix_pairs(df, 0.8, once=False).collect()]
    got = set(made)
    assert len(made) < 1.5 * len(got)  # a pair is made about once, though it shares many shingles
    assert want and want <= got and len(got) < len(sets) * (len(sets) - 1) // 2
