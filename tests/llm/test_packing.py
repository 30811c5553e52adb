import random
import zlib

import numpy as np
import pytest

from pointspark.llm import packing
from tests.llm import common


def brute(pos, cost, length, short):
    best = [0] + [10**9] * (len(pos) - 1)
    for j in range(1, len(pos)):
        for i in range(j):
            gap = pos[j] - pos[i]
            if gap <= length:
                pad = 0 if gap in short else length - gap
                best[j] = min(best[j], best[i] + pad + cost[j])
    return best[-1]


@pytest.mark.parametrize("seed", range(30))
def test_cuts_cost_no_more_than_any_others(seed):
    rng = random.Random(seed)
    length, short = 16, (8, 4)
    pos = [0]
    while len(pos) < 60:
        pos.append(pos[-1] + rng.randint(1, 9))
    cost = [0, *[rng.choice((0, 2, 5)) for _ in pos[1:]]]
    cuts = packing.best_cuts(pos, cost, length, short)
    spent, at = 0, 0
    for c in cuts:
        gap = c - at
        assert gap <= length
        spent += (0 if gap in short else length - gap) + cost[pos.index(c)]
        at = c
    assert at == pos[-1] and spent == brute(pos, cost, length, short)


def test_tail():
    assert packing.tail_cuts(0, 1024, 24) == [] and packing.tail_cuts(512, 1024, 24) == [512] and packing.tail_cuts(1000, 1024, 24) == [1000]
    cuts = packing.tail_cuts(700, 1024, 24)
    assert cuts[-1] == 700 and all((b - a).bit_count() == 1 for a, b in zip([0, *cuts], cuts, strict=False))


def check(rows, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    want = {}
    for d in docs:
        ids = np.array([*t.encode(d.text or "", add_special_tokens=False).ids, 0], "<u4")
        want.setdefault(d.doc_id, []).append(ids)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == set(want)
    for k, pieces in by.items():
        assert sum(p.length for p in pieces) == sum(map(len, want[k]))
        for p in pieces:
            assert any(len(ids) == p.doc_tokens and zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for ids in want[k])
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        s.sort()
        assert [a for a, _ in s] == [sum(n for _, n in s[:i]) for i in range(len(s))] and sum(n for _, n in s) <= 1024
    return [sum(n for _, n in s) for s in seqs.values()]


def test_edge_cases(spark):
    docs = common.edge_docs(spark, clashes=True)
    check(packing.pack(docs).collect(), docs.select("doc_id", "text").collect())
    assert packing.pack(common.empty_docs(spark)).count() == 0


def test_little_padding(spark):
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, common.prose(rng, rng.randint(1, 900))) for i in range(600)], "doc_id long, text string").coalesce(1)
    sizes = check(packing.pack(docs).collect(), docs.collect())
    assert sum(0 if n & (n - 1) == 0 else 1024 - n for n in sizes) < 0.01 * sum(sizes)


def test_ids_come_with_pieces(spark):
    docs = common.edge_docs(spark)
    for r in packing.pack(docs, with_ids=True).collect():
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32


def test_blocks_go_on_where_the_last_ended(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 3000)
    rng = random.Random(2)
    docs = [(i, common.prose(rng, 200)) for i in range(60)]
    enc = packing.Encoder()
    p = packing.Packer(enc.ends, 0, 1024, 64, 3, 24)
    rows = [r for i, t in docs for r in p.add(i, np.concatenate([enc.ids(t), [0]]))] + list(p.run(last=True))
    for i, t in docs:
        own = sorted((r[1], r[7].tolist()) for r in rows if r[0] == i)
        assert [x for _, ids in own for x in ids] == [*enc.ids(t).tolist(), 0]


def test_sequences_rise_with_the_order(spark):
    rng = random.Random(3)
    docs = [(i, common.prose(rng, rng.randint(1, 400)), f"{(i * 37) % 200:03d}") for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string, order0 string").repartition(6)
    rows = packing.pack(df, order=("order0",)).collect()
    check(rows, [r for r in df.collect()])
    place = {i: o for i, _, o in docs}
    at = [place[r.doc_id] for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset))]
    assert at == sorted(at)
