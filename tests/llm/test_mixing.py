import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pointspark.llm import mixing
from tests.llm import common


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def goals(sizes, weights, repeats):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        level = left / sum(w[s] for s in free)
        full = [s for s in free if level * w[s] > repeats * sizes[s]]
        if not full:
            return out | {s: level * w[s] for s in free}
        for s in full:
            out[s] = float(repeats * sizes[s])
            left -= out[s]
        free -= set(full)
    return out


def check(df, names):
    n_size, n_source, n_target, n_taken, n_at = names
    rows = df.collect()
    by = defaultdict(list)
    for r in rows:
        assert r[n_size] == size(r.text) and 0 <= r[n_taken] <= 3 * r[n_size]
        assert list(r[n_at]) == sorted(r[n_at]) and all(0 <= p <= 1 for p in r[n_at])
        by[r.source].append(r)
    sizes = {s: sum(r[n_size] for r in g) for s, g in by.items()}
    want = goals(sizes, mixing.integrals(mixing.SCHEDULE), 3)
    for s, g in by.items():
        assert g[0][n_source] == sizes[s]
        assert g[0][n_target] == pytest.approx(want[s])
        assert abs(sum(r[n_taken] for r in g) - want[s]) <= 0.5
    return rows


def test_edge_cases(spark):
    df, names = mixing.mixing_plan(common.edge_docs(spark, clashes=True))
    assert df.count() == len(common.edge_rows()) and df.where("size <> 'mine'").count() == 0
    check(df, names)
    assert mixing.mixing_plan(common.empty_docs(spark))[0].count() == 0
    assert mixing.mix(common.empty_docs(spark)).count() == 0


def test_hot_and_small_sources(spark):
    rows = [(i, "w " * (i % 50), "en", f"s{0 if i % 3 else i % 17}", 0) for i in range(3000)]
    df = spark.createDataFrame(rows, common.SCHEMA)
    one, names = mixing.mixing_plan(df, blocks=64)
    a = sorted((r.doc_id, r.taken, tuple(r.positions)) for r in check(one, names))
    b = sorted((r.doc_id, r.taken, tuple(r.positions)) for r in mixing.mixing_plan(df.repartition(7), blocks=64)[0].collect())
    assert a == b


def test_no_words_at_all(spark):
    df = spark.createDataFrame([(1, " ", "en", "a", 1), (2, None, "en", "b", 1)], common.SCHEMA)
    assert [tuple(r)[-5:] for r in mixing.mixing_plan(df)[0].collect()] == [(0, 0, 0.0, 0, [])] * 2


def test_schedule_is_inverted(spark):
    assert mixing.integrals(mixing.SCHEDULE) == pytest.approx((5, 2, 1))
    df = spark.range(101).select((F.col("id") / 100.0).alias("y"))
    for i in range(3):
        for y, t in df.select("y", mixing.position_at(F.col("y"), mixing.SCHEDULE, i)).collect():
            area = 0.0
            for (t0, a), (t1, b) in zip(mixing.SCHEDULE, mixing.SCHEDULE[1:], strict=False):
                u = min(max(t - t0, 0), t1 - t0)
                area += a[i] * u + (b[i] - a[i]) / (t1 - t0) * u * u / 2
            assert area == pytest.approx(y * mixing.integrals(mixing.SCHEDULE)[i], abs=1e-9)


def test_mix_gives_copies_in_order(spark):
    df = spark.createDataFrame([(i, f"w{i} " * 20, "en", f"s{i % 4}", 0) for i in range(400)], common.SCHEMA)
    plan, names = mixing.mixing_plan(df, whole=True)
    want = {r.doc_id: len(r[names[4]]) for r in plan.collect()}
    got = defaultdict(int)
    for r in mixing.mix(df).collect():
        got[r.doc_id] += 1
    assert {k: v for k, v in want.items() if v} == dict(got) and mixing.mix(df).columns == df.columns
    early = mixing.mix(df).limit(80).collect()  # heavier sources first, as their schedule says
    share = sum(r.source in ("s0", "s3") for r in early) / len(early)
    assert share > 0.75


def test_equal_rows_are_copied_as_often_as_they_stand(spark):
    rows = [(None, "same text here " * 5, "en", "a", 1)] * 30 + [(7, "same text here " * 5, "en", "a", 1)] * 3 + [(i, f"w{i} " * 15, "en", "b", 0) for i in range(50)] + [(None, None, None, None, None)] * 5
    df = spark.createDataFrame(rows, common.SCHEMA)
    plan, names = mixing.mixing_plan(df, whole=True)
    want, got = defaultdict(int), defaultdict(int)
    for r in plan.collect():
        want[r.doc_id, r.text] += len(r[names[4]])
    for r in mixing.mix(df).collect():
        got[r.doc_id, r.text] += 1
    assert {k: v for k, v in want.items() if v} == dict(got)


def test_many_blocks_agree_with_one(spark):
    rows = [(i, "w " * (i % 31), "en", f"s{i % 5}", 0) for i in range(2000)]
    df = spark.createDataFrame(rows, common.SCHEMA)
    for blocks in (1, 97):
        check(*mixing.mixing_plan(df, blocks=blocks))


def test_rows_without_an_id_do_not_depend_on_the_split(spark):
    rng = random.Random(4)
    rows = [(None if i % 3 else i, common.prose(rng, rng.randint(1, 40)) if i % 5 else "the same text", "en", "abc"[i % 3], i % 7) for i in range(300)]
    seen = []
    for parts in (1, 3, 7):
        docs = spark.createDataFrame(rows, common.SCHEMA).repartition(parts)
        plan, (size, _, _, taken, _) = mixing.mixing_plan(docs, blocks=5)
        seen.append(sorted((r.doc_id or -1, r.text, r.source, r.n_chars, r[size], r[taken]) for r in plan.collect()))
        mixed = mixing.mix(docs, blocks=5)
        seen.append(sorted(map(repr, mixed.groupBy(*mixed.columns).agg(F.count("*").alias("n")).collect())))
    assert seen[0] == seen[2] == seen[4] and seen[1] == seen[3] == seen[5]
    assert len(seen[0]) == 300
