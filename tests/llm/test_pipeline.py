"""Each stage on its own input, on small tables and on edge cases."""

import itertools
import random
from collections import Counter

import corpus_pipeline as cp
from pointspark.llm import registry
from tests.llm import common
from tests.llm.test_text import lines_brute


def test_stages_are_as_agreed():
    assert [n for n, _ in cp.STAGES] == ["language ID", "line dedup", "SimHash near-dedup", "mixing sources to target weights", "packing"]
    assert sorted(int(k[2:].split("_")[0]) for k in registry.queries()) == list(range(1, 11))


def test_language_stage(spark, data):
    docs = common.edge_docs(spark)
    kept = cp.language_id(spark, docs, data)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r[0] for r in common.edge_rows() if any(c.isalpha() for c in r[1] or ""))


def test_line_stage(spark, data):
    shared = "This line stands everywhere"
    rows = [(i, f"{shared}\nown {i}", "en", "a", 1) for i in range(12)] + [(99, shared, "en", "a", 1)] + common.edge_rows()
    docs = spark.createDataFrame(rows, common.SCHEMA)
    got = Counter(tuple(r) for r in cp.line_dedup(spark, docs, data).collect())
    want = Counter()
    for r, (text, _, gone) in zip(rows, lines_brute([r[1] for r in rows], 10), strict=True):
        if not gone or text.strip(" \t\n\r\x0b\x0c"):
            want[r[0], text, r[2], r[3], len(text)] += 1
    assert got == want


def test_near_duplicate_stage(spark, data):
    rng = random.Random(8)
    texts = [common.prose(rng, 400) for _ in range(20)]
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(texts)] + [(100 + i, t, "en", "b", 1) for i, t in enumerate(texts[:5])] + [(200, texts[6].upper(), "en", "c", 1), (7, texts[7], "en", "a", 1)]
    docs = spark.createDataFrame(rows, common.SCHEMA)
    assert sorted(r.doc_id for r in cp.simhash_dedup(spark, docs, data).collect()) == list(range(20))


def test_training_order_reaches_the_sequences(spark, data, tmp_path):
    from pointspark.llm import mixing

    rng = random.Random(11)
    rows = [(i, " ".join([f"id{i}", *common.prose(rng, rng.randint(1, 300 if i % 9 else 3000)).split()]), "en", f"s{i % 4}", 0) for i in range(300)]
    docs = spark.createDataFrame(rows, common.SCHEMA)
    plan, (*_, at) = mixing.mixing_plan(docs, whole=True)
    first = sorted((p, r.doc_id) for r in plan.collect() for p in r[at])
    path = str(tmp_path / "mixed")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        cp.mix_sources(spark, docs, data).write.parquet(path)
        out = cp.pack_sequences(spark, spark.read.parquet(path), data).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len([f for f in (tmp_path / "mixed").iterdir() if f.name.startswith("part-")]) == 7
    begins = [r.doc_id for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)) if r.start == 0]
    ties = [[i for _, i in g] for _, g in itertools.groupby(first, key=lambda x: x[0])]
    assert len(ties) > 200
    for g in ties:  # sources that begin together stand in any order
        assert sorted(begins[: len(g)]) == g
        begins = begins[len(g) :]


def test_stages_with_clashing_columns(spark, data):
    docs = common.edge_docs(spark, clashes=True)
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == docs.columns
        assert out.count() <= 2 * docs.count()
    assert cp.pack_sequences(spark, docs, data).count() > 0


def test_empty(spark, data):
    docs = common.empty_docs(spark)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, data)
        assert docs.count() == 0
        docs = common.empty_docs(spark)


def test_run(spark, data):
    out = cp.run(spark, data)
    assert {"doc_id", "start", "length", "sequence_id", "offset", "ids"} <= set(out.columns)
    sizes = Counter()
    for r in out.select("sequence_id", "length", "ids").collect():
        assert len(r.ids) == r.length
        sizes[r.sequence_id] += r.length
    assert max(sizes.values()) <= 1024


def test_near_duplicates_are_those_of_simhash(spark, data):
    """Fingerprints decide: a stage that linked by min-hash and exact Jaccard kept other documents."""
    from pointspark.llm import simhash

    rng = random.Random(3)
    long = common.prose(rng, 600).split()
    near = [*long[:300], "other", *long[301:]]  # a word of 600: alike at 0.8, but not all such pairs are within three bits
    short = [f"{a} {b} tail" for a in "abcdefgh" for b in "xyz"]
    texts = [" ".join(long), " ".join(near), *short, *(common.prose(rng, 50) for _ in range(30))]
    for i in range(20):  # every sixtieth word replaced: alike at 0.8 by far, fingerprints further off
        words = common.prose(rng, 300).split()
        texts += [" ".join(words), " ".join(w if k % 60 else f"w{i}" for k, w in enumerate(words))]
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, common.SCHEMA)
    prints = simhash.fingerprints(texts, 3).tolist()
    root = list(range(len(texts)))
    for _ in texts:
        for i, j in itertools.combinations(range(len(texts)), 2):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[i] = root[j] = min(root[i], root[j])
    kept = sorted(r.doc_id for r in cp.simhash_dedup(spark, docs, data).collect())
    assert kept == sorted(set(root))
    assert kept != sorted(r.doc_id for r in simhash.keep_one(docs).collect())
