"""Phrases whose words stand together more often than by chance, mined by vertical inverted lists.

The corpus is cut into blocks of one language. In a block each phrase has the
ascending list of its places; the sum of the lengths of a phrase's lists is its
exact frequency. Phrases grow by a word at a time: the places of a frequent phrase of
k words are merged with the postings of the words that stand k places on. All
lists of a block meet in one task, so that only list lengths cross the corpus;
a block is told which of its phrases are frequent, and makes their lists anew
when they are to grow.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointspark.operators.ordered import numbered
from pointspark.session import discard, materialize

MOST_WORDS = 3
MIN_COUNT = 10
#: Per cent of a phrase's occurrences inside a longer one from which it is left out.
INSIDE = 50
TOP = 2000
#: Words of a block, beyond which a further text starts a new one.
BLOCK = 3_000_000
#: Least number of parts in which what follows a phrase is counted.
PARTS = 4
#: Parts in which each language's best are looked for first.
SALTS = 64

#: Pieces end at these; none of them can stand in a word, so a full stop is the mark of an end.
ENDS = b".,;:!?\n\x0b\x0c\r"
_UPPER = bytes(range(65, 91))
_LOWER = bytes.maketrans(_UPPER + ENDS, _UPPER.lower() + b"." * len(ENDS))


def tokens(text: str | None) -> list[bytes]:
    """The words of text in lower case (A-Z), with a full stop wherever a piece ends."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).replace(b".", b" . ").split()


def packed(places: np.ndarray, start: np.ndarray) -> pa.ListArray:
    """The lists of places that begin at start, each as its first place and the steps from there; small numbers take little room where they are written."""
    steps = np.diff(places, prepend=0)
    steps[start] = places[start]
    return pa.ListArray.from_arrays(pa.array(np.append(start, len(places)).astype(np.int32)), pa.array(steps.astype(np.int32)))


def unpacked(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The places in all lists, one list after the other, and the length of each list."""
    size = np.diff(lists.offsets.to_numpy())
    steps = lists.flatten().to_numpy().astype(np.int64)
    sums = np.cumsum(steps)
    first = np.cumsum(size) - size
    return sums - np.repeat((sums - steps)[first], size), size


def postings(docs: DataFrame) -> DataFrame:
    """(block, lang, word, local, n, places) for each word of each block of docs (text, lang); local numbers the words of a block.

    A block holds texts of one language. A place is left free wherever a piece ends.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # blocks that are open hold a number for each word: at most BLOCK in all, of whichever languages
        task, number = TaskContext.get().partitionId(), count()
        open_: dict[str, tuple[dict[bytes, int], list[np.ndarray]]] = {}
        held: Counter[str] = Counter()

        def closed(lang: str) -> Iterator[pa.RecordBatch]:
            words, parts = open_.pop(lang)
            held.pop(lang)
            ids = np.concatenate(parts)
            order = np.argsort(ids, kind="stable")
            start = np.searchsorted(ids[order], np.arange(len(words) + 1))
            names = [w.decode("utf-8", "surrogatepass") for w in words]
            block = (task << 32) + next(number)
            for i in range(1, len(words), 20_000):
                to = min(i + 20_000, len(words))
                lists = packed(order[start[i] : start[to]], start[i:to] - start[i])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(to - i, block)), pa.array([lang] * (to - i), pa.string()), pa.array(names[i:to], pa.string()), pa.array(np.arange(i, to)), pa.array(np.diff(start[i : to + 1])), lists],
                    ["block", "lang", "word", "local", "n", "places"],
                )

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found = tokens(text.as_py())
                if not found:
                    continue
                if held and held.total() + len(found) > BLOCK:
                    yield from closed(max(held, key=held.__getitem__))
                if lang not in open_:
                    words: dict[bytes, int] = defaultdict(count(1).__next__)
                    words[b"."] = 0
                    open_[lang] = words, []
                words, parts = open_[lang]
                parts.append(np.fromiter(map(words.__getitem__, [*found, b"."]), np.int32, len(found) + 1))
                held[lang] += len(found) + 1
        for lang in list(open_):
            yield from closed(lang)

    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(listed, "block long, lang string, word string, local long, n long, places array<int>")


def by_block(rows: DataFrame, each, schema: str) -> DataFrame:
    """each(table) of the rows of every block, gathered in one task; each gives columns."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            block = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), b.num_rows]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if rest and rest[0].column(0)[0].as_py() != int(block[i]):
                    yield from each(pa.Table.from_batches(rest))
                    rest = []
                rest.append(b.slice(i, j - i))
        if rest:
            yield from each(pa.Table.from_batches(rest))

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in run(batches):
            yield pa.RecordBatch.from_arrays(cols, names)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # by one number, which Spark sorts without comparing rows; what is in order inside a block is put so where it is needed
    return rows.repartition(n, "block").sortWithinPartitions("block").mapInArrow(out, schema)


def looked_up(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each wanted key among the keys, -1 where it is not there."""
    if not len(keys):
        return np.full(len(wanted), -1, np.int64)
    order = np.argsort(keys)
    i = np.minimum(np.searchsorted(keys, wanted, sorter=order), len(keys) - 1)
    return np.where(keys[order[i]] == wanted, order[i], -1)


def extended(index: DataFrame, names: DataFrame, longer: list[DataFrame], parts: int) -> DataFrame:
    """(block, head, part, nexts, ns): the frequent phrases of each block, those of the most words, with the words that follow and how often.

    index has the postings (block, local, places), names the frequent words
    (block, local, id), longer for 2, 3 ... words the frequent phrases (block,
    head, nexts), a phrase being the ids of its words. The places of a phrase of
    k words are merged with the postings of the words k places on; what they
    share is the list of a longer phrase, whose length is given. What follows a
    phrase is dealt to parts rows.
    """
    k = len(longer) + 1

    def merged(t: pa.Table) -> Iterator[list[pa.Array]]:
        kind = t.column("kind").to_numpy()
        block = t.column("block")[0].as_py()

        def of_kind(j: int, *columns: str) -> list[pa.Array]:
            rows = pa.array(np.flatnonzero(kind == j))
            return [t.column(c).take(rows).combine_chunks() for c in columns]

        def flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            return lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())

        named, ids = (x.to_numpy() for x in of_kind(1, "a", "b"))
        local, lists = of_kind(0, "a", "places")
        places, size = unpacked(lists)
        # the lists of frequent words, as a map from place to word, so that all merges of a block are one look-up
        word = np.full(int(places.max(initial=0)) + k + 1, -1, np.int32)
        word[places] = np.repeat(looked_up(named, local.to_numpy()), size)
        del lists, places
        at = np.flatnonzero(word >= 0)
        own, phrases = word[at].astype(np.int64), ids[:, None]  # the phrase at each place, and what words it has
        known: list[np.ndarray] = []
        for j in range(1, k):
            heads, nexts = of_kind(j + 1, "head", "nexts")
            heads, (nexts, size) = flat(heads)[0].reshape(-1, j), flat(nexts)
            first = looked_up(ids, heads[:, 0])
            for i in range(1, j):
                first = looked_up(known[i - 1], (first << 32) | looked_up(ids, heads[:, i]))
            first = np.repeat(first, size)
            known.append((first << 32) | looked_up(ids, nexts))
            found = looked_up(known[-1], (own << 32) | word[at + j])
            at, own, phrases = at[found >= 0], found[found >= 0], np.column_stack([np.repeat(heads, size, axis=0), nexts])
        after = word[at + k].astype(np.int64)
        key, n = np.unique((own[after >= 0] << 32) | after[after >= 0], return_counts=True)
        if not len(key):
            return
        first, after = key >> 32, ids[key & 0xFFFFFFFF]
        part = after % parts
        order = np.lexsort((part, first))
        first, after, part, n = first[order], after[order], part[order], n[order]
        start = np.flatnonzero((np.diff(first, prepend=-1) != 0) | (np.diff(part, prepend=-1) != 0))
        for i in range(0, len(start), 20_000):
            s = start[i : i + 20_000]
            end = start[i + 20_000] if i + 20_000 < len(start) else len(first)
            offsets = pa.array(np.append(s, end).astype(np.int32) - np.int32(s[0]))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v[s[0] : end].astype(kind))) for v, kind in ((after, np.int64), (n, np.int32))]
            heads = pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1, dtype=np.int32) * k), pa.array(phrases[first[s]].ravel()))
            yield [pa.array(np.full(len(s), block)), heads, pa.array(part[s].astype(np.int32)), *lists]

    # empty lists, not nulls: where a list is null, Spark counts a batch's size again from the last list before it, row by row
    none = {c: F.lit(0).cast("long") for c in "ab"} | {c: F.array().cast(t) for c, t in (("places", "array<int>"), ("head", "array<long>"), ("nexts", "array<long>"))}

    def rows(df: DataFrame, kind: int, **columns: str) -> DataFrame:
        return df.select("block", F.lit(kind).alias("kind"), *[F.col(columns[c]).alias(c) if c in columns else empty.alias(c) for c, empty in none.items()])

    whole = rows(index, 0, a="local", places="places").unionByName(rows(names, 1, a="local", b="id"))
    for j, d in enumerate(longer, 2):
        whole = whole.unionByName(rows(d, j, head="head", nexts="nexts"))
    return by_block(whole, merged, "block long, head array<long>, part int, nexts array<long>, ns array<int>")


def score(a: str, l: str, r: str) -> str:  # noqa: E741
    """SQL for floor(10^6 a^2 / (l r)); the products are exact for counts below 10^15."""
    return f"(cast(1000000 as decimal(7,0)) * cast({a} as decimal(15,0)) * cast({a} as decimal(15,0))) div (cast({l} as decimal(15,0)) * cast({r} as decimal(15,0)))"


def phrases(docs: DataFrame, most_words: int = MOST_WORDS, min_count: int = MIN_COUNT) -> tuple[list[DataFrame], DataFrame]:
    """For 1, 2 ... most_words words: (words, lang, phrase, f, ls, rs) of the phrases found min_count times; and (lang, n).

    words are the ids of a phrase's words. ls and rs have the frequencies of both
    sides of each cut, after one word, two and so on.
    """
    slim = docs.select("lang", "text")
    # no more parts than there are blocks, so that small files do not make small blocks
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + size // (6 * BLOCK)
    # as the data grow, what follows a frequent word is counted in more parts and stands in more rows
    parts = max(PARTS, isqrt(blocks))
    index = materialize(postings(slim.coalesce(blocks)), "postings")
    totals = index.groupBy("lang").agg(F.sum("n").alias("n"))
    words = index.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= min_count)
    words = materialize(numbered(words, ("lang", "word"), 0, "id"), "frequent-words")
    empty = F.array().cast("array<long>")
    levels = [words.select(F.array("id").alias("words"), "lang", F.col("word").alias("phrase"), "f", empty.alias("ls"), empty.alias("rs"))]
    names = materialize(index.select("block", "lang", "word", "local").join(words.select("lang", "word", "id"), ["lang", "word"]).select("block", "local", "id"), "word-names")
    longer: list[DataFrame] = []
    for k in range(1, most_words):
        lists = materialize(extended(index.select("block", "local", "places"), names, longer, parts), f"lists-{k + 1}")
        # what follows a phrase is dealt to parts before it is counted, so a frequent phrase is not one task's
        counted = lists.select("head", "part", "nexts", "ns").repartition("head", "part").select("head", "part", F.explode(F.arrays_zip("nexts", "ns")).alias("x"))
        found = counted.groupBy("head", "part", F.col("x.nexts").alias("next")).agg(F.sum("x.ns").alias("f")).where(F.col("f") >= min_count)
        found = materialize(found, f"frequent-{k + 1}")
        # a phrase without its last and without its first word is as frequent at least
        p = levels[-1].select(F.col("words").alias("head"), "lang", F.col("phrase").alias("p_phrase"), F.col("f").alias("p_f"), F.col("ls").alias("p_ls"))
        s = levels[-1].select(F.col("words").alias("tail"), F.col("f").alias("s_f"), F.col("rs").alias("s_rs"))
        w = words.select(F.col("id").alias("next"), "word")
        whole = found.withColumn("words", F.concat("head", F.array("next"))).withColumn("tail", F.slice("words", 2, k))
        rows = whole.join(p, "head").join(w, "next").join(s, "tail")
        rows = rows.select("words", "lang", F.concat_ws(" ", "p_phrase", "word").alias("phrase"), "f", F.concat("p_ls", F.array("p_f")).alias("ls"), F.concat(F.array("s_f"), "s_rs").alias("rs"))
        levels.append(materialize(rows, f"phrases-{k + 1}"))
        if k + 1 < most_words:
            # each block learns which of its phrases are frequent
            known = found.groupBy("head", "part").agg(F.collect_list("next").alias("good"))
            here = lists.select("block", "head", "part", "nexts").join(known, ["head", "part"], "left").select("block", "head", F.array_intersect("nexts", "good").alias("nexts"))
            longer.append(materialize(here.where(F.size("nexts") > 0), f"names-{k + 1}"))
        discard(lists)
    return levels, totals


def collocations(docs: DataFrame, most_words: int = MOST_WORDS, min_count: int = MIN_COUNT, inside: int = INSIDE, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's top phrases of two to most_words words by falling score.

    Texts are lower-cased (A-Z) and cut into pieces at .,;:!? and line ends, and
    pieces into words at spaces and tabs. a is the number of the phrase's
    occurrences, overlaps included, at least min_count; l and r are those of its
    two sides at the cut of the lowest score, the first of equal ones; n counts
    all words of the language. The score is floor(10^6 a^2 / (l r)). A phrase is
    left out where one that is longer holds it and has at least inside per cent
    of its occurrences. Ties go to larger a, then to the phrase in byte order.

    A null lang is `und`. Null and empty texts have no words; repeated rows count
    each; doc_ids are not read, and neither are other columns. Texts are read
    whole. An empty table gives no rows.
    """
    levels, totals = phrases(docs, most_words, min_count)
    whole = None
    for i, level in enumerate(levels[1:], 1):
        if i + 1 < len(levels):
            # what is in a phrase of more words is in one of one word more that is as frequent
            n = i + 1
            held = levels[i + 1].select(F.explode(F.array(F.slice("words", 1, n), F.slice("words", 2, n))).alias("words"), F.col("f").alias("most")).groupBy("words").agg(F.max("most").alias("most"))
            level = level.join(held, "words", "left").where(f"most is null or 100 * most < {inside} * f").drop("most")
        level = level.select("lang", "phrase", "f", "ls", "rs")
        whole = level if whole is None else whole.unionByName(level)
    cut = F.transform("ls", lambda l, i: F.struct(l.alias("l"), F.get("rs", i).alias("r"), i.alias("i")))  # noqa: E741
    scored = F.expr(f"array_min(transform(cuts, c -> struct({score('f', 'c.l', 'c.r')} as score, c.i as i, c.l as l, c.r as r)))")
    best = whole.withColumn("cuts", cut).select("lang", "phrase", F.col("f").alias("a"), scored.alias("x"))
    best = best.select("lang", "phrase", "a", F.col("x.l").alias("l"), F.col("x.r").alias("r"), F.col("x.score").alias("score"))
    # a language's phrases are not sorted in one task: its best of each part are
    order = [F.desc("score"), F.desc("a"), "phrase"]
    part = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    few = best.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op12_collocations": op12_collocations}
SQL = {
    "op12_collocations": """
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?' || chr(10) || chr(11) || chr(12) || chr(13) || chr(9), 'abcdefghijklmnopqrstuvwxyz......... ') AS text FROM documents),
p AS (SELECT lang, unnest(string_split(text, '.')) AS piece FROM d),
w AS MATERIALIZED (SELECT lang, [x for x in string_split(piece, ' ') if x <> ''] AS ws FROM p),
g AS (
  SELECT lang, unnest(ws) AS phrase, 1 AS k FROM w
  UNION ALL SELECT lang, unnest([ws[i] || ' ' || ws[i + 1] for i in range(1, len(ws))]), 2 FROM w WHERE len(ws) >= 2
  UNION ALL SELECT lang, unnest([ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] for i in range(1, len(ws) - 1)]), 3 FROM w WHERE len(ws) >= 3),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f, string_split(phrase, ' ') AS s FROM g GROUP BY lang, k, phrase),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT * FROM f WHERE k >= 2 AND f >= 10),
sides AS MATERIALIZED (
  SELECT lang, phrase, k, f AS a, 1 AS cut, s[1] AS lp, array_to_string(s[2:], ' ') AS rp FROM c
  UNION ALL SELECT lang, phrase, k, f, 2, s[1] || ' ' || s[2], s[3] FROM c WHERE k = 3),
cuts AS MATERIALIZED (
  SELECT z.lang, z.phrase, k, a, cut, x.f AS l, y.f AS r FROM sides z
    JOIN (SELECT lang, phrase, f FROM f) x ON x.lang = z.lang AND x.phrase = z.lp JOIN (SELECT lang, phrase, f FROM f) y ON y.lang = z.lang AND y.phrase = z.rp),
s AS (SELECT *, CAST(1000000 * CAST(a AS HUGEINT) * a // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM cuts),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
h AS (SELECT lang, phrase, max(f) AS most FROM (
  SELECT lang, s[1] || ' ' || s[2] AS phrase, f FROM c WHERE k = 3 UNION ALL SELECT lang, s[2] || ' ' || s[3], f FROM c WHERE k = 3) GROUP BY lang, phrase),
kept AS (SELECT b.* FROM b LEFT JOIN h ON b.lang = h.lang AND b.phrase = h.phrase AND b.k = 2 WHERE h.most IS NULL OR 100 * h.most < 50 * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r.r AS BIGINT) AS r, n, score
FROM ranked r JOIN n ON n.lang = r.lang WHERE rank <= 2000
"""
}
