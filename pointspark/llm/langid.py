"""Language identification by rank-order profiles of character n-grams.

A profile lists a language's most frequent n-grams (one to three characters,
words padded with a space) by rank. A document's own list is compared with each
profile by the out-of-place distance: how far each of its n-grams stands from
its rank there, a fixed maximum where it is missing.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointspark.llm.names import free_names
from pointspark.session import materialize, worker_cache

#: N-grams in a profile and in a document's list.
RANKS = 300
#: Documents of a language, expected, from which its profile is learned.
TRAIN_DOCS = 4000
FOLDS = 5


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return worker_cache("letters", lambda: np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))


def ngrams(text: str, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams in text, ascending, and how often each occurs; nothing for a text without letters."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    c = np.where(table[c], c, 32)
    space = c == 32
    if space.all():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keep = ~space
    keep[1:] |= keep[:-1]  # the first space of a run
    c = np.concatenate([[32], c[keep]] if not space[0] else [c[keep]] if keep[0] else [[32], c[keep]])
    if c[-1] != 32:
        c = np.concatenate([c, [32]])
    two = c[:-1] | c[1:] << 21
    three = two[:-1] | c[2:] << 42
    # a space in the middle is where one word ends and another begins
    return np.unique(np.concatenate([c[c != 32], two, three[c[1:-1] != 32]]), return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """The n most frequent codes by falling count, then by code."""
    if len(codes) > n:
        least = np.partition(counts, len(counts) - n)[len(counts) - n]
        some = counts >= least
        codes, counts = codes[some], counts[some]
    return codes[np.lexsort((codes, -counts))][:n]


def learn_profiles(docs: DataFrame, ranks: int = RANKS, train_docs: int = TRAIN_DOCS, seed: int = 7) -> dict[str, list[int]]:
    """language -> its n-grams by rank, from docs (doc_id, text, lang).

    Of each language about train_docs documents are used (all, where there are
    fewer), chosen by a hash of doc_id and text. Rows without text or lang teach
    nothing; an empty table gives no profiles. What comes to the driver is ranks
    n-grams for each value of lang, so that column has to name languages.
    """
    known = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null")
    # written, so that the planner knows its size
    sizes = materialize(known.groupBy(F.col("lang").alias("of")).agg(F.count("*").alias("n")), "languages")
    rate = F.least(F.lit(1.0), F.lit(float(train_docs)) / F.col("n")) * (1 << 30)
    drawn = known.withColumn("draw", F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(1 << 30))).join(sizes, F.col("lang") == F.col("of")).where(F.col("draw") < rate)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = letters()
        for b in batches:
            by: dict[str, list] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                by.setdefault(lang, []).append(ngrams(text.as_py(), table))
            for lang, found in by.items():
                codes, at = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
                n = np.bincount(at, np.concatenate([x for _, x in found]), len(codes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n)], ["lang", "code", "n"])

    counted = drawn.select("lang", "text").mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    best = counted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))).where(F.col("rank") <= ranks)
    out: dict[str, list[int]] = {}
    for r in best.orderBy("lang", "rank").select("lang", "code").collect():
        out.setdefault(r.lang, []).append(r.code)
    return out


def identify(docs: DataFrame, profiles: dict[str, list[int]], ranks: int = RANKS) -> tuple[DataFrame, list[str]]:
    """docs with the predicted language and a score, and the names of the two added columns.

    The score is 1 at distance 0 and 0 at the largest distance. Equal distances
    go to the smaller language name. Null texts and texts without a letter get
    `und` and 0, and so do all where there are no profiles. Only text is read,
    whole and however long. Repeated rows and null doc_ids are rows like any
    other; other columns stay. An empty table gives no rows.
    """
    pred, score = free_names(docs.columns, "lang_pred", "score")
    langs = sorted(profiles)
    vocabulary = np.array(sorted({c for p in profiles.values() for c in p}), np.int64)
    place = np.full((len(vocabulary) + 1, len(langs)), -1, np.int64)  # the last row: an n-gram of no profile
    for i, lang in enumerate(langs):
        place[np.searchsorted(vocabulary, profiles[lang]), i] = np.arange(len(profiles[lang]))
    at_text, names = docs.columns.index("text"), [*docs.columns, pred, score]

    def judge(text: str | None, table: np.ndarray) -> tuple[str, float]:
        codes, counts = ngrams(text, table) if text else ((), ())
        if not len(codes) or not langs:
            return "und", 0.0
        own = ranked(codes, counts, ranks)
        i = np.searchsorted(vocabulary, own)
        i[i == len(vocabulary)] = 0
        there = place[np.where(vocabulary[i] == own, i, len(vocabulary))]
        distance = np.where(there >= 0, np.abs(there - np.arange(len(own))[:, None]), ranks).sum(axis=0)
        best = int(distance.argmin())
        return langs[best], 1.0 - float(distance[best]) / (ranks * len(own))

    def batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = letters()
        for b in batches:
            found = [judge(x.as_py(), table) for x in b.column(at_text)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names)

    from pyspark.sql import types as T

    return docs.mapInArrow(batch, T.StructType([*docs.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])), [pred, score]


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept from learning: crc32 of its id's digits leaves no remainder; rows without an id are not, but teach nothing either."""
    return F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    profiles = learn_profiles(docs.where(~held_out()))
    out, _ = identify(docs.select("doc_id", "text"), profiles)
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


QUERIES = {"op8_language_id": op8_language_id}
SQL: dict[str, str] = {}
