"""Quality rules: counts from each text, and a log-likelihood ratio of hashed n-grams.

Two multinomials over hashed n-grams are estimated, one from trusted documents
and one from the whole corpus. A document's verdict is the mean, over its
n-grams, of the logarithm of their ratio, against a fixed threshold. The n-grams
are single words, and pairs of neighbouring words by shape (runs of small
letters, capitals and digits each as one character), which tell how a text is
written whatever it is about.

DataFrame operations only; the lambdas run on arrays inside a row, and nothing
but the bucket counts is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointspark.llm.names import free_names

SPACE = r"[\x20\x09-\x0D]+"
TRIM = " \t\n\x0b\x0c\r"
#: Buckets for words, and as many again for pairs of shapes.
BUCKETS = 1 << 13
#: Trusted documents, expected, from which the target is estimated.
TRUSTED = 20_000
#: Added to every bucket's share, in documents' n-grams per bucket.
SMOOTHING = 1.0
#: The least mean log ratio of a document that is kept.
THRESHOLD = -0.2

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def shapes(text: Column) -> Column:
    """The words of text with runs of small letters as a, of other letters as A, of digits as 9; as many as its words."""
    return words(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\p{Ll}+", "a"), r"[\p{L}&&[^a]]+", "A"), "[0-9]+", "9"))


def grams(word: str, shape: str, buckets: int) -> Column:
    """Buckets of a row's n-grams, given the names of its array columns."""
    single = F.transform(word, lambda x: F.xxhash64(x).bitwiseAND(F.lit(buckets - 1)))
    # the shapes are referred to twice, so they are computed once a row
    pair = F.transform(F.sequence(F.lit(1), F.size(shape)), lambda i: F.xxhash64(F.get(shape, i - 1), F.get(shape, i)).bitwiseAND(F.lit(buckets - 1)) + F.lit(buckets))
    return F.concat(single, F.when(F.size(shape) > 0, pair).otherwise(F.array().cast("array<bigint>")))


def fit(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, most_trusted: int = TRUSTED, smoothing: float = SMOOTHING) -> list[float]:
    """The log ratio of each bucket, 2 * buckets of them: target share over corpus share.

    trusted holds the doc_ids of trusted documents; about most_trusted of them
    are used (all, if there are fewer), drawn by hash, so that they may be sent
    to every task. The corpus counts cover every row of docs. Without trusted
    documents all ratios are 0.
    """
    ids = trusted.select("doc_id").where("doc_id is not null").distinct()
    n = ids.count()
    rate = min(1.0, most_trusted / n) if n else 0.0
    drawn = ids.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < F.lit(int(rate * (1 << 30)))).withColumn("t", F.lit(1))
    w, s, g = "w", "s", "g"
    base = docs.select("doc_id", words(F.col("text")).alias(w), shapes(F.col("text")).alias(s)).join(F.broadcast(drawn), "doc_id", "left")
    found = base.select("t", F.explode(grams(w, s, buckets)).alias(g)).groupBy(g).agg(F.count("*").alias("n"), F.count("t").alias("k")).collect()
    corpus, target = [0] * (2 * buckets), [0] * (2 * buckets)
    for r in found:
        corpus[r.g], target[r.g] = r.n, r.k
    out = []
    for at in (0, buckets):
        c, t = corpus[at : at + buckets], target[at : at + buckets]
        all_c, all_t = sum(c) + smoothing * buckets, sum(t) + smoothing * buckets
        out += [math.log(((y + smoothing) / all_t) / ((x + smoothing) / all_c)) if sum(t) else 0.0 for x, y in zip(c, t, strict=True)]
    return out


def judge(docs: DataFrame, ratios: list[float], threshold: float = THRESHOLD) -> tuple[DataFrame, list[str]]:
    """docs with counts and verdict, and the names of the added columns: n_words,
    word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, ratio, kept.

    Null and empty texts have no words and fail; texts are read whole, however
    long. Repeated rows and null doc_ids are rows like any other; other columns
    stay. An empty table gives no rows. Windows of three words are compared by
    64-bit hashes.
    """
    names = free_names(docs.columns, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "ratio", "kept")
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat, failed, ratio, kept = names
    w, s, h, st, sp, lines = free_names([*docs.columns, *names], "w", "s", "h", "st", "sp", "lines")
    buckets = len(ratios) // 2
    text = F.coalesce("text", F.lit(""))
    df = docs.withColumns({w: words(F.col("text")), s: shapes(F.col("text")), lines: F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(TRIM)) != "")})
    n = F.size(w)
    window = F.transform(F.sequence(F.lit(2), n - 1), lambda i: F.xxhash64(F.get(w, i - 2), F.get(w, i - 1), F.get(w, i)))
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    total = F.aggregate(grams(w, s, buckets), F.lit(0.0), lambda a, x: a + F.get(table, x.cast("int")))
    df = df.withColumns({
        h: F.when(n >= 3, window).otherwise(F.array().cast("array<bigint>")),
        n_words: n.cast("long"),
        word_chars: F.length(F.array_join(w, "")).cast("long"),
        n_symbols: (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long"),
        n_dup_lines: (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        ratio: F.coalesce(F.try_divide(total, F.size(w) + F.size(s)), F.lit(0.0)),
    }).drop(w, s, lines)
    # hashes with their places, in order, where any hash comes twice
    placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    df = df.withColumn(st, F.when(F.size(F.array_distinct(h)) < F.size(h), placed)).drop(h)
    same = lambda j, k: F.get(st, j)["h"] == F.get(st, k)["h"]
    twice = F.filter(F.sequence(F.lit(0), F.size(st) - 1), lambda j: F.coalesce(same(j, j - 1), F.lit(False)) | F.coalesce(same(j, j + 1), F.lit(False)))
    df = df.withColumn(sp, F.when(F.col(st).isNotNull(), F.sort_array(F.transform(twice, lambda j: F.get(st, j)["i"])))).drop(st)
    # a window covers three words, or as many as there are before the next one
    covered = F.aggregate(F.sequence(F.lit(1), F.size(sp)), F.lit(0), lambda a, k: a + F.least(F.lit(3), F.coalesce(F.get(sp, k) - F.get(sp, k - 1), F.lit(3))))
    df = df.withColumn(n_repeat, F.when(F.col(sp).isNotNull(), covered).otherwise(0).cast("long")).drop(sp)
    df = df.withColumn(failed, (F.col(n_words) < MIN_WORDS) | (100 * F.col(n_repeat) > MAX_REPEAT_PERCENT * F.col(n_words)))
    return df.withColumn(kept, ~F.col(failed) & (F.col(ratio) >= threshold)).select(*docs.columns, *names), names


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    out, _ = judge(docs, fit(docs, trusted))
    return out.drop("text")


QUERIES = {"op9_quality_rules": op9_quality_rules}
SQL: dict[str, str] = {}
