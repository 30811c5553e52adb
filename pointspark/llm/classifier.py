"""Document quality by hierarchical empirical Bayes.

A classifier gives each document evidence from its text. The documents of a
host, and those of a path of a host, tell how good their neighbours are: a
path's mean is shrunk towards its host's, and a host's towards the global one,
the more so the fewer documents there are; how much is estimated from the spread
of the means. A document's posterior combines its own evidence with what its
path says without it.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointspark.llm.urlfilter import host_and_path
from pointspark.session import materialize

#: Labelled documents, expected, on which the classifier is trained.
TRAIN_DOCS = 20_000
LIMIT = 0.5
#: Parts into which the rows of one place are dealt.
SALTS = 16
#: Bounds of the estimated weight of a prior, in documents.
STRENGTH = (1.0, 1e4)
#: Evidence counts at most so much, as log odds.
MOST_EVIDENCE = 12.0

CLASSES = ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "capitals"), (b"0123456789", "digits"), (b"#*$%&|<>=~^_{}[]\\@", "symbols"), (b"!?", "marks"), (b".,;:", "stops"), (b"\n", "line ends"))
N_FEATURES = len(CLASSES) + 6


def features(text: str | None) -> list[float]:
    """Shares and logarithms that describe how a text is written."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    bytes_ = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if raw else np.zeros(256, np.int64)
    words = raw.split()
    n, size = max(1, len(words)), max(1, len(raw))
    found = Counter(words)
    out = [float(bytes_[list(c)].sum()) / size for c, _ in CLASSES]
    out += [len(found) / n, max(found.values(), default=0) / n, size / n / 10, math.log1p(len(words)) / 5]
    out += [sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, float(bytes_[194:].sum()) / size]
    return out


def feature_rows(b: pa.RecordBatch, column: int) -> np.ndarray:
    return np.array([features(x.as_py()) for x in b.column(column)], np.float64).reshape(-1, N_FEATURES)


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, rounds: int = 300, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Means, deviations, weights and intercept of a logistic regression on labels (doc_id, label 0 or 1).

    About train_docs labelled ids are drawn by hash and sent to every task;
    their features, a bounded number of rows, come to the driver. Labels with a
    null are left out; of several labels of an id the largest counts. The
    intercept is that of equally many good and bad documents, so the result is
    evidence alone. Without labels of both kinds there is no evidence.
    """
    known = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    n = known.count()
    rate = min(1.0, train_docs / n) if n else 0.0
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < F.lit(int(rate * (1 << 30))))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = feature_rows(b, 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * N_FEATURES, pa.int32()), pa.array(x.ravel()))], ["label", "x"])

    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("label", "text").mapInArrow(describe, "label int, x array<double>").toPandas()
    zero = np.zeros(N_FEATURES)
    if rows["label"].nunique() < 2:
        return zero, zero + 1, zero, 0.0
    x, y = np.stack(rows["x"].to_numpy()), rows["label"].to_numpy(np.float64)
    order = np.lexsort((*x.T, y))  # sums do not depend on the order in which rows came
    x, y = x[order], y[order]
    mean, dev = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.column_stack([(x - mean) / dev, np.ones(len(x))])
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y).mean())
    w = np.zeros(N_FEATURES + 1)
    for _ in range(rounds):  # Newton steps, damped by the ridge
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (weight * (p - y)) / len(y) + ridge * w
        h = (z * (weight * p * (1 - p))[:, None]).T @ z / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return mean, dev, w[:-1], float(w[-1])


def logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def strength(groups: DataFrame, n: str, total: str, mean: float) -> float:
    """The weight of the prior, in documents: what makes the groups' means as spread as they are."""
    spread = mean * (1 - mean)
    r = groups.agg(F.sum(n).alias("n"), F.sum(F.col(n) * F.pow(F.col(total) / F.col(n) - F.lit(mean), 2)).alias("d"), F.count("*").alias("g"), F.sum(F.col(n) * F.col(n)).alias("nn")).first()
    if not r.g or r.g < 2 or spread <= 0:
        return STRENGTH[1]
    room = r.n - r.nn / r.n
    between = (r.d - (r.g - 1) * spread) / room if room > 0 else 0.0
    return STRENGTH[1] if between <= 0 else min(STRENGTH[1], max(STRENGTH[0], spread / between - 1))


def score_quality(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", limit: float = LIMIT, train_docs: int = TRAIN_DOCS, url: str | None = None) -> tuple[DataFrame, list[str]]:
    """(doc_id, host, path, evidence, host_posterior, path_posterior, quality, keep) for every row of docs, and the last five names.

    labels: (doc_id, label), 1 for good. host and path name the columns of docs
    that say where a document is from, or url the column from which both come
    (of the path, its first part); a null is a place of its own. evidence is
    in log odds; the posteriors are probabilities; keep is quality >= limit.
    Null and empty texts count by their features like any text; texts are read
    whole, however long. Repeated rows and null doc_ids are rows like any other.
    An empty table gives no rows.
    """
    mean, dev, w, b = train(docs, labels, train_docs)
    if url is None:
        from_host, from_path = F.col(host).cast("string"), F.col(path).cast("string")
    else:
        from_host, rest = host_and_path(F.col(url))
        from_path = F.regexp_extract(rest, "^/[^/]*", 0)
    slim = docs.select("doc_id", from_host.alias("host"), from_path.alias("path"), "text")

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            e = np.clip((feature_rows(x, 3) - mean) / dev @ w + b, -MOST_EVIDENCE, MOST_EVIDENCE)
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), x.column(2), pa.array(e)], ["doc_id", "host", "path", "evidence"])

    schema = T.StructType([*slim.schema.fields[:3], T.StructField("evidence", T.DoubleType())])
    place = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("null"))
    own = materialize(slim.mapInArrow(evidence, schema), "evidence").withColumns({"hk": place("host"), "pk": place("path"), "p": 1 / (1 + F.exp(-F.col("evidence"))), "salt": F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")})
    # sums are rounded, so that they do not depend on the order of the rows
    paths = materialize(own.groupBy("hk", "pk").agg(F.count("*").alias("n"), F.sum(F.round("p", 6).cast("decimal(20,6)")).cast("double").alias("s"), F.collect_set("salt").alias("salts")), "path-sums")
    hosts = paths.groupBy("hk").agg(F.sum("n").alias("hn"), F.sum(F.col("s").cast("decimal(38,6)")).cast("double").alias("hs"))
    total = hosts.agg(F.sum("hn").alias("n"), F.sum(F.col("hs").cast("decimal(38,6)")).cast("double").alias("s")).first()
    mu = total.s / total.n if total.n else 0.5
    k_host, k_path = strength(hosts, "hn", "hs", mu), strength(paths, "n", "s", mu)
    host_mean = (F.col("hs") + F.lit(k_host * mu)) / (F.col("hn") + F.lit(k_host))
    places = materialize(paths.join(hosts.select("hk", host_mean.alias("host_posterior")), "hk"), "path-posteriors")
    # a place may hold a third of all rows: it is met in as many parts as its rows are dealt into, SALTS at most
    joined = own.join(places.withColumn("salt", F.explode("salts")), ["hk", "pk", "salt"])
    prior = F.col("host_posterior") * F.lit(k_path)
    without = (F.col("s") - F.col("p") + prior) / (F.col("n") - 1 + F.lit(k_path))
    out = joined.withColumns({"path_posterior": (F.col("s") + prior) / (F.col("n") + F.lit(k_path)), "quality": 1 / (1 + F.exp(-(F.col("evidence") + logit(without))))})
    return out.select("doc_id", "host", "path", "evidence", "host_posterior", "path_posterior", "quality", (F.col("quality") >= limit).alias("keep")), ["evidence", "host_posterior", "path_posterior", "quality", "keep"]


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    out, _ = score_quality(docs, labels)
    return out


QUERIES = {"op3_quality_classifier": op3_quality_classifier}
SQL: dict[str, str] = {}
