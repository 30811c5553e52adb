"""URL filters: rules by host and path, and logistic regression on hashed character n-grams.

A rule decides where one fits. Every other URL gets the verdict of a classifier
over character n-grams of its host and path, hashed into a fixed number of
buckets, which is trained on a small table of labelled URLs.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointspark.llm.names import free_names

#: (verdict, host, path): fits the host and its subdomains where the path starts with the rule's.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
BUCKETS = 1 << 14
SIZES = (3, 4, 5)
#: Rows of a labelled table that are used at most; it is read to the driver.
MOST_LABELLED = 5000
#: Blocked from here on: on unseen hosts of the built-in table (ten parts, by host) all that it blocks is labelled so, and it blocks 0.69 of these; at 0.5 that is 0.99 and 0.78.
LIMIT = 0.6

#: The built-in table: lines of label and url, with their origin at the top.
LABELLED = os.path.join(os.path.dirname(os.path.abspath(__file__)), "labelled_urls.tsv")


def labelled_urls(path: str = LABELLED) -> list[tuple[str, int]]:
    """(url, 1 for block or 0 for allow) of a table's lines; those that begin with # are left out. Read on the driver."""
    with open(path, encoding="utf-8") as f:
        rows = [line.rstrip("\n").split("\t") for line in f if line.strip() and not line.startswith("#")]
    return [(url, int(label)) for label, url in rows]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a URL; both empty for null and where there is no ://."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.coalesce(F.regexp_extract(url, pattern, 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def split_url(url: str) -> tuple[str, str]:
    """The same on the driver, for training."""
    head, sep, rest = url.partition("://")
    if not sep:
        return "", ""
    at = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    path = rest[at:].split("?")[0].split("#")[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:at]), path


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Index of the longest rule (by host and path together) that fits; null if none does. Rules of equal length go by their order."""
    out = F.lit(None).cast("int")
    for i in sorted(range(len(rules)), key=lambda i: (len(rules[i][1] + rules[i][2]), -i)):
        _, h, p = rules[i]
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.lit(i)).otherwise(out)
    return out


def ngram_buckets(host: str, path: str, buckets: int = BUCKETS, sizes: tuple[int, ...] = SIZES) -> np.ndarray:
    """Distinct buckets of the n-grams of host and of path, each marked at its ends; hosts and paths hash apart."""
    found = set()
    for mark, s in (("h", host), ("p", path)):
        s = f"^{s}$"
        for n in sizes:
            found.update(zlib.crc32((mark + s[i : i + n]).encode("utf-8", "surrogatepass")) % buckets for i in range(max(0, len(s) - n) + 1))
    return np.fromiter(sorted(found), np.int64, len(found))


def train(rows: list[tuple[str, int]], buckets: int = BUCKETS, sizes: tuple[int, ...] = SIZES, rounds: int = 300, rate: float = 2.0, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights by bucket and an intercept, by gradient steps on the whole table; each row's features have norm 1."""
    x = [ngram_buckets(*split_url(u), buckets, sizes) for u, _ in rows]
    at, col = np.repeat(np.arange(len(x)), [len(v) for v in x]), np.concatenate(x) if x else np.zeros(0, np.int64)
    unit = 1 / np.sqrt(np.array([len(v) for v in x]))[at] if x else np.zeros(0)
    y, w, b = np.array([float(v) for _, v in rows]), np.zeros(buckets), 0.0
    for _ in range(rounds if len(rows) else 0):
        z = np.bincount(at, w[col] * unit, len(x)) + b
        miss = 1 / (1 + np.exp(-z)) - y
        w -= rate * (np.bincount(col, miss[at] * unit, buckets) / len(x) * 10 + ridge * w)
        b -= rate * miss.mean()
    return w, float(b)


def filter_urls(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES, limit: float = LIMIT, most_labelled: int = MOST_LABELLED) -> tuple[DataFrame, list[str]]:
    """pages with host, path, rule, block_score and verdict of their url, and the names of these columns.

    labelled has url and label (1: block); rows with a null in either are left
    out and most_labelled are used, first by hash. Without it the built-in
    table is used. rule is host and path of the longest rule that fits, or null;
    then the classifier decides: block from limit on. Null urls and such
    without :// have empty host and path, which no rule fits. Urls are read whole,
    however long. Repeated rows are rows like any other; other columns stay. An
    empty table gives no rows.
    """
    rows = labelled_urls()
    if labelled is not None:
        known = labelled.where("url is not null and label is not null").select("url", F.col("label").cast("int").alias("label"))
        rows = [(r.url, r.label) for r in known.orderBy(F.xxhash64("url"), "url", "label").limit(most_labelled).collect()]
    w, b = train(rows)
    names = free_names(pages.columns, "host", "path", "rule", "block_score", "verdict")
    host, path, rule, score, verdict = names
    h, p = host_and_path(F.col("url"))
    df = pages.withColumns({host: h, path: p})
    at_host, columns = len(pages.columns), [*pages.columns, host, path, score]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            z = []
            for own_host, own_path in zip(x.column(at_host).to_pylist(), x.column(at_host + 1).to_pylist(), strict=True):
                found = ngram_buckets(own_host, own_path)
                z.append(w[found].sum() / np.sqrt(len(found)) + b)
            yield pa.RecordBatch.from_arrays([*x.columns, pa.array(1 / (1 + np.exp(-np.array(z, np.float64))))], columns)

    scored = df.mapInArrow(judge, T.StructType([*df.schema.fields, T.StructField(score, T.DoubleType())]))
    i = longest_rule(F.col(host), F.col(path), rules)
    texts, verdicts = F.array(*[F.lit(h + p) for _, h, p in rules]), F.array(*[F.lit(v) for v, _, _ in rules])
    by_score = F.when(F.col(score) >= limit, "block").otherwise("allow")
    out = scored.withColumns({rule: F.get(texts, i), verdict: F.coalesce(F.get(verdicts, i), by_score)}) if rules else scored.withColumns({rule: F.lit(None).cast("string"), verdict: by_score})
    return out.select(*pages.columns, *names), names


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    out, _ = filter_urls(pages)
    return out.drop("url")


QUERIES = {"op5_url_filters": op5_url_filters}
SQL: dict[str, str] = {}
