"""Removing lines that many documents share.

Lines are exploded, normalised and hashed; documents are counted by hash; lines
whose hash stands in enough documents go; what is left is put together again in
the order of its positions.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointspark.llm.names import free_names
from pointspark.session import materialize

MIN_CHARS = 1
MIN_DOCS = 10
#: Frequent hashes (16 bytes each) that are sent to every worker; more are joined instead.
BROADCAST_LIMIT = 1_000_000


def line_keys(text: str | None, min_chars: int) -> list[bytes | None]:
    """A 128-bit hash for each line of text; None for a line whose key is too short to count.

    Null and empty texts are one empty line. A key is the line without
    whitespace at its ends, A-Z in lower case.
    """
    keys: list[bytes | None] = []
    for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n"):
        key = line.strip(b" \t\n\r\x0b\x0c").lower()
        # UTF-8 bytes bound the code points from above
        if len(key) < min_chars or len(key.decode("utf-8", "surrogatepass")) < min_chars:
            keys.append(None)
        else:
            keys.append(xxhash.xxh3_128_digest(key))
    return keys


def frequent_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(key, n_docs) for the line keys found in at least min_docs documents of docs (doc_id, text).

    Rows with one doc_id are one document; a row without one is a document of
    its own. Null and empty texts are one empty line. An empty table has no
    frequent lines.
    """
    twice = materialize(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated-ids")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: Counter[bytes] = Counter()
            for text in b.column(0):
                found.update({k for k in line_keys(text.as_py(), min_chars) if k is not None})
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["key", "n"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = {(i, k) for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True) for k in line_keys(text.as_py(), min_chars) if k is not None}
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([k for _, k in found], pa.binary())], ["doc_id", "key"])

    alone, repeated = docs.select("doc_id", "text"), None
    if twice.limit(1).count():
        repeated = alone.join(twice, "doc_id", "left_semi").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pairs, "doc_id long, key binary").distinct()
        alone = alone.join(twice, "doc_id", "left_anti")
    counts = alone.select("text").mapInArrow(count, "key binary, n long")
    if repeated is not None:
        counts = counts.unionByName(repeated.groupBy("key").agg(F.count("*").alias("n")))
    return counts.groupBy("key").agg(F.sum("n").alias("n_docs")).where(F.col("n_docs") >= min_docs)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, broadcast_limit: int = BROADCAST_LIMIT) -> tuple[DataFrame, list[str]]:
    """docs with shared lines taken out of text, and the names of two added columns: lines before, and dropped.

    Keys of at least min_chars code points found in at least min_docs documents
    lose all their lines. Rows with one doc_id are one document and a row with a
    null doc_id is one of its own; a line that a document repeats counts once. Null and empty
    texts are one empty line and come out empty. Other columns stay; the added
    names change where docs has them. An empty table gives an empty one.

    The frequent hashes are counted first: up to broadcast_limit they are sent
    to the workers and no text is shuffled; beyond it, the positions of dropped
    lines are found by a join on the hash and brought to their documents.
    """
    n_lines, n_dropped, drop, u, v = free_names(docs.columns, "n_lines", "n_dropped", "drop_positions", "uid1", "uid2")
    hot = materialize(frequent_lines(docs, min_chars, min_docs).select("key"), "frequent-lines")
    n_hot = hot.count()
    out_schema = T.StructType([*docs.schema.fields, T.StructField(n_lines, T.LongType()), T.StructField(n_dropped, T.LongType())])
    columns = docs.columns
    at_text = columns.index("text")

    def rebuilt(b: pa.RecordBatch, dropped) -> pa.RecordBatch:
        """b with the lines whose index i in row r satisfies dropped(r, keys, i) taken out."""
        texts, before, gone = [], [], []
        for r, text in enumerate(b.column(at_text)):
            text = text.as_py() or ""
            out = dropped(r, text)
            lines = text.split("\n")
            texts.append("\n".join(x for x, d in zip(lines, out, strict=True) if not d) if any(out) else text)
            before.append(len(lines))
            gone.append(sum(out))
        arrays = [pa.array(texts, b.schema.field(i).type) if i == at_text else b.column(i) for i in range(len(columns))]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(before, pa.int64()), pa.array(gone, pa.int64())], [*columns, n_lines, n_dropped])

    if n_hot <= broadcast_limit:
        keys = docs.sparkSession.sparkContext.broadcast(b"".join(bytes(r[0]) for r in hot.toLocalIterator()))

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            raw = keys.value
            found = {raw[i : i + 16] for i in range(0, len(raw), 16)}
            for b in batches:
                yield rebuilt(b, lambda r, text: [k in found for k in line_keys(text, min_chars)])

        return docs.mapInArrow(apply, out_schema), [n_lines, n_dropped]

    marked = docs.withColumns({u: F.xxhash64("doc_id", "text"), v: F.xxhash64("text", "doc_id", F.lit(1))})

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            us, vs, positions, keys = [], [], [], []
            for a, c, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                for i, k in enumerate(line_keys(text.as_py(), min_chars)):
                    if k is not None:
                        us.append(a), vs.append(c), positions.append(i), keys.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64()), pa.array(positions, pa.int32()), pa.array(keys, pa.binary())], [u, v, "i", "key"])

    lines = marked.select(u, v, "text").mapInArrow(explode, f"`{u}` long, `{v}` long, i int, key binary")
    gone = lines.join(hot, "key", "left_semi").groupBy(u, v).agg(F.collect_set("i").alias(drop))
    joined = marked.join(gone, [u, v], "left").select(*columns, drop)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            positions = [set(x or ()) for x in b.column(len(columns)).to_pylist()]
            yield rebuilt(b, lambda r, text, p=positions: [i in p[r] for i in range(text.count("\n") + 1)])

    return joined.mapInArrow(take, out_schema), [n_lines, n_dropped]


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out, _ = dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


QUERIES = {"op10_line_dedup": op10_line_dedup}
SQL = {
    "op10_line_dedup": r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
e AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
k AS (SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e),
hot AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT k.doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(hot.key) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE hot.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN hot ON k.key = hot.key GROUP BY k.doc_id
"""
}
