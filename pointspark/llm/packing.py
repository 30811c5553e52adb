"""Packing documents into fixed-length training sequences.

Tokens of the documents, in row order, form one stream per input split. Cuts
between sequences are chosen by dynamic programming: the cost of a sequence is
its padding plus a penalty for where it ends (nothing at a document's end, a
little at a sentence's end, more inside a sentence). The best predecessor of
each cut lies in a sliding window of `length` tokens, so a monotone queue gives
it in constant time. Sequences whose length is a power of two need no padding
and enter as extra transitions.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession

from pointspark.llm.names import free_names
from pointspark.session import worker_cache

LENGTH = 1024
SENTENCE_PENALTY = 3
INSIDE_PENALTY = 24
#: A cut inside a sentence may fall at every so many tokens of the stream.
INSIDE_STEP = 64
#: Lengths below the full one that enter the programme as unpadded sequences.
SHORT = (512, 256, 128)
#: Tokens gathered before a run of the dynamic programme.
BLOCK = 1 << 17
SEPARATOR = 0

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: Characters on which every implementation of the splitting pattern agrees;
#: other texts go through the reference library itself.
PLAIN = re.compile("[\t\n\r -~¡-¬®-ɏ]*")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Token ids of a text, the same as tokenizers gives for the file.

    The rank file beside a byte-level vocabulary holds the same merges and is
    read by a faster library; texts with special strings or unusual characters
    take the slower one, whose ids define the result.
    """

    def __init__(self, path: str | None = None):
        import base64
        import os

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        path = path or tokenizer_path()
        self.exact = Tokenizer.from_file(path)
        self.fast = None
        twin = os.path.splitext(path)[0] + ".tiktoken"
        if os.path.exists(twin):
            with open(twin, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("twin", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        size = self.exact.get_vocab_size()
        self.ends = np.zeros(size, bool)
        for token, i in self.exact.get_vocab().items():
            # a full stop, mark or line end closes a sentence; Ċ is how the vocabulary writes \n
            self.ends[i] = token[-1:] in (".", "!", "?", "Ċ")

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None and "<|" not in text and PLAIN.fullmatch(text):
            return self.fast.encode_to_numpy(text).astype(np.int64)
        return np.asarray(self.exact.encode(text, add_special_tokens=False).ids, np.int64)


def best_cuts(pos: list[int], penalty: list[int], length: int = LENGTH, short: tuple[int, ...] = SHORT) -> list[int]:
    """Positions at which to cut, of the candidates pos (ascending, from 0, the last forced).

    Minimises, over all sequences, length minus tokens (nothing at a power of
    two in short) plus the penalty of each cut. Gaps must not exceed length.
    """
    m = len(pos)
    dp, back = [0] * m, [0] * m
    at = {p: i for i, p in enumerate(pos)}
    queue: deque[int] = deque([0])
    key = [0] * m  # dp + pos: what the queue is ordered by
    for j in range(1, m):
        p = pos[j]
        low = p - length
        while pos[queue[0]] < low:
            queue.popleft()
        i = queue[0]
        best = key[i] + length - p
        for s in short:
            k = at.get(p - s)
            if k is not None and dp[k] < best:
                best, i = dp[k], k
        best += penalty[j]
        dp[j], back[j] = best, i
        k = key[j] = best + p
        while queue and key[queue[-1]] >= k:
            queue.pop()
        queue.append(j)
    cuts, j = [], m - 1
    while j > 0:
        cuts.append(pos[j])
        j = back[j]
    return cuts[::-1]


def candidates(ends: np.ndarray, docs: np.ndarray, total: int, step: int, sentence: int, inside: int) -> tuple[list[int], list[int]]:
    """Candidate cut positions in a stream of total tokens, and their penalties."""
    cost = np.full(total + 1, -1, np.int64)
    cost[step:total:step] = inside
    cost[np.flatnonzero(ends) + 1] = sentence
    cost[docs] = 0
    cost[0] = cost[total] = 0
    pos = np.flatnonzero(cost >= 0)
    return pos.tolist(), cost[pos].tolist()


def tail_cuts(n: int, length: int, inside: int) -> list[int]:
    """Cut positions in a last sequence of n < length tokens: powers of two, if that costs less than its padding."""
    if n == 0 or n & (n - 1) == 0 or length - n <= inside * (n.bit_count() - 1):
        return [n] if n else []
    cuts, at = [], 0
    for b in range(n.bit_length() - 1, -1, -1):
        if n >> b & 1:
            at += 1 << b
            cuts.append(at)
    return cuts


class Packer:
    """Takes documents one by one; yields rows of SCHEMA (and ids) as sequences are complete."""

    def __init__(self, ends: np.ndarray, first_sequence: int, length: int, step: int, sentence: int, inside: int):
        self.ends, self.sequence, self.length = ends, first_sequence, length
        self.step, self.sentence, self.inside = step, sentence, inside
        self.docs: list[tuple] = []  # doc_id, ids left, ids before them, ids in all
        self.size = 0

    def add(self, doc_id, ids: np.ndarray) -> Iterator[tuple]:
        self.docs.append((doc_id, ids, 0, len(ids)))
        self.size += len(ids)
        if self.size >= BLOCK:
            yield from self.run(last=False)

    def run(self, last: bool) -> Iterator[tuple]:
        if not self.size:
            return
        stream = np.concatenate([d[1] for d in self.docs])
        stops = np.cumsum([len(d[1]) for d in self.docs])
        pos, cost = candidates(self.ends[stream], stops, self.size, self.step, self.sentence, self.inside)
        cuts = best_cuts(pos, cost, self.length, SHORT if self.length == LENGTH else ())
        # what stands after the last cut but one waits for more documents
        before = cuts[-2] if len(cuts) > 1 else 0
        if not last:
            cuts = cuts[:-1]
        else:
            cuts = cuts[:-1] + [before + c for c in tail_cuts(self.size - before, self.length, self.inside)]
        k, begin = 0, 0
        starts = np.concatenate([[0], stops[:-1]])
        for cut in cuts:
            offset = 0
            while begin < cut:
                doc_id, _, skipped, total = self.docs[k]
                end = min(cut, int(stops[k]))
                ids = stream[begin:end]
                crc = zlib.crc32(ids.astype("<u4").tobytes())
                yield doc_id, skipped + begin - int(starts[k]), end - begin, crc, total, self.sequence, offset, ids
                offset += end - begin
                begin = end
                k += end == stops[k]
            self.sequence += 1
        rest = self.docs[k:]
        if rest:
            doc_id, ids, skipped, total = rest[0]
            used = begin - int(starts[k])
            rest[0] = doc_id, ids[used:], skipped + used, total
        self.docs, self.size = rest, self.size - begin


def pack(
    docs: DataFrame,
    length: int = LENGTH,
    tokenizer: str | None = None,
    with_ids: bool = False,
    sentence_penalty: int = SENTENCE_PENALTY,
    inside_penalty: int = INSIDE_PENALTY,
    inside_step: int = INSIDE_STEP,
    order: tuple[str | Column, ...] = (),
) -> DataFrame:
    """Pack docs (doc_id, text) into sequences of at most length tokens.

    One row per piece of a document in a sequence: SCHEMA, and with_ids the
    piece's token ids. A part is read as a stream with one block of tokens in
    memory. Without an order, rows of an input split keep theirs and nothing is
    shuffled. With one, rows are range-partitioned and sorted by it, and
    sequence ids rise with it.

    Null and empty texts are documents of the separator alone. A null doc_id is
    carried through. Repeated rows are packed each. A text longer than a
    sequence goes on in the next ones. An empty table gives no rows. Other
    columns are ignored.
    """
    if length < inside_step:
        raise ValueError("length must not be below inside_step")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_cache(f"encoder {tokenizer}", lambda: Encoder(tokenizer))
        packer = Packer(encoder.ends, TaskContext.get().partitionId() << 33, length, inside_step, sentence_penalty, inside_penalty)
        separator = np.array([SEPARATOR], np.int64)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            arrays = [pa.array(c, pa.int64()) for c in cols[:7]]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in cols[7]])])
                arrays.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(cols[7]), pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(arrays, names)

        rows: list[tuple] = []
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.concatenate([encoder.ids(text.as_py() or ""), separator])
                rows.extend(packer.add(doc_id, ids))
                if len(rows) >= 2000:
                    yield batch(rows)
                    rows = []
        rows.extend(packer.run(last=True))
        if rows:
            yield batch(rows)

    places = free_names(["doc_id", "text"], *[f"order{i}" for i in range(len(order))])
    keys = [(docs[c] if isinstance(c, str) else c).alias(n) for c, n in zip(order, places, strict=True)]
    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"], *keys)
    if order:
        n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        slim = slim.repartitionByRange(n, *places).sortWithinPartitions(*places).select("doc_id", "text")
    return slim.mapInArrow(split, SCHEMA + (", ids array<int>" if with_ids else ""))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op1_packing": op1_packing}
SQL: dict[str, str] = {}
