"""Periodic runs of words, by Crochemore's partition refinement.

Positions of a text are classed by the words that follow them: at length L two
positions are in one class where the same L words start at both. Classes of
length L + 1 come from those of length L by splitting them by the class of the
next position, and of the parts of a class that was split only the smaller ones
have to split others. Two neighbouring members of a class that stand L apart are
a square of period L, and squares of one period at successive positions are a
run. All texts of a batch are refined together, level by level.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointspark.llm.names import free_names

MIN_LENGTH = 6
MIN_EXPONENT = 4
#: Words that are refined together; a longer text is on its own.
CHUNK = 500_000

RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


class Classes:
    """Positions by the class of the words that start at them, each class a linked list in ascending order.

    Class 0 is that of positions which can be in no run any more: too few
    others read alike.
    """

    def __init__(self, letters: np.ndarray, limit: np.ndarray, members: int):
        """letters: a number for each word, 0 between texts; limit: the longest period that is looked for at each position."""
        n = len(letters)
        self.nil, self.members, self.limit, self.level = n, members, limit, 1
        self.most = int(limit.max(initial=0))
        self.of = np.zeros(n + 1, np.int64)
        self.next, self.last = np.full(n + 1, n), np.full(n + 1, n)
        self.marked = np.zeros(n + 1, bool)
        self.due: dict[int, list[np.ndarray]] = defaultdict(list)
        self.size, self.named = np.zeros(1024, np.int64), 1
        order = np.argsort(letters, kind="stable")
        start = np.flatnonzero(np.diff(letters[order], prepend=-1))
        size = np.diff(start, append=n)
        self._listed(order, start, size, (size >= members) & (letters[order[start]] > 0))
        self.alive = np.flatnonzero(self.of[:n])
        #: Positions by whose class others are to be split: at first all.
        self.splitters = np.arange(n)

    def _listed(self, order: np.ndarray, start: np.ndarray, size: np.ndarray, lives: np.ndarray) -> None:
        """Positions in order, in groups, become classes where lives says so; the others are of class 0."""
        names = np.where(lives, np.cumsum(lives) + self.named - 1, 0)
        self.named += int(lives.sum())
        if self.named > len(self.size):
            self.size = np.concatenate([self.size, np.zeros(self.named, np.int64)])
        self.size[names] = size
        each = np.repeat(names, size)
        self.of[order] = each
        before, after = order[:-1], order[1:]
        joined = (each[1:] == each[:-1]) & (each[1:] > 0)
        before, after = before[joined], after[joined]
        fresh = self.next[before] != after
        first, end = order[start], order[start + size - 1]
        self.last[first], self.next[end] = self.nil, self.nil
        self.next[before], self.last[after] = after, before
        self._expect(before[fresh], after[fresh])

    def _expect(self, i: np.ndarray, j: np.ndarray) -> None:
        """Neighbours i and j are looked at when the level is their distance."""
        gap = j - i
        good = (gap >= self.level) & (gap <= self.limit[i])
        i, gap = i[good], gap[good]
        if not len(i):
            return
        order = np.argsort(gap, kind="stable")
        i, gap = i[order], gap[order]
        at = np.flatnonzero(np.diff(gap, prepend=-1))
        for d, a, b in zip(gap[at].tolist(), at.tolist(), [*at[1:].tolist(), len(i)], strict=True):
            self.due[d].append(i[a:b])

    def squares(self) -> np.ndarray:
        """Where squares of the level's period start, ascending."""
        waiting = self.due.pop(self.level, None)
        if not waiting:
            return np.zeros(0, np.int64)
        i = np.unique(np.concatenate(waiting))
        return i[(self.of[i] > 0) & (self.next[i] == i + self.level)]

    def refine(self) -> None:
        """From classes of the level's length to those of the next."""
        p = self.splitters - 1
        p = p[p >= 0]
        p = p[(self.of[p] > 0) & (self.limit[p] > self.level)]
        self.level += 1
        if 4 * len(p) > len(self.alive):  # most of what lives is met: all of it is put in order anew
            self.alive = self.alive[(self.of[self.alive] > 0) & (self.limit[self.alive] >= self.level)]
            p = self.alive
        parent, by = self.of[p], self.of[p + 1]
        order = np.argsort((parent << 32) | by, kind="stable") if p is self.alive else np.lexsort((p, by, parent))
        p, parent, by = p[order], parent[order], by[order]
        new_parent = np.diff(parent, prepend=-1) != 0
        start = np.flatnonzero(new_parent | (np.diff(by, prepend=-1) != 0))
        size = np.diff(start, append=len(p))
        # groups of one parent follow each other
        family = np.cumsum(new_parent[start]) - 1
        heads = np.flatnonzero(new_parent[start])
        left = self.size[parent[start[heads]]] - np.add.reduceat(size, heads) if len(heads) else size
        dies = (by[start] == 0) | (size < self.members)
        same = (left[family] == 0) & (np.bincount(family, minlength=len(heads))[family] == 1) & ~dies
        if same.any():
            keep = np.repeat(~same, size)
            p, start, size, family, dies = p[keep], None, size[~same], family[~same], dies[~same]
            parent = parent[keep]
            start = np.cumsum(size) - size
            heads = np.flatnonzero(np.diff(family, prepend=-1))
            left = left[family[heads]]
            family = np.cumsum(np.diff(family, prepend=-1) != 0) - 1
        if not len(p):
            self.splitters = p
            return
        # the largest part of a class splits nothing
        rank = np.lexsort((np.where(dies, 0, size), family))
        tops = rank[np.append(heads[1:], len(rank)) - 1]
        best = np.where(dies[tops], 0, size[tops])
        stays = (left >= self.members) & (left >= best)
        large = np.zeros(len(size), bool)
        large[tops[~stays & (best > 0)]] = True
        rest = self._unlinked(p, parent, parent[start[heads]], left, stays)
        self.size[parent[start[heads]]] = left
        self._listed(p, start, size, ~dies)
        self.splitters = np.concatenate([p[np.repeat(~large, size)], rest])

    def _unlinked(self, p: np.ndarray, parent: np.ndarray, parents: np.ndarray, left: np.ndarray, stays: np.ndarray) -> np.ndarray:
        """Takes p out of their parents' lists; gives the members left of those parents that do not stay the largest part, killing what is too small."""
        some = left > 0
        if not some.any():
            return np.zeros(0, np.int64)
        at = np.searchsorted(parents, parent)
        p, at = p[some[at]], at[some[at]]
        order = np.lexsort((p, at))
        p, at = p[order], at[order]
        self.marked[p] = True
        first, end = ~self.marked[self.last[p]], ~self.marked[self.next[p]]
        self.marked[p] = False
        # stretches of the list that go: their ends, in the list's order
        before, after, at = self.last[p[first]], self.next[p[end]], at[first]
        self.next[before], self.last[after] = after, before
        both = (before < self.nil) & (after < self.nil)
        self._expect(before[both], after[both])
        walk = np.flatnonzero(some & ~stays)
        if not len(walk):
            return np.zeros(0, np.int64)
        near = np.where(before < self.nil, before, after)
        entry = near[np.searchsorted(at, walk)]
        found = [entry]
        for way in (self.last, self.next):
            here = entry
            while len(here := (step := way[here])[step < self.nil]):
                found.append(here)
        rest = np.concatenate(found)
        self.of[rest[left[np.searchsorted(parents, self.of[rest])] < self.members]] = 0
        return rest


def find_runs(texts: list[np.ndarray], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[list[tuple[int, int, int]]]:
    """For each text, given as a number for each word, its runs (start, length, period) by start, then period.

    A run is a longest stretch with smallest period q and a length of at least
    min_length and min_exponent (2 or more) times q.
    """
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    order = sorted((i for i, t in enumerate(texts) if len(t) >= max(min_length, min_exponent)), key=lambda i: len(texts[i]))
    while order:
        taken, words = [], 0
        while order and (not taken or words + len(texts[order[-1]]) <= CHUNK):
            taken.append(order.pop())
            words += len(texts[taken[-1]])
        letters, limit, starts, base = [], [], [], 1
        for i in taken:
            t = texts[i]
            starts.append(sum(map(len, letters)) if not starts else starts[-1] + len(letters[-2]) + 1)
            letters += [t + base, np.zeros(1, np.int64)]
            limit += [np.full(len(t) + 1, len(t) // min_exponent)]
            base += int(t.max()) + 1
        # a run holds min_exponent periods, so each of its words starts at least min_exponent - 1 equal factors
        classes = Classes(np.concatenate(letters), np.concatenate(limit), max(2, min_exponent - 1))
        periods, squares = [], []
        while True:
            if len(found := classes.squares()):
                squares.append(found)
                periods.append(np.full(len(found), classes.level))
            if classes.level >= classes.most or not len(classes.splitters):
                break
            classes.refine()
        if not squares:
            continue
        q, i = np.concatenate(periods), np.concatenate(squares)
        first = np.flatnonzero((np.diff(q, prepend=0) != 0) | (np.diff(i, prepend=-2) != 1))
        length = np.diff(first, append=len(i)) - 1 + 2 * q[first]
        q, i = q[first], i[first]
        good = (length >= min_length) & (length >= min_exponent * q)
        base = np.array(starts)
        doc = np.searchsorted(base, i, side="right") - 1
        for d, s, n, k in sorted(zip(doc[good].tolist(), (i - base[doc])[good].tolist(), length[good].tolist(), q[good].tolist(), strict=True), key=lambda r: (r[0], r[1], r[3])):
            out[taken[d]].append((s, n, k))
    return out


def numbered(words: list[bytes]) -> np.ndarray:
    """A number for each word, equal for equal ones."""
    names: dict[bytes, int] = defaultdict(count().__next__)
    return np.fromiter(map(names.__getitem__, words), np.int64, len(words))


def collapse_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> tuple[DataFrame, list[str]]:
    """docs with the runs of words in text and the text without their repetitions, and the names of the two added columns.

    Words are separated by ASCII whitespace and compared as they are. The first
    column has (start, length, period) by start, then period, in words from 0.
    The second has the words, joined by one space, that no run holds after its
    first period. Null and empty texts have no runs and an empty result; so
    have texts of whitespace. Each row is by itself, so repeated rows and null
    doc_ids are rows like any other. Other columns stay; the added names change
    where docs has them. Texts are read whole: a worker holds the words of
    CHUNK words' worth of texts, or of one longer text. An empty table gives
    an empty one.
    """
    runs, collapsed = free_names(docs.columns, "runs", "collapsed")
    at_text, names = docs.columns.index("text"), [*docs.columns, runs, collapsed]
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in RUN.names]))

    def batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                words = [(t.as_py() or "").encode("utf-8", "surrogatepass").split() for t in b.column(at_text)]
                found = find_runs([numbered(w) for w in words], min_length, min_exponent)
                texts = []
                for w, r in zip(words, found, strict=True):
                    if r:
                        gone = np.zeros(len(w) + 1, np.int64)
                        for s, n, q in r:
                            gone[s + q] += 1
                            gone[s + n] -= 1
                        gone = np.cumsum(gone).tolist()
                        w = [x for x, g in zip(w, gone, strict=False) if not g]
                    texts.append(b" ".join(w).decode("utf-8", "surrogatepass"))
                rows = [[dict(zip(RUN.names, x, strict=True)) for x in r] for r in found]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, kind), pa.array(texts, pa.string())], names)

    schema = T.StructType([*docs.schema.fields, T.StructField(runs, T.ArrayType(RUN)), T.StructField(collapsed, T.StringType())])
    return docs.mapInArrow(batch, schema), [runs, collapsed]


def repeated_tail(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of one document in ten with a tail that repeats, as the query's contract has it; without an id they stay."""
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    return words[:a] + (tail * ((n - a) // p + 1))[: n - a]


def with_tails(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with repeated_tail."""

    def batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for k, i in enumerate(b.column(0).to_pylist()):
                if i is not None and texts[k] and zlib.crc32(str(i).encode()) % 10 == 0:
                    texts[k] = b" ".join(repeated_tail(texts[k].encode("utf-8", "surrogatepass").split(), i)).decode("utf-8", "surrogatepass")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(batch, "doc_id long, text string")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_tails(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    out, _ = collapse_runs(docs)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    told = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    found = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(told, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return found.select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


QUERIES = {"op11_periodic_runs": op11_periodic_runs}
SQL: dict[str, str] = {}
