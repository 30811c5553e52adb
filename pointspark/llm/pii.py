"""Personal data in texts: fixed patterns, and spans added by weak supervision.

The four base kinds are found by their patterns and checks. Further candidates
(secrets, numbers of identity cards, telephone numbers without a country,
disguised addresses, names after a title) are put before labelers: a stricter
pattern, a gazetteer of words that stand near such data, the punctuation around
them, how varied they are, and signs of something else. Expectation-maximisation
over the counts of vote patterns estimates, for each kind, how reliable each
labeler is and how likely each pattern is personal data; kinds with few
candidates lean on what all kinds together say. A logistic regression on votes
and shape, trained on those estimates, decides on every candidate.

DataFrame operations only. Texts are searched once; what is found is written.
What comes to the driver is one row for each combination of votes and shape.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointspark.llm.names import free_names
from pointspark.session import materialize

LOCAL = "A-Za-z0-9._%+-"
#: kind, what a text must contain, pattern. The lookbehinds give the leftmost match without trying every character of a run: a match starts a run, or goes on where the last match ended.
BASE = (
    ("email", "@", rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", r"[0-9]\.[0-9]", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"),
    ("card", r"[0-9][\x20-]?[0-9]", r"[0-9](?:[\x20-]?[0-9])++"),
    ("phone", r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
)
KEY = "A-Za-z0-9+/_="
CANDIDATES = (
    ("secret", r"[0-9]", rf"(?<![{KEY[:-1]}-])(?=[A-Za-z+/_]*+[0-9])(?=[0-9+/_]*+[A-Za-z])[A-Za-z0-9+/_]{{20,}}+=*+(?![{KEY}-])"),
    ("identity", r"[0-9]-[0-9]", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("local_phone", r"[0-9][\x20.-][0-9]", r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
    ("disguised", r"(?i)[\[(]\x20?at\x20?[\])]", rf"(?i)(?<![{LOCAL}])[{LOCAL}]++\x20?[\[(]\x20?at\x20?[\])]\x20?[A-Za-z0-9-]++(?:\x20?[\[(]\x20?dot\x20?[\])]\x20?[A-Za-z0-9-]++|\.[A-Za-z0-9-]++)++"),
    ("name", r"(?:Mr|Mrs|Ms|Dr|Prof)\.", r"(?<![A-Za-z])(?:Mrs|Mr|Ms|Dr|Prof)\.\x20\p{Lu}\p{Ll}++(?:\x20\p{Lu}\p{Ll}++)?"),
)
KINDS = tuple(k for k, _, _ in (*BASE, *CANDIDATES))
#: Words that stand before data of a kind.
GAZETTEER = {
    "secret": ("token", "secret", "key", "password", "passwd", "auth", "bearer", "credential"),
    "identity": ("ssn", "social", "security", "identity"),
    "local_phone": ("phone", "tel", "call", "mobile", "fax"),
    "disguised": ("mail", "contact", "write", "reach"),
    "name": ("name", "dear", "signed", "patient", "client"),
}
#: What a stricter pattern asks of a kind.
STRICT = {
    "secret": r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64}|(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9].*[0-9]).*)$",
    "identity": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    "local_phone": r"^\(?[2-9]",
    "disguised": r"(?i)(?:\.|dot\x20?[\])]\x20?)(?:com|net|org|edu|info|[a-z]{2})$",
    "name": r"\x20\p{Lu}\p{Ll}+\x20\p{Lu}\p{Ll}+$",
}
LABELERS = ("strict", "gazetteer", "context", "variety", "other")
SHAPES = ("length", "digits")
BLOCK = 256
LIMIT = 0.5
#: How many candidates of a kind what all kinds say counts for, in the estimates of that kind.
POOLED = 20.0


def starts(df: DataFrame, lengths: str, gaps: str, out: str) -> DataFrame:
    """df with the starts of pieces of the given lengths, piece i after gap i, all laid end to end.

    Running sums are taken in blocks, then over blocks, so that a row with many
    pieces costs little more than their number.
    """
    inner, outer = free_names(df.columns, "inner", "outer")
    zero = F.array(F.lit(0).cast("long"))
    grow = lambda a, v: F.concat(a, F.array(F.element_at(a, -1) + v))
    both = F.zip_with(gaps, lengths, lambda a, b: a + b)
    # gaps has one more; the null that zip_with gives there falls away
    df = df.withColumn(out, F.slice(both, 1, F.greatest(F.size(lengths), F.lit(0))))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(out) - 1) / BLOCK)), lambda b: F.slice(out, (b * BLOCK + 1).cast("int"), BLOCK))
    df = df.withColumn(inner, F.when(F.size(lengths) > 0, F.transform(blocks, lambda x: F.aggregate(x, zero, grow))))
    df = df.withColumn(outer, F.aggregate(inner, zero, lambda a, x: grow(a, F.element_at(x, -1))))
    at = F.flatten(F.transform(inner, lambda x, b: F.transform(F.slice(x, 1, F.size(x) - 1), lambda v: v + F.get(outer, b))))
    df = df.withColumn(out, F.zip_with(F.slice(gaps, 1, F.greatest(F.size(lengths), F.lit(0))), at, lambda g, s: g + s))
    return df.drop(inner, outer)


def matches(df: DataFrame, text: str, pattern: str, contains: str, out: str, context: bool = False) -> DataFrame:
    """df with out: an array of the pattern's matches (start, end in code points, m), and with context what is before (40 characters) and after (1)."""
    found, pieces, gaps, lengths, at = free_names(df.columns, "found", "pieces", "gaps", "lengths", "at")
    has = F.contains(F.col(text), F.lit(contains)) if contains == "@" else F.col(text).rlike(contains)
    df = df.withColumn(found, F.when(has, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))
    df = df.withColumn(pieces, F.when(F.size(found) > 0, F.split(text, pattern)))
    df = df.withColumns({gaps: F.transform(pieces, lambda x: F.length(x).cast("long")), lengths: F.when(F.col(pieces).isNotNull(), F.transform(found, lambda x: F.length(x).cast("long")))})
    df = starts(df, lengths, gaps, at)
    one = lambda m, i: [F.get(at, i).alias("start"), (F.get(at, i) + F.get(lengths, i)).alias("end"), m.alias("m")]
    around = lambda i: [F.substring(F.get(pieces, i), -40, 40).alias("before"), F.substring(F.get(pieces, i + 1), 1, 1).alias("after")] if context else []
    empty = "array<struct<start:bigint,end:bigint,m:string" + (",before:string,after:string" if context else "") + ">>"
    df = df.withColumn(out, F.coalesce(F.when(F.col(pieces).isNotNull(), F.transform(found, lambda m, i: F.struct(*one(m, i), *around(i)))), F.array().cast(empty)))
    return df.drop(found, pieces, gaps, lengths, at)


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the check of card numbers."""
    turned = F.reverse(number)

    def add(a: Column, i: Column) -> Column:
        v = F.substr(turned, i, F.lit(1)).cast("int")
        return a + F.when(i % 2 == 1, v).when(v > 4, 2 * v - 9).otherwise(2 * v)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    n = F.length(digits(m))
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
        return m.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return n.between(14, 19) & F.when(n.between(14, 19), luhn(digits(m))).otherwise(False)
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def votes(kind: str, x: Column) -> list[Column]:
    """1 for, -1 against, 0 none, by each labeler."""
    m, before, after = x["m"], x["before"], x["after"]
    near = r"(?i)(?:" + "|".join(GAZETTEER[kind]) + r")[^\n]{0,20}$"
    distinct = F.size(F.array_distinct(F.split(F.lower(m), "")))
    varied = F.when(distinct >= 8, 1).when(distinct <= 4, -1).otherwise(0) if kind == "secret" else F.lit(0)
    return [
        F.when(m.rlike(STRICT[kind]), 1).otherwise(-1),
        F.when(before.rlike(near), 1).otherwise(0),
        F.when(before.rlike(r"[=:\"'(<]\x20*+[\"']?$"), 1).when(before.rlike(r"[A-Za-z0-9]$"), -1).otherwise(0),
        varied,
        F.when(before.rlike(r"[/\\@#]$") | after.isin("/", "\\", "@"), -1).otherwise(0),
    ]


def checked(part: str, i: int, kind: str) -> Column:
    """The matches in part that are valid, as spans."""
    return F.transform(F.filter(part, lambda x: valid(kind, x["m"])), lambda x: F.struct(x["start"].alias("start"), F.lit(i).alias("ord"), x["end"].alias("end")))


def described(i: int, kind: str):
    """A function from a match of candidate kind i to its span, votes and shape."""

    def describe(x: Column) -> Column:
        share = F.length(digits(x["m"])) / F.length(x["m"])
        shape = F.array(F.when(F.length(x["m"]) < 24, 0).when(F.length(x["m"]) < 48, 1).otherwise(2), F.when(share < 0.1, 0).when(share < 0.7, 1).otherwise(2))
        return F.struct(x["start"].alias("start"), F.lit(len(BASE) + i).alias("ord"), x["end"].alias("end"), F.array(*votes(kind, x)).alias("votes"), shape.alias("shape"))

    return describe


def with_spans(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """docs with arrays of base spans and of candidates that overlap none of them, by start and kind."""
    text, base, cand, part = free_names(docs.columns, "pii_text", "base_spans", "candidates", "part")
    df = docs.withColumn(text, F.coalesce("text", F.lit("")))
    df = df.withColumn(base, F.array().cast("array<struct<start:bigint,ord:int,end:bigint>>"))
    for i, (kind, contains, pattern) in enumerate(BASE):
        df = matches(df, text, pattern, contains, part)
        df = df.withColumn(base, F.concat(base, checked(part, i, kind))).drop(part)
    df = df.withColumn(base, F.sort_array(base))
    fields = "start:bigint,ord:int,end:bigint,votes:array<int>,shape:array<int>"
    df = df.withColumn(cand, F.array().cast(f"array<struct<{fields}>>"))
    for i, (kind, contains, pattern) in enumerate(CANDIDATES):
        df = matches(df, text, pattern, contains, part, context=True)
        free = F.filter(part, lambda x: ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))

        df = df.withColumn(cand, F.concat(cand, F.transform(free, described(i, kind)))).drop(part)
    return df.drop(text), base, cand


def estimate(rows: list[tuple[tuple[int, ...], int]], rounds: int = 60, pooled: tuple[float, list[dict]] | None = None) -> tuple[dict[tuple[int, ...], float], float, list[dict]]:
    """EM over (vote pattern, count): how likely each pattern is a hit, the share of hits, and each labeler's chances of a vote by class.

    The first guess is the majority, or what the pooled share and chances say,
    which then count as POOLED candidates; else counts are smoothed by one.
    """
    share, chances, weight = (*pooled, POOLED) if pooled else (0.5, [{(c, x): 1 / 3 for c in (0, 1) for x in (-1, 0, 1)} for _ in LABELERS], 2.0)
    prior = {1: weight * share, 0: weight * (1 - share)}

    def judge(total: dict[int, float], chances: list[dict], v: tuple[int, ...]) -> float:
        p = [math.log(total[c] / (total[0] + total[1])) + sum(math.log(s[c, x]) for s, x in zip(chances, v, strict=True)) for c in (0, 1)]
        return 1 / (1 + math.exp(min(50.0, max(-50.0, p[0] - p[1]))))

    post = {v: judge(prior, chances, v) if pooled else 1 / (1 + math.exp(-1.5 * sum(v))) for v, _ in rows}
    first = chances
    for _ in range(rounds):
        total = dict(prior)
        seen = [{(c, x): prior[c] * p for (c, x), p in s.items()} for s in first]
        for v, n in rows:
            for c, w in ((1, n * post[v]), (0, n * (1 - post[v]))):
                total[c] += w
                for s, x in zip(seen, v, strict=True):
                    s[c, x] += w
        chances = [{k: x / total[k[0]] for k, x in s.items()} for s in seen]
        share = total[1] / (total[0] + total[1])
        new = {v: judge(total, chances, v) for v, _ in rows}
        if max((abs(new[v] - post[v]) for v in new), default=0) < 1e-6:
            break
        post = new
    return post, share, chances


def features(kind: int, v: tuple[int, ...], shape: tuple[int, ...]) -> list[float]:
    return [1.0, *map(float, v), *[float(shape[0] == i) for i in (1, 2)], *[float(shape[1] == i) for i in (1, 2)], *[float(kind == len(BASE) + i) for i in range(1, len(CANDIDATES))]]


def regress(rows: list[tuple[list[float], float, float]], rounds: int = 400, rate: float = 0.5, ridge: float = 1e-3) -> list[float]:
    """Logistic regression of soft answers: rows of (features, answer, weight), by gradient steps."""
    w = [0.0] * len(rows[0][0])
    whole = sum(n for _, _, n in rows)
    for _ in range(rounds):
        g = [ridge * x for x in w]
        for x, y, n in rows:
            p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x, strict=True))))
            for i, a in enumerate(x):
                if a:
                    g[i] += n / whole * (p - y) * a
        w = [a - rate * b for a, b in zip(w, g, strict=True)]
    return w


def train(df: DataFrame, cand: str) -> list[float]:
    """The span classifier's weights, from all candidates of df; [] where there are none."""
    x = F.explode(F.transform(cand, lambda c: F.struct(c["ord"].alias("ord"), c["votes"].alias("votes"), c["shape"].alias("shape"))))
    counted = df.select(x.alias("x")).groupBy("x").agg(F.count("*").alias("n")).collect()
    if not counted:
        return []
    by_votes: dict[tuple[int, ...], int] = {}
    by_kind: dict[int, dict[tuple[int, ...], int]] = {}
    for r in counted:
        v = tuple(r.x.votes)
        by_votes[v] = by_votes.get(v, 0) + r.n
        own = by_kind.setdefault(r.x.ord, {})
        own[v] = own.get(v, 0) + r.n
    _, *pooled = estimate(sorted(by_votes.items()))
    post = {k: estimate(sorted(own.items()), pooled=tuple(pooled))[0] for k, own in by_kind.items()}
    rows = sorted((features(r.x.ord, tuple(r.x.votes), tuple(r.x["shape"])), post[r.x.ord][tuple(r.x.votes)], float(r.n)) for r in counted)
    return regress(rows)


def find_pii(docs: DataFrame, weights: list[float] | None = None, limit: float = LIMIT, carried: tuple[str, ...] | None = None) -> tuple[DataFrame, list[str]]:
    """The carried columns of docs (all, unless named) with base_spans and spans, arrays of (start, ord, end) by start and kind (ord is an index in KINDS), and those two names.

    Positions count code points; ends are exclusive. The classifier is trained
    on docs unless weights are given; what the texts hold is then written with
    the carried columns and read twice. Null and empty texts have no spans;
    texts are searched whole, however long. Repeated rows and null doc_ids are
    rows like any other. An empty table gives no rows.
    """
    df, base, cand = with_spans(docs)
    if carried is not None:
        df = df.select(*carried, base, cand)
    if weights is None:
        df = materialize(df, "spans")
        weights = train(df, cand)
    slim = lambda c: F.struct(c["start"].alias("start"), c["ord"].alias("ord"), c["end"].alias("end"))

    def hit(c: Column) -> Column:
        parts = [F.lit(1.0), *[F.get(c["votes"], i).cast("double") for i in range(len(LABELERS))]]
        parts += [(F.get(c["shape"], s) == i).cast("double") for s in (0, 1) for i in (1, 2)]
        parts += [(c["ord"] == len(BASE) + i).cast("double") for i in range(1, len(CANDIDATES))]
        score = sum((w * p for w, p in zip(weights, parts, strict=True)), F.lit(0.0))
        return score >= math.log(limit / (1 - limit))

    (spans,) = free_names(df.columns, "spans")
    added = F.transform(F.filter(cand, hit), slim) if weights else F.array().cast("array<struct<start:bigint,ord:int,end:bigint>>")
    return df.withColumn(spans, F.sort_array(F.concat(base, added))).drop(cand), [base, spans]


def written(spans: str) -> Column:
    """kind:start:end of each span, with commas between."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["ord"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    df, (base, spans) = find_pii(docs, carried=("doc_id",))

    def number(i: int) -> Column:
        return F.size(F.filter(base, lambda x: x["ord"] == i)).cast("long")

    return df.select("doc_id", *[number(i).alias(f"n_{k}") for i, (k, _, _) in enumerate(BASE)], F.sha2(written(base), 256).alias("base_sha256"), written(spans).alias("spans"), F.size(spans).cast("long").alias("n_spans"))


QUERIES = {"op7_pii": op7_pii}
SQL: dict[str, str] = {}
