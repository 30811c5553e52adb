"""Small corpora for the tests of the text operators."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators might use for values of their own.
CLASHES = "size string, target string, taken string, positions string, position string, sk string, sn string, n_lines string, n_dropped string, lang_pred string, score string, label string, fp string, text_hash string, n_words string, ratio string, kept string, w string, s string, h string, st string, sp string, lines string, spans string, base_spans string, candidates string, part string, found string, host string, path string, rule string, verdict string, evidence string, keep string, key string, t string, k string, x string"
CLASH_NAMES = [c.split()[0] for c in CLASHES.split(", ")]

WORDS = "the river of stone and light was over a small town where people came to read old books about weather ships trees music bread salt paper winter summer hands doors".split()


def prose(rng: random.Random, n: int) -> str:
    out = []
    while len(out) < n:
        k = min(n - len(out), rng.randint(4, 14))
        s = [rng.choice(WORDS) for _ in range(k)]
        out += [s[0].capitalize(), *s[1:-1], s[-1] + "."] if k > 1 else [s[0] + "."]
    return " ".join(out)


def edge_rows() -> list[tuple]:
    """Nulls in every column, empty and blank texts, ties, repeated rows, a long text."""
    rng = random.Random(5)
    p = prose(rng, 120)
    return [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \t\n ", None, None, None), (4, p, "en", "a", len(p)), (4, p, "en", "a", len(p)),
        (5, p, "en", "b", len(p)), (None, "No number here.", "en", None, 5), (None, None, None, None, None), (6, "1234 5678", "de", "b", 9),
        (7, "word " * 30_000, "en", "a", 150_000), (8, "x" * 50_000, "en", "c", 50_000), (9, "é ü 漢字 <|endoftext|> \u00a0 \x1c z", "fr", "c", 9), (10, "one\n\n\ntwo\none", "en", "\U0001f600", 12),
    ]


def edge_docs(spark, clashes: bool = False):
    df = spark.createDataFrame(edge_rows(), SCHEMA)
    if clashes:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit("mine") for c in CLASH_NAMES})
    return df


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)
