"""The queries of this subpackage and, where SQL can express one, its SQL."""

from pointspark.llm import classifier, collocation, langid, linededup, mixing, ngramjoin, packing, periodic, pii, quality, simhash, topk, urlfilter

MODULES = (packing, mixing, classifier, simhash, urlfilter, topk, pii, langid, quality, linededup, periodic, collocation, ngramjoin)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
