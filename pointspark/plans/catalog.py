"""Every registered query of the library and its SQL twin."""

from pointspark.plans import aggregates, core, graphs, joins, scalars, selection, streams  # noqa: F401  (they register)
from pointspark.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
