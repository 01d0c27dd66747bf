"""Named queries over the given tables and their SQL."""

from functools import wraps

from folioflow.catalog.base import ORACLES, QUERIES
from folioflow.ship import ship


def _load():
    from folioflow.catalog import frames, jobs, plans, scalars, sheets, streams  # noqa: F401


def _shipped(fn):
    @wraps(fn)
    def run(spark, sf_dir):
        ship(spark)
        return fn(spark, sf_dir)

    return run


def queries() -> dict:
    _load()
    return {name: _shipped(fn) for name, fn in sorted(QUERIES.items())}


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(sorted(ORACLES.items()))
