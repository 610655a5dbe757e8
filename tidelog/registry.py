"""Registered queries and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidelog.fixtures import DUCK, compose
from tidelog.session import tune

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(tune(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = compose(sql, DUCK)
        return fn

    return register


def percent_sql(part: str, whole: str, digits: int) -> str:
    """Percentage of two counts rounded half up, for the reference SQL."""
    return f"(({part}) * {2 * 10 ** (digits + 2)} + ({whole})) // (2 * ({whole})) / {10 ** digits}::DOUBLE"


def load_all() -> None:
    import tidelog.plans.load  # noqa: F401
