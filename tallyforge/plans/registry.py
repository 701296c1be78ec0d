"""All queries of the library, by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Queries of small objects that the driver holds (configurations, request bodies, printed tables), which are run as tests only.
EXAMPLES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
EXAMPLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *, queries=QUERIES, oracle=ORACLE_SQL):
    """Registers a query; doubles are rounded to six places, as the SQL does."""

    def keep(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            df = build(spark, sf_dir)
            return df.select(*(F.round(F.col(f"`{n}`"), 6).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes))

        queries[name] = run
        if sql:
            oracle[name] = sql
        return run

    return keep


def example(name: str, sql: str | None = None):
    """Registers a query that says nothing about tables of any size."""
    return query(name, sql, queries=EXAMPLES, oracle=EXAMPLE_SQL)


def load() -> None:
    from . import calls_q, joins_q, judgements_q, scalars_q, sources_q, stats_q, text_q  # noqa: F401


load()
