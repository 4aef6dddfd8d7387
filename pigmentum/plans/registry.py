"""Named queries over the engine's operators, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources import fixtures

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, *views: str, sql: str | None = None, derived: tuple[str, ...] = ()):
    """Registers f(*views as DataFrames). `sql` follows the views' WITH clause; extra CTEs begin with a comma.

    `derived` names the tables that f gets in Spark, where they aren't the views one by one."""

    def wrap(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*(fixtures.view(spark, sf_dir, v) if v in fixtures.VIEWS or v in fixtures.DERIVED else spark.read.parquet(f"{sf_dir}/{v}.parquet") for v in derived or views))

        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = run
        if sql is not None:
            own = [v for v in views if v in fixtures.VIEWS]
            SQL[name] = sql if sql.startswith("WITH") else f"{fixtures.duckdb_with(*own)} {sql}" if own else (f"WITH {sql.lstrip(' ,')}" if sql.lstrip().startswith(",") else sql)
        return f

    return wrap


def r(x: str, digits: int = 6) -> str:
    """SQL of half-up rounding; the engine's round_to."""
    m = float(10**digits)
    return f"(floor(({x}) * {m} + 0.5) / {m})"


def whole(x: str) -> str:
    return f"CAST(floor(({x}) + 0.5) AS BIGINT)"
