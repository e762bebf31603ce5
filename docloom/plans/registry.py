"""All registered queries and the equivalent SQL.

The tables hold no rulings, so most queries read a view that is derived from whole tables by SQL which both
engines run as it is; what is compared is what is done with the view.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
VIEWS: dict[str, str] = {}

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "benchmark", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame over the tables."""
    sql = VIEWS[name]
    used = [n for n in [*TABLES, *VIEWS] if f"{{{n}}}" in sql]
    frames = {n: view(spark, sf_dir, n) if n in VIEWS else table(spark, sf_dir, n) for n in used}
    return spark.sql(sql, **frames)


def view_sql(name: str) -> str:
    """A view as a subquery over the tables."""
    sql = VIEWS[name]
    for n in [*TABLES, *VIEWS]:
        sql = sql.replace(f"{{{n}}}", f"({view_sql(n)})" if f"{{{n}}}" in sql and n in VIEWS else n)
    return sql


def query(name: str, views: list[str], sql: str | None = None) -> Callable:
    """Registers a function of (spark, views by name) and its SQL, which reads the views as CTEs."""

    def add(fn: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(*[view(spark, sf_dir, v) if v in VIEWS else table(spark, sf_dir, v) for v in views])

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ctes = ", ".join(f"{v} AS ({view_sql(v)})" for v in views if v in VIEWS)
            ORACLES[name] = (f"WITH {ctes} " if ctes else "") + sql if not sql.lstrip().upper().startswith("WITH") else f"WITH {ctes}{', ' if ctes else ''}" + sql.lstrip()[4:]
            if "reach AS" in sql:
                ORACLES[name] = ORACLES[name].replace("WITH", "WITH RECURSIVE", 1)
        return fn

    return add


from docloom.plans import catalogue_queries, document_queries, linkage_queries, scalar_queries, views  # noqa: E402, F401
