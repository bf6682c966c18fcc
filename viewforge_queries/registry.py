"""All registered queries."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

import viewforge_queries
import viewforge
from viewforge_queries import catalog, clauses, dates, exports, functions, pipelines, state, views
from viewforge.session import ship_packages

MODULES = [pipelines, clauses, functions, views, dates, state, exports, catalog]

Query = Callable[[SparkSession, str], DataFrame]


def _prepared(query: Query) -> Query:
    """Times are compared as UTC; workers need not have the packages installed."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_packages(spark, viewforge, viewforge_queries)
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return query(spark, sf_dir)

    return run


def prepared(found: dict[str, Query]) -> dict[str, Query]:
    return {name: _prepared(query) for name, query in found.items()}


def queries() -> dict[str, Query]:
    return prepared({name: query for module in MODULES for name, query in module.QUERIES.items()})


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
