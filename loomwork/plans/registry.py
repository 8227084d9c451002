"""Named queries over the test tables, and the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Queries in this engine's dialect.
TEXTS: dict[str, str] = {}


def views(spark: SparkSession, sf_dir: str, text: str) -> None:
    """Temporary views of the tables that the text names."""
    for t in TABLES:
        if re.search(rf"\b{t}\b", text):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def sql_query(name: str, text: str, oracle: str | None = None) -> None:
    """A query in this engine's SQL dialect; oracle where the other engine needs other words."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from loomwork.session import Loom

        views(spark, sf_dir, text)
        return Loom(spark).sql(text)

    run.__name__ = name
    QUERIES[name], SQL[name], TEXTS[name] = run, oracle or text, text


def frame_query(oracle: str | None):
    """Decorator for a query built with the DataFrame API; its function takes (spark, t) where t(name) is a table."""

    def wrap(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        run.__name__ = f.__name__
        QUERIES[f.__name__] = run
        if oracle:
            SQL[f.__name__] = oracle
        return run

    return wrap


from loomwork.plans import suite_h2o, suite_operators, suite_tpch  # noqa: E402, F401  they register themselves
