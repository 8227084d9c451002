"""Functions that Spark lacks, as column expressions and as SQL functions of the session."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: SQL functions with a body in SQL: they stay in the JVM and inline into the plan.
SQL_FUNCTIONS = {
    "cot_safe": "(x DOUBLE) RETURNS DOUBLE RETURN CASE WHEN x = 0 THEN NULL ELSE cot(x) END",
    "div_trunc": "(a BIGINT, b BIGINT) RETURNS BIGINT RETURN a div nullif(b, 0)",
    "trunc_num": "(x DOUBLE) RETURNS DOUBLE RETURN CASE WHEN x < 0 THEN CAST(ceil(x) AS DOUBLE) ELSE CAST(floor(x) AS DOUBLE) END",
    "gcd": "(a BIGINT, b BIGINT) RETURNS BIGINT RETURN aggregate(sequence(1, 92), named_struct('x', abs(a), 'y', abs(b)), (s, _) -> CASE WHEN s.y = 0 THEN s ELSE named_struct('x', s.y, 'y', s.x % s.y) END, s -> s.x)",
    "lcm": "(a BIGINT, b BIGINT) RETURNS BIGINT RETURN CASE WHEN a = 0 OR b = 0 THEN 0L ELSE abs(a div gcd(a, b) * b) END",
}


def register_sql(spark: SparkSession) -> None:
    """Temporary SQL functions, once a session."""
    if getattr(spark, "_loomwork_functions", False):
        return
    for name, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    spark._loomwork_functions = True


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor by Euclid's steps; 92 are enough for any two 64-bit numbers."""
    start = F.struct(F.abs(a).cast("long").alias("x"), F.abs(b).cast("long").alias("y"))
    step = lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), F.try_mod(s["x"], s["y"]).alias("y")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step, lambda s: s["x"])


def array_agg_all(x: Column) -> Column:
    """array_agg that keeps nulls."""
    return F.transform(F.array_agg(F.struct(x.alias("x"))), lambda e: e["x"])


def approx_percentile_cont(x: Column, p: float) -> Column:
    """Interpolated percentile."""
    return F.percentile(x, F.lit(p))


def count_distinct_over(x: Column, window) -> Column:
    """count(DISTINCT x) OVER window, for frames that hold few values: a row carries its frame's set; whole partitions have operators.count_distinct_window."""
    return F.size(F.collect_set(x).over(window)).cast("long")


def safe_div(a: Column, b: Column) -> Column:
    """Integer division that is null for a zero divisor."""
    return F.expr("1") * F.when(b != 0, F.floor(F.abs(a) / F.abs(b)) * F.signum(a.cast("double") * b.cast("double")))
