"""Joins of every type, NOT IN for large lists, DISTINCT ON, unnest, unions that keep partitions."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.operators.partitioning import bucket_of, cuts

SWAPPED = {"right_semi": "left_semi", "right_anti": "left_anti"}
HINTS = {"hash": "shuffle_hash", "merge": "merge", "broadcast": "broadcast"}


def join(left: DataFrame, right: DataFrame, on, how: str = "inner", strategy: str | None = None, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """A join of any type, right semi and anti and both mark joins among them.

    strategy: hash, merge or broadcast; broadcast only holds where the plan's statistics put the build side
    under broadcast_bytes, else Spark chooses.
    """
    how = how.lower().replace(" ", "_")
    if how in SWAPPED:
        left, right, how = right, left, SWAPPED[how]
    if how in ("left_mark", "right_mark"):
        return mark_join(left, right, on) if how == "left_mark" else mark_join(right, left, on)
    if strategy and not (strategy == "broadcast" and estimated_bytes(right) > broadcast_bytes):
        right = right.hint(HINTS[strategy])
    return left.join(right, on, how)


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a plan's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def mark_join(left: DataFrame, right: DataFrame, on: list[str] | str, mark: str = "mark") -> DataFrame:
    """left with a boolean column: whether right has a row of the same keys (nulls match nothing)."""
    keys = [on] if isinstance(on, str) else list(on)
    present = right.select(*keys).distinct().withColumn(mark, F.lit(True))
    return left.join(present, keys, "left").withColumn(mark, F.coalesce(mark, F.lit(False)))


def not_in(left: DataFrame, key: str, right: DataFrame, right_key: str) -> DataFrame:
    """left WHERE key NOT IN (SELECT right_key FROM right), with its rules for null, and no side that must fit a task.

    An empty list keeps every row; a null in the list drops every row; a null key is dropped unless the list is empty.
    """
    counts = right.agg(F.count("*").alias("_n"), F.count(right_key).alias("_n_known"))  # one row
    listed = right.select(F.col(right_key).alias("_k")).where("_k is not null").distinct()
    kept = left.crossJoin(F.broadcast(counts)).where(f"_n = 0 or ({key} is not null and _n = _n_known)")
    return kept.join(listed, F.col(key) == F.col("_k"), "left_anti").drop("_n", "_n_known")


def distinct_on(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group of equal keys."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_nth = 1").drop("_nth")


def group_percentiles(df: DataFrame, keys: list[str], value: Column, wanted: dict[str, tuple[float, Column]], parts: int) -> DataFrame:
    """For each group its interpolated percentiles of value, name: (share, weight), as percentile() gives them; keys become _g0, _g1 ...

    Spark's percentile holds all values of a group in one task.  Here equal values are folded, ranges of values are
    counted, and the two values about each place are found by running counts in their range.
    """
    groups = [f"_g{i}" for i in range(len(keys))]
    base = df.select(*(F.col(k).alias(g) for k, g in zip(keys, groups)), value.cast("double").alias("_x"), *(w.cast("long").alias(f"_w_{n}") for n, (_, w) in wanted.items())).where("_x is not null")
    at = cuts(base, "_x", parts)
    cells = base.groupBy(*groups, "_x").agg(*(F.sum(F.when(F.col(f"_w_{n}") < 0, F.raise_error(F.lit("a negative weight"))).otherwise(F.col(f"_w_{n}"))).alias(f"_c_{n}") for n in wanted))
    cells = cells.fillna(0, [f"_c_{n}" for n in wanted]).withColumn("_part", bucket_of(F.col("_x"), at))
    of_group = Window.partitionBy(*groups)
    before = of_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = cells.groupBy(*groups, "_part").agg(*(F.sum(f"_c_{n}").alias(f"_s_{n}") for n in wanted))
    sums = sums.select(*(F.col(c).alias(f"{c}_") for c in [*groups, "_part"]), *(F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in wanted), *(F.sum(f"_s_{n}").over(of_group).alias(f"_n_{n}") for n in wanted))
    same = functools.reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"{c}_")) for c in [*groups, "_part"]))
    running = Window.partitionBy(*groups, "_part").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    ranked = cells.join(sums, same).select(*groups, "_x", *(F.col(f"{v}_{n}") for v in ("_c", "_n") for n in wanted), *((F.col(f"_b_{n}") + F.sum(f"_c_{n}").over(running)).alias(f"_r_{n}") for n in wanted))
    found, out = [], []
    for n, (share, _) in wanted.items():
        place = (F.col(f"_n_{n}") - 1) * F.lit(float(share))
        here = lambda p: (F.col(f"_r_{n}") - F.col(f"_c_{n}") <= p) & (p < F.col(f"_r_{n}"))  # noqa: B023, E731
        found += [F.max(F.when(here(f(place)), F.col("_x"))).alias(f"{e}_{n}") for e, f in (("_lo", F.floor), ("_hi", F.ceil))] + [F.max(place).alias(f"_at_{n}")]
        low, high, spot = F.col(f"_lo_{n}"), F.col(f"_hi_{n}"), F.col(f"_at_{n}")
        out.append(F.when(low == high, low).otherwise((F.ceil(spot) - spot) * low + (spot - F.floor(spot)) * high).alias(n))
    return ranked.groupBy(*groups).agg(*found).select(*groups, *out)


def unnest(df: DataFrame, columns: list[str], preserve_nulls: bool = True, depth: int = 1) -> DataFrame:
    """Lists side by side (shorter ones padded with null), depth levels deep; structs become their fields."""
    kinds = dict(df.dtypes)
    structs = [c for c in columns if kinds[c].startswith("struct")]
    lists = [c for c in columns if c not in structs]
    if lists:
        rest = [c for c in df.columns if c not in lists]
        zipped = F.arrays_zip(*(F.coalesce(c, F.array()).alias(c) if len(lists) > 1 else F.col(c).alias(c) for c in lists))
        expand = F.inline_outer if preserve_nulls else F.inline
        df = df.select(*rest, expand(zipped).alias(*lists)).select(*df.columns)
        if depth > 1:
            return unnest(df, columns, preserve_nulls, depth - 1)
    if structs:
        names = [f"`{c}`.*" if c in structs else f"`{c}`" for c in df.columns]
        df = df.select(*names)
    return df


def interleave(first: DataFrame, *others: DataFrame) -> DataFrame:
    """UNION ALL by position."""
    for df in others:
        first = first.union(df)
    return first
