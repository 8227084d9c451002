"""Range repartitioning by measured cuts, filters by partition, and column statistics of a running plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def cuts(df: DataFrame, key: str, parts: int, error: float = 0.001) -> list:
    """Up to parts - 1 rising values of key that cut its rows into about equal ranges; nulls don't count."""
    if parts < 2:
        return []
    found = df.where(F.col(key).isNotNull()).agg(F.percentile_approx(key, [k / parts for k in range(1, parts)], int(1 / error)).alias("c")).first()["c"]
    return sorted(set(found or []))


def bucket_of(key: Column, at: list) -> Column:
    """The number of the range that owns the key: [cut k-1, cut k) is k; null is -1.  A binary search in the cuts."""
    if not at:
        return F.when(key.isNull(), -1).otherwise(0)
    table, steps = F.array(*map(F.lit, at)), [1 << b for b in reversed(range(len(at).bit_length()))]
    found = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda p, s: F.when(F.get(table, p + s - 1) <= key, p + s).otherwise(p))
    return F.when(key.isNull(), -1).otherwise(found)


def unordered_ranges(df: DataFrame, key: str, parts: int) -> DataFrame:
    """P partitions to K disjoint ranges of key."""
    return df.repartitionByRange(parts, F.col(key).asc_nulls_last())


def ordered_ranges(df: DataFrame, key: str, parts: int) -> DataFrame:
    """K disjoint ranges of key, each sorted: partition order is global order."""
    return unordered_ranges(df, key, parts).sortWithinPartitions(F.col(key).asc_nulls_last())


def hash_repartition(df: DataFrame, parts: int, *keys: str) -> DataFrame:
    return df.repartition(parts, *keys) if keys else df.repartition(parts)


def per_partition_filter(df: DataFrame, bucket: Column, predicates: list[Column | str]) -> DataFrame:
    """predicates[k] applied to the rows of bucket k; rows of other buckets go."""
    keep = F.lit(False)
    for k, p in enumerate(predicates):
        keep = F.when(bucket == k, F.expr(p) if isinstance(p, str) else p).otherwise(keep)
    return df.where(keep)


def range_filter(df: DataFrame, key: str, at: list, low_halo, high_halo, bucket: str = "bucket") -> DataFrame:
    """Each row once for every range that has the key within its bounds widened by the halos; null keys in -1."""
    k = F.col(key)
    return df.withColumn(bucket, F.explode(F.sequence(bucket_of(k - high_halo, at), bucket_of(k + low_halo, at))))


#: Columns that with_ranges() adds.
RANGE, OWN = "_loom_range", "_loom_own"


def with_ranges(df: DataFrame, key: str, low_halo, high_halo, parts: int | None = None) -> DataFrame:
    """Rows by ranges of key, each range with the rows that frames of the given reach need: columns RANGE, and OWN for the row's own range."""
    at = cuts(df, key, parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return range_filter(df, key, at, low_halo, high_halo, RANGE).withColumn(OWN, F.col(RANGE) == bucket_of(F.col(key), at))


def order_parts(df: DataFrame, order: list[tuple[str, bool, bool]], parts: int, n: int) -> tuple[Column, Column]:
    """(part, key) for n rows in an ORDER BY of (column, descending, nulls first): parts rise with the order and equal keys share one.

    Cuts come from a sample of keys, as in Spark's range exchange; only keys that run the same way as the first one are cut on.
    """
    kinds = {f.name.lower(): f.dataType for f in df.schema}
    down, fields, types = order[0][1], [], []
    for c, way, nulls_first in order:
        if way != down:
            break
        if nulls_first == down:  # structs have nulls first, or last when read backwards
            fields.append(F.col(c).isNull())
            types.append("boolean")
        fields.append(F.col(c))
        types.append(kinds[c.lower()].simpleString())
    key = F.struct(*(f.alias(f"k{i}") for i, f in enumerate(fields)))
    if parts < 2:
        return F.lit(0), key
    taken = df.select(key.alias("k")).sample(min(1.0, 100 * parts / max(n, 1)), 1)
    cut = F.transform(F.sequence(F.lit(1), F.lit(parts - 1)), lambda i: F.get("a", F.floor(i * F.size("a") / parts).cast("int")))
    found = taken.agg(F.sort_array(F.collect_list("k")).alias("a")).select(F.explode(F.array_distinct(cut)).alias("c")).where("c is not null").select(*(F.col(f"c.k{i}").cast("string") for i in range(len(fields)))).collect()
    if not found:
        return F.lit(0), key
    table = F.sort_array(F.array(*(F.struct(*(F.lit(v).cast(t).alias(f"k{i}") for i, (v, t) in enumerate(zip(row, types)))) for row in found)))
    steps = [1 << b for b in reversed(range(len(found).bit_length()))]
    at = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda p, s: F.when((p + s <= len(found)) & (F.get(table, p + s - 1) <= key), p + s).otherwise(p))
    return (F.lit(len(found)) - at if down else at), key


def runtime_stats(df: DataFrame, key: str, name: str = "stats") -> tuple[DataFrame, Observation]:
    """df with a tap: after an action the observation holds rows, nulls, least and greatest key."""
    tap = Observation(name)
    return df.observe(tap, F.count("*").alias("rows"), F.count_if(F.col(key).isNull()).alias("nulls"), F.min(key).alias("least"), F.max(key).alias("greatest")), tap
