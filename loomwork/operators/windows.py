"""Windows that Spark lacks: a bounded RANGE frame without PARTITION BY in parallel, and GROUPS frames."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.operators.partitioning import OWN, RANGE, bucket_of, cuts, with_ranges


def parallel_range_window(df: DataFrame, key: str, preceding: float, following: float, aggregate: Callable[[WindowSpec], Column], name: str, parts: int | None = None, nulls_last: bool = True) -> DataFrame:
    """aggregate(window) OVER (ORDER BY key RANGE BETWEEN preceding PRECEDING AND following FOLLOWING) by ranges of key.

    Rows go to the range that owns their key and to every range that their key's frame reaches into; each
    range is a window partition of its own and returns only the rows it owns.  Null keys are peers of
    each other only and form one range.  Plain Spark runs such a frame in a single task.
    """
    order = F.col(key).asc_nulls_last() if nulls_last else F.col(key).asc_nulls_first()
    window = Window.partitionBy(RANGE).orderBy(order).rangeBetween(-preceding, following)
    # the value that the owner computes is the only one kept
    return with_ranges(df, key, preceding, following, parts).withColumn(name, aggregate(window)).where(OWN).drop(RANGE, OWN)


def range_frame(df: DataFrame, key: str, preceding: float, following: float, aggregates: dict[str, tuple[str, Column]], parts: int | None = None) -> DataFrame:
    """df with name = function(x) OVER (ORDER BY key RANGE BETWEEN preceding PRECEDING AND following FOLLOWING) for each name: (function, x).

    Functions are count, sum, avg, min and max.  Equal keys are folded first.  A key goes to the range it lies in and to
    those of the first and last rows whose frames it can enter, three ranges at most; ranges between, all of whose frames
    hold it, get totals.  In a range, frames are merged from a tree of folded neighbours, so work doesn't grow with frames.
    """
    at = cuts(df, key, parts or max(200, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    k, folded, merged = F.col("_key"), [], []
    for name, (f, x) in aggregates.items():
        if f in ("min", "max"):
            folded.append(getattr(F, f)(x).alias(name))
            merged.append(getattr(F, f)(name).alias(name))
            continue
        folded.append(F.count(x).alias(f"{name}_n"))
        merged.append(F.sum(f"{name}_n").alias(f"{name}_n"))
        if f != "count":
            folded.append(F.sum(x.cast("double") if f == "avg" else x).alias(name))
            merged.append(F.sum(name).alias(name))
    groups = df.groupBy(F.col(key).alias("_key")).agg(*folded)
    values = groups.columns[1:]
    floating = dict(groups.dtypes)["_key"] == "double"
    slack = (F.abs(k) + max(preceding, following)) * 1e-14 if floating else F.lit(0)  # where rounding decides, the frames do
    bounds = {"_b0": k - following - slack, "_b1": k - following + slack, "_b2": k + preceding - slack, "_b3": k + preceding + slack} if floating else {"_b0": k - following, "_b1": None, "_b2": k + preceding, "_b3": None}
    for b, x in bounds.items():
        groups = groups.withColumn(b, bucket_of(x, at) if x is not None else F.col("_b0" if b == "_b1" else "_b2"))
    ends = F.array_union(F.sequence("_b0", "_b1"), F.sequence("_b2", "_b3"))
    spread = groups.withColumn(OWN, bucket_of(k, at)).withColumn("_ends", ends).withColumn(RANGE, F.explode(F.array_union("_ends", F.array(OWN))))
    spread = spread.select(RANGE, "_key", (F.col(RANGE) == F.col(OWN)).alias("_asks"), F.array_contains("_ends", F.col(RANGE)).alias("_held"), *values)
    between = groups.where("_b2 - _b1 > 1").groupBy("_b1", "_b2").agg(*merged).withColumn(RANGE, F.explode(F.expr("sequence(_b1 + 1, _b2 - 1)"))).groupBy(RANGE).agg(*merged)
    between = between.select(RANGE, F.lit(None).cast(dict(groups.dtypes)["_key"]).alias("_key"), F.lit(False).alias("_asks"), F.lit(False).alias("_held"), *values)
    kinds = {f.name: f.dataType.simpleString() for f in groups.schema}
    out = {name: {"count": "bigint", "avg": "double"}.get(f) or kinds[name] for name, (f, _) in aggregates.items()}
    schema = ", ".join(f"`{n}` {t}" for n, t in {"_key": kinds["_key"], **out}.items())
    found = spread.union(between).groupBy(RANGE).applyInArrow(_slide(preceding, following, {n: f for n, (f, _) in aggregates.items()}), schema)
    return df.join(found, df[key].eqNullSafe(found["_key"])).drop("_key")


def _slide(preceding: float, following: float, functions: dict[str, str]) -> Callable:
    """A function of one range's keys that gives the frames of those that ask."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def slid(op, tree, start, stop, empty):
        """op over tree[start:stop] for each pair: what is left over at either end of ever larger blocks."""
        out, start, stop = np.full(len(start), empty, tree.dtype), start.copy(), stop.copy()
        while (start < stop).any():
            at = (start < stop) & (start & 1 == 1)
            out[at] = op(out[at], tree[start[at]])
            start += at
            at = (start < stop) & (stop & 1 == 1)
            stop -= at
            out[at] = op(out[at], tree[stop[at]])
            start, stop, even = start >> 1, stop >> 1, len(tree) // 2 * 2
            tree = op(tree[:even:2], tree[1:even:2])
        return out

    def run(table):
        table = table.combine_chunks()
        held, asks = (table.column(c).to_numpy() for c in ("_held", "_asks"))
        keys = pc.fill_null(table.column("_key"), 0).to_numpy()
        keys = keys if keys.dtype.kind == "f" else keys.astype(np.int64)
        inside, middle = np.flatnonzero(held), np.flatnonzero(~held & ~asks)
        inside = inside[np.argsort(keys[inside], kind="stable")]
        own, ordered = keys[asks], keys[inside]
        start, stop = np.searchsorted(ordered, own - preceding, "left"), np.searchsorted(ordered, own + following, "right")
        columns = {"_key": table.column("_key").filter(pa.array(asks))}

        def total(name, empty=0):
            values = pc.fill_null(table.column(name), empty).to_numpy()
            if values.dtype.kind == "i" and np.abs(values.astype(float)).sum() >= 2**63:
                raise OverflowError(f"a sum of {name} may not fit a bigint")
            return slid(np.add, values[inside], start, stop, empty) + values[middle].sum(dtype=values.dtype)

        for name, f in functions.items():
            if f in ("min", "max"):
                source = table.column(name)
                source = source.combine_chunks() if isinstance(source, pa.ChunkedArray) else source
                empty, op = (len(source) + 1, np.minimum) if f == "min" else (-1, np.maximum)
                code = pc.rank(source, sort_keys="ascending", null_placement="at_end", tiebreaker="dense").to_numpy().astype(np.int64)
                place = np.zeros(len(source) + 2, np.int64)
                place[code] = np.arange(len(source))
                code[source.is_null().to_numpy(zero_copy_only=False)] = empty
                best = slid(op, code[inside], start, stop, empty)
                for c in code[middle]:
                    best = op(best, c)
                columns[name] = source.take(pa.array(place[best], mask=best == empty))
                continue
            n = total(f"{name}_n")
            with np.errstate(all="ignore"):
                columns[name] = pa.array(n if f == "count" else total(name) if f == "sum" else total(name) / n, mask=None if f == "count" else n == 0)
        return pa.table(columns)

    return run


def groups_frame(df: DataFrame, partition_by: list[str], order_by: list[Column], start: int, end: int, aggregate: Callable[[WindowSpec], Column], name: str) -> DataFrame:
    """aggregate OVER (PARTITION BY ... ORDER BY ... GROUPS BETWEEN start AND end), bounds in groups of peers."""
    whole = Window.partitionBy(*partition_by).orderBy(*order_by)
    framed = Window.partitionBy(*partition_by).orderBy("_group").rangeBetween(start, end)
    return df.withColumn("_group", F.dense_rank().over(whole)).withColumn(name, aggregate(framed)).drop("_group")


def count_distinct_window(df: DataFrame, partition_by: list[str], value: str | Column, name: str) -> DataFrame:
    """count(DISTINCT value) OVER (PARTITION BY ...), from one aggregate joined back: no task holds a set of values."""
    keys = [f"_of{k}" for k in range(len(partition_by))]
    counts = df.groupBy(*(F.col(c).alias(k) for c, k in zip(partition_by, keys))).agg(F.count_distinct(value).alias(name))
    if not keys:
        return df.crossJoin(F.broadcast(counts))  # one row
    same = functools.reduce(Column.__and__, (df[c].eqNullSafe(F.col(k)) for c, k in zip(partition_by, keys)))
    return df.join(counts, same).drop(*keys)


#: Types whose Arrow columns become the pandas columns that Spark makes of them.
PLAIN = (T.IntegralType, T.FloatType, T.DoubleType, T.BooleanType, T.BinaryType, T.DateType, T.DecimalType)


def _plain(kind: T.DataType) -> bool:
    return isinstance(kind, PLAIN) or kind == T.StringType()


def user_window(df: DataFrame, partition_by: list[str], order_by: list[str], evaluate: Callable, name: str, returns: str) -> DataFrame:
    """evaluate(rows) OVER (PARTITION BY ... ORDER BY ...): a pandas frame of one partition in order to a value for each row.

    A partition must fit one Python worker; rows keep their columns.  Nulls sort last.  Partitions come many to an
    Arrow batch, so small ones cost little besides evaluate itself.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    kind = T.StructType.fromDDL(f"x {returns}")[0].dataType
    if all(_plain(f.dataType) for f in df.schema) and _plain(kind):
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = df.repartition(parts, *partition_by) if partition_by else df.repartition(1)
        order = [F.col(c) for c in partition_by] + [F.col(c).asc_nulls_last() for c in order_by]
        dealt = dealt.sortWithinPartitions(*order) if order else dealt
        return dealt.mapInArrow(_by_group(partition_by, evaluate, name, kind), f"{schema}, `{name}` {returns}")

    def run(rows):
        rows = rows.sort_values(order_by, kind="stable").reset_index(drop=True)
        return rows.assign(**{name: evaluate(rows)})

    return df.groupBy(*partition_by).applyInPandas(run, f"{schema}, `{name}` {returns}")


def _by_group(keys: list[str], evaluate: Callable, name: str, kind: T.DataType) -> Callable:
    """A function of a task's batches, sorted by keys: evaluate for each group, which may lie in several batches."""
    import numpy as np
    import pandas as pd
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark.sql.pandas.types import to_arrow_type

    out_type = to_arrow_type(kind)

    def starts(table) -> np.ndarray:
        """The rows where a group starts; null equals null and NaN equals NaN."""
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for c in keys:
            x = table.column(c)
            x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
            l, r = x.slice(0, len(x) - 1), x.slice(1)
            other = pc.fill_null(pc.not_equal(l, r), False)
            if pa.types.is_floating(x.type):
                other = pc.and_not(other, pc.fill_null(pc.and_(pc.is_nan(l), pc.is_nan(r)), False))
            new[1:] |= pc.or_(other, pc.not_equal(l.is_null(), r.is_null())).to_numpy(zero_copy_only=False)
        return np.flatnonzero(new)

    def column(values: list) -> pa.Array:
        one = lambda v: pa.array(v, type=out_type, mask=pd.isnull(v), from_pandas=True)
        if len({v.dtype for v in values}) == 1 and isinstance(values[0], np.ndarray):
            return one(np.concatenate(values))
        return pa.concat_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in map(one, values)])

    def done(table):
        table = table.combine_chunks()
        at = [*starts(table), table.num_rows]
        # whole numbers with nulls would become floats in every group of the batch: they are filled here, and groups that hold nulls read on their own
        holes, filled = np.zeros(table.num_rows, bool), table
        for k, f in enumerate(table.schema):
            if table.column(k).null_count and (pa.types.is_integer(f.type) or pa.types.is_boolean(f.type)):
                holes |= table.column(k).is_null().to_numpy()
                filled = filled.set_column(k, f.name, pc.fill_null(table.column(k), pa.scalar(0).cast(f.type)))
        frame, before, values = filled.to_pandas(), np.concatenate([[0], np.cumsum(holes)]), []
        for a, b in zip(at, at[1:]):
            rows = table.slice(a, b - a).to_pandas() if before[b] > before[a] else frame.iloc[a:b]
            rows.index = pd.RangeIndex(b - a)
            v = evaluate(rows)
            if not (isinstance(v, pd.Series) and v.index.equals(rows.index)):
                v = rows.assign(**{name: v})[name]
            values.append(v.to_numpy() if isinstance(v.dtype, np.dtype) else v.array)
        yield from table.append_column(name, column(values)).to_batches()

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            last = int(starts(batch)[-1])
            same = bool(held) and len(starts(pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), batch.slice(0, 1)]))) == 1
            if held and not (same and last == 0):
                yield from done(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = []
            elif not held and last:
                yield from done(pa.Table.from_batches([batch.slice(0, last)]))
            held.append(batch.slice(last))
        if held:
            yield from done(pa.Table.from_batches(held))

    return run


def top_n_per_group(df: DataFrame, keys: list[str], order_by: list[Column], n: int) -> DataFrame:
    """The first n rows of each group; Spark limits the groups before the shuffle."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order_by))).where(F.col("_nth") <= n).drop("_nth")
