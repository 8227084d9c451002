"""Connected components of an edge table.

Up to LOCAL edges are united in one task (a bounded table); more by alternating large-star and small-star
steps over the whole cluster.  Both give every vertex the smallest id that it reaches.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, materialize, rows_of, ship

#: Edges that one task unites at most.
LOCAL = 200_000


def _unite(batches):
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = up
        return x

    for u, v in rows_of(batches):
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    yield from batched(((x, find(x)) for x in list(root)), pa.schema([("id", pa.int64()), ("component", pa.int64())]))


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """edges: (u, v).  Minimum of each u's neighbours and itself; only sums by key are grouped, so hubs don't meet in one row."""
    if small:
        own = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    else:
        own = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = materialize(own.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
    joined = own.join(low, "u")
    if small:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    else:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return materialize(out.where("u <> v").distinct(), "edges")


def components(edges: DataFrame, a: str = "a", b: str = "b", local: int = LOCAL) -> DataFrame:
    """(id, component): every vertex that has an edge, with the smallest id that it reaches."""
    now = materialize(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "edges")
    if now.count() <= local:
        ship(now.sparkSession)
        return now.repartition(1).mapInArrow(_unite, "id long, component long")
    before = None
    while True:
        now = _star(_star(now, False), True)
        sign = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        if (sign["n"], sign["s"]) == before:
            break
        before = sign["n"], sign["s"]
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
