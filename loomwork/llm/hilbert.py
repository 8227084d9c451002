"""Approximate nearest neighbours (cosine) by several shifted Hilbert curves.

Each curve has a random projection of its own to DIMS dimensions and a shift of its own.  Distinct
vectors are range-partitioned by curve and Hilbert key in Spark and numbered along each curve.  A query
sees a window of REACH vectors to either side of its place on each curve, whatever the size of the table: blocks of
ROWS vectors, with as many more of their neighbours as a window needs, are the unit of work.  On the curves
a vector is a code of one byte a dimension.  The best of all windows by the codes' cosine merge,
and these few are ranked anew by the exact cosine of the original vectors.

The work for a query is CURVES windows, so it does not grow with the table; what falls with the table's size is
recall, if the vectors have no structure at all.  Of independent normal ones in 64 dimensions, the worst case, the
windows find 0.96 of the 5 nearest among 51,000 and see about a third of the table for that; more of them need
more curves or wider windows.

Equal vectors are one entry that carries its smallest ids, as many as a result can need, so copies
cost nothing and ties go to the smallest ids.  Vectors that are null, zero or hold a null or
non-finite component take no part; nor do rows without an id.  Vectors of another length are compared within their
own length only.  Repeated rows of an id count once.  An empty table gives no rows; further columns don't matter.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, release, ship

#: Curves, dimensions of their projections, bits of a key, vectors to either side in a window, vectors of a block.
CURVES, DIMS, BITS, REACH, ROWS = 64, 16, 48, 192, 1024
#: Of a window and of all windows together, so many times the wanted vectors go on.
SPARE = 3


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row of cells (n x dims, values below 2**bits) along the Hilbert curve.

    The transposed form of J. Skilling's "Programming the Hilbert curve" (2004).  Per level from the top: undo the reflections and exchanges that the levels above have made, then
    read the bits as a Gray code.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for d in range(dims):
            flip = (x[d] & q) > 0
            swap = np.where(flip, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            x[d] ^= swap
        q >>= 1
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    gray = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        gray ^= np.where((x[-1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= gray
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            key = key << 1 | (x[d] >> b) & 1
    return key


@functools.lru_cache(maxsize=1024)
def projection(d: int, number: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Basis, shift and bits a dimension of the curve of that number."""
    rnd = np.random.default_rng([number, d])
    dims = min(DIMS, d)
    basis, _ = np.linalg.qr(rnd.standard_normal((d, dims)))
    return basis * np.sqrt(d) / 6, 0.5 + rnd.uniform(-0.05, 0.05, dims), min(BITS // dims, 16)


def curve(vectors: np.ndarray, number: int) -> np.ndarray:
    """Keys on the curve of that number, from unit vectors (n x d)."""
    basis, shift, bits = projection(vectors.shape[1], number)
    return hilbert_keys(np.clip((vectors @ basis + shift) * (1 << bits), 0, (1 << bits) - 1).astype(np.int64), bits)


def codes(unit: np.ndarray) -> np.ndarray:
    """One signed byte for each component, the largest of a vector as 127."""
    return np.rint(unit * (127 / np.abs(unit).max(axis=1, keepdims=True))).astype(np.int8)


def _binary(rows: np.ndarray) -> pa.Array:
    """Each row of bytes as a value."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _keys(batches, curves: int):
    """Rows (entry, query, vector) to a row for each curve."""
    release()
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            entry, query = (part.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            vectors = part.column(2).to_pylist()
            length = np.array([len(v) for v in vectors])
            for size in np.unique(length):
                own = np.flatnonzero(length == size)
                v = np.array([vectors[k] for k in own], np.float64)
                v /= np.abs(v).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
                unit = v / np.linalg.norm(v, axis=1, keepdims=True)
                n, code = len(own), codes(unit)
                for some in itertools.batched(range(curves), max(1, (1 << 21) // (n * int(size)))):
                    columns = [
                        pa.array(np.full(n * len(some), size, np.int32)), pa.array(np.repeat(np.array(some, np.int32), n)), pa.array(np.concatenate([curve(unit, c) for c in some])),
                        pa.array(np.tile(entry[own], len(some))), pa.array(np.tile(query[own], len(some))), _binary(np.tile(code, (len(some), 1))),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["size", "curve", "key", "entry", "query", "code"])


def _lines(batches):
    """The rows of each block (size, curve, block, then entry, query, code) as size and three arrays."""
    held, key = [], None

    def block():
        return key[0], np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])

    for batch in batches:
        if not batch.num_rows:
            continue
        size, line, number, entry, asks = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
        code = batch.column(5)
        offsets = np.frombuffer(code.buffers()[1], np.int32)[code.offset : code.offset + len(code) + 1]
        data = np.frombuffer(code.buffers()[2], np.int8)
        first = np.flatnonzero(np.append(True, (size[1:] != size[:-1]) | (line[1:] != line[:-1]) | (number[1:] != number[:-1])))
        for a, b in zip(first, np.append(first[1:], len(size))):
            now = int(size[a]), int(line[a]), int(number[a])
            if now != key and held:
                yield block()
                held = []
            key = now
            held.append((entry[a:b], asks[a:b], data[offsets[a] : offsets[b]].reshape(b - a, now[0])))
    if held:
        yield block()


def _windows(batches, k: int, reach: int):
    """The k best of each query's window in a block, by the codes' cosine."""
    release()
    for _, entry, asks, code in _lines(batches):
        at = np.flatnonzero(asks)
        if not len(at):
            continue
        unit = code.astype(np.float32)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        found = []
        for x in at:
            low = max(x - reach, 0)
            near = unit[low : x + reach + 1] @ unit[x]
            best = np.argpartition(-near, k - 1)[:k] if len(near) > k else np.arange(len(near))
            found.append((np.full(len(best), entry[x]), entry[low + best], near[best]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[j] for f in found])) for j in range(3)], names=["q", "entry", "near"])


def nearest(vectors: DataFrame, queries: str, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", curves: int = CURVES, rows: int = ROWS, reach: int = REACH) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for the rows that the SQL condition ``queries`` on vec_id names."""
    spark = vectors.sparkSession
    ship(spark)
    parts, most = int(spark.conf.get("spark.sql.shuffle.partitions")), SPARE * (k + 1)
    plain = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")).where("vec_id is not null and size(vector) > 0")
    plain = plain.where("not exists(vector, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(vector, x -> x <> 0)")
    # equal vectors are one entry with its k + 1 smallest ids; ids are cut in each partition first, so no copy group meets in one row
    asked = plain.withColumn("asked", F.expr(queries))
    some = asked.groupBy("vector", F.spark_partition_id().alias("p")).agg(F.slice(F.array_sort(F.collect_set("vec_id")), 1, k + 1).alias("ids"), F.max("asked").alias("asked"))
    entries = some.groupBy("vector").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"), F.max("asked").alias("query"))
    entries = materialize(entries.withColumn("entry", F.col("ids")[0]), "entries")
    keyed = entries.select("entry", "query", "vector").mapInArrow(lambda b: _keys(b, curves), "size int, curve int, key long, entry long, query boolean, code binary")
    order = ("size", "curve", "key", "entry")
    dealt = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("size", "curve", "entry", "query", "code", F.monotonically_increasing_id().alias("place"))
    dealt = materialize(dealt, "curves")
    # place along the whole curve: the rows of the partitions before, and the place in the partition
    line = Window.partitionBy("size", "curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("size", "curve", F.expr("shiftright(place, 33)").alias("part")).agg(F.count("*").alias("n"), F.min("place").alias("first"))
    base = base.select("size", "curve", "part", (F.coalesce(F.sum("n").over(line), F.lit(0)) - F.col("first")).alias("base"))
    placed = dealt.withColumn("part", F.expr("shiftright(place, 33)")).join(base, ["size", "curve", "part"]).withColumn("nth", F.expr("base + place"))
    own = F.expr(f"nth div {rows}")
    blocks = placed.select("size", "curve", F.explode(F.expr(f"sequence(greatest(nth - {reach}, 0) div {rows}, (nth + {reach}) div {rows})")).alias("block"), "nth", "entry", F.col("query").alias("asks"), own.alias("own"), "code")
    blocks = blocks.withColumn("asks", F.expr("asks and block = own")).drop("own").repartition(parts, "size", "curve", "block").sortWithinPartitions("size", "curve", "block", "nth")
    found = blocks.select("size", "curve", "block", "entry", "asks", "code").mapInArrow(lambda b: _windows(b, most, reach), "q long, entry long, near float")
    found = found.groupBy("q", "entry").agg(F.max("near").alias("near"))
    found = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("near"), "entry"))).where(F.col("r") <= most)
    found = materialize(found.select("q", "entry"), "candidates")
    # exact cosine of the original vectors
    mine, other = entries.select(F.col("entry").alias("q"), F.col("vector").alias("x")), entries.select("entry", "ids", F.col("vector").alias("y"))
    dot = lambda a, b: f"aggregate(zip_with({a}, {b}, (s, t) -> s * t), 0D, (s, t) -> s + t)"
    scored = found.join(mine, "q").join(other, "entry").select("q", "entry", "ids", F.expr(f"{dot('x', 'y')} / (sqrt({dot('x', 'x')}) * sqrt({dot('y', 'y')}))").alias("score"))
    top = scored.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "entry"))).where(F.col("r") <= k + 1)
    top = materialize(top.select("q", "score", F.explode("ids").alias("vec_id")), "found")
    ids = plain.where(queries).select(F.col("vec_id").alias("query_id"), "vector").join(entries.select("vector", F.col("entry").alias("q")), "vector").select("query_id", "q").distinct()
    ranked = ids.join(top, "q").where("query_id <> vec_id").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
