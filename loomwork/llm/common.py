"""What the operators share: tables, scratch space on shared storage, shipping the package, Arrow batches."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Hashable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from loomwork.operators.relational import estimated_bytes

#: Bytes of values that one Arrow batch sent back to Spark holds at most, but for a single larger row.
BATCH_BYTES = 4 << 20
#: Bytes for each core under which a table is dealt out before it is worked on.  Bytes of an Arrow batch that Spark sends to a Python worker, where the session doesn't say otherwise.
SPREAD_BYTES = 4 << 20
SENT_BYTES, SENT_SETTING = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once a SparkContext; they need no shared Python path.  Bounds the bytes of Arrow batches."""
    sc = spark.sparkContext
    if not sc.getConf().contains(SENT_SETTING):
        spark.conf.set(SENT_SETTING, str(SENT_BYTES))
    if getattr(sc, "_loomwork_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="loomwork-")
    with zipfile.ZipFile(f"{folder}/loomwork_{uuid.uuid4().hex[:8]}.zip", "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    sc.addPyFile(z.filename)
    sc._loomwork_shipped = True


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; without it a folder of this machine, for a local master only."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = getattr(spark.sparkContext, "_loomwork_scratch", None)
        if where is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            where = spark.sparkContext._loomwork_scratch = "file://" + tempfile.mkdtemp(prefix="loomwork-scratch-")
    return where.rstrip("/")


def _remove(path: str) -> None:
    """Removes a folder, if it is there; one in a store that only Spark reaches stays."""
    if path.startswith("file:"):
        path = path[5:]
    try:
        store, where = fs.FileSystem.from_uri(path if "://" in path else Path(path).absolute().as_uri())
        if store.get_file_info(where).type != fs.FileType.NotFound:
            store.delete_dir(where)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        pass


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; removed when the driver's Python ends, if drop_scratch() hasn't done it before."""
    path = f"{scratch(spark)}/loomwork/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def drop_scratch(*made: DataFrame) -> None:
    """Removes the files of DataFrames that materialize() returned; for when nothing reads them any more."""
    for df in made:
        _remove(df.scratch_path)


_KEPT: list[tuple[Hashable, object]] = []


def kept(key: Hashable, make: Callable[[], object]):
    """An object that a worker process keeps from one task to the next; one at a time, whatever the operator."""
    if not _KEPT or _KEPT[0][0] != key:
        release()
        _KEPT.append((key, make()))
    return _KEPT[0][1]


def release() -> None:
    """Drops what kept() holds and gives free memory back; tasks of operators that keep nothing begin with it."""
    _KEPT.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def spread(df: DataFrame) -> DataFrame:
    """df, dealt to all cores where it is so small that a scan may give it to fewer tasks: a table of one file can be one row group.

    Only tables of under SPREAD_BYTES for each core are moved; the rows are the same.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if estimated_bytes(df) < cores * SPREAD_BYTES else df


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of Arrow batches as tuples of Python values, a small slice at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield from zip(*(c.to_pylist() for c in part.columns))


def batched(rows: Iterable[tuple], schema: pa.Schema, size=None) -> Iterator[pa.RecordBatch]:
    """Tuples to Arrow batches of bounded bytes; size(row) gives the bytes of a row's long values."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += 64 + (size(row) if size else 0)
        if total >= BATCH_BYTES:
            yield to_batch(held, schema)
            held, total = [], 0
    if held:
        yield to_batch(held, schema)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
