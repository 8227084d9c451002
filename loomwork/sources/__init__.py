"""Readers and sinks: Spark's own, pipe-delimited .tbl files, Arrow files, and sinks with one file."""

from __future__ import annotations

import os
import uuid
from typing import Any

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from loomwork.sources import arrow

BUILT_IN = {"parquet", "csv", "json", "orc", "text"}


def read(spark: SparkSession, kind: str, path: str, schema: StructType | str | None = None, **options: Any) -> DataFrame:
    kind = kind.lower()
    if kind == "tbl":
        return read_tbl(spark, path, schema, **options)
    if kind == "arrow":
        return arrow.read(spark, path, **options)
    if kind == "avro":
        raise RuntimeError("Avro needs the spark-avro package on the class path")
    if kind not in BUILT_IN:
        raise ValueError(f"unknown format {kind}")
    reader = spark.read.options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    elif kind == "csv" and "inferSchema" not in options:
        reader = reader.option("inferSchema", "true")
    return reader.format(kind).load(path)


def read_tbl(spark: SparkSession, path: str, schema: StructType | str, **options: Any) -> DataFrame:
    """Pipe-delimited files whose lines end with a delimiter: the empty last column goes."""
    own = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    wide = StructType([*own.fields, StructField("_end", _string(), True)])
    return spark.read.options(sep="|", **options).schema(wide).csv(path).drop("_end")


def _string():
    from pyspark.sql.types import StringType

    return StringType()


def write(df: DataFrame, kind: str, path: str, partition_by: list[str] = (), mode: str = "errorifexists", single_file: bool | None = None, **options: Any) -> None:
    """A directory of files, or one file where the path ends in the format's name and single_file isn't False."""
    kind = kind.lower()
    if kind not in BUILT_IN:
        raise ValueError(f"no sink for {kind}")
    one = single_file if single_file is not None else path.endswith(f".{kind}") and not partition_by
    if kind == "csv" and "header" not in options:
        options["header"] = "true"
    if not one:
        writer = df.write.mode(mode).options(**options)
        (writer.partitionBy(*partition_by) if partition_by else writer).format(kind).save(path)
        return
    store, target = fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path.removeprefix("file:")))
    there = store.get_file_info(target).type
    if there != fs.FileType.NotFound and mode == "errorifexists":
        raise FileExistsError(path)
    folder = f".{uuid.uuid4().hex}.tmp"
    df.coalesce(1).write.options(**options).format(kind).save(path + folder)
    part = next(f.path for f in store.get_file_info(fs.FileSelector(target + folder)) if f.base_name.startswith("part-"))
    if there == fs.FileType.Directory:
        store.delete_dir(target)
    elif there == fs.FileType.File:
        store.delete_file(target)
    store.move(part, target)
    store.delete_dir(target + folder)


def series(spark: SparkSession, start: Any, end: Any, step: Any = 1, inclusive: bool = True, name: str = "value") -> DataFrame:
    """generate_series (inclusive) or range; a null argument gives no rows.  Integers never meet in one row."""
    if start is None or end is None or step is None:
        return spark.range(0).select(F.col("id").alias(name))
    if isinstance(start, int) and isinstance(step, int):
        return spark.range(start, end + (1 if step > 0 else -1) if inclusive else end, step).select(F.col("id").alias(name))
    df = spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end), F.expr(step) if isinstance(step, str) else F.lit(step))).alias(name))
    return df if inclusive else df.where(F.col(name) != F.lit(end))
