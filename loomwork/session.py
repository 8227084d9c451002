"""Sessions: how to make one, and ``Loom``, the context whose sql() takes the extended dialect."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from loomwork import dialect
from loomwork.functions import catalog

#: Settings that suit large inputs: adaptive plans, skewed joins dealt anew, runtime bloom filters.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.timeType.enabled": "true",
}

#: Names of settings that users of other engines know, and what they are here.
ALIASES = {
    "execution.target_partitions": "spark.sql.shuffle.partitions",
    "target_partitions": "spark.sql.shuffle.partitions",
    "execution.time_zone": "spark.sql.session.timeZone",
    "execution.parquet.pushdown_filters": "spark.sql.parquet.filterPushdown",
    "execution.collect_statistics": "spark.sql.statistics.histogram.enabled",
    "optimizer.repartition_file_min_size": "spark.sql.files.maxPartitionBytes",
    "optimizer.hash_join_single_partition_threshold": "spark.sql.autoBroadcastJoinThreshold",
    "broadcast_join_threshold": "spark.sql.autoBroadcastJoinThreshold",
    "adaptive.enabled": "spark.sql.adaptive.enabled",
    "adaptive.coalesce_partitions": "spark.sql.adaptive.coalescePartitions.enabled",
    "shuffle.compression": "spark.io.compression.codec",
    "job.name": "spark.job.description",
}


def standalone(cores: int | str = "*", **conf: Any) -> Loom:
    """A context on this machine."""
    return _build(SparkSession.builder.master(f"local[{cores}]"), conf)


def remote(address: str, **conf: Any) -> Loom:
    """A context on a cluster: a Spark master's address, or sc://host:port for a Connect server."""
    b = SparkSession.builder
    return _build(b.remote(address) if address.startswith("sc://") else b.master(address), conf)


def _build(builder: SparkSession.Builder, conf: dict[str, Any]) -> Loom:
    for k, v in (DEFAULTS | {ALIASES.get(k, k): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return Loom(builder.getOrCreate())


class Loom:
    """One session with the dialect's statements, readers, sinks and introspection."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        catalog.register_sql(spark)

    # ------------------------------------------------------------ SQL

    def sql(self, text: str, *params: Any, **named: Any) -> DataFrame:
        """Runs one statement.  params fill $1, $2 ...; named fill $name."""
        return dialect.run(self, text, params, named)

    def script(self, text: str) -> Iterator[DataFrame]:
        for statement in dialect.statements(text):
            yield self.sql(statement)

    def set(self, key: str, value: Any) -> None:
        self.spark.conf.set(ALIASES.get(key, key), value)

    # ------------------------------------------------------------ tables

    def table(self, name: str) -> DataFrame:
        return self.spark.table(name)

    def tables(self) -> DataFrame:
        return self.spark.sql("SHOW TABLES")

    def register(self, name: str, df: DataFrame) -> None:
        df.createOrReplaceTempView(name)

    def deregister(self, name: str) -> bool:
        return self.spark.catalog.dropTempView(name)

    def _reader(self, kind: str, path: str, schema=None, **options: Any) -> DataFrame:
        from loomwork import sources

        return sources.read(self.spark, kind, path, schema, **options)

    def read_parquet(self, path: str, **options: Any) -> DataFrame:
        return self._reader("parquet", path, **options)

    def read_csv(self, path: str, **options: Any) -> DataFrame:
        """The first line names the columns unless header is false."""
        return self._reader("csv", path, **({"header": "true"} | options))

    def read_json(self, path: str, **options: Any) -> DataFrame:
        return self._reader("json", path, **options)

    def read_tbl(self, path: str, schema, **options: Any) -> DataFrame:
        return self._reader("tbl", path, schema, **options)

    def read_arrow(self, path: str, **options: Any) -> DataFrame:
        return self._reader("arrow", path, **options)

    def register_parquet(self, name: str, path: str, **options: Any) -> None:
        self.register(name, self.read_parquet(path, **options))

    def register_csv(self, name: str, path: str, **options: Any) -> None:
        self.register(name, self.read_csv(path, **options))

    def register_json(self, name: str, path: str, **options: Any) -> None:
        self.register(name, self.read_json(path, **options))

    def register_udf(self, name: str, f: Callable, returns: str, vectorised: bool = True) -> None:
        """A scalar function for SQL; vectorised ones take and return pandas Series."""
        from pyspark.sql import functions as F

        self.spark.udf.register(name, F.pandas_udf(f, returns) if vectorised else F.udf(f, returns))

    def register_async_udf(self, name: str, f: Callable, returns: str, at_once: int = 64) -> None:
        """A scalar function for SQL from a coroutine function of one row's values; at most at_once calls wait at a time in a task."""
        import asyncio

        import pandas as pd
        from pyspark.sql import functions as F

        async def together(rows: list[tuple]) -> list:
            gate = asyncio.Semaphore(at_once)

            async def one(row: tuple):
                async with gate:
                    return await f(*row)

            return await asyncio.gather(*map(one, rows))

        def of_batch(*columns: pd.Series) -> pd.Series:
            return pd.Series(asyncio.run(together(list(zip(*columns)))), dtype=object)

        of_batch.__annotations__ = {"columns": pd.Series, "return": pd.Series}
        self.spark.udf.register(name, F.pandas_udf(of_batch, returns))

    # ------------------------------------------------------------ sinks

    @staticmethod
    def _write(df: DataFrame, kind: str, path: str, partition_by: list[str] = (), mode: str = "errorifexists", **options: Any) -> None:
        from loomwork import sources

        sources.write(df, kind, path, partition_by, mode, **options)

    def write_parquet(self, df: DataFrame, path: str, **options: Any) -> None:
        self._write(df, "parquet", path, **options)

    def write_csv(self, df: DataFrame, path: str, **options: Any) -> None:
        self._write(df, "csv", path, **options)

    def write_json(self, df: DataFrame, path: str, **options: Any) -> None:
        self._write(df, "json", path, **options)

    # ------------------------------------------------------------ results

    def collect_with_progress(self, df: DataFrame, tell: Callable[[int, int], None], every: float = 0.2) -> list:
        """The rows; meanwhile tell(finished tasks, known tasks) is called every so many seconds."""
        import threading
        import uuid

        sc, group, done = self.spark.sparkContext, uuid.uuid4().hex, threading.Event()
        tracker = sc.statusTracker()

        def watch() -> None:
            while not done.wait(every):
                stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
                infos = [i for s in stages if (i := tracker.getStageInfo(s))]
                tell(sum(i.numCompletedTasks for i in infos), sum(i.numTasks for i in infos))

        thread = threading.Thread(target=watch, daemon=True)
        sc.setJobGroup(group, "collect_with_progress")
        thread.start()
        try:
            return df.collect()
        finally:
            done.set()
            thread.join()
            sc.setLocalProperty("spark.jobGroup.id", None)

    @staticmethod
    def collect_partitioned(df: DataFrame) -> list[list]:
        """Rows by partition, in the order of partitions (for small results)."""
        from pyspark.sql import functions as F

        out: dict[int, list] = {}
        for row in df.withColumn("_p", F.spark_partition_id()).collect():
            out.setdefault(row["_p"], []).append(row[:-1])
        return [out[k] for k in sorted(out)]

    @staticmethod
    def to_arrow_table(df: DataFrame):
        return df.toArrow()

    @staticmethod
    def to_polars(df: DataFrame):
        try:
            import polars
        except ImportError as e:
            raise RuntimeError("polars is not installed") from e
        return polars.from_arrow(df.toArrow())

    @staticmethod
    def explain(df: DataFrame, kind: str = "formatted") -> str:
        from loomwork.plans import explain

        return explain.text(df, kind)

    @staticmethod
    def explain_analyze(df: DataFrame) -> DataFrame:
        from loomwork.plans import explain

        return explain.analyze(df)


def conf_key(key: str) -> str:
    return ALIASES.get(re.sub(r"^\w+\.(?=(execution|optimizer|adaptive|shuffle|job)\.)", "", key.strip().lower()), key.strip())
