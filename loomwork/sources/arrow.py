"""Arrow IPC files as a distributed source: a task for each file, batches as they are in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema


def _open(path: str):
    import pyarrow as pa
    from pyarrow import fs

    store, where = fs.FileSystem.from_uri(path)
    file = store.open_input_file(where)
    try:
        return pa.ipc.open_file(file)
    except pa.ArrowInvalid:
        file.seek(0)
        return pa.ipc.open_stream(file)


def _files(path: str) -> list[str]:
    from pyarrow import fs

    store, where = fs.FileSystem.from_uri(path)
    info = store.get_file_info(where)
    if info.type == fs.FileType.File:
        return [path]
    base = path.rstrip("/")
    found = store.get_file_info(fs.FileSelector(where, recursive=True))
    return sorted(base + f.path[len(where.rstrip("/")) :] for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))


class ArrowSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "loom_arrow"

    def schema(self):
        return from_arrow_schema(_open(_files(self.options["path"])[0]).schema)

    def reader(self, schema):
        return ArrowReader(self.options["path"])


class ArrowReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return [InputPartition(f) for f in _files(self.path)]

    def read(self, partition):
        import pyarrow as pa
        from pyarrow import fs

        store, where = fs.FileSystem.from_uri(partition.value)
        with store.open_input_file(where) as file:
            try:
                reader = pa.ipc.open_file(file)
                yield from (reader.get_batch(k) for k in range(reader.num_record_batches))
            except pa.ArrowInvalid:
                file.seek(0)
                yield from pa.ipc.open_stream(file)


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    if "://" not in path:
        path = f"file://{path}"
    spark.dataSource.register(ArrowSource)
    return spark.read.format("loom_arrow").options(**options).load(path)
