"""Arrow IPC files as a data source: format "arrow_ipc", a partition for each file.

    spark.dataSource.register(ArrowIpcSource)
    spark.read.format("arrow_ipc").option("path", folder).load()
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tidelog.session import ship
from tidelog.sources.storage import list_files, open_folder, publish


def _files(path: str) -> list[str]:
    return [f for f, _ in list_files(path, (".arrow",))]


class ArrowIpcReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.wanted = path, schema

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(f) for f in _files(self.path)] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        with open_folder(self.path)[0].open_input_file(partition.value) as f, pa.ipc.open_file(f) as reader:
            if reader.schema.names != self.wanted.names:
                raise ValueError(f"{partition.value}: the schema differs from the first file's")
            for i in range(reader.num_record_batches):
                yield reader.get_batch(i)


class ArrowIpcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "arrow_ipc"

    def schema(self) -> StructType:
        from pyspark.sql.pandas.types import from_arrow_schema

        files = _files(self.options["path"])
        if not files:
            raise ValueError(f"{self.options['path']} holds no .arrow file")
        with open_folder(self.options["path"])[0].open_input_file(files[0]) as f, pa.ipc.open_file(f) as reader:
            return from_arrow_schema(reader.schema)

    def reader(self, schema: StructType) -> ArrowIpcReader:
        return ArrowIpcReader(self.options["path"], schema)


def read_ipc(spark: SparkSession, path: str) -> DataFrame:
    ship(spark)
    spark.dataSource.register(ArrowIpcSource)
    return spark.read.format("arrow_ipc").option("path", path).load()


def write_ipc(df: DataFrame, folder: str) -> DataFrame:
    """One .arrow file a task, complete or absent; returns (file, rows) and writes when that is run."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"part-{TaskContext.get().partitionId():06d}.arrow"
        first = next(batches, None)
        if first is None:
            return
        rows = 0
        with publish(folder, name) as f, pa.ipc.new_file(f, first.schema) as out:
            batch = first
            while batch is not None:
                out.write_batch(batch)
                rows += batch.num_rows
                batch = next(batches, None)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([rows])], names=["file", "rows"])

    return df.mapInArrow(run, "file string, rows long")
