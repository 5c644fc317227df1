"""Following logs: change feeds, incremental materialisation, append sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidelog.functions.subjects import subject_matches
from tidelog.operators.logs import apply_once
from tidelog.session import hadoop_path


def follow(spark: SparkSession, path: str, schema: StructType, after: int | None = None, seq: str = "global_sequence", subject_filter: str | None = None) -> DataFrame:
    """A log folder as a stream. The offset log is the durable cursor; `after` seeks past a sequence, a filter keeps matching subjects."""
    rows = spark.readStream.schema(schema).parquet(path)
    if after is not None:
        rows = rows.where(F.col(seq) > after)
    return rows if subject_filter is None else rows.where(subject_matches(F.col("subject"), subject_filter))


def once_each(rows: DataFrame, event_id: str = "event_id") -> DataFrame:
    """The first record of each event id; ids seen stay in the state store."""
    return rows.dropDuplicates([event_id])


def materialise(rows: DataFrame, target: str, checkpoint: str, seq: str = "global_sequence", event_id: str = "event_id") -> StreamingQuery:
    """Appends each event id once to `target`, exactly once also when a batch is repeated.

    A batch owns the folder batch=<id> and replaces it whole, so a repetition writes the
    same again; ids of earlier batches are left out by an anti join on their column alone.
    The join reads earlier ids between the batch's least and greatest only: where ids grow,
    statistics leave out the history, so a batch costs what it holds.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fs, at = hadoop_path(spark, target)
        there = fs.exists(at)
        earlier = None
        if there:
            low, high = batch.agg(F.min(event_id), F.max(event_id)).first()
            earlier = spark.read.parquet(target).where((F.col("batch") != batch_id) & F.col(event_id).between(low, high)).select(event_id)
        apply_once(batch, earlier, seq, event_id).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_to(rows: DataFrame, target: str, checkpoint: str, partition_by: list[str] | None = None) -> StreamingQuery:
    """Routes records to `target`, partitioned (by shard, say), with the file sink's own commit log."""
    writer = rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", target).trigger(availableNow=True)
    return (writer.partitionBy(*partition_by) if partition_by else writer).start()
