"""Streaming queries over the tables: each runs a stream to the end of its input and returns what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators import folds
from tidelog.plans.lenses import LENSES, duck
from tidelog.session import hadoop_path, scratch_folder
from tidelog.streaming import feeds, groups


def _events(spark: SparkSession, sf: str) -> DataFrame:
    """The events as a stream, whether the table is a folder or one file (which a stream reads by its folder and name)."""
    path = f"{sf}/events.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    fs, at = hadoop_path(spark, path)
    if fs.getFileStatus(at).isDirectory():
        return reader.parquet(path)
    return reader.option("recursiveFileLookup", "true").option("pathGlobFilter", "events.parquet").parquet(sf)


def _through(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A lens over the events as a stream."""
    return spark.sql(LENSES[name], events=_events(spark, sf))


def fold_available_now(spark: SparkSession, sf: str) -> DataFrame:
    """Execution states from an incrementally materialised log."""
    folder = scratch_folder(spark, "fold")
    feeds.materialise(_through(spark, sf, "event_log"), f"{folder}/log", f"{folder}/checkpoint").awaitTermination()
    return folds.fold_executions(spark.read.parquet(f"{folder}/log"))


def routed_by_shard(spark: SparkSession, sf: str) -> DataFrame:
    """Records of one subject filter past a cursor, routed to a folder for each shard."""
    folder = scratch_folder(spark, "routed")
    rows = _through(spark, sf, "stream").where(F.col("sequence") > 100)
    from tidelog.functions.subjects import subject_matches

    rows = rows.where(subject_matches(F.col("subject"), "events.purchase.>"))
    feeds.append_to(rows, f"{folder}/out", f"{folder}/checkpoint", ["shard"]).awaitTermination()
    return spark.read.schema("sequence long, subject string, payload string, transaction_id string, shard int").parquet(f"{folder}/out").select("shard", "sequence", "subject")


SCRIPT_LENS = """
SELECT CAST(user_id % 4 AS INT) AS shard, event_id AS tick, CASE WHEN event_type IN ('view', 'click') THEN 'append' WHEN event_type = 'error' THEN 'ack' ELSE 'poll' END AS kind,
CASE WHEN event_type IN ('view', 'click') THEN event_id + 1 ELSE NULL END AS seq, 'events.' || event_type AS subject, 'w' || CAST(user_id % 3 AS STRING) AS member FROM {events}"""


def group_redelivery(spark: SparkSession, sf: str) -> DataFrame:
    """Deliveries of a consumer group with redelivery after 40 ticks."""
    folder = scratch_folder(spark, "group")
    script = spark.sql(SCRIPT_LENS, events=_events(spark, sf))
    feeds.append_to(groups.deliver(script, 40), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema(groups.DELIVERIES).parquet(f"{folder}/out")


def queries() -> dict:
    return {"stream_fold_available_now": fold_available_now, "stream_routed_by_shard": routed_by_shard, "stream_group_redelivery": group_redelivery}


def oracle_sql() -> dict[str, str]:
    from tidelog.plans.catalogue import EXECUTIONS

    return {
        "stream_fold_available_now": duck(f"SELECT * FROM {EXECUTIONS} AS x"),
        "stream_routed_by_shard": duck("SELECT shard, sequence, subject FROM {stream} AS s WHERE sequence > 100 AND starts_with(subject, 'events.purchase.')"),
    }
