"""Append-only JSON-lines journals, read strictly: a declared schema, unknown fields rejected, malformed lines an error."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.errors import StorageCorrupt
from tidelog.operators.stores import transaction_faults
from tidelog.schemas import schema_of


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read(spark: SparkSession, path: str, dataset: str, strict: bool = True) -> DataFrame:
    """A journal's records. Strict reading fails on a malformed line or, at the check below, an undeclared field."""
    schema = schema_of(dataset)
    if not strict:
        return spark.read.schema(schema).json(path, mode="DROPMALFORMED")
    lines = spark.read.text(path)
    unknown = F.array_except(F.json_object_keys("value"), F.array(*[F.lit(n) for n in schema.names]))
    checked = F.when(F.size(unknown) > 0, F.raise_error(F.concat(F.lit("undeclared field in a journal: "), F.array_join(unknown, ", ")))).otherwise(F.col("value"))
    return lines.select(F.from_json(checked, schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def open_transactions(spark: SparkSession, path: str) -> DataFrame:
    """A transaction journal in order; a gap, a repeated id or an empty record makes it unusable."""
    rows = read(spark, path, "transaction")
    fault = transaction_faults(rows).head(1)
    if fault:
        raise StorageCorrupt(f"transaction {fault[0].sequence}: {fault[0].reason}")
    return rows.orderBy("sequence")
