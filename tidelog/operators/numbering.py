"""Numbering the records of a key in order, where one key may hold most of a log.

A window over a key runs in one task. Where the order is a whole number, records are cut
into runs of it: a partial aggregation counts each run, one small window sums the counts,
and records are numbered within their runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

RUN = 1 << 16
_WHOLE = (ByteType, ShortType, IntegerType, LongType)


def _in_runs(rows: DataFrame, order: Column | str) -> bool:
    return isinstance(order, str) and order in rows.columns and isinstance(rows.schema[order].dataType, _WHOLE)


def number(rows: DataFrame, keys: list[str], order: Column | str, name: str, run: int = RUN) -> DataFrame:
    """rows with `name`: 1, 2, ... within each key, in the order of a column; nulls come first."""
    if not _in_runs(rows, order):
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(order)).cast("long"))
    at = F.floor(F.col(order) / run)
    runs = rows.groupBy(*keys, at.alias("__run")).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__run")) - F.col("__n")
    runs = runs.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("__run").alias("__at"), before.alias("__before"))
    within = F.row_number().over(Window.partitionBy(*keys, "__run").orderBy(order))
    numbered = rows.withColumn("__run", at).withColumn("__within", within)
    same = numbered["__run"].eqNullSafe(runs["__at"])
    for k in keys:
        same &= numbered[k].eqNullSafe(runs[f"__{k}"])
    return numbered.join(runs, same).withColumn(name, (F.col("__before") + F.col("__within")).cast("long")).select(*rows.columns, name)


def previous(rows: DataFrame, keys: list[str], order: str, name: str, run: int = RUN) -> DataFrame:
    """rows with `name`: the value of `order` just before, within each key; null for the first. Null orders stand before all."""
    if not _in_runs(rows, order):
        return rows.withColumn(name, F.lag(order).over(Window.partitionBy(*keys).orderBy(order)))
    at = F.floor(F.col(order) / run)
    runs = rows.groupBy(*keys, at.alias("__run")).agg(F.max(order).alias("__max"))
    earlier = F.max("__max").over(Window.partitionBy(*keys).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("__run").alias("__at"), earlier.alias("__earlier"))
    within = F.lag(order).over(Window.partitionBy(*keys, "__run").orderBy(order))
    marked = rows.withColumn("__run", at).withColumn("__within", within)
    same = marked["__run"].eqNullSafe(runs["__at"])
    for k in keys:
        same &= marked[k].eqNullSafe(runs[f"__{k}"])
    return marked.join(runs, same).withColumn(name, F.coalesce("__within", "__earlier")).select(*rows.columns, name)
