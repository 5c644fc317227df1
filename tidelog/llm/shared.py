"""Cutting lineage in the shared folder, and Python over record batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from tidelog.session import shared_folder, ship


def cut(df: DataFrame) -> DataFrame:
    """df written once to the shared folder, so a lost executor costs a read and not the work before it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """df.mapInArrow with this package at hand in the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)
