"""Snapshot tables: write, commit, latest-snapshot scans with filter and projection, grants."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType, StringType

from tidelog.errors import InvalidState, NotFound, PermissionDenied, StorageCorrupt
from tidelog.functions.scalars import check_identifier, content_digest
from tidelog.session import hadoop_path

TABLES = "table_id string, tenant string, namespace string, name string, created_by string, commit_seq long"
SNAPSHOTS = "table_id string, snapshot_id string, parent_id string, files array<string>, commit_seq long"
CONTENTS = "table_id string, snapshot_id string, file string, byte_len long, digest string"
GRANTS = "tenant string, namespace string, table string, principal string"


@dataclass(frozen=True)
class Predicate:
    """Equality with a value of the column's own kind: text with text, whole numbers with whole numbers."""

    column: str
    value: str | int


def check_projection(names: Sequence[str], columns: Sequence[str]) -> list[str]:
    if not columns:
        raise InvalidState("a projection must name a column")
    if len(set(columns)) < len(columns):
        raise InvalidState("a projection must not name a column twice")
    missing = [c for c in columns if c not in names]
    if missing:
        raise InvalidState(f"there is no column {missing[0]}")
    return list(columns)


def filter_project(df: DataFrame, predicate: Predicate | None = None, projection: Sequence[str] | None = None) -> DataFrame:
    """Rows equal to the predicate (null never is), then the projection; the predicate's column need not be in it. Kept rows keep their nulls."""
    if predicate is not None:
        if predicate.column not in df.columns:
            raise InvalidState(f"there is no column {predicate.column}")
        kind = df.schema[predicate.column].dataType
        text, whole = isinstance(kind, StringType), isinstance(kind, (LongType, IntegerType, ShortType, ByteType))
        if not (text and isinstance(predicate.value, str) or whole and isinstance(predicate.value, int) and not isinstance(predicate.value, bool)):
            raise InvalidState(f"column {predicate.column} is {kind.simpleString()}; the predicate's value is not")
        df = df.where(F.col(predicate.column) == F.lit(predicate.value))
    return df if projection is None else df.select(*check_projection(df.columns, projection))


def latest_snapshots(snapshots: DataFrame) -> DataFrame:
    return snapshots.groupBy("table_id").agg(F.max_by(F.struct("snapshot_id", "parent_id", "files"), "commit_seq").alias("s")).select("table_id", "s.*")


def broken_chains(snapshots: DataFrame) -> DataFrame:
    """Snapshots whose parent is not the one committed before them."""
    before = F.lag("snapshot_id").over(Window.partitionBy("table_id").orderBy("commit_seq"))
    return snapshots.withColumn("expected", before).where(~F.col("parent_id").eqNullSafe(F.col("expected"))).select("table_id", "snapshot_id", "parent_id", "expected")


def scannable(tables: DataFrame, grants: DataFrame, principal: str) -> DataFrame:
    """Tables that a principal may scan (semi join)."""
    own = grants.where(F.col("principal") == principal)
    return tables.join(own, (tables["tenant"] == own["tenant"]) & (tables["namespace"] == own["namespace"]) & (tables["name"] == own["table"]), "left_semi")


class Catalog:
    """Tables, snapshots and grants as append-only Parquet logs below a folder; one writer."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _log(self, name: str, ddl: str) -> DataFrame:
        path = f"{self.root}/_catalog/{name}"
        fs, at = hadoop_path(self.spark, path)
        if not fs.exists(at):
            return self.spark.createDataFrame([], ddl)
        return self.spark.read.schema(ddl).parquet(path)

    @property
    def tables(self) -> DataFrame:
        return self._log("tables", TABLES)

    @property
    def snapshots(self) -> DataFrame:
        return self._log("snapshots", SNAPSHOTS)

    @property
    def contents(self) -> DataFrame:
        """(table_id, snapshot_id, file, byte_len, digest) of the files that snapshots were committed with."""
        return self._log("contents", CONTENTS)

    @property
    def grants(self) -> DataFrame:
        return self._log("grants", GRANTS)

    def _append(self, name: str, ddl: str, row: tuple) -> None:
        self.spark.createDataFrame([row], ddl).coalesce(1).write.mode("append").parquet(f"{self.root}/_catalog/{name}")

    def _next(self, log: DataFrame) -> int:
        return (log.agg(F.max("commit_seq")).first()[0] or 0) + 1

    def create_table(self, tenant: str, namespace: str, name: str, created_by: str) -> str:
        for value, what in ((tenant, "tenant"), (namespace, "namespace"), (name, "table"), (created_by, "principal")):
            check_identifier(value, what)
        table_id = f"{tenant}_{namespace}_{name}"
        if not self.tables.where(F.col("table_id") == table_id).isEmpty():
            raise InvalidState(f"table {table_id} is there already")
        self._append("tables", TABLES, (table_id, tenant, namespace, name, created_by, self._next(self.tables)))
        return table_id

    def get_table(self, tenant: str, namespace: str, name: str):
        found = self.tables.where((F.col("tenant") == tenant) & (F.col("namespace") == namespace) & (F.col("name") == name)).head(1)
        if not found:
            raise NotFound(f"there is no table {tenant}.{namespace}.{name}")
        return found[0]

    def latest_snapshot(self, table_id: str):
        found = latest_snapshots(self.snapshots.where(F.col("table_id") == table_id)).head(1)
        return found[0] if found else None

    def get_snapshot(self, table_id: str, snapshot_id: str):
        found = self.snapshots.where((F.col("table_id") == table_id) & (F.col("snapshot_id") == snapshot_id)).head(1)
        if not found:
            raise NotFound(f"table {table_id} has no snapshot {snapshot_id}")
        return found[0]

    def commit_snapshot(self, table_id: str, snapshot_id: str, parent_id: str | None, files: list[str]) -> None:
        """Commits a snapshot whose parent must be the latest one."""
        check_identifier(snapshot_id, "snapshot")
        if not files:
            raise InvalidState("a snapshot must list a file")
        latest = self.latest_snapshot(table_id)
        if (latest.snapshot_id if latest else None) != parent_id:
            raise InvalidState(f"the parent of {snapshot_id} is not the latest snapshot of {table_id}")
        if not self.snapshots.where((F.col("table_id") == table_id) & (F.col("snapshot_id") == snapshot_id)).isEmpty():
            raise InvalidState(f"snapshot {snapshot_id} is there already")
        self._append("snapshots", SNAPSHOTS, (table_id, snapshot_id, parent_id, files, self._next(self.snapshots)))

    def grant(self, tenant: str, namespace: str, table: str, principal: str) -> None:
        if self.can_scan(tenant, namespace, table, principal):
            raise InvalidState(f"{principal} may scan {table} already")
        self._append("grants", GRANTS, (tenant, namespace, table, principal))

    def can_scan(self, tenant: str, namespace: str, table: str, principal: str) -> bool:
        return not self.grants.where((F.col("tenant") == tenant) & (F.col("namespace") == namespace) & (F.col("table") == table) & (F.col("principal") == principal)).isEmpty()

    def write(self, df: DataFrame, tenant: str, namespace: str, table: str, snapshot_id: str, created_by: str) -> None:
        """Writes df as the next snapshot of a table, which is created if it is not there; a later snapshot must have the same schema."""
        table_id = f"{tenant}_{namespace}_{table}"
        latest = None
        if self.tables.where(F.col("table_id") == table_id).isEmpty():
            self.create_table(tenant, namespace, table, created_by)
        else:
            latest = self.latest_snapshot(table_id)
        if latest is not None and self.spark.read.parquet(*latest.files).schema != df.schema:
            raise InvalidState(f"the schema of {table_id} cannot change")
        path = f"{self.root}/{tenant}/{namespace}/tables/{table}/snapshots/{snapshot_id}"
        df.write.mode("errorifexists").parquet(path)
        stored = stored_files(self.spark, path)
        stored.select(F.lit(table_id).alias("table_id"), F.lit(snapshot_id).alias("snapshot_id"), "file", "byte_len", "digest").write.mode("append").parquet(f"{self.root}/_catalog/contents")
        self.commit_snapshot(table_id, snapshot_id, latest.snapshot_id if latest else None, [path])

    def read_latest(self, tenant: str, namespace: str, table: str) -> DataFrame:
        row = self.get_table(tenant, namespace, table)
        latest = self.latest_snapshot(row.table_id)
        if latest is None:
            raise NotFound(f"table {row.table_id} has no snapshot")
        return self.spark.read.parquet(*latest.files)

    def damaged(self, table_id: str, snapshot_id: str) -> DataFrame:
        """(file, reason) of a snapshot's files that are 'missing', 'unknown', or differ in 'length' or 'digest' from what was committed. Reads every byte of them once, file by file in tasks."""
        row = self.get_snapshot(table_id, snapshot_id)
        wanted = self.contents.where((F.col("table_id") == table_id) & (F.col("snapshot_id") == snapshot_id)).select("file", F.struct("byte_len", "digest").alias("w"))
        got = stored_files(self.spark, *row.files).select("file", F.struct("byte_len", "digest").alias("g"))
        reason = F.when(F.col("g").isNull(), "missing").when(F.col("w").isNull(), "unknown").when(F.col("w.byte_len") != F.col("g.byte_len"), "length").when(F.col("w.digest") != F.col("g.digest"), "digest")
        return wanted.join(got, "file", "full_outer").select("file", reason.alias("reason")).where("reason is not null")

    def scan(self, tenant: str, namespace: str, table: str, predicate: Predicate | None = None, projection: Sequence[str] | None = None, principal: str | None = None, verify: bool = False) -> DataFrame:
        """The latest snapshot, filtered and projected; with a principal only if granted, checked before anything is read. With `verify` its files are held against their digests first, and damage is an error."""
        if principal is not None and not self.can_scan(tenant, namespace, table, principal):
            raise PermissionDenied(f"{principal} may not scan {tenant}.{namespace}.{table}")
        whole = self.read_latest(tenant, namespace, table)
        if verify:
            table_id = self.get_table(tenant, namespace, table).table_id
            found = self.damaged(table_id, self.latest_snapshot(table_id).snapshot_id).head(1)
            if found:
                raise StorageCorrupt(f"{found[0].file} of {table_id}: {found[0].reason}")
        return filter_project(whole, predicate, projection)


def stored_files(spark: SparkSession, *folders: str) -> DataFrame:
    """(file, byte_len, digest) of the data files in folders."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(list(folders))
    return raw.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("byte_len"), content_digest(F.col("content")).alias("digest"))


def checked_batches(df: DataFrame) -> DataFrame:
    """A scan's result as a service hands it on: one that has no row at all is an error."""
    if df.isEmpty():
        raise InvalidState("the scan gave no batch")
    return df


def same_schema(parts: Sequence[DataFrame]) -> DataFrame:
    """Parts of one result, one after another; different schemas are an error."""
    if not parts:
        raise InvalidState("the scan gave no batch")
    for p in parts[1:]:
        if p.schema != parts[0].schema:
            raise InvalidState(f"batches of one result differ: {parts[0].schema.simpleString()} and {p.schema.simpleString()}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out
