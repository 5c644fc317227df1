"""Physical layout of logs: parts, granules, pruning, merging, retention, reclaiming."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.errors import NotFound
from tidelog.operators.numbering import number
from tidelog.session import hadoop_path, ship

SEAL_RECORDS = 1024
GRANULE = 16


def assign_parts(log: DataFrame, shard: str, seq: str, seal: int = SEAL_RECORDS) -> DataFrame:
    """`part` counts from 0 in each shard, `seal` records each, in order of `seq`."""
    numbered = number(log, [shard], seq, "position")
    return numbered.withColumn("position", F.col("position") - 1).withColumn("part", F.expr(f"position div {seal}"))


def manifest(parted: DataFrame, shard: str, seq: str) -> DataFrame:
    return parted.groupBy(shard, "part").agg(F.min(seq).alias("min_seq"), F.max(seq).alias("max_seq"), F.count("*").alias("records"))


def granules(parted: DataFrame, shard: str, seq: str, seal: int = SEAL_RECORDS, granule: int = GRANULE) -> DataFrame:
    """(shard, part, granule, first_seq, records): marks of a sparse index."""
    return parted.withColumn("granule", F.expr(f"(position % {seal}) div {granule}")).groupBy(shard, "part", "granule").agg(F.min(seq).alias("first_seq"), F.count("*").alias("records"))


def prune(parts: DataFrame, shard: str, shard_value: int, after: int) -> DataFrame:
    """Parts that may hold records of a shard past a cursor, in order."""
    return parts.where((F.col(shard) == shard_value) & (F.col("max_seq") > after)).orderBy("min_seq")


def locate_granule(marks: DataFrame, shard: str, shard_value: int, seq_value: int) -> DataFrame:
    """The last granule whose first sequence is not above `seq_value`: one row."""
    return marks.where((F.col(shard) == shard_value) & (F.col("first_seq") <= seq_value)).orderBy(F.desc("first_seq")).limit(1)


def durable_view(parts: DataFrame) -> DataFrame:
    """Parts that have a replica, without their local path."""
    rows = parts.where(F.size("replicas") > 0)
    return rows.withColumn("local_path", F.lit(None).cast("string")) if "local_path" in parts.columns else rows


def plan_merges(parts: DataFrame, shard: str, small: int = SEAL_RECORDS, trigger: int = 4, most: int = 8) -> DataFrame:
    """(shard, run, parts): the first run of at least `trigger` small durable parts of each shard, its first `most` parts in order.

    Runs are islands of the difference of two row numbers.
    """
    ok = (F.col("records") <= small) & F.col("durable")
    order = Window.partitionBy(shard).orderBy("min_seq")
    numbered = parts.withColumn("ok", ok).withColumn("n", F.row_number().over(order)).withColumn("k", F.row_number().over(Window.partitionBy(shard, "ok").orderBy("min_seq")))
    runs = numbered.where("ok").withColumn("run", F.col("n") - F.col("k"))
    runs = runs.withColumn("length", F.count("*").over(Window.partitionBy(shard, "run"))).where(F.col("length") >= trigger)
    runs = runs.withColumn("first_run", F.min("run").over(Window.partitionBy(shard))).where("run = first_run")
    taken = runs.withColumn("place", F.row_number().over(Window.partitionBy(shard).orderBy("min_seq"))).where(F.col("place") <= most)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("place", "part"))), lambda x: x["part"])
    return taken.groupBy(shard).agg(ordered.alias("parts"), F.sum("records").alias("records"))


def merge_parts(sources: list[DataFrame], seq: str) -> DataFrame:
    """One sorted run of all records of the sources: superseded records stay."""
    out = sources[0]
    for df in sources[1:]:
        out = out.unionByName(df)
    return out.repartitionByRange(F.col(seq)).sortWithinPartitions(seq)


def with_buffer(sealed: DataFrame, buffer: DataFrame) -> DataFrame:
    """Sealed records and those still in memory, as one log."""
    return sealed.unionByName(buffer)


def retention(parts: DataFrame, floor: int | Column) -> DataFrame:
    """Each part with `drop`: wholly below the floor; a part astride it stays."""
    return parts.withColumn("drop", F.col("max_seq") < floor)


def drop_parts(parted: DataFrame, parts: DataFrame, shard: str) -> DataFrame:
    """The records that stay when the parts marked `drop` (see retention) are removed whole."""
    gone = parts.where("drop").select(shard, "part")
    return parted.join(gone, [shard, "part"], "left_anti").select(*parted.columns)


def apply_merges(parts: DataFrame, plan: DataFrame, shard: str) -> DataFrame:
    """The manifest after the merges of a plan (see plan_merges): merged parts are one, under the first one's number, `merged` says of how many; no record is lost."""
    named = plan.select(shard, F.col("parts")[0].alias("__into"), F.explode("parts").alias("part"))
    into = parts.join(named, [shard, "part"], "left").withColumn("part", F.coalesce("__into", "part"))
    return into.groupBy(shard, "part").agg(F.min("min_seq").alias("min_seq"), F.max("max_seq").alias("max_seq"), F.sum("records").cast("long").alias("records"), F.count("*").alias("merged"))


BLOOM_WORDS, BLOOM_HASHES = 64, 7
LANES = 64  # of parts, each of which meets all values asked for
_PARTS, _ASKED = 2048, 512  # tried against each other at once


def _bloom_halves(rows: DataFrame, member: str, *columns: str) -> DataFrame:
    """(columns..., __one, __two): the two halves of the MD5 of each value that is not null, from which its places are counted."""
    halves = (F.conv(F.substring(F.md5(F.col(member).cast("string")), at, 8), 16, 10).cast("long").alias(name) for at, name in ((1, "__one"), (9, "__two")))
    return rows.where(F.col(member).isNotNull()).select(*columns, *halves)


def part_blooms(parted: DataFrame, shard: str, member: str, words: int = BLOOM_WORDS) -> DataFrame:
    """(shard, part, word, bits): the words that are not zero of a Bloom filter over the values of `member` in each part.

    A filter has `words` words of 32 bits; a value sets BLOOM_HASHES places by double hashing
    of its MD5. Records are brought together by part before their places are counted out.
    """
    halves = _bloom_halves(parted, member, shard, "part").repartition(shard, "part")
    places = F.array(*(F.pmod(F.col("__one") + k * (F.col("__two") + 1), F.lit(32 * words)) for k in range(BLOOM_HASHES)))
    bits = halves.select(shard, "part", F.explode(places).alias("__bit"))
    return bits.groupBy(shard, "part", F.expr("__bit div 32").cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(__bit % 32 as int))")).alias("bits"))


def _bit_rows(filters: pa.RecordBatch, words: int) -> np.ndarray:
    """A row for each bit of the filters (words, bits): the filters that have it set, 64 to a number."""
    table = np.zeros((filters.num_rows, words), "<u4")
    at = np.repeat(np.arange(filters.num_rows), pc.list_value_length(filters.column("__words")).to_numpy(zero_copy_only=False))
    table[at, filters.column("__words").flatten().to_numpy()] = filters.column("__bits").flatten().to_numpy()
    by_bit = np.packbits(np.unpackbits(table.view(np.uint8), axis=1, bitorder="little").T, axis=1, bitorder="little")
    out = np.zeros((32 * words, -(-filters.num_rows // 64) * 8), np.uint8)
    out[:, : by_bit.shape[1]] = by_bit
    return out.view("<u8")


def maybe_members(blooms: DataFrame, shard: str, values: DataFrame, member: str, words: int = BLOOM_WORDS) -> DataFrame:
    """(member, shard, part) of the parts that may hold each value; one that holds it is never left out.

    Every value is tried against every filter, but no pair becomes a row unless it is a
    result: parts are dealt to lanes, the values asked for go to every lane and stand first
    in it, and the filters that follow are turned, 2,048 at a time, into one row of bits for
    each place; a value's parts are the AND of its places' rows. A task holds the values
    asked for, some 40 bytes each, and one such table.
    """
    spark = blooms.sparkSession
    ship(spark)
    types = {"__member": values.schema[member].dataType.simpleString(), "__shard": blooms.schema[shard].dataType.simpleString(), "__part": blooms.schema["part"].dataType.simpleString()}
    blank = {k: F.lit(None).cast(v).alias(k) for k, v in (types | {"__one": "long", "__two": "long", "__words": "array<int>", "__bits": "array<long>"}).items()}
    held = blooms.groupBy(F.col(shard).alias("__shard"), F.col("part").alias("__part")).agg(F.collect_list(F.struct("word", "bits")).alias("__held"))
    filters = held.select(F.pmod(F.xxhash64("__shard", "__part"), F.lit(LANES)).cast("int").alias("__lane"), F.lit(1).alias("__kind"), blank["__member"], blank["__one"], blank["__two"], "__shard", "__part", F.col("__held.word").alias("__words"), F.col("__held.bits").alias("__bits"))
    asked = _bloom_halves(values.select(F.col(member).alias("__member")).distinct(), "__member", "__member")
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(LANES - 1))).alias("__lane"), F.lit(0).alias("__kind"), "__member", "__one", "__two", blank["__shard"], blank["__part"], blank["__words"], blank["__bits"])
    lanes = asked.unionByName(filters).repartition("__lane").sortWithinPartitions("__lane", "__kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane, names, places = None, [], []
        for batch in batches:
            of, kinds = (batch.column(c).to_numpy() for c in ("__lane", "__kind"))
            cuts = np.flatnonzero((np.diff(of) != 0) | (np.diff(kinds) != 0)) + 1
            for start, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if start == end:
                    continue
                rows = batch.slice(start, end - start)
                if of[start] != lane:
                    lane, names, places = of[start], [], []
                if kinds[start] == 0:
                    one, two = (rows.column(c).to_numpy() for c in ("__one", "__two"))
                    places.append(((one[:, None] + np.arange(BLOOM_HASHES) * (two[:, None] + 1)) % (32 * words)).astype(np.int32))
                    names.append(pa.concat_arrays([rows.column("__member")]))
                elif places:
                    if len(places) > 1:
                        places, names = [np.concatenate(places)], [pa.concat_arrays(names)]
                    for first in range(0, rows.num_rows, _PARTS):
                        yield from tried(rows.slice(first, _PARTS), names[0], places[0])

    def tried(filters: pa.RecordBatch, names: pa.Array, places: np.ndarray) -> Iterator[pa.RecordBatch]:
        table = _bit_rows(filters, words)
        for first in range(0, len(places), _ASKED):
            some = places[first : first + _ASKED]
            both = table[some[:, 0]]
            for k in range(1, BLOOM_HASHES):
                both &= table[some[:, k]]
            value, group = np.nonzero(both)
            if len(value):
                hit, bit = np.nonzero(np.unpackbits(both[value, group].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                which = pa.array(group[hit] * 64 + bit)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(first + value[hit])), filters.column("__shard").take(which), filters.column("__part").take(which)], names=[*types])

    found = lanes.mapInArrow(run, ", ".join(f"{k} {v}" for k, v in types.items()))
    return found.select(F.col("__member").alias(member), F.col("__shard").alias(shard), F.col("__part").alias("part"))


def summarise(counts: list[tuple[DataFrame, dict[str, Column]]]) -> DataFrame:
    """(dataset, n): the aggregates of each table, by one aggregation a table."""
    out = None
    for table, columns in counts:
        row = table.agg(*(c.cast("long").alias(k) for k, c in columns.items()))
        pairs = F.array(*(F.struct(F.lit(k).alias("dataset"), F.coalesce(F.col(f"`{k}`"), F.lit(0).cast("long")).alias("n")) for k in columns))
        row = row.select(F.inline(pairs))
        out = row if out is None else out.unionAll(row)
    return out


def reclaim_plan(segments: DataFrame, consumers: DataFrame, min_retained: int = 1, max_retained: int | None = None) -> DataFrame:
    """Each segment (segment, last_seq) with `reclaim`.

    A segment goes if it is not the active one nor among the newest `min_retained`, and
    ends at or below the boundary: the lower of the consumers' least cursor and the last
    sequence before the newest `max_retained`; without either nothing goes. Segments are
    few rows, but both bounds are joined as one-row tables, not collected.
    """
    keep = max(min_retained, 1)
    newest = Window.orderBy(F.desc("segment"))
    ranked = segments.withColumn("age", F.row_number().over(newest))
    ceiling = consumers.agg(F.min(F.coalesce("acked", F.lit(0))).alias("ceiling"))
    window = ranked.agg(F.max(F.when(F.col("age") > (max_retained or 0), F.col("last_seq"))).alias("window") if max_retained is not None else F.lit(None).cast("long").alias("window"))
    bounds = ceiling.crossJoin(window).select(F.coalesce(F.least("ceiling", "window"), F.lit(0)).alias("boundary"))
    judged = ranked.crossJoin(bounds)
    return judged.withColumn("reclaim", (F.col("age") > keep) & (F.col("age") > 1) & (F.col("last_seq") <= F.col("boundary"))).drop("age")


def write_parts(log: DataFrame, path: str, shard: str, seq: str, seal: int = SEAL_RECORDS, member: str | None = None) -> None:
    """Range-partitioned, sorted Parquet files of at most `seal` records below a directory for each shard.

    Statistics of the sort key prune files; with `member` its values go to bloom filters of
    about 1 % false positives, which a reader asks before an equality on that column.
    """
    writer = log.repartitionByRange(F.col(shard), F.col(seq)).sortWithinPartitions(shard, seq).write.partitionBy(shard).option("maxRecordsPerFile", seal)
    if member is not None:
        writer = writer.option(f"parquet.bloom.filter.enabled#{member}", "true").option(f"parquet.bloom.filter.fpp#{member}", "0.01")
    writer.mode("append").parquet(path)


def write_replica(log: DataFrame, root: str, shard: str, seq: str, seal: int = SEAL_RECORDS, keep: Column | None = None) -> None:
    """Parts of a log below `root` and, once they are whole, the manifest that lists their files (file, byte_len); `keep` leaves out of it what it does not hold for."""
    spark = log.sparkSession
    write_parts(log if keep is None else log.where(keep), f"{root}/parts", shard, seq, seal)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{root}/parts")
    files.select(F.substring_index("path", f"{root.split(':')[-1].lstrip('/')}/parts/", -1).alias("file"), F.col("length").alias("byte_len")).coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest")


def cold_load(spark: SparkSession, replicas: list[str]) -> DataFrame:
    """The log that the first replica with a manifest lists; parts that it does not list are not read. No manifest at all is an error."""
    for root in replicas:
        fs, at = hadoop_path(spark, f"{root}/manifest/_SUCCESS")
        if fs.exists(at):
            files = [r.file for r in spark.read.parquet(f"{root}/manifest").select("file").collect()]  # a manifest is read by its reader whole
            return spark.read.option("basePath", f"{root}/parts").parquet(*(f"{root}/parts/{f}" for f in sorted(files))) if files else spark.read.parquet(f"{root}/parts").limit(0)
    raise NotFound("no replica has a manifest")
