"""Operator 5: near-duplicate groups by DartMinHash.

A document is a weighted set: its word bigrams with their counts. For every bigram
the plane (weight x rank) carries the same unit Poisson process of darts in every
document, made from hashes. A bigram of weight w owns the strip [0, w); darts inside
it, up to a rank at which a document expects about K ln K + 2K of them, are hashed to
K coordinates, and each coordinate keeps its earliest dart. Two documents agree in a
coordinate with the probability of their weighted Jaccard similarity. Only as many
darts are made as a signature needs, whatever the number of bigrams times K.

Documents of one signature are one node from here on, so exact copies and repeated rows
cost an aggregation. Signatures are cut into bands; buckets with the same members are one
bucket. Inside a bucket every pair counts, by a breadth-first search that compares only
with documents not reached yet: exact, and linear where copies are many. A bucket of more
than BUCKET_ROWS is cut into blocks, and every two blocks meet in a task of their own, so
no task holds more. Links are merged to groups by alternating star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from tidelog.llm.shared import cut, map_arrow
from tidelog.llm.textbatch import flat_text, pieces, ragged_range
from tidelog.llm.words import mix, ngram_hashes, words

COORDINATES = 128
BANDS, ROWS = 25, 5
#: Documents are near copies if their signatures agree in at least this share.
THRESHOLD = 0.6
#: Signatures that one task compares at once; larger buckets are compared in blocks of half as many.
BUCKET_ROWS = 20_000
_POISSON = np.cumsum([np.exp(-1) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320, 362880, 3628800, 39916800)])
_UNIT = 2.0**-53


def weighted_elements(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, element hash, count) of the word bigrams; the word itself for a text of one word; bytes for a text without words."""
    w = words(data, offsets)
    per_doc = np.diff(w.bounds)
    owner = np.repeat(np.arange(len(per_doc)), per_doc)
    first, grams = ngram_hashes(w, 2)
    single = w.bounds[:-1][per_doc == 1]
    bare = np.flatnonzero((per_doc == 0) & (np.diff(offsets) > 0))
    at = ragged_range(offsets[bare], np.diff(offsets)[bare])
    doc = np.concatenate([owner[first], owner[single], np.repeat(bare, np.diff(offsets)[bare])])
    element = np.concatenate([grams, mix(w.hashes[single] + np.uint64(1)), mix(data[at].astype(np.uint64) + np.uint64(1 << 40))])
    key = np.sort(doc.astype(np.uint64) << np.uint64(44) | element >> np.uint64(20))
    new = np.flatnonzero(np.diff(key, prepend=key[:1] ^ np.uint64(1))) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(new, len(key)))
    return (key[new] >> np.uint64(44)).astype(np.int64), key[new] & np.uint64((1 << 44) - 1), count.astype(np.float64)


def dart_signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int, k: int = COORDINATES) -> np.ndarray:
    """(docs, k) uint32: the earliest dart of each coordinate; 0 in the rows of documents without elements. doc ascends; weights are 1 at least."""
    signature = np.zeros(docs * k, np.uint32)
    total = np.bincount(doc, weight, docs)
    limit = np.divide(k * np.log(k) + 2 * k, total, out=np.zeros(docs), where=total > 0)
    open_docs = total > 0
    while open_docs.any():
        use = open_docs[doc]
        d, e, w = doc[use], element[use], weight[use]
        best = np.full(docs * k, np.inf)
        keys, ranks, marks = [], [], []
        octaves = np.floor(np.log2(w)).astype(np.int64) + 1
        i = np.repeat(np.arange(len(d)), octaves)
        octave = ragged_range(np.zeros(len(d), np.int64), octaves)
        cells = np.ceil(limit[d[i]] * 2.0**octave).astype(np.int64)
        step = 1 << 20
        ends = np.cumsum(cells)
        cuts = [0, *np.searchsorted(ends, np.arange(step, int(ends[-1]), step)).tolist(), len(i)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a >= b:
                continue
            j = np.repeat(np.arange(a, b), cells[a:b])
            cell = ragged_range(np.zeros(b - a, np.int64), cells[a:b])
            seed = mix(e[i[j]] + cell.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (octave[j].astype(np.uint64) << np.uint64(58)))
            many = np.searchsorted(_POISSON, (seed >> np.uint64(11)).astype(np.float64) * _UNIT)
            q = np.repeat(np.arange(len(j)), many)
            number = ragged_range(np.zeros(len(j), np.int64), many)
            h = mix(seed[q] + (number + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            scale = 2.0 ** octave[j[q]]
            across = scale - 1 + scale * ((h >> np.uint64(11)).astype(np.float64) * _UNIT)
            h = mix(h + np.uint64(0xA0761D6478BD642F))
            rank = (cell[q] + (h >> np.uint64(11)).astype(np.float64) * _UNIT) / scale
            owner = i[j[q]]
            hit = (across < w[owner]) & (rank < limit[d[owner]])
            h = mix(h[hit] + np.uint64(0xE7037ED1A0B428DB))
            keys.append(d[owner[hit]] * k + ((h >> np.uint64(32)) % np.uint64(k)).astype(np.int64))
            ranks.append(rank[hit])
            marks.append((h & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        key, rank, mark = (np.concatenate(x) for x in (keys, ranks, marks))
        np.minimum.at(best, key, rank)
        first = rank == best[key]
        signature[key[first]] = mark[first]
        filled = np.isfinite(best).reshape(docs, k).all(1)
        open_docs &= ~filled
        limit[open_docs] *= 2  # a coordinate without a dart: look further; the darts seen stay the same
    return signature.reshape(docs, k)


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """(docs, bands) int64."""
    out = np.empty((len(signature), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(signature), b + 1, np.uint64)
        for r in range(rows):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + signature[:, b * rows + r])
        out[:, b] = h
    return out.view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, whole long, more long, signature binary) of the documents that have an id and text; whole and more hash the signature."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            data, offsets, _ = flat_text(batch.column(1))
            s = dart_signatures(*weighted_elements(data, offsets), batch.num_rows)
            whole, more = band_keys(s, 1, COORDINATES)[:, 0], band_keys(s[:, ::-1], 1, COORDINATES)[:, 0]
            binary = pa.Array.from_buffers(pa.binary(), len(s), [None, pa.py_buffer(np.arange(0, s.nbytes + 1, 4 * COORDINATES, dtype=np.int32)), pa.py_buffer(s.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(whole), pa.array(more), binary], names=["id", "whole", "more", "signature"])

    picked = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).where("id is not null and length(text) > 0")
    return map_arrow(picked, run, f"id {id_type}, whole long, more long, signature binary")


def signature_rows(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """(rows, COORDINATES) of a binary column."""
    raw = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(raw, pa.ChunkedArray):
        raw = raw.chunk(0)
    begin = np.frombuffer(raw.buffers()[1], np.int32 if pa.types.is_binary(raw.type) else np.int64)[raw.offset]
    return np.frombuffer(raw.buffers()[2], np.uint32, len(raw) * COORDINATES, int(begin)).reshape(-1, COORDINATES)


def banded(heads: DataFrame) -> DataFrame:
    """(id, whole, key): a row for each band of each signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = band_keys(signature_rows(batch.column(2)))
                again = pa.array(np.repeat(np.arange(batch.num_rows), BANDS))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(again), batch.column(1).take(again), pa.array(keys.ravel())], names=["id", "whole", "key"])

    return map_arrow(heads.select("id", "whole", "signature"), run, f"id {heads.schema['id'].dataType.simpleString()}, whole long, key long")


def bucket_links(ids: np.ndarray, signature: np.ndarray, threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """(position, position of its component's first) for one bucket; components of the graph of all pairs that agree enough."""
    need = threshold * signature.shape[1]
    left, links = np.arange(1, len(ids)), []
    root, queue = 0, [0]
    while True:
        while queue and len(left):
            here = queue.pop()
            near = (signature[left] == signature[here]).sum(1) >= need
            for j in left[near].tolist():
                links.append((j, root))
                queue.append(j)
            left = left[~near]
        if not len(left):
            return links
        root, queue, left = int(left[0]), [int(left[0])], left[1:]


def links_of_sorted(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Links of rows (key, id, signature) that come ordered by key; a bucket may span batches."""
    held: pa.Table | None = None

    def solve(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        key, ids = table.column("key").to_numpy(), table.column("id")
        s = signature_rows(table.column("signature"))
        starts = np.flatnonzero(np.diff(key, prepend=key[:1] - 1))
        ends = np.append(starts[1:], len(key))
        two = ends - starts == 2
        a = starts[two]
        near = (s[a] == s[a + 1]).sum(1) >= threshold * COORDINATES
        src, dst = [a[near] + 1], [a[near]]
        for x, y in zip(starts[ends - starts > 2].tolist(), ends[ends - starts > 2].tolist(), strict=True):
            if found := bucket_links(np.arange(x, y), s[x:y], threshold):
                pairs = np.array(found) + x
                src.append(pairs[:, 0])
                dst.append(pairs[:, 1])
        src, dst = np.concatenate(src), np.concatenate(dst)
        return pa.RecordBatch.from_arrays([ids.take(pa.array(src)).combine_chunks(), ids.take(pa.array(dst)).combine_chunks()], names=["u", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        key = held.column("key")
        last = key[-1].as_py()
        if key[0].as_py() == last:
            continue
        cut_at = int(np.searchsorted(key.to_numpy(), last))
        if held.num_rows >= BUCKET_ROWS:
            yield solve(held.slice(0, cut_at))
            held = held.slice(cut_at)
    if held is not None and held.num_rows:
        yield solve(held)


def components(links: DataFrame) -> DataFrame:
    """(id, root) of every id in `links` (u, v): root is the least id that is connected with it; roots themselves are not listed.

    Large and small stars in turn, each a shuffle of the links, until nothing changes:
    a number of rounds that grows with the logarithm of the longest path.
    """

    def stars(edges: DataFrame) -> DataFrame:
        # least neighbours by aggregation and a join: a hub's links are split over tasks, which a window would not do
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.join(both.groupBy("u").agg(F.min("v").alias("m")), "u").withColumn("m", F.least("m", "u"))
        large = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        return small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()

    def print_of(edges: DataFrame):
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = cut(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    before = print_of(edges)
    while before[0]:
        edges = cut(stars(edges))
        after = print_of(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))


def bucket_pairs(heads: DataFrame, threshold: float = THRESHOLD, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(u, v): links among nodes (id, whole, signature) that share a band and agree in `threshold` of their coordinates; as many as connect all that do."""
    keyed = banded(heads)
    twice = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    shared = cut(keyed.join(twice, "key").select("key", "id", "whole"))  # few: most bands are of one node alone
    # near copies share many bands: of buckets with the same members one is enough
    sets = shared.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor("whole").alias("a"), F.bit_xor(F.xxhash64("whole")).alias("b"))
    chosen = sets.groupBy("n", "a", "b").agg(F.min("key").alias("key"))
    shared = shared.join(chosen.select("key", "n"), "key")
    blocks = F.ceil(F.col("n") / F.lit(max(1, bucket_rows // 2)))
    block = F.pmod(F.xxhash64("whole", "id"), blocks)
    others = F.filter(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda j: j != block)
    cells = F.transform(others, lambda j: F.xxhash64("key", F.least(j, block), F.greatest(j, block)))
    shared = shared.withColumn("key", F.explode(F.when(F.col("n") > bucket_rows, cells).otherwise(F.array("key"))))
    rows = shared.select("id", "whole", "key").join(heads, ["id", "whole"])
    grouped = rows.select("key", "id", "signature").repartition("key").sortWithinPartitions("key", "id")
    id_type = heads.schema["id"].dataType.simpleString()
    return map_arrow(grouped, lambda batches: links_of_sorted(batches, threshold), f"u {id_type}, v {id_type}")


def members(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(id, root) of every id that has text: root is the least id of its group."""
    table = cut(signatures(docs, id_col, text_col))
    # a node for each signature, named by its least id: exact copies and repeated rows never meet in buckets
    heads = cut(table.groupBy("whole", "more").agg(F.min("id").alias("id"), F.first("signature").alias("signature")))
    names = heads.select("whole", "more", F.col("id").alias("head"))
    belongs = cut(table.select("id", "whole", "more").distinct().join(names, ["whole", "more"]).select("id", "head"))
    one = belongs.groupBy("id").agg(F.min("head").alias("head"), F.max("head").alias("last"))
    # an id of several texts joins their nodes
    torn = belongs.join(one.where("head <> last").select("id", F.col("head").alias("v")), "id").select(F.col("head").alias("u"), "v")
    found = components(bucket_pairs(heads.select("id", "whole", "signature"), threshold, bucket_rows).unionByName(torn))
    return one.select("id", "head").join(found.select(F.col("id").alias("head"), "root"), "head", "left").select("id", F.coalesce("root", "head").alias("root"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(id, group_id, n_links, keep): one row for each id; group_id is the least id of its group, n_links the number of other ids in the group, as links are transitive; keep is true for the least id alone.

    Cases: an id that several rows share is one document, with all their texts; null ids
    are left out, as nothing can name them; null and empty texts have no copies and are
    each a group; a text of one word is compared by that word, a text of no words (signs
    alone) by its bytes; groups are transitive; an empty table gives no rows; other
    columns are not carried.
    """
    found = members(docs, id_col, text_col, threshold, bucket_rows)
    ids = docs.select(docs[id_col].alias("id")).where("id is not null").distinct()
    out = cut(ids.join(found, "id", "left").select("id", F.coalesce("root", "id").alias("group_id")))
    sizes = out.groupBy("group_id").agg((F.count("*") - 1).alias("n_links")).where("n_links > 0")
    out = out.join(sizes, "group_id", "left").select("id", "group_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), (F.col("id") == F.col("group_id")).alias("keep"))
    return out.withColumnRenamed("id", id_col)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row for each group of near copies, with all columns of `docs`.

    Cases: the least id of a group stays; of rows that share it, the one whose text sorts
    first stays (nulls last), of equal texts the one whose other columns sort first, in
    their order, nulls last; rows with a null id pass through, all of them; otherwise as
    in near_groups().
    """
    found = members(docs, id_col, text_col, threshold, bucket_rows).where("id <> root").select(F.col("id").alias(id_col))
    left = docs.where(docs[id_col].isNotNull()).join(found, id_col, "left_anti").select(*docs.columns)
    number = "__number"
    while number in docs.columns:
        number += "_"
    others = [F.col(f"`{f.name}`") if _sorts(f.dataType) else F.to_json(F.struct(F.col(f"`{f.name}`"))) for f in docs.schema if f.name not in (id_col, text_col)]
    order = [F.col(text_col).asc_nulls_last(), *(c.asc_nulls_last() for c in others)]
    one = left.withColumn(number, F.row_number().over(Window.partitionBy(id_col).orderBy(*order))).where(F.col(number) == 1).drop(number)
    return one.unionByName(docs.where(docs[id_col].isNull()))


def _sorts(kind: DataType) -> bool:
    """Whether Spark can order values of a type."""
    if isinstance(kind, StructType):
        return all(_sorts(f.dataType) for f in kind)
    return _sorts(kind.elementType) if isinstance(kind, ArrayType) else not isinstance(kind, (MapType, VariantType))
