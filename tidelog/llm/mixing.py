"""Operator 1: mixing sources to target weights.

Tokens (here: runs of text without white space, with the white space after them) are
packed into blocks of a fixed number. Output shards draw how many blocks they take
from each source, multinomially by the target weights. The k-th draw of a source maps
to a block through a pseudorandom permutation of that source's block numbers, a fresh
one for every pass over them, and slots meet blocks by number.

Plan: documents are dealt by hash into lanes of one source, about LANE_BYTES each. A
first pass over the texts counts tokens, which fixes the block numbers of every lane;
slots are then small rows (source, lane, block). A cogroup by (source, lane, group of
epochs) packs a lane and joins its blocks with their slots in one place. A group has as
many epochs as give about GROUP_BYTES of output; a lane's texts go to each of its groups.
So a source that is drawn within that many passes is shuffled once, and one that is drawn
far more often than it has blocks is spread over tasks, none of which makes more.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.shared import cut, map_arrow
from tidelog.llm.textbatch import flat_text, pieces, ragged_range, segment_sum
from tidelog.llm.words import mix
from tidelog.session import ship

BLOCK_TOKENS = 1024
SHARD_BLOCKS = 512
LANE_BYTES = 1 << 20
GROUP_BYTES = 32 << 20
SEED = 20_240_601
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_CHUNK = 64  # block numbers that slots and lanes meet by


def token_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions where a token begins; white space at the head of a text belongs to its first token."""
    if not len(data):
        return np.zeros(0, np.int64)
    space = _SPACE[data]
    begins = ~space
    begins[1:] &= space[:-1]
    head = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[head] = ~space[head]
    return np.flatnonzero(begins)


def permute(index: np.ndarray, size: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Images of `index` under pseudorandom permutations of range(size), chosen by seed: four Feistel rounds, walked until inside."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x = index.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> half[todo], x[todo] & mask[todo]
        for k in range(4):
            left, right = right, left ^ (mix(right + seed[todo] + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) & mask[todo])
        x[todo] = left << half[todo] | right
        todo = todo[x[todo] >= size[todo].astype(np.uint64)]
    return x.astype(np.int64)


def lane_tokens(docs: DataFrame) -> DataFrame:
    """(source_key, deal, n_tokens, n_bytes) of each row that has tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            data, offsets, _ = flat_text(batch.column(2))
            counts = np.diff(np.searchsorted(token_starts(data, offsets), offsets))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts), pa.array(np.diff(offsets))], names=["source_key", "deal", "n_tokens", "n_bytes"]).filter(pa.array(counts > 0))

    return map_arrow(docs.select("source_key", "deal", "text"), run, "source_key string, deal long, n_tokens long, n_bytes long")


def pack_lane(docs: pa.Table, block_tokens: int) -> dict[str, list | np.ndarray]:
    """Blocks of one lane, in the order of (deal, doc_id): text, n_tokens, doc_ids and the language with most tokens."""
    docs = docs.sort_by([("deal", "ascending"), ("doc_id", "ascending")])
    data, offsets, _ = flat_text(docs.column("text"))
    starts = token_starts(data, offsets)
    bounds = np.searchsorted(starts, offsets)
    used = np.flatnonzero(np.diff(bounds))  # documents with tokens
    total = len(starts)
    begin = starts.copy()
    begin[bounds[used]] = offsets[used]  # white space at the head
    doc_of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    cuts = np.union1d(np.arange(0, total, block_tokens), bounds[used])  # a piece is of one document and one block
    ends = np.append(cuts[1:], total)
    stop = np.where(ends < total, begin[np.minimum(ends, total - 1)], len(data))
    stop = np.minimum(stop, offsets[doc_of[cuts] + 1])
    raw = data.tobytes()
    ids, langs = docs.column("doc_id").to_pylist(), docs.column("lang").to_pylist()
    out: dict[str, list] = {"text": [], "n_tokens": [], "doc_ids": [], "lang": []}
    block = cuts // block_tokens
    edges = np.flatnonzero(np.diff(block, prepend=-1))
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(cuts)], strict=True):
        parts = [raw[begin[cuts[i]] : stop[i]] for i in range(a, b)]
        of = doc_of[cuts[a:b]].tolist()
        sizes = (ends[a:b] - cuts[a:b]).tolist()
        votes: dict = {}
        for d, n in zip(of, sizes, strict=True):
            votes[langs[d]] = votes.get(langs[d], 0) + n
        out["text"].append(b"\n\n".join(parts).decode())
        out["n_tokens"].append(sum(sizes))
        out["doc_ids"].append([ids[d] for d in of])
        out["lang"].append(min(votes, key=lambda x: (-votes[x], x is None, x or "")))
    return out


def sum_before(rows: DataFrame, keys: list[str], order: str, value: str, name: str, run: int = 4096) -> DataFrame:
    """rows with `name`: the sum of `value` over the rows of the same keys and a lesser `order`, a whole number that stands once in a key.

    Runs of `run` orders are summed first, so no task has to hold a whole key.
    """
    rows = rows.withColumn("__run", F.expr(f"`{order}` div {run}"))
    runs = rows.groupBy(*keys, "__run").agg(F.sum(value).alias("__sum"))
    runs = runs.select(*keys, "__run", (F.sum("__sum").over(Window.partitionBy(*keys).orderBy("__run")) - F.col("__sum")).alias("__before"))
    within = F.sum(value).over(Window.partitionBy(*keys, "__run").orderBy(order)) - F.col(value)
    out = rows.withColumn("__within", within).join(runs, [*keys, "__run"])
    return out.withColumn(name, F.col("__before") + F.col("__within")).drop("__run", "__before", "__within")


def of_source(values: dict[str, int]) -> Column:
    """The value of a row's source, from one literal map."""
    return F.from_json(F.lit(json.dumps(values)), "map<string,long>")[F.col("source_key")]


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None, n_blocks: int | None = None, block_tokens: int = BLOCK_TOKENS, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", lane_bytes: int = LANE_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(shard, slot, source, epoch, block, n_tokens, doc_ids, lang, text): one row for each slot of the output shards.

    `weights` are the sources' target shares of blocks (equal if None; those of sources
    without tokens are spread over the others in proportion). `n_blocks` is the number of slots, by default
    that of the blocks. A block holds `block_tokens` tokens; the last of each lane may
    hold fewer. Texts of different documents in a block are joined by an empty line;
    no token is lost or doubled in packing. A source drawn more often than it has
    blocks is passed again, in another order (`epoch` counts the passes), so the uses of
    its blocks differ by one at most.

    Cases: null, empty and blank texts give no tokens; a null source is a source of its
    own (weight key None); null ids are packed as others; repeated rows are packed as
    often as they stand; ties in the deal are broken by id; no tokens at all, or no
    weight above zero, give no rows; other columns are not carried, so names cannot
    clash. A negative or infinite weight is an error. The driver holds one row for each
    source, as the weights are a list of sources.
    """
    if weights is not None and any(not 0 <= w < float("inf") for w in weights.values()):
        raise ValueError("weights must be finite and not negative")
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    source = docs[source_col].cast("string")
    text = docs[text_col].cast("string")
    base = docs.select(
        docs[id_col].alias("doc_id"), text.alias("text"), docs[lang_col].cast("string").alias("lang"),
        F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source)).alias("source_key"), F.xxhash64(docs[id_col], text).alias("deal"),
    ).where("length(text) > 0")
    counted = cut(lane_tokens(base))
    # one row for each source: their number does not follow the corpus
    sizes = {r[0]: max(1, -(-r[1] // lane_bytes)) for r in counted.groupBy("source_key").agg(F.sum("n_bytes")).collect()}
    schema = f"shard long, slot int, source string, epoch long, block long, n_tokens int, doc_ids array<{id_type}>, lang string, text string"
    wanted = {k: 1.0 if weights is None else float(weights.get(None if k == "n" else k[1:], 0.0)) for k in sizes}
    keys = sorted(k for k, w in wanted.items() if w > 0)
    if not keys:
        return spark.createDataFrame([], schema)
    share = np.array([wanted[k] for k in keys])
    share /= share.sum()
    with_lane = lambda df: df.withColumn("lane", F.pmod("deal", of_source(sizes)))
    lanes = with_lane(counted).groupBy("source_key", "lane").agg(F.ceil(F.sum("n_tokens") / block_tokens).alias("blocks"), F.sum("n_bytes").alias("n_bytes"))
    lanes = sum_before(lanes, ["source_key"], "lane", "blocks", "from").withColumn("to", F.col("from") + F.col("blocks"))
    lanes = cut(lanes.select("source_key", "lane", "from", "to", "n_bytes"))
    found = {r[0]: (r[1], r[2]) for r in lanes.groupBy("source_key").agg(F.max("to"), F.max("n_bytes")).collect()}
    totals = {k: v[0] for k, v in found.items()}
    slots = sum(totals.values()) if n_blocks is None else int(n_blocks)
    if slots <= 0:
        return spark.createDataFrame([], schema)
    shards = -(-slots // shard_blocks)
    have = np.array([totals[k] for k in keys], np.int64)
    per_group = np.array([max(1, group_bytes // max(1, found[k][1])) for k in keys], np.int64)  # epochs

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column(0).to_numpy()
            size = np.minimum(shard_blocks, slots - number * shard_blocks)
            counts = np.array([np.random.Generator(np.random.Philox(key=[seed, int(i)])).multinomial(n, share) for i, n in zip(number, size, strict=True)]).reshape(-1, len(keys))
            within = np.cumsum(counts, 1) - counts
            shard, which = (x.ravel() for x in np.meshgrid(number, np.arange(len(keys)), indexing="ij"))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (shard, which.astype(np.int32), np.repeat(size, len(keys)), counts.ravel(), within.ravel())], names=["shard", "which", "size", "n", "within"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, which, size, n, within, before = (batch.column(i).to_numpy() for i in range(6))
            row = np.repeat(np.arange(len(n)), n)
            step = ragged_range(np.zeros(len(n), np.int64), n)
            k = before[row] + step
            total = have[which[row]]
            epoch, at = k // total, k % total
            salt = mix(np.uint64(seed) + mix(which[row].astype(np.uint64) << np.uint64(40) | epoch.astype(np.uint64)))
            block = permute(at, total, salt)
            slot = permute(within[row] + step, size[row], mix(shard[row].astype(np.uint64) + np.uint64(seed + 1)))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, object)[which[row]], pa.string()), pa.array(shard[row]), pa.array(slot.astype(np.int32)), pa.array(epoch), pa.array(epoch // per_group[which[row]]), pa.array(block)], names=["source_key", "shard", "slot", "epoch", "group", "block"])

    drawn = cut(map_arrow(spark.range(shards), draw, "shard long, which int, size long, n long, within long"))
    draws = dict(map(tuple, drawn.groupBy("which").agg(F.sum("n")).collect()))
    groups = {k: max(1, -(-(-(-draws[i] // int(have[i]))) // int(per_group[i]))) for i, k in enumerate(keys)}
    drawn = sum_before(drawn, ["which"], "shard", "n", "before").where("n > 0").select("shard", "which", "size", "n", "within", "before")
    placed = map_arrow(drawn, place, "source_key string, shard long, slot int, epoch long, group long, block long")
    in_groups = lambda df: df.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), of_source(groups) - 1)))
    spans = lanes.where(F.col("source_key").isin(keys)).withColumn("chunk", F.explode(F.sequence(F.expr(f"`from` div {_CHUNK}"), F.expr(f"(`to` - 1) div {_CHUNK}"))))
    # the planner takes the slots, which Python makes from a short range, for few rows: no broadcast
    met = placed.withColumn("chunk", F.expr(f"block div {_CHUNK}")).join(in_groups(spans).hint("merge"), ["source_key", "chunk", "group"]).where("block >= `from` and block < `to`")
    met = met.select("source_key", "lane", "group", "shard", "slot", "epoch", "block", (F.col("block") - F.col("from")).alias("local"))

    arrow_schema = pa.schema([("shard", pa.int64()), ("slot", pa.int32()), ("source", pa.string()), ("epoch", pa.int64()), ("block", pa.int64()), ("n_tokens", pa.int32()), ("doc_ids", pa.list_(_arrow_type(docs, id_col))), ("lang", pa.string()), ("text", pa.string())])

    def fill(key: tuple, texts: pa.Table, wanted: pa.Table) -> pa.Table:
        if not texts.num_rows or not wanted.num_rows:
            return arrow_schema.empty_table()
        blocks = pack_lane(texts, block_tokens)
        wanted = wanted.sort_by([("shard", "ascending"), ("slot", "ascending")])
        at = wanted.column("local").to_numpy()
        name = key[0].as_py()
        columns = [wanted.column("shard"), wanted.column("slot"), pa.array([None if name == "n" else name[1:]] * len(at), pa.string()), wanted.column("epoch"), wanted.column("block")]
        columns += [pa.array(blocks[c], arrow_schema.field(c).type).take(pa.array(at)) for c in ("n_tokens", "doc_ids", "lang", "text")]
        return pa.table([c.cast(f.type) for c, f in zip(columns, arrow_schema, strict=True)], schema=arrow_schema)

    dealt = in_groups(with_lane(base.where(F.col("source_key").isin(keys))))
    ship(spark)
    by = ["source_key", "lane", "group"]
    return dealt.groupBy(*by).cogroup(met.groupBy(*by)).applyInArrow(fill, schema)


def _arrow_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def mixed_documents(docs: DataFrame, weights: dict[str | None, float] | None = None, **how) -> DataFrame:
    """mix_sources() as rows of documents: doc_id is the slot's number over all shards, n_chars the text's characters. Cases as there."""
    mixed = mix_sources(docs, weights, **how)
    width = how.get("shard_blocks", SHARD_BLOCKS)
    return mixed.select((F.col("shard") * width + F.col("slot")).cast("long").alias("doc_id"), "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))
