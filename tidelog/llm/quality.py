"""Operator 6: quality classifier by nearest-neighbour voting in a latent-semantic space.

A bounded sample of labelled rows gives the reference set. A document is a vector of
hashed byte 3-grams and 6-grams of whole texts (log counts times inverse document
frequency) beside a few terms for how concentrated those counts are, projected on the
leading singular vectors of the reference matrix and brought to unit length. The labelled vectors are broadcast; every document is
compared with all of them by blocked matrix products, and its nearest neighbours vote
with their similarities as weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.shared import map_arrow
from tidelog.llm.textbatch import flat_text, pieces

#: Labelled rows in the reference set, per label at most. They and their vectors are broadcast: about 1 MB.
SAMPLE_ROWS_PER_LABEL = 1500
FEATURES = 4096
TOPICS = 64
NEIGHBOURS = 15
#: A document is kept if its vote for good quality is at least this.
MIN_SCORE = 0.35
BLOCK = 512
#: Positions whose n-grams are hashed at once.
STEP_BYTES = 2 << 20
#: Columns for the concentration of a document's counts, which tells repeated words from prose.
LEVELS = 13
PROSE_BITS = 8.5
TEXTURE_WEIGHT = 0.5


@dataclass
class Model:
    weights: np.ndarray  # (FEATURES) inverse document frequency
    projection: np.ndarray  # (FEATURES + LEVELS, topics)
    vectors: np.ndarray  # (rows, topics), unit length
    labels: np.ndarray  # (rows) 0 or 1
    balance: np.ndarray  # (rows) 1 / share of the label in the sample


def _hash(grams: list[np.ndarray], odd: int) -> np.ndarray:
    """Features of n-grams given as n arrays of their bytes."""
    h = np.zeros(len(grams[0]), np.uint32)
    for g in grams:
        h *= np.uint32(0x01000193)
        h ^= g
    h *= np.uint32(odd)
    h >>= np.uint32(32 - FEATURES.bit_length() + 1)
    return h


def count_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, FEATURES) counts of hashed byte 3-grams and 6-grams inside each document; one or two bytes are a 3-gram with zero bytes after them."""
    docs = len(offsets) - 1
    out = np.zeros(docs * FEATURES, np.float32)
    sizes = np.diff(offsets)
    brief = np.flatnonzero((sizes > 0) & (sizes < 3))
    if len(brief):
        ends = np.concatenate([data, np.zeros(1, np.uint8)])[offsets[brief] + 1]
        grams = [data[offsets[brief]], np.where(sizes[brief] == 2, ends, 0), np.zeros(len(brief))]
        np.add.at(out, brief * FEATURES + _hash([g.astype(np.uint32) for g in grams], 0x9E3779B1), 1)
    for n, odd in ((3, 0x9E3779B1), (6, 0x85EBCA77)):
        for a in range(0, len(data) - n + 1, STEP_BYTES):  # a long text is not widened whole
            b = min(a + STEP_BYTES, len(data) - n + 1)
            wide = data[a : b + n - 1].astype(np.uint32)
            h = _hash([wide[k : b - a + k] for k in range(n)], odd)
            at = np.arange(a, b)
            owner = np.repeat(np.arange(docs), np.diff(np.clip(offsets, a, b)))
            inside = at + n <= offsets[1:][owner]
            out += np.bincount((owner * FEATURES + h)[inside], minlength=docs * FEATURES).astype(np.float32)
    return out.reshape(docs, FEATURES)


def unit_rows(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(size == 0, 1, size)


def texture(x: np.ndarray) -> np.ndarray:
    """(documents, LEVELS): bits of concentration of the counts, shared between the two nearest levels.

    log2((sum c)^2 / sum c^2) is the number of bits over which counts spread; it is held
    against what a text of that length can have, at most PROSE_BITS.
    """
    total = x.sum(1)
    level = np.log2(np.maximum(total, 1) ** 2 / np.maximum((x * x).sum(1), 1))
    level = np.clip(2 * (np.minimum(np.log2(np.maximum(total, 1)), PROSE_BITS) - level), 0, LEVELS - 1)
    near = 1 - np.abs(level[:, None] - np.arange(LEVELS))
    return np.where(total[:, None] > 0, np.maximum(near, 0), 0).astype(np.float32)


def weigh(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Unit rows of log counts times weights, beside the texture columns. Changes x."""
    extra = texture(x) * np.float32(TEXTURE_WEIGHT)
    np.log1p(x, out=x)
    x *= weights
    return np.concatenate([unit_rows(x), extra], 1)


def feature_blocks(data: np.ndarray, offsets: np.ndarray, rows: int = 256) -> Iterator[tuple[int, np.ndarray]]:
    for k in range(0, len(offsets) - 1, rows):
        part = offsets[k : k + rows + 1]
        yield k, count_features(data[part[0] : part[-1]], part - part[0])


def fit_model(texts: list[str], labels: list[int], topics: int = TOPICS, seed: int = 11) -> Model:
    """Latent-semantic vectors of labelled texts, by randomised singular value decomposition."""
    data, offsets, _ = flat_text(pa.array(texts, pa.large_string()))
    x = np.concatenate([c for _, c in feature_blocks(data, offsets)])
    weights = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + 1
    x = weigh(x, weights)
    rng = np.random.default_rng(seed)
    q = rng.normal(size=(FEATURES + LEVELS, min(topics + 16, len(x)))).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    projection = np.ascontiguousarray((q @ vt.T)[:, :topics], np.float32)
    y = np.array(labels, np.float32)
    share = np.where(y == 1, max(y.mean(), 1e-9), max(1 - y.mean(), 1e-9))
    return Model(weights, projection, unit_rows(x @ projection), y, (1 / share).astype(np.float32))


def score_flat(model: Model, data: np.ndarray, offsets: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Weighted share of the good label among the nearest labelled rows of each document; 0.5 if none is at all alike, NaN for an empty text."""
    out = np.full(len(offsets) - 1, np.nan)
    k = min(neighbours, len(model.labels))
    for at, x in feature_blocks(data, offsets, BLOCK):
        v = unit_rows(weigh(x, model.weights) @ model.projection)
        near = v @ model.vectors.T
        bar = np.partition(near, near.shape[1] - k, 1)[:, near.shape[1] - k, None]
        near[near < bar] = 0  # all that tie with the k-th vote
        np.maximum(near, 0, out=near)
        near *= model.balance
        total = near.sum(1)
        with np.errstate(invalid="ignore", divide="ignore"):
            out[at : at + len(x)] = np.where(total > 0, near @ model.labels / total, 0.5)
    out[np.diff(offsets) == 0] = np.nan
    return out


def labelled_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_label: int) -> tuple[list[str], list[int]]:
    """At most `per_label` texts of each label 0 and 1, chosen by hash of the id; only their ids are broadcast to find the texts."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("id").isNotNull() & F.col("label").isin(0, 1))
    known = known.groupBy("id").agg(F.max("label").alias("label"), F.min("label").alias("least")).where("label = least").drop("least")
    counts = dict(map(tuple, known.groupBy("label").count().collect()))
    if not counts:
        return [], []
    share = F.create_map(*[x for k, n in sorted(counts.items()) for x in (F.lit(k), F.lit(min(1.0, 1.2 * per_label / n)))])
    rank = F.pmod(F.xxhash64("id"), F.lit(1_000_000_007))
    picked = sorted(map(tuple, known.select(rank.alias("rank"), "label", "id").where(F.col("rank") < share[F.col("label")] * 1_000_000_007).collect()))
    chosen = [r for value in (0, 1) for r in [r for r in picked if r[1] == value][:per_label]]
    if not chosen:
        return [], []
    ids = F.broadcast(docs.sparkSession.createDataFrame([(r[2], r[1]) for r in chosen], known.select("id", "label").schema))
    found = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).where("length(text) > 0").join(ids, "id")
    # of repeated ids one text, chosen where the rows are: no more than the sample reaches the driver
    rows = sorted(map(tuple, found.groupBy("id", "label").agg(F.min("text").alias("text")).collect()))
    return [r[2] for r in rows], [r[1] for r in rows]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_label: int = SAMPLE_ROWS_PER_LABEL) -> Model | None:
    """A model from labelled documents; None without any."""
    texts, values = labelled_rows(docs, labels, id_col, text_col, label_col, per_label)
    return fit_model(texts, values) if texts else None


def classify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """(id, score, keep) for every row: score is the vote for good quality, keep says score >= min_score.

    Cases: null and empty texts have a null score and are not kept; a text of one byte
    is judged as any other; a text that no labelled row is alike at all has 0.5; without
    a model every score is null and every row with text is kept, as nothing speaks
    against it; neighbours that tie with the
    last one all vote; repeated rows and null ids give a row each; an empty table gives
    no rows; other columns are not carried.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            data, offsets, _ = flat_text(batch.column(1))
            score, keep = judge(shared.value, data, offsets, min_score)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, mask=np.isnan(score)), pa.array(keep)], names=["id", "score", "keep"])

    picked = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return map_arrow(picked, run, f"id {id_type}, score double, keep boolean").withColumnRenamed("id", id_col)


def judge(model: Model | None, data: np.ndarray, offsets: np.ndarray, min_score: float) -> tuple[np.ndarray, np.ndarray]:
    if model is None:
        return np.full(len(offsets) - 1, np.nan), np.diff(offsets) > 0
    score = score_flat(model, data, offsets)
    return score, np.nan_to_num(score, nan=-1.0) >= min_score


def keep_good(docs: DataFrame, model: Model | None, text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """The rows that classify() keeps, with all their columns, in one pass without a join.

    Cases: as in classify(); rows are judged one by one, so repeated rows stay repeated
    and columns of any name pass through.
    """
    schema = docs.schema
    at = schema.names.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col):
            data, offsets, _ = flat_text(batch.column(at))
            yield batch.filter(pa.array(judge(shared.value, data, offsets, min_score)[1]))

    return map_arrow(docs, run, schema)
