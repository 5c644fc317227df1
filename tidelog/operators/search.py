"""Exact retrieval: vector, text and hybrid top-k, and context assembly under a budget.

Each search is one scan with the score computed in generated code and a top-k
(TakeOrderedAndProject), so nothing but k rows a task reaches the driver. Scores are
doubles rounded to six places; ties are broken by id on the rounded value.

The *_each searches answer all rows of a table of queries, or all scopes, at once: queries
and points of a scope meet in blocks, numpy keeps of each block what may be among a
query's best k, and one window a query ranks the rounded scores. k is the only limit.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.errors import InvalidState
from tidelog.functions.scalars import check_vector, cosine, count_matches, truncate_bytes, weighted_score
from tidelog.session import ship

MAX_TIER_K = 64
MAX_RETRIEVAL_K, DEFAULT_RETRIEVAL_K = 64, 8
MAX_CHUNK_BYTES, DEFAULT_CHUNK_BYTES = 65_536, 4_096
DIGITS = 6
_TIES = ["document_id", "ordinal", "chunk_id"]
_SCOPE = ["tenant", "namespace"]
#: Vectors of one scope in a block, on either side; queries of a block that are scored at once.
BLOCK, STEP = 4_096, 256


def _positive(limit: int) -> int:
    if limit <= 0:
        raise InvalidState("a search limit must be greater than zero")
    return limit


def in_scope(chunks: DataFrame, documents: DataFrame, tenant: str, namespace: str) -> DataFrame:
    """Chunks of the documents of one tenant and namespace (semi join; tenant and namespace are filtered at the scan)."""
    scope = documents.where((F.col("tenant") == tenant) & (F.col("namespace") == namespace)).select("document_id")
    return chunks.join(scope, "document_id", "left_semi")


def chunks_containing(chunks: DataFrame, documents: DataFrame, tenant: str, namespace: str, needle: str) -> DataFrame:
    """Chunks whose text contains the needle, without case, by document and ordinal."""
    low = needle.strip().lower()
    if not low:
        raise InvalidState("a text query must not be blank")
    return in_scope(chunks, documents, tenant, namespace).where(F.contains(F.lower("text"), F.lit(low))).orderBy("document_id", "ordinal")


def score(query: Sequence[float], vector: Column) -> Column:
    return F.round(cosine(query, vector), DIGITS)


def vector_topk(chunks: DataFrame, documents: DataFrame, embeddings: DataFrame, tenant: str, namespace: str, model_id: str, query: Sequence[float], limit: int) -> DataFrame:
    """Chunks by cosine of their embedding of one model; only embeddings of the query's length take part."""
    _positive(limit)
    fit = embeddings.where((F.col("model_id") == model_id) & (F.size("vector") == len(query)))
    hits = fit.join(in_scope(chunks, documents, tenant, namespace), "chunk_id").withColumn("score", F.coalesce(score(query, F.col("vector")), F.lit(0.0)))
    return hits.select("chunk_id", "document_id", "ordinal", "text", "model_id", "score").orderBy(F.desc("score"), *_TIES).limit(limit)


def text_hits(chunks: DataFrame, documents: DataFrame, tenant: str, namespace: str, query: str) -> DataFrame:
    found = in_scope(chunks, documents, tenant, namespace).withColumn("match_count", count_matches(F.col("text"), query))
    return found.where("match_count > 0")


def text_topk(chunks: DataFrame, documents: DataFrame, tenant: str, namespace: str, query: str, limit: int) -> DataFrame:
    """Chunks by number of occurrences; none without any."""
    _positive(limit)
    hits = text_hits(chunks, documents, tenant, namespace, query)
    return hits.select("chunk_id", "document_id", "ordinal", "text", "match_count").orderBy(F.desc("match_count"), *_TIES).limit(limit)


def hybrid_topk(chunks: DataFrame, documents: DataFrame, embeddings: DataFrame, tenant: str, namespace: str, model_id: str, query: Sequence[float], text_query: str, limit: int, vector_weight: float, text_weight: float) -> DataFrame:
    """Chunks by weighted sum of cosine and occurrences; sums of exactly zero are dropped, negative ones kept."""
    _positive(limit)
    fit = embeddings.where((F.col("model_id") == model_id) & (F.size("vector") == len(query)))
    both = fit.join(in_scope(chunks, documents, tenant, namespace), "chunk_id")
    both = both.withColumn("vector_score", F.coalesce(score(query, F.col("vector")), F.lit(0.0))).withColumn("match_count", count_matches(F.col("text"), text_query))
    both = both.withColumn("combined_score", F.round(weighted_score(F.col("vector_score"), F.col("match_count"), vector_weight, text_weight), DIGITS)).where("combined_score <> 0")
    order = [F.desc("combined_score"), F.desc("vector_score"), F.desc("match_count"), *_TIES]
    return both.select("chunk_id", "document_id", "ordinal", "text", "model_id", "vector_score", "match_count", "combined_score").orderBy(*order).limit(limit)


def assemble_context(hits: DataFrame, order: list[Column | str], max_block_chars: int, max_total_chars: int, by: Sequence[str] = ()) -> DataFrame:
    """Blocks in rank order under a character budget: each at most `max_block_chars`, all together at most `max_total_chars`.

    `hits` is a top-k result, so one window over it is small. Adds rank, block (the text
    kept), original_chars, block_chars and clipped; hits past the budget are absent. With
    `by`, the columns of a query's key, each query has its own ranks and budget.
    """
    if max_block_chars <= 0 or max_total_chars <= 0:
        raise InvalidState("a context budget must be greater than zero")
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    wish = F.least(F.char_length("text"), F.lit(max_block_chars))
    used = F.coalesce(F.sum(wish).over(Window.partitionBy(*by).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = ranked.withColumn("used", used).where(F.col("used") < max_total_chars)
    size = F.least(wish, F.lit(max_total_chars) - F.col("used")).cast("int")
    return ranked.withColumn("original_chars", F.char_length("text").cast("long")).withColumn("block", F.substring("text", F.lit(1), size)).withColumn("block_chars", size.cast("long")).withColumn("clipped", F.col("original_chars") > F.col("block_chars")).drop("used", "text")


def retrieve(chunks: DataFrame, documents: DataFrame, tenant: str, namespace: str, query: str, top_k: int = 0, max_chunk_bytes: int = 0) -> DataFrame:
    """Text hits with outcome columns: 'hit', or one row 'empty', 'rejected' (a bound is exceeded) or 'invalid' (a blank query) without a hit.

    Zero stands for the default of a bound. candidate_count saturates at the greatest k.
    """
    spark = chunks.sparkSession
    outcome = "rejected" if top_k > MAX_RETRIEVAL_K or max_chunk_bytes > MAX_CHUNK_BYTES else "invalid" if not query.strip() else None
    columns = "outcome string, candidate_count long, truncated_by_top_k boolean, document_id string, chunk_id string, ordinal int, match_count long, byte_len long, truncated boolean, text string"
    if outcome:
        return spark.createDataFrame([(outcome, 0, False, *[None] * 7)], columns)
    k, cap = top_k or DEFAULT_RETRIEVAL_K, max_chunk_bytes or DEFAULT_CHUNK_BYTES
    order = [F.desc("match_count"), *_TIES]
    found = text_hits(chunks, documents, tenant, namespace, query)
    # one row of at most MAX_RETRIEVAL_K candidates, there also if there are none: one scan gives hits or 'empty'
    place = F.row_number().over(Window.orderBy(*order)).alias("rank")
    rows = F.array_sort(F.collect_list(F.struct("rank", "document_id", "chunk_id", "ordinal", "match_count", "text")))
    held = found.orderBy(*order).limit(MAX_RETRIEVAL_K).select("*", place).agg(rows.alias("c"))
    one = held.select(F.size("c").cast("long").alias("candidate_count"), F.explode_outer(F.slice("c", 1, k)).alias("h"))
    size = F.octet_length("h.text").cast("long")
    return one.select(
        F.when(F.col("candidate_count") > 0, "hit").otherwise("empty").alias("outcome"), "candidate_count", (F.col("candidate_count") > k).alias("truncated_by_top_k"), "h.document_id", "h.chunk_id", "h.ordinal", "h.match_count",
        size.alias("byte_len"), (size > cap).alias("truncated"), truncate_bytes(F.col("h.text"), cap).alias("text"),
    )


def tier_topk(points: DataFrame, collection: str, model_id: str, query: Sequence[float], k: int) -> DataFrame:
    """Live points of a collection and model, of the query's length, by cosine; k from 1 to 64."""
    if not 1 <= k <= MAX_TIER_K:
        raise InvalidState(f"k must be from 1 to {MAX_TIER_K}")
    fit = points.where((F.col("collection") == collection) & (F.col("model_id") == model_id) & (F.size("vector") == len(query)))
    scored = fit.withColumn("score", F.coalesce(score(query, F.col("vector")), F.lit(0.0)))
    return scored.select("point_id", "score").orderBy(F.desc("score"), "point_id").limit(k)


def log_topk(points: DataFrame, collection: str, query: Sequence[float], k: int) -> DataFrame:
    """Live points of a collection by cosine; other lengths and zero norms score 0 and stay; k = 0 gives none."""
    q = [float(x) for x in query]
    known = any(q) and len(q) > 0
    value = F.coalesce(score(check_vector(q), F.col("vector")), F.lit(0.0)) if known else F.lit(0.0)
    return points.where(F.col("collection") == collection).select("point_id", value.alias("score")).orderBy(F.desc("score"), "point_id").limit(max(k, 0))


def _by_length(vectors: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, places, matrix, norms) of the vectors of each length; a vector with a missing or non-finite element has norm 0."""
    sizes = np.asarray(vectors.value_lengths().fill_null(0))
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(sizes) - sizes
    for n in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == n)
        m = flat[starts[at][:, None] + np.arange(n)]
        m[~np.isfinite(m).all(1)] = 0
        yield n, at, m, np.sqrt((m * m).sum(1))


def _block_scores(queries: pa.ListArray, points: pa.ListArray) -> np.ndarray:
    """Cosines of all pairs; 0 where lengths differ or a norm is 0."""
    out = np.zeros((len(queries), len(points)))
    others = {n: rest for n, *rest in _by_length(points)}
    for n, at, m, norm in _by_length(queries):
        if n in others:
            at2, m2, norm2 = others[n]
            size = norm[:, None] * norm2
            out[np.ix_(at, at2)] = np.divide(m @ m2.T, size, out=np.zeros_like(size), where=size > 0)
    return out


def _candidates(queries: DataFrame, points: DataFrame, by: list[str], k: int, vector_weight: float = 1.0, text_weight: float = 0.0, zeros: bool = True) -> DataFrame:
    """(columns of queries and points but the vectors, vector_score) with every pair of a scope that may be among its query's best k; scores are not rounded yet.

    Queries and points are matched by the columns `by`, which both have; their other names
    differ. With a text weight, points have match_count. Without `zeros`, pairs of a sum of
    zero do not count.
    """
    keys, rest = [c for c in queries.columns if c != "vector"], [c for c in points.columns if c not in ("vector", *by)]
    blocks = points.groupBy(*by).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("__blocks"))
    part = F.pmod(F.xxhash64(*rest), F.col("__blocks")).cast("int")
    count = F.col("match_count").cast("double") if text_weight else F.lit(0.0)
    right = points.join(blocks, by).groupBy(*by, part.alias("__block")).agg(F.collect_list(F.struct(F.struct(*rest).alias("row"), count.alias("n"), "vector")).alias("__p"))
    own = queries.groupBy(*by).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("__own"))
    left = queries.join(own, by).groupBy(*by, F.pmod(F.xxhash64(*keys), F.col("__own")).alias("__part")).agg(F.collect_list(F.struct(F.struct(*keys).alias("row"), "vector")).alias("__q"))
    left = left.join(blocks, by).withColumn("__block", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    pairs = left.join(right, [*by, "__block"]).select("__q", "__p")
    slack = 2 * 10.0**-DIGITS * (1 + abs(vector_weight))  # what rounding can move a sum, and more

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (q, vectors), (p, n, others) = (batch.column(c)[i].values.flatten() for c in (0, 1))
                for at in range(0, len(q), STEP):
                    score = _block_scores(vectors.slice(at, STEP), others)
                    total = vector_weight * score + text_weight * np.asarray(n)
                    more = 0
                    if not zeros:
                        total[np.abs(total) < 1e-12] = -np.inf
                        more = int((np.abs(total) <= slack).sum(1).max(initial=0))  # these may be zero once rounded
                    found = np.isfinite(total)
                    if k + more < len(p):
                        least = np.partition(total, len(p) - k - more, axis=1)[:, len(p) - k - more] if k + more else np.full(len(total), np.inf)
                        found &= total >= least[:, None] - slack
                    a, b = np.nonzero(found)
                    yield pa.RecordBatch.from_arrays([q.slice(at, STEP).take(pa.array(a)), p.take(pa.array(b)), pa.array(score[a, b])], names=["q", "p", "vector_score"])

    schema = f"q {queries.select(F.struct(*keys)).schema[0].dataType.simpleString()}, p {points.select(F.struct(*rest)).schema[0].dataType.simpleString()}, vector_score double"
    ship(queries.sparkSession)
    return pairs.mapInArrow(run, schema).select("q.*", "p.*", "vector_score")


def _best(hits: DataFrame, key: list[str], order: list[Column | str], k: int) -> DataFrame:
    return hits.withColumn("__rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("__rank") <= k).drop("__rank")


def _check_queries(queries: DataFrame) -> DataFrame:
    """queries, failing in the task that meets an empty or non-finite vector."""
    good = (F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return queries.withColumn("vector", F.when(F.coalesce(good, F.lit(False)), F.col("vector")).otherwise(F.raise_error("a query vector must not be empty and must be finite")))


def tier_topk_each(queries: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """tier_topk() for every row of (query_id, collection, model_id, vector): (query_id, collection, model_id, point_id, score).

    A query vector of zeros scores 0 with all points; a query without points has no rows.
    """
    if not 1 <= k <= MAX_TIER_K:
        raise InvalidState(f"k must be from 1 to {MAX_TIER_K}")
    by = ["collection", "model_id", "__length"]
    sized = lambda df: df.withColumn("__length", F.size("vector"))
    found = _candidates(sized(_check_queries(queries.select("query_id", "collection", "model_id", "vector"))), sized(points.select("collection", "model_id", "point_id", "vector")), by, k)
    scored = found.select("query_id", "collection", "model_id", "point_id", F.round("vector_score", DIGITS).alias("score"))
    return _best(scored, ["query_id", "collection", "model_id"], [F.desc("score"), "point_id"], k)


def log_topk_each(queries: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """log_topk() for every row of (query_id, collection, vector): (query_id, collection, point_id, score)."""
    found = _candidates(_check_queries(queries.select("query_id", "collection", "vector")), points.select("collection", "point_id", "vector"), ["collection"], max(k, 0))
    scored = found.select("query_id", "collection", "point_id", F.round("vector_score", DIGITS).alias("score"))
    return _best(scored, ["query_id", "collection"], [F.desc("score"), "point_id"], k)


def scoped(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks with the tenant and namespace of their document, in each scope that holds it."""
    return chunks.join(documents.select("document_id", *_SCOPE).distinct(), "document_id")


def _catalogue_each(queries: DataFrame, chunks: DataFrame, embeddings: DataFrame, k: int, **weights) -> DataFrame:
    by = [*_SCOPE, "model_id", "__length"]
    sized = lambda df: df.withColumn("__length", F.size("vector"))
    fit = embeddings.select("chunk_id", "model_id", "vector").join(chunks, "chunk_id")
    found = _candidates(sized(_check_queries(queries.select("query_id", *_SCOPE, "model_id", "vector"))), sized(fit), by, k, **weights)
    return found.drop("__length").withColumn("vector_score", F.round("vector_score", DIGITS))


def vector_topk_each(queries: DataFrame, chunks: DataFrame, documents: DataFrame, embeddings: DataFrame, limit: int) -> DataFrame:
    """vector_topk() for every row of (query_id, tenant, namespace, model_id, vector), without the texts, which chunk_id names."""
    found = _catalogue_each(queries, scoped(chunks, documents).select("chunk_id", "document_id", "ordinal", *_SCOPE), embeddings, _positive(limit))
    scored = found.select("query_id", *_SCOPE, "model_id", "chunk_id", "document_id", "ordinal", F.col("vector_score").alias("score"))
    return _best(scored, ["query_id", *_SCOPE, "model_id"], [F.desc("score"), *_TIES], limit)


def hybrid_topk_each(queries: DataFrame, chunks: DataFrame, documents: DataFrame, embeddings: DataFrame, text_query: str, limit: int, vector_weight: float, text_weight: float) -> DataFrame:
    """hybrid_topk() for every row of (query_id, tenant, namespace, model_id, vector) and one text, without the texts of the chunks."""
    counted = scoped(chunks, documents).select("chunk_id", "document_id", "ordinal", *_SCOPE, count_matches(F.col("text"), text_query).alias("match_count"))
    found = _catalogue_each(queries, counted, embeddings, _positive(limit), vector_weight=vector_weight, text_weight=text_weight, zeros=False)
    both = found.withColumn("combined_score", F.round(weighted_score(F.col("vector_score"), F.col("match_count"), vector_weight, text_weight), DIGITS)).where("combined_score <> 0")
    order = [F.desc("combined_score"), F.desc("vector_score"), F.desc("match_count"), *_TIES]
    both = both.select("query_id", *_SCOPE, "model_id", "chunk_id", "document_id", "ordinal", "vector_score", "match_count", "combined_score")
    return _best(both, ["query_id", *_SCOPE, "model_id"], order, limit)


def chunks_containing_each(chunks: DataFrame, documents: DataFrame, needle: str) -> DataFrame:
    """chunks_containing() for every tenant and namespace."""
    low = needle.strip().lower()
    if not low:
        raise InvalidState("a text query must not be blank")
    return scoped(chunks, documents).where(F.contains(F.lower("text"), F.lit(low)))


def text_topk_each(chunks: DataFrame, documents: DataFrame, query: str, limit: int) -> DataFrame:
    """text_topk() for every tenant and namespace."""
    hits = scoped(chunks, documents).withColumn("match_count", count_matches(F.col("text"), query)).where("match_count > 0")
    return _best(hits.select(*_SCOPE, "chunk_id", "document_id", "ordinal", "text", "match_count"), _SCOPE, [F.desc("match_count"), *_TIES], _positive(limit))


def retrieve_each(chunks: DataFrame, documents: DataFrame, query: str, top_k: int = 0, max_chunk_bytes: int = 0) -> DataFrame:
    """retrieve() for every tenant and namespace of the documents; a scope without hits has its row 'empty'. Bounds and the query are checked at once, for all."""
    if top_k > MAX_RETRIEVAL_K or max_chunk_bytes > MAX_CHUNK_BYTES or not query.strip():
        raise InvalidState("a retrieval is out of bounds or blank")
    k, cap = top_k or DEFAULT_RETRIEVAL_K, max_chunk_bytes or DEFAULT_CHUNK_BYTES
    candidates = text_topk_each(chunks, documents, query, MAX_RETRIEVAL_K).withColumn("candidate_count", F.count("*").over(Window.partitionBy(*_SCOPE)))
    size = F.octet_length("text").cast("long")
    hits = _best(candidates, _SCOPE, [F.desc("match_count"), *_TIES], k).select(
        *_SCOPE, F.lit("hit").alias("outcome"), "candidate_count", (F.col("candidate_count") > k).alias("truncated_by_top_k"), "document_id", "chunk_id", "ordinal", "match_count", size.alias("byte_len"), (size > cap).alias("truncated"), truncate_bytes(F.col("text"), cap).alias("text")
    )
    none = documents.select(*_SCOPE).dropna().distinct().join(hits.select(*_SCOPE), _SCOPE, "left_anti")
    return hits.unionByName(none.select(*_SCOPE, F.lit("empty").alias("outcome"), F.lit(0).cast("long").alias("candidate_count"), F.lit(False).alias("truncated_by_top_k")), allowMissingColumns=True)
