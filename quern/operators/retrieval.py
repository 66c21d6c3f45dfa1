"""Retrieval over tables of questions and chunks: dense, lexical, fusion, reranking.

All operators are set-based and keyed by ``query_id``; every ranking ends with ``chunk_id`` so that
ties have one order. Fixed sizes: 60 candidates a list, 32 fused, floor 0.25, 8 a document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.text import coverage
from quern.functions.vectors import normalised
from quern.operators import lexical as lx
from quern.sources.files import written

POOL, FUSED, FLOOR, PER_DOCUMENT, RRF_K, W_DENSE, W_LEXICAL = 60, 32, 0.25, 8, 60, 1.0, 0.8
#: Bytes of question vectors that a task holds, and pairs that are scored at once.
BLOCK_BYTES, PAIRS = 16 << 20, 1_000_000
#: Chunk ids that are sent to all tasks.
SENT = 1 << 20


def top(df: DataFrame, score: str, k: int | Column, name: str = "position", by: str = "query_id") -> DataFrame:
    """The best rows of each query with their 1-based position."""
    w = Window.partitionBy(by).orderBy(F.col(score).desc(), "chunk_id")
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Unit rows of a list column; null and shorter vectors are padded with zeros, a zero vector stays zero."""
    lengths = np.array([x or 0 for x in column.value_lengths().to_pylist()])
    flat = np.nan_to_num(column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False))
    if (lengths == dim).all():
        m = flat.reshape(-1, dim).copy()
    else:
        m = np.zeros((len(lengths), dim))
        for row, end, n in zip(m, np.cumsum(lengths), lengths, strict=True):
            row[: min(n, dim)] = flat[end - n : end][:dim]
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(size == 0, 1, size)


def _blocks(queries: DataFrame) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and unit vectors of the questions, in blocks of BLOCK_BYTES of vectors at most; their size is counted first."""
    asked = queries.select("query_id", "query_embedding")
    n, dim = asked.agg(F.count("*"), F.coalesce(F.max(F.size("query_embedding")), F.lit(1))).first()
    n_blocks = max(1, -(-n * dim * 8 // BLOCK_BYTES))
    for block in range(n_blocks):
        rows = (asked if n_blocks == 1 else asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == block)).toArrow()
        yield rows.column("query_id").combine_chunks(), _matrix(rows.column("query_embedding").combine_chunks(), dim)


def _kth(s: np.ndarray, q: np.ndarray, n: int, k: int) -> np.ndarray:
    """The k-th greatest value of each of ``n`` questions, -inf for those with fewer."""
    order, counts = np.lexsort((-s, q)), np.bincount(q, minlength=n)
    out, some = np.full(n, -np.inf), counts >= k
    out[some] = s[order[(np.cumsum(counts) - counts)[some] + k - 1]]
    return out


def _places(s: np.ndarray, q: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The 0-based place of each pair in its question and group, by falling value."""
    order = np.lexsort((-s, group, q))
    new = np.r_[True, (np.diff(q[order]) != 0) | (np.diff(group[order]) != 0)][: len(s)]
    first = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
    out = np.empty(len(s), int)
    out[order] = np.arange(len(s)) - first
    return out


def similarities(queries: DataFrame, chunks: DataFrame, floor: float = FLOOR, best: int | None = None, cap: int | None = None) -> DataFrame:
    """(chunk columns, query_id, similarity) of all pairs at or above the floor.

    The questions are the stated query set. They go to the tasks in blocks of BLOCK_BYTES at most,
    whose size is counted first; chunks are read once per block and never shuffled. A batch of
    chunks is multiplied with PAIRS over its length questions at a time. Each pair carries the chunk's columns, so ``chunks`` should have no more than are wanted.
    With ``best`` only pairs leave a task that can be among the best so many of their question by what the task has seen; with ``cap`` too, among these
    when a document gives at most ``cap`` rows, and, should there be one document only, among the best of all.
    """
    kept = [f for f in chunks.schema.fields if f.name != "embedding"]
    out = T.StructType([*kept, queries.schema["query_id"], T.StructField("similarity", T.DoubleType())])
    parts = []
    for block, vectors_of in _blocks(queries):

        def score(batches: Iterator[pa.RecordBatch], ids: pa.Array = block, asked: np.ndarray = vectors_of) -> Iterator[pa.RecordBatch]:
            least, over = np.full(len(ids), floor), np.full(len(ids), floor)  # what a row within the cap, and one beyond it, must reach
            for b in batches:
                if not b.num_rows:
                    continue
                vectors = _matrix(b.column("embedding"), asked.shape[1])
                group = b.column("document_id").dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) if cap else None
                step = max(1, PAIRS // len(vectors))
                for i in range(0, len(ids), step):
                    of = slice(i, i + step)
                    s = np.round(vectors @ asked[of].T, 6)
                    if best and not cap and len(s) > best:
                        least[of] = np.maximum(least[of], np.partition(s, -best, axis=0)[-best])
                    at, q = np.nonzero(s >= least[of])
                    s = s[at, q]
                    if cap and best:
                        within = _places(s, q, group[at]) < cap
                        n = len(least[of])
                        least[of] = np.maximum(least[of], _kth(s[within], q[within], n, best))
                        over[of] = np.maximum(over[of], _kth(s, q, n, best))
                        can = s >= np.where(within, least[of][q], over[of][q])
                        at, q, s = at[can], q[can], s[can]
                    yield pa.RecordBatch.from_arrays([*(b.column(f.name).take(pa.array(at)) for f in kept), ids.take(pa.array(q + i)), pa.array(s)], [f.name for f in out])

        parts.append(chunks.mapInArrow(score, out))
    return reduce(DataFrame.unionByName, parts)


def similarity_summary(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per question, how many chunks it was compared with and the best similarity; each batch leaves one row per question."""
    chunk = chunks.select("embedding")
    out = T.StructType([queries.schema["query_id"], T.StructField("n", T.LongType()), T.StructField("best", T.DoubleType())])
    parts = []
    for block, vectors_of in _blocks(queries):

        def score(batches: Iterator[pa.RecordBatch], ids: pa.Array = block, asked: np.ndarray = vectors_of) -> Iterator[pa.RecordBatch]:
            step = max(1, PAIRS // max(1, len(ids)))
            for b in batches:
                vectors = _matrix(b.column("embedding"), asked.shape[1])
                for i in range(0, len(vectors) if len(ids) else 0, step):
                    s = np.round(vectors[i : i + step] @ asked.T, 6)
                    yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(ids), len(s))), pa.array(s.max(axis=0))], ["query_id", "n", "best"])

        parts.append(chunk.mapInArrow(score, out))
    return reduce(DataFrame.unionByName, parts).groupBy("query_id").agg(F.sum("n").alias("n"), F.max("best").alias("best"))


def dense_topk(queries: DataFrame, chunks: DataFrame, k: int = POOL, floor: float = FLOOR) -> DataFrame:
    k = min(max(k, 1), POOL)
    return top(similarities(queries, chunks, floor, k), "similarity", k)


def per_document_cap(candidates: DataFrame, score: str = "similarity", cap: int = PER_DOCUMENT, pool: int = POOL) -> DataFrame:
    """At most ``cap`` rows of a document where a query has several documents, else the pool; then the pool's best.

    The candidates are read once. Each query keeps the pool's best of the rows within the cap and of those beyond it;
    the former have at least two documents if the query has, so that is seen in these few rows.
    """
    w = Window.partitionBy("query_id", "document_id").orderBy(F.col(score).desc(), "chunk_id")
    ranked = candidates.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= pool).withColumn("_over", F.col("_r") > cap)
    w = Window.partitionBy("query_id", "_over").orderBy(F.col(score).desc(), "chunk_id")
    few = ranked.withColumn("_p", F.row_number().over(w)).filter(F.col("_p") <= pool)
    of = Window.partitionBy("query_id")
    several = F.min("document_id").over(of) < F.max("document_id").over(of)
    return top(few.withColumn("_several", several).filter("NOT (_over AND _several)").drop("_r", "_over", "_p", "_several"), score, pool)


def merge_variants(candidates: DataFrame, score: str = "similarity") -> DataFrame:
    """The best score of a chunk over the variants of a query, ranked again."""
    return top(candidates.groupBy("query_id", "chunk_id").agg(F.max(score).alias(score)), score, POOL)


def ann_topk(queries: DataFrame, chunks: DataFrame, k: int = 10, share: float = 0.7, sample: int = 4096, seed: int = 7, cells: int | None = None) -> DataFrame:
    """(query_id, chunk_id, similarity, position): approximate dense search in the cells nearest to each question.

    Cells are the k-means centres of at most ``sample`` vectors, as many as the square root of the number of
    vectors unless given, but no more than the sample has room for. Every vector belongs to its nearest cell. A question asks the nearest cells that
    hold ``share`` of the sample. A batch of chunks is scored cell by cell, one matrix product with the questions
    that ask it, so nothing is joined and no cell is a hot key.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    cells = cells or max(2, min(int(chunks.count() ** 0.5), sample // 16))
    some = chunks.orderBy(F.xxhash64("chunk_id")).limit(sample).select(array_to_vector(normalised(F.col("embedding"))).alias("features"))
    centres = np.array(KMeans(k=cells, seed=seed, maxIter=10).fit(some).clusterCenters())
    centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    held = np.array([v.toArray() for (v,) in some.collect()])
    full = np.bincount((held @ centres.T).argmax(axis=1), minlength=len(centres)) / max(1, len(held))
    out = T.StructType([queries.schema["query_id"], chunks.schema["chunk_id"], T.StructField("similarity", T.DoubleType())])
    parts = []
    for ids, asked in _blocks(queries):
        order = np.argsort(-(asked @ centres.T), axis=1)
        before = np.cumsum(full[order], axis=1) - full[order]
        asks = np.zeros((len(ids), len(centres)), bool)
        np.put_along_axis(asks, order, before < share, axis=1)

        def score(batches: Iterator[pa.RecordBatch], ids: pa.Array = ids, asked: np.ndarray = asked, asks: np.ndarray = asks) -> Iterator[pa.RecordBatch]:
            for b in batches:
                vectors = _matrix(b.column("embedding"), asked.shape[1])
                cell = (vectors @ centres.T).argmax(axis=1)
                for c in np.unique(cell):
                    mine, who = np.flatnonzero(cell == c), np.flatnonzero(asks[:, c])
                    if len(who):
                        s = np.round(vectors[mine] @ asked[who].T, 6)
                        least = np.partition(s, -k, axis=0)[-k] if len(s) > k else -np.inf
                        at, q = np.nonzero(s >= least)
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(who[q])), b.column("chunk_id").take(pa.array(mine[at])), pa.array(s[at, q])], [f.name for f in out])

        parts.append(chunks.select("chunk_id", "embedding").mapInArrow(score, out))
    return top(reduce(DataFrame.unionByName, parts), "similarity", k)


def lexical_match(queries: DataFrame, chunks: DataFrame, text: str = "question", english: bool = False, within: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, document_id) of the chunks that a web-search question finds; ``chunks`` may be a written index of postings."""
    return lx.match(queries, chunks, text, english, within=within)


def cover_density(queries: DataFrame, chunks: DataFrame, text: str = "question", english: bool = False, within: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, document_id, lexical_rank) by cover density; ``chunks`` may be a written index of postings."""
    return lx.density(queries, chunks, text, english, within=within)


def visible(chunks: DataFrame) -> DataFrame:
    """Chunks that may be searched: of a ready document, of its version, slides only of a parser that keeps their order."""
    return chunks.filter((F.col("status") == "ready") & (F.col("chunk_version") == F.col("version")) & (~F.endswith(F.lower("filename"), F.lit(".pptx")) | (F.col("parser_version") >= 2)))


def _by_variant(queries: DataFrame) -> DataFrame:
    """Questions with (query_id, variant) as one key; a question without a variant is the only one."""
    rows = queries if "variant" in queries.columns else queries.withColumn("variant", F.lit(0))
    return rows.withColumn("query_id", F.struct("query_id", "variant"))


def _merged(lists: DataFrame, score: str) -> DataFrame:
    """The lists of a question's variants as one: each chunk by its best score, with positions anew."""
    best = lists.groupBy("query_id.query_id", "chunk_id").agg(F.max("document_id").alias("document_id"), F.max(score).alias(score))
    return best.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col(score).desc(), "chunk_id")))


def dense_lists(queries: DataFrame, chunks: DataFrame, floor: float = FLOOR, cap: int = PER_DOCUMENT, pool: int = POOL) -> DataFrame:
    """(query_id, chunk_id, document_id, similarity, position): each variant's list with its cap per document, merged. A variant without a vector gives none."""
    asked = _by_variant(queries).filter("query_embedding IS NOT NULL")
    found = similarities(asked, chunks.select("chunk_id", "document_id", "embedding"), floor, pool, cap)
    return _merged(per_document_cap(found, cap=cap, pool=pool), "similarity")


def lexical_topk(queries: DataFrame, chunks: DataFrame, text: str = "question", english: bool = True, cap: int = PER_DOCUMENT, pool: int = POOL, within: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, document_id, lexical_rank, position): each variant's chunks by cover density, at most ``cap`` of a
    document where a variant finds several documents, the first ``pool`` of these; the variants' lists merged by best rank.

    Chunks must be eligible (``visible``) before they are ranked. ``chunks`` may be a written index of postings, then with the eligible ones in
    ``within``. Only chunks that can come among the first leave a task. A variant that asks for nothing is passed over.
    """
    asked = _by_variant(queries).filter(F.col(text).isNotNull())
    found = lx.best_density(asked, chunks, pool, cap, text, english, within=within)
    return _merged(per_document_cap(found, "lexical_rank", cap, pool), "lexical_rank")


def rrf_fuse(dense: DataFrame, lexical: DataFrame, k: int = RRF_K, w_dense: float = W_DENSE, w_lexical: float = W_LEXICAL, limit: int = FUSED) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (position each); ties by similarity, then chunk."""
    d = dense.select("query_id", "chunk_id", F.col("position").alias("dense_position"), "similarity")
    x = lexical.select("query_id", "chunk_id", F.col("position").alias("lexical_position"), "lexical_rank")
    both = d.join(x, ["query_id", "chunk_id"], "full_outer")
    part = lambda w, p: F.coalesce(F.lit(w) / (k + F.col(p)), F.lit(0.0))
    both = both.withColumn("fusion_score", F.round(part(w_dense, "dense_position") + part(w_lexical, "lexical_position"), 8))
    w = Window.partitionBy("query_id").orderBy(F.col("fusion_score").desc(), F.col("similarity").desc_nulls_last(), "chunk_id")
    return both.withColumn("fused_position", F.row_number().over(w)).filter(F.col("fused_position") <= limit)


def with_chunks(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """The rows with the columns of their chunks (by chunk_id). Chunks that no row names are left out where they are read, so only named ones are dealt.

    ``rows`` are read twice. More than SENT ids aren't sent to the tasks; then chunks are joined as they are.
    """
    ids = rows.select("chunk_id").distinct()
    named = chunks.join(F.broadcast(ids), "chunk_id", "left_semi") if ids.count() <= SENT else chunks
    return rows.join(named, "chunk_id")


def heuristic_rerank(fused: DataFrame, queries: DataFrame, chunks: DataFrame, k: int = FUSED, question: str = "question", content: str = "content") -> DataFrame:
    """0.6 of the question's terms that the content has plus 0.4 of the similarity; ties by fusion score, then chunk."""
    rows = with_chunks(written(fused), chunks.select("chunk_id", "document_id", F.col(content).alias("_c"))).join(queries.select("query_id", F.col(question).alias("_q")), "query_id")
    rows = rows.withColumn("rerank_score", F.round(0.6 * coverage("_q", "_c") + 0.4 * F.coalesce("similarity", F.lit(0.0)), 4)).drop("_q", "_c")
    w = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), F.col("fusion_score").desc(), "chunk_id")
    return rows.withColumn("final_position", F.row_number().over(w)).filter(F.col("final_position") <= k)


def _reason(n: Column, support: Column, similarity: Column, rerank: Column, min_rerank: float, min_similarity: float, min_chunks: int) -> Column:
    weak = ~(rerank.isNull() | (rerank >= min_rerank)) | ~(similarity.isNull() | (similarity >= min_similarity))
    return F.when(n.isNull(), "no_candidates").when(weak, "weak_top_score").when(support < min_chunks, "insufficient_support").otherwise("ok")


def _supports(supporting: float, min_similarity: float) -> Column:
    return F.when(F.col("rerank_score").isNotNull(), F.col("rerank_score") >= supporting).otherwise(F.coalesce("similarity", F.lit(0.0)) >= min_similarity)


def evidence_gate(queries: DataFrame, ranked: DataFrame, min_rerank: float = 0.35, min_similarity: float = 0.30, min_chunks: int = 1, supporting: float = 0.30) -> DataFrame:
    """One verdict per query: no_candidates, weak_top_score, insufficient_support or ok."""
    supports = _supports(supporting, min_similarity)
    seen = ranked.groupBy("query_id").agg(F.count("*").alias("n"), F.count_if(supports).alias("supporting_chunks"), F.count_distinct(F.when(supports, F.col("document_id"))).alias("distinct_documents"), F.max("similarity").alias("best_similarity"), F.max("rerank_score").alias("best_rerank_score"))
    reason = _reason(F.col("n"), F.col("supporting_chunks"), F.col("best_similarity"), F.col("best_rerank_score"), min_rerank, min_similarity, min_chunks)
    rows = queries.select("query_id").join(seen, "query_id", "left")
    return rows.select("query_id", (reason == "ok").alias("grounded"), reason.alias("reason"), F.coalesce("supporting_chunks", F.lit(0)).alias("supporting_chunks"), F.coalesce("distinct_documents", F.lit(0)).alias("distinct_documents"), "best_similarity", "best_rerank_score")


def with_reason(ranked: DataFrame, min_rerank: float = 0.35, min_similarity: float = 0.30, min_chunks: int = 1, supporting: float = 0.30) -> DataFrame:
    """The ranked passages with their query's verdict in ``reason``, found over the query's rows without reading them twice."""
    w = Window.partitionBy("query_id")
    seen = ranked.withColumn("_n", F.count_if(_supports(supporting, min_similarity)).over(w)).withColumn("_s", F.max("similarity").over(w)).withColumn("_b", F.max("rerank_score").over(w))
    return seen.withColumn("reason", _reason(F.lit(1), F.col("_n"), F.col("_s"), F.col("_b"), min_rerank, min_similarity, min_chunks)).drop("_n", "_s", "_b")


def retrieve(queries: DataFrame, vectors: DataFrame, passages: DataFrame, english: bool = True, index: DataFrame | None = None) -> DataFrame:
    """Dense and lexical lists, fused and reranked: at most FUSED ranked passages a query.

    queries: with ``variant`` and the variant's question and vector where questions are expanded; variant 0 is the question as it was asked, by which passages are reranked.
    vectors: the chunks that have an embedding, for dense search; passages: all chunks with their content, for full-text search. Only ``visible`` ones are found.
    index: written postings of the passages, read in their stead for full-text search.
    """
    passages = visible(passages)
    dense = dense_lists(queries, visible(vectors))
    lexical = lexical_topk(queries, passages if index is None else index, english=english, within=None if index is None else passages)
    asked = queries.filter("variant = 0") if "variant" in queries.columns else queries
    return heuristic_rerank(rrf_fuse(dense, lexical), asked, passages)
