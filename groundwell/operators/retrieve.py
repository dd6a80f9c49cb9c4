"""Ranked retrieval for a DataFrame of queries: BM25, dense top-k, fusion, caps and filters.

Access rules are applied before ranking, so a restricted chunk can't push an eligible one out of the
top k; freshness and type filters act after the cut, as documented. All orders end in a unique key.
Only the query side is ever broadcast, and only while it has at most ``BROADCAST_QUERIES`` rows and, for
vectors, ``BROADCAST_BYTES``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import dot, tokens

BROADCAST_QUERIES = 100_000
BROADCAST_BYTES = 64 << 20
#: Scores that a worker holds at a time.
BLOCK_CELLS = 4_000_000


def entitled(tags: Column, roles: Column) -> Column:
    """Untagged, or a tag among the roles; case-sensitive, no trimming. Null counts as empty."""
    none = F.array().cast("array<string>")
    tags = F.coalesce(tags, none)
    return (F.size(tags) == 0) | F.coalesce(F.arrays_overlap(tags, F.coalesce(roles, none)), F.lit(False))


def fresh(obsolete: Column, effective: Column, expiry: Column, as_of: Column) -> Column:
    """Not obsolete, and as_of within both inclusive bounds; a null bound is none."""
    return ~F.coalesce(obsolete, F.lit(False)) & (effective.isNull() | (effective <= as_of)) & (expiry.isNull() | (as_of <= expiry))


def small(df: DataFrame, limit: int = BROADCAST_QUERIES) -> DataFrame:
    """A broadcast hint if the table has at most ``limit`` rows, counted here."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


@dataclass(frozen=True)
class Index:
    """BM25 tables of a corpus: postings (term, chunk_id, tf), doc_len (chunk_id, dl), one-row stats (n, avgdl), terms (term, df, idf)."""

    postings: DataFrame
    doc_len: DataFrame
    stats: DataFrame
    terms: DataFrame


def lengths(chunks: DataFrame, chunk_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    return chunks.select(F.col(chunk_col).alias("chunk_id"), F.size(tokens(F.col(text_col))).alias("dl"))


def build_index(chunks: DataFrame, *, chunk_col: str = "chunk_id", text_col: str = "text") -> Index:
    words = chunks.select(F.col(chunk_col).alias("chunk_id"), F.explode(tokens(F.col(text_col))).alias("term"))
    postings = words.groupBy("term", "chunk_id").agg(F.count("*").alias("tf"))
    doc_len = lengths(chunks, chunk_col, text_col)
    stats = doc_len.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    terms = postings.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(stats.select("n")))
    return Index(postings, doc_len, stats, terms.select("term", "df", idf(F.col("n"), F.col("df")).alias("idf")))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25_scores(chunks: DataFrame, queries: DataFrame, *, k1: float = 1.5, b: float = 0.75, chunk_col: str = "chunk_id", text_col: str = "text", query_col: str = "query_id", question_col: str = "question", tags_col: str | None = None, roles_col: str | None = None) -> DataFrame:
    """(query_id, chunk_id, score) of every chunk that shares a term with a query and that the query's roles may see.

    Two passes over the chunks, both with the distinct query terms broadcast into the scan: one counts
    the chunks that hold each term, and all chunks and their lengths, in one aggregation; the other
    keeps the postings of query terms with the chunk length riding along. Statistics cover the whole
    corpus, also what a query may not see.
    """
    roles = [] if roles_col is None else [F.col(roles_col).alias("roles")]
    asked = queries.select(F.col(query_col).alias("query_id"), *roles, F.explode(tokens(F.col(question_col))).alias("term"))
    asked = asked.groupBy("query_id", "term").agg(F.count("*").alias("qtf"), *([F.first("roles").alias("roles")] if roles else []))
    few = asked.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES
    hint = F.broadcast if few else lambda df: df
    terms = hint(asked.select("term").distinct())
    tags = [] if tags_col is None else [F.col(tags_col).alias("tags")]
    words = chunks.select(F.col(chunk_col).alias("chunk_id"), *tags, tokens(F.col(text_col)).alias("w"))
    # A chunk's mark, the empty term, carries its length: so one aggregation yields n, all lengths and each term's count.
    each = words.select(F.size("w").alias("dl"), F.explode(F.array_append(F.array_distinct("w"), F.lit(""))).alias("term"))
    counts = each.join(hint(asked.select("term").distinct().unionByName(asked.sparkSession.sql("SELECT '' AS term"))), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"), F.sum("dl").alias("total"))
    whole = Window.partitionBy(F.lit(0))  # over the query terms only
    mark = F.col("term") == ""
    counts = counts.withColumns({"n": F.max(F.when(mark, F.col("df"))).over(whole), "avgdl": F.max(F.when(mark, F.col("total") / F.col("df"))).over(whole)})
    weights = asked.join(counts.where(~mark), "term")
    weights = weights.select("query_id", *(["roles"] if roles else []), "term", (F.col("qtf") * idf(F.col("n"), F.col("df"))).alias("weight"), "avgdl")
    key = ["chunk_id", "dl", "term", *(["tags"] if tags else [])]
    held = words.select("chunk_id", *(["tags"] if tags else []), F.size("w").alias("dl"), F.explode("w").alias("term"))
    held = held.join(terms, "term", "left_semi").groupBy(*key).agg(F.count("*").alias("tf"))
    part = F.col("weight") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    met = held.join(hint(weights), "term")
    if tags:
        met = met.where(entitled(F.col("tags"), F.col("roles") if roles else F.lit(None).cast("array<string>")))
    return met.groupBy("query_id", "chunk_id").agg(F.sum(part).alias("score"))


def index_scores(index: Index, queries: DataFrame, *, k1: float = 1.5, b: float = 0.75, query_col: str = "query_id", question_col: str = "question") -> DataFrame:
    """``bm25_scores`` from stored tables: reads the postings of the query terms and no text."""
    asked = queries.select(F.col(query_col).alias("query_id"), F.explode(tokens(F.col(question_col))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    weights = asked.join(index.terms, "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("weight"))
    part = F.col("weight") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    met = index.postings.join(small(weights), "term").join(index.doc_len, "chunk_id").crossJoin(F.broadcast(index.stats.select("avgdl")))
    return met.groupBy("query_id", "chunk_id").agg(F.sum(part).alias("score"))


def top_k(scores: DataFrame, k: int, digits: int | None = None) -> DataFrame:
    """The k best rows of each query with rank from 1; ties go to the smaller chunk id. k <= 0 gives no row."""
    if k <= 0:
        return scores.withColumn("rank", F.lit(0)).limit(0)
    if digits is not None:
        scores = scores.withColumn("score", F.round("score", digits))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def dense_scores(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score): inner product of every query vector with every chunk it may see.

    vectors: chunk_id, vector and optionally tags; queries: query_id, vector and optionally roles.
    All pairs, for a small set of either; ``dense_top_k`` is the search.
    """
    asked = queries.select("query_id", F.col("vector").alias("_qv"), *([F.col("roles")] if "roles" in queries.columns else []))
    pairs = vectors.join(small(asked), entitled(F.col("tags"), F.col("roles")) if "tags" in vectors.columns and "roles" in queries.columns else F.lit(True))
    return pairs.select("query_id", "chunk_id", dot(F.col("vector"), F.col("_qv")).alias("score"))


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that hold ``dim`` numbers, and these as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    sizes[column.is_null().to_numpy(zero_copy_only=False)] = -1
    at = np.flatnonzero(sizes == dim)
    flat = column.take(pa.array(at)).flatten()
    whole = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), dim)
    good = np.isfinite(whole).all(1)
    return at[good], whole[good]


def dense_top_k(vectors: DataFrame, queries: DataFrame, k: int, *, digits: int = 6) -> DataFrame:
    """(query_id, chunk_id, score, rank): the k best of the chunks that each query may see, by inner product.

    vectors and queries as in ``dense_scores``; vectors with a null or non-finite number, or of another
    length than the query's, take no part. Scores are rounded before they are ordered. The queries are
    broadcast as matrices of at most BROADCAST_BYTES, each batch of vectors is multiplied as a block and
    keeps its k best of each query, so no pair leaves the worker but those. More queries than that run
    in several passes over the vectors, in a union.
    """
    if k <= 0:
        return dense_scores(vectors, queries).withColumn("rank", F.lit(0)).limit(0)
    roles = F.col("roles") if "roles" in queries.columns else F.lit(None).cast("array<string>")
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"), roles.alias("roles")).where("vector is not null")
    size = asked.agg(F.coalesce(F.sum(F.size("vector") * 8), F.lit(0))).first()[0]
    passes = -(-size // BROADCAST_BYTES) or 1
    by_tags = "tags" in vectors.columns
    held = vectors.select("chunk_id", F.col("vector").cast("array<double>").alias("vector"), *([F.col("tags")] if by_tags else []))
    kinds = {name: df.schema[name].dataType.simpleString() for name, df in (("query_id", queries), ("chunk_id", vectors))}
    out = None
    for turn in range(passes):
        part = asked if passes == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == turn)
        block = part.toArrow()
        found = held.mapInArrow(_block_search(vectors.sparkSession.sparkContext.broadcast(block), k, digits, by_tags), f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, score double")
        out = found if out is None else out.unionByName(found)
    return top_k(out, k)


def _block_search(shared, k: int, digits: int, by_tags: bool):
    def search(batches):
        block = shared.value
        dims = sorted({len(v) for v in block.column("vector").to_pylist()})
        groups = []
        for dim in dims:
            at, matrix = _matrix(block.column("vector"), dim)
            groups.append((dim, block.column("query_id").take(pa.array(at)), matrix, [frozenset(r or ()) for r in block.column("roles").take(pa.array(at)).to_pylist()]))
        for batch in batches:
            for dim, query_ids, matrix, roles in groups:
                rows, vectors = _matrix(batch.column(1), dim)
                if not len(rows) or not len(matrix):
                    continue
                ids = batch.column(0).take(pa.array(rows))
                order = np.argsort(np.array(ids.to_pylist(), object if pa.types.is_string(ids.type) else None), kind="stable")
                rank_of = np.empty(len(rows), np.int64)
                rank_of[order] = np.arange(len(rows))
                tags = [frozenset(t or ()) for t in batch.column(2).take(pa.array(rows)).to_pylist()] if by_tags else []
                step = max(1, BLOCK_CELLS // len(rows))
                for low in range(0, len(matrix), step):
                    some = slice(low, low + step)
                    scores = matrix[some] @ vectors.T
                    scores = np.copysign(np.floor(np.abs(scores) * 10.0**digits + 0.5) / 10.0**digits, scores) + 0.0
                    if by_tags:
                        seen = {(t, r): not t or bool(t & r) for t in set(tags) for r in set(roles[some])}
                        scores = np.where(np.array([[seen[t, r] for t in tags] for r in roles[some]]), scores, -np.inf)
                    picked_q, picked_v = [], []
                    for q, row in enumerate(scores):
                        near = np.arange(len(row))
                        if len(row) > k:
                            near = np.flatnonzero(row >= np.partition(row, -k)[-k])
                        near = near[np.lexsort((rank_of[near], -row[near]))][:k]
                        near = near[row[near] > -np.inf]
                        picked_q.append(np.full(len(near), q))
                        picked_v.append(near)
                    q, v = np.concatenate(picked_q), np.concatenate(picked_v)
                    query = query_ids.take(pa.array(q + low))
                    yield pa.RecordBatch.from_arrays([query.combine_chunks() if isinstance(query, pa.ChunkedArray) else query, ids.take(pa.array(v)), pa.array(scores[q, v])], names=["query_id", "chunk_id", "score"])

    return search


def rrf(rankings: DataFrame, *, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of (query_id, side, rank, chunk_id, score): sum of 1 / (k + rank).

    Keeps each side's best score, null where a side lacks the chunk.
    """
    sides = [F.max(F.when(F.col("side") == s, F.col("score"))).alias(f"{s}_score") for s in ("dense", "sparse")]
    return rankings.groupBy("query_id", "chunk_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("rrf"), *sides)


def min_max(score: Column, partition: str = "query_id") -> Column:
    """Scores scaled to 0..1 over a query's rows; where all are equal, 0 if they are 0, else 1."""
    w = Window.partitionBy(partition)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high - low < 1e-12, F.when(high == 0.0, 0.0).otherwise(1.0)).otherwise((score - low) / (high - low))


def hybrid(dense: DataFrame, sparse: DataFrame, *, depth: int = 20, k: int = 60) -> DataFrame:
    """(query_id, chunk_id, rank, score, rrf): fused order, with the mean of the normalised sides as score.

    The order stays that of the fusion, so the first row need not have the highest score. A query without
    any sparse row keeps its dense scores.
    """
    both = dense.select("query_id", F.lit("dense").alias("side"), "rank", "chunk_id", "score").unionByName(sparse.select("query_id", F.lit("sparse").alias("side"), "rank", "chunk_id", "score"))
    fused = rrf(both, k=k)
    filled = [F.coalesce(F.col(f"{s}_score"), F.lit(0.0)) for s in ("dense", "sparse")]
    mixed = 0.5 * min_max(filled[0]) + 0.5 * min_max(filled[1])
    lone = F.count("sparse_score").over(Window.partitionBy("query_id")) == 0
    fused = fused.withColumn("score", F.when(lone, F.col("dense_score")).otherwise(mixed))
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf"), "chunk_id")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= depth).select("query_id", "chunk_id", "rank", "score", "rrf")


def cap_per_document(ranking: DataFrame, *, per_document: int = 2, k: int = 5, document_col: str = "document_id") -> DataFrame:
    """The first k rows in rank order with at most ``per_document`` of a document; <= 0 means no cap. Ranks are renewed."""
    if k <= 0:
        return ranking.limit(0)
    out = ranking
    if per_document > 0:
        own = Window.partitionBy("query_id", document_col).orderBy("rank")
        out = out.withColumn("_of", F.row_number().over(own)).where(F.col("_of") <= per_document).drop("_of")
    order = Window.partitionBy("query_id").orderBy("rank")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rerank(ranking: DataFrame, scorer, *, per_document: int = 2, k: int = 5, document_col: str = "document_id") -> DataFrame:
    """Order the pool by ``scorer(ranking) -> Column`` (null keeps the old score), then cap."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    scored = ranking.withColumn("score", F.coalesce(scorer(ranking), F.col("score"))).withColumn("rank", F.row_number().over(order))
    return cap_per_document(scored, per_document=per_document, k=k, document_col=document_col)


def confident(ranking: DataFrame, threshold: float = 0.15) -> DataFrame:
    """Rows at or above the threshold of queries whose best score reaches it; other queries abstain."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    return ranking.withColumn("_best", best).where((F.col("_best") >= threshold) & (F.col("score") >= threshold)).drop("_best")


def contradictions(ranking: DataFrame, vectors: DataFrame, *, least: float = 0.75) -> DataFrame:
    """Pairs of a query's retrieved chunks with cosine of at least ``least``: candidates for a judge.

    The pairs are of one query's few retrieved rows, in rank order.
    """
    held = ranking.select("query_id", "rank", "chunk_id").join(vectors.select("chunk_id", "vector"), "chunk_id")
    a = held.select("query_id", F.col("rank").alias("rank_a"), F.col("chunk_id").alias("a"), F.col("vector").alias("va"))
    b = held.select("query_id", F.col("rank").alias("rank_b"), F.col("chunk_id").alias("b"), F.col("vector").alias("vb"))
    pairs = a.join(b, "query_id").where("rank_a < rank_b").withColumn("cosine", F.round(dot(F.col("va"), F.col("vb")), 5))
    return pairs.where(F.col("cosine") >= least).select("query_id", "a", "b", "cosine")


def strategy_of(retrieval: str, chunks: DataFrame, queries: DataFrame) -> str:
    """auto means hybrid where chunks and queries have a vector, else sparse; a named strategy never changes."""
    if retrieval not in ("auto", "dense", "sparse", "hybrid"):
        raise ValueError(f"unknown retrieval {retrieval!r}")
    if retrieval != "auto":
        return retrieval
    return "hybrid" if "vector" in chunks.columns and "vector" in queries.columns else "sparse"


def label(strategy: str, reranked: bool) -> str:
    return strategy + "+rerank" * reranked


def after_cut(pool: DataFrame, chunks: DataFrame, queries: DataFrame, as_of: Column | None) -> DataFrame:
    """``pool`` with document_id, without rows that are not fresh at ``as_of`` or not of the query's doc_type (null: any)."""
    held = [c for c in ("obsolete", "effective_date", "expiry_date") if c in chunks.columns]
    kind = "doc_type" in queries.columns and "doc_type" in chunks.columns
    out = pool.join(chunks.select("chunk_id", "document_id", *held, *(["doc_type"] if kind else [])), "chunk_id")
    if as_of is not None:
        column = lambda c, t: F.col(c).cast(t) if c in held else F.lit(None).cast(t)
        out = out.where(fresh(column("obsolete", "boolean"), column("effective_date", "date"), column("expiry_date", "date"), as_of))
    if kind:
        wanted = queries.select("query_id", F.col("doc_type").alias("_wanted"))
        out = out.join(small(wanted), "query_id").where(F.col("_wanted").isNull() | (F.col("_wanted") == F.col("doc_type"))).drop("_wanted", "doc_type")
    return out.drop(*held)


def ranked(chunks: DataFrame, queries: DataFrame, *, retrieval: str = "auto", k: int = 5, depth: int = 20, per_document: int = 2, as_of: Column | None = None, scorer=None, question_col: str = "question", digits: int = 6) -> DataFrame:
    """(query_id, chunk_id, document_id, rank, score): what each query retrieves, by one of the strategies.

    chunks: chunk_id, document_id, text and optionally vector, access_tags, doc_type, obsolete,
    effective_date, expiry_date; queries: query_id, the question and optionally vector, roles, doc_type.
    Access rules hold below every cut, also without roles; the freshness and type filters act behind it.
    dense is the plain top k; sparse is BM25, scaled, reranked, capped; hybrid fuses both at ``depth``.
    """
    name, depth = strategy_of(retrieval, chunks, queries), max(depth, k)
    guarded = "access_tags" in chunks.columns
    asked = queries if "roles" in queries.columns else queries.withColumn("roles", F.array().cast("array<string>"))

    def dense(n: int) -> DataFrame:
        vectors = chunks.select("chunk_id", "vector", *([F.col("access_tags").alias("tags")] if guarded else []))
        return after_cut(dense_top_k(vectors, asked, n, digits=digits), chunks, queries, as_of)

    if name == "dense":
        return dense(k).select("query_id", "chunk_id", "document_id", "rank", "score")
    scores = bm25_scores(chunks, asked, question_col=question_col, **({"tags_col": "access_tags", "roles_col": "roles"} if guarded else {}))
    sparse = after_cut(top_k(scores, depth, digits=digits), chunks, queries, as_of)
    if name == "hybrid":
        pool = hybrid(dense(depth), sparse, depth=depth).join(chunks.select("chunk_id", "document_id"), "chunk_id")
    else:
        pool = sparse.withColumn("score", min_max(F.col("score")))
    if scorer is not None:
        out = rerank(pool, scorer, per_document=per_document, k=k)
    else:
        out = cap_per_document(pool, per_document=per_document, k=k)
    return out.select("query_id", "chunk_id", "document_id", "rank", "score")
