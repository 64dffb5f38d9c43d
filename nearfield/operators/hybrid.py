"""Hybrid search: a dense and a lexical ranking fused by reciprocal ranks or by weighted scores."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from nearfield.operators.bm25 import Bm25Index
from nearfield.operators.knn import METRICS, knn_join, literal

DEFAULT_K, DEFAULT_RRF_K, MOST_UNION = 400, 60, 100_000
NO_RANK = 2147483647


@dataclass(frozen=True)
class HybridQuery:
    """What to search for and how to fuse. Either branch is off without its query, or with a k of 0."""

    vector_query: Sequence[float] | None = None
    text_query: str | None = None
    fusion: str | None = "rrf"
    dense_weight: float = 1.0
    bm25_weight: float = 1.0
    alpha: float | None = None
    rrf_k: int | None = None
    dense_k: int | None = None
    bm25_k: int | None = None
    final_k: int | None = None
    require_bm25_match: bool = False

    def __post_init__(self) -> None:
        if self.vector_query is None and self.text_query is None:
            raise ValueError("hybrid_query requires vector_query or text_query")
        if (self.fusion or "rrf").lower() not in ("rrf", "weighted"):
            raise ValueError(f"fusion must be rrf or weighted, not {self.fusion}")
        for name in ("dense_weight", "bm25_weight"):
            w = getattr(self, name)
            if w is None or not math.isfinite(w) or w < 0:
                raise ValueError(f"{name} must be finite and not negative")
        if self.alpha is not None and not 0 <= self.alpha <= 1:
            raise ValueError("alpha must lie between 0 and 1")
        for name, least in (("rrf_k", 1), ("final_k", 1), ("dense_k", 0), ("bm25_k", 0)):
            k = getattr(self, name)
            if k is not None and k < least:
                raise ValueError(f"{name} must be at least {least}")
        if self.require_bm25_match is None:
            raise ValueError("require_bm25_match must not be null")

    def __str__(self) -> str:
        return f"hybrid_query(fusion={(self.fusion or 'rrf').lower()}, vector={self.vector_query is not None}, text={self.text_query is not None})"

    def budget(self, k: int | None, limit: int | None, auto: bool = True) -> int:
        """Candidates of a branch; a k that isn't given follows the limit."""
        if k is not None:
            return k
        return DEFAULT_K if limit is None or not auto else min(DEFAULT_K, max(32, 8 * limit))


def dense_distance(metric: str, vec: Column, query: Sequence[float]) -> Column:
    """The distance that the dense branch ranks by: squared for l2, on unit vectors for cosine."""
    return METRICS["l2_squared" if metric == "l2" else metric](vec, literal(query))


def hybrid_distance(vec: Column, query: HybridQuery, metric: str = "cosine") -> Column:
    """Distance of the dense part alone; a text query can't be scored row by row."""
    if query.vector_query is None or query.text_query is not None:
        raise ValueError("a text query needs hybrid_search()")
    return METRICS[metric](vec, literal(query.vector_query))


def ranked(rows: DataFrame, order: list[Column], k: int, score: Column, branch: str) -> DataFrame:
    """The first k rows with their rank and score; only those k reach the window's single task."""
    top = rows.withColumn("__s", score).orderBy(*order).limit(k)
    rank = F.row_number().over(Window.orderBy(*order)).cast("bigint")
    return top.select("id", rank.alias(f"{branch}_rank"), F.col("__s").alias(f"{branch}_score"))


def scaled_score(c: str, over: WindowSpec) -> Column:
    """A branch's score brought to 0 .. 1 over the candidates; 0 for those that the branch doesn't have."""
    low, high = F.min(c).over(over), F.max(c).over(over)
    flat = F.when(F.col(c) > 0, 1.0).otherwise(0.0)
    return F.coalesce(F.when(F.col(c).isNull(), 0.0).when(high > low, (F.col(c) - low) / (high - low)).otherwise(flat), F.lit(0.0))


def fuse(dense: DataFrame | None, lexical: DataFrame | None, query: HybridQuery) -> DataFrame:
    """(id, dense_rank, bm25_rank, dense_score, bm25_score, score) from (id, dense_rank, dense_score) and (id, bm25_rank, bm25_score)."""
    parts = []
    for df, mine, other in ((dense, "dense", "bm25"), (lexical, "bm25", "dense")):
        if df is not None:
            parts.append(df.select("id", f"{mine}_rank", f"{mine}_score", F.lit(None).cast("bigint").alias(f"{other}_rank"), F.lit(None).cast("double").alias(f"{other}_score")))
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    names = ["dense_rank", "bm25_rank", "dense_score", "bm25_score"]
    union = both.groupBy("id").agg(*[F.max(c).alias(c) for c in names])
    if query.require_bm25_match:
        union = union.where(F.col("bm25_rank").isNotNull())
    if (query.fusion or "rrf").lower() == "rrf":
        k = query.rrf_k or DEFAULT_RRF_K
        share = lambda w, r: F.coalesce(F.lit(float(w)) / (F.lit(float(k)) + F.col(r)), F.lit(0.0))
        score = share(query.dense_weight, "dense_rank") + share(query.bm25_weight, "bm25_rank")
    else:
        alpha = 0.5 if query.alpha is None else query.alpha
        whole = Window.partitionBy()
        score = F.lit(alpha) * scaled_score("dense_score", whole) + F.lit(1 - alpha) * scaled_score("bm25_score", whole)
    return union.select("id", *names, F.round(score, 9).alias("score"))


def fused_order() -> list[Column]:
    """Best score; then both branches before one, the dense rank, the lexical rank, the id."""
    rank = lambda c: F.coalesce(F.col(c), F.lit(NO_RANK))
    both = F.when(F.col("dense_rank").isNotNull() & F.col("bm25_rank").isNotNull(), 0).otherwise(1)
    return [F.col("score").desc(), both, rank("dense_rank"), rank("bm25_rank"), F.col("id")]


def hybrid_search(
    docs: DataFrame, query: HybridQuery, index: Bm25Index | None = None, limit: int | None = None, metric: str = "cosine", id_col: str = "doc_id", vec_col: str = "embedding", text_col: str = "text", quantized: bool = False, auto_budget: bool = True
) -> DataFrame:
    """(id, dense_rank, bm25_rank, dense_score, bm25_score, score), best first.

    Documents are those with a usable vector (not NULL, and not zero for cosine), in
    both branches. Without a text query the dense ranking is the result. The dense
    score is minus the distance.
    """
    usable = docs.where(F.col(vec_col).isNotNull() & F.exists(vec_col, lambda x: x != 0)) if metric == "cosine" else docs.where(F.col(vec_col).isNotNull())
    cut = min(x for x in (MOST_UNION, query.final_k, limit) if x is not None)
    dense = lexical = None
    dense_k, bm25_k = query.budget(query.dense_k, limit, auto_budget), query.budget(query.bm25_k, limit, auto_budget)
    if query.text_query is None:
        dense_k = limit or MOST_UNION
    if query.vector_query is not None and dense_k:
        rows = usable.select(F.col(id_col).alias("id"), F.round(dense_distance(metric, F.col(vec_col), query.vector_query), 9).alias("d"))
        dense = ranked(rows, [F.col("d").asc_nulls_last(), F.col("id")], dense_k, -F.col("d"), "dense")
    if query.text_query is not None and bm25_k:
        index = index or Bm25Index.of(usable, id_col, text_col, vec_col if metric == "cosine" else None)
        found = index.topk(query.text_query, bm25_k, quantized).withColumnRenamed("doc_id", "id")
        lexical = ranked(found, [F.col("score").desc(), F.col("id")], bm25_k, F.col("score"), "bm25")
    if query.text_query is None:
        out = dense.withColumns({"bm25_rank": F.lit(None).cast("bigint"), "bm25_score": F.lit(None).cast("double"), "score": F.col("dense_score")})
        return out.select("id", "dense_rank", "bm25_rank", "dense_score", "bm25_score", "score").orderBy("dense_rank").limit(min(limit or MOST_UNION, MOST_UNION))
    if dense is None and lexical is None:
        empty = usable.select(F.col(id_col).alias("id")).where("false")
        dense = empty.select("id", F.lit(0).cast("bigint").alias("dense_rank"), F.lit(0.0).alias("dense_score"))
    return fuse(dense, lexical, query).orderBy(*fused_order()).limit(cut)


def hybrid_search_many(
    docs: DataFrame, queries: DataFrame, k: int, index: Bm25Index | None = None, branch_k: int = DEFAULT_K, rrf_k: int = DEFAULT_RRF_K, metric: str = "cosine", query_id: str = "query_id", id_col: str = "doc_id", vec_col: str = "embedding", text_col: str = "text",
    fusion: str = "rrf", alpha: float = 0.5, require_bm25_match: bool = False,
) -> DataFrame:
    """(query_id, id, dense_rank, bm25_rank, score, rank) by reciprocal ranks or weighted scores, for many queries (query_id, query, terms) in one job."""
    usable = docs.where(F.col(vec_col).isNotNull() & F.exists(vec_col, lambda x: x != 0)) if metric == "cosine" else docs.where(F.col(vec_col).isNotNull())
    index = index or Bm25Index.of(usable, id_col, text_col)
    dense = knn_join(queries, usable, branch_k, metric, query_id, "query", id_col, vec_col)
    lexical = index.topk_many(queries, branch_k, query_id)
    none, no_score = F.lit(None).cast("bigint"), F.lit(None).cast("double")
    parts = dense.select(query_id, F.col(id_col).alias("id"), F.col("rank").alias("dense_rank"), none.alias("bm25_rank"), (-F.col("distance")).alias("dense_score"), no_score.alias("bm25_score"))
    parts = parts.unionByName(lexical.select(query_id, F.col("doc_id").alias("id"), none.alias("dense_rank"), F.col("rank").alias("bm25_rank"), no_score.alias("dense_score"), F.col("score").alias("bm25_score")))
    names = ["dense_rank", "bm25_rank", "dense_score", "bm25_score"]
    union = parts.groupBy(query_id, "id").agg(*[F.max(c).alias(c) for c in names])
    union = union.where(F.col("bm25_rank").isNotNull()) if require_bm25_match else union
    if fusion == "rrf":
        share = lambda r: F.coalesce(F.lit(1.0) / (F.lit(float(rrf_k)) + F.col(r)), F.lit(0.0))
        score = share("dense_rank") + share("bm25_rank")
    else:
        own = Window.partitionBy(query_id)
        score = F.lit(alpha) * scaled_score("dense_score", own) + F.lit(1 - alpha) * scaled_score("bm25_score", own)
    fused = union.withColumn("score", F.round(score, 9))
    rank = F.row_number().over(Window.partitionBy(query_id).orderBy(*fused_order()))
    return fused.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= k).drop("dense_score", "bm25_score")


def rrf_full_outer(dense: DataFrame, lexical: DataFrame, k: int = DEFAULT_RRF_K) -> DataFrame:
    """(id, score) by a full outer join of (id, dense_rank) and (id, bm25_rank); ties go by id."""
    both = dense.join(lexical, "id", "full_outer")
    score = F.coalesce(1.0 / (F.lit(k) + F.col("dense_rank")), F.lit(0.0)) + F.coalesce(1.0 / (F.lit(k) + F.col("bm25_rank")), F.lit(0.0))
    return both.select("id", F.round(score, 9).alias("score")).orderBy(F.col("score").desc(), "id")


def scan_stats(result: DataFrame) -> DataFrame:
    """(final, both, dense_only, bm25_only) counts of a hybrid result."""
    d, b = F.col("dense_rank").isNotNull(), F.col("bm25_rank").isNotNull()
    return result.agg(F.count("*").alias("final"), F.count_if(d & b).alias("both"), F.count_if(d & ~b).alias("dense_only"), F.count_if(~d & b).alias("bm25_only"))
