"""Hybrid search: vector and keyword candidates, fusion, reranking by recency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import index as X
from tessella.operators import search as S


def candidates(k: int) -> int:
    """Twice what is asked for, at most 50."""
    return min(2 * S.top_k(k), S.MOST)


def fused(index: X.Index, vectors: DataFrame, query: DataFrame, terms: str, k: int = 10) -> DataFrame:
    """(doc_id, semantic_rank, keyword_rank, certainty, rrf); vec_id is the document's id."""
    near = S.vector_topk(vectors, query, candidates(k)).select(F.col("vec_id").alias("doc_id"), "certainty")
    words = X.lookup(index, terms).orderBy(F.desc("score"), "doc_id").limit(candidates(k))
    s = S.ranked(near, "certainty", "doc_id", "rank")
    w = S.ranked(words, "score", "doc_id", "rank")
    return S.rrf(s.select("doc_id", "rank"), w.select("doc_id", "rank"), "doc_id").join(near, "doc_id", "left").withColumn("rrf", F.round("rrf", 9))


def search(index: X.Index, vectors: DataFrame, query: DataFrame, terms: str, k: int = 10) -> DataFrame:
    """Reranked hits. The tables have no document times: a document's age in days is taken to be doc_id modulo 30, and unknown for
    hits that only the keyword side has."""
    hits = fused(index, vectors, query, terms, k)
    aged = hits.withColumn("age", F.when(F.col("semantic_rank").isNotNull(), (F.col("doc_id") % 30).cast("double")))
    return S.rerank(aged, "doc_id", "certainty", "age", k).select("doc_id", "semantic_rank", "keyword_rank", "final")
