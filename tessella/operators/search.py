"""Vector and keyword retrieval, rank fusion, reranking, and measures of retrieval quality."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import columns as C

MOST, DEFAULT = 50, 10
RRF_K, SEMANTIC_WEIGHT, KEYWORD_WEIGHT = 60, 0.75, 0.25


def top_k(k: int | None) -> int:
    return min(k or DEFAULT, MOST)


def vector_topk(vectors: DataFrame, query: DataFrame, k: int | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k vectors nearest to the one row of `query`: (key, certainty), best first. One vector and its norm are broadcast, the rest is
    scanned once. Without a query row there are no hits."""
    q = F.broadcast(query.select(F.col(vector).alias("_q")).limit(1).select("_q", F.sqrt(C.dot(F.col("_q"), F.col("_q"))).alias("_n")))
    v = F.col(vector)
    norms = F.sqrt(C.dot(v, v)) * F.col("_n")
    cos = F.when(norms == 0, 0.0).otherwise(C.dot(v, F.col("_q")) / norms)
    return vectors.join(q, F.lit(True)).select(key, F.round((1 + cos) / 2, 6).alias("certainty")).orderBy(F.desc("certainty"), key).limit(top_k(k))


def terms_of(query: str) -> list[str]:
    """Terms of a query, all of which a hit must have: marks go, blanks and hyphens separate, case doesn't count."""
    return list(dict.fromkeys(re.findall(r"\w+", re.sub(r"[^\w\s\-]", "", query).lower())))


def cover_ranks(places: DataFrame, terms: list[str], key: str) -> DataFrame:
    """(key, score) of the documents that hold all terms, by cover density: each smallest stretch with all of them adds 0.1 / (1 + the number of other
    words in it). places: (key, term, pos), one row for each occurrence. One sweep along the occurrences of a document finds the stretches: at
    each, the latest occurrence of every term is known, and a new stretch ends where the earliest of these moves on."""
    along = Window.partitionBy(key).orderBy("pos")
    so_far = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = places.withColumn("n", F.row_number().over(along))
    latest = [F.last(F.when(F.col("term") == t, F.struct("pos", "n")), ignorenulls=True).over(so_far) for t in terms]
    rows = rows.select(key, "pos", "n", *(c.alias(f"_{i}") for i, c in enumerate(latest)))
    have_all = reduce(and_, (F.col(f"_{i}").isNotNull() for i in range(len(terms))))
    start = F.least(*(F.col(f"_{i}") for i in range(len(terms)))) if len(terms) > 1 else F.col("_0")
    rows = rows.withColumn("start", F.when(have_all, start)).withColumn("before", F.lag("start.pos").over(along))
    covers = rows.where(F.col("start").isNotNull() & (F.col("before").isNull() | (F.col("start.pos") > F.col("before"))))
    others = (F.col("pos") - F.col("start.pos")) - (F.col("n") - F.col("start.n"))
    return covers.groupBy(key).agg(F.round(F.sum(0.1 / (1 + others)), 6).alias("score"))


def keyword_matches(docs: DataFrame, query: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents that hold all terms: (key, score), by cover density. No terms, no rows. One scan; texts that lack a term as a plain substring are passed
    over before words are counted."""
    terms = terms_of(query)
    if not terms:
        return docs.select(key, F.lit(0.0).alias("score")).limit(0)
    low = docs.where(reduce(and_, (F.contains(F.lower(F.col(text)), F.lit(t)) for t in terms)))
    words = low.select(key, F.posexplode(C.words(F.col(text))).alias("pos", "term"))
    return cover_ranks(words.where(F.col("term").isin(terms)), terms, key)


def positions(run: DataFrame, by: str, order: list) -> DataFrame:
    """Each row's 1-based position in its list."""
    return run.withColumn("pos", F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def ranked(hits: DataFrame, score: str, key: str, name: str) -> DataFrame:
    """Ranks of a list that top-k has already made small."""
    return hits.withColumn(name, F.row_number().over(Window.orderBy(F.desc(score), key)))


def rrf(semantic: DataFrame, keyword: DataFrame, key: str) -> DataFrame:
    """Weighted reciprocal rank fusion of two ranked lists (key, rank); a list that lacks a key adds nothing."""
    s, k = semantic.withColumnRenamed("rank", "semantic_rank"), keyword.withColumnRenamed("rank", "keyword_rank")
    part = lambda w, r: F.coalesce(w / (RRF_K + F.col(r)), F.lit(0.0))
    return s.join(k, key, "full").withColumn("rrf", part(SEMANTIC_WEIGHT, "semantic_rank") + part(KEYWORD_WEIGHT, "keyword_rank"))


def rerank(fused: DataFrame, key: str, cos: str, age_days: str, k: int | None = None) -> DataFrame:
    everything = Window.partitionBy()
    out = fused.withColumn("final", C.reranked(F.col(cos), F.col("rrf"), F.min("rrf").over(everything), F.max("rrf").over(everything), C.recency(F.col(age_days))))
    return out.withColumn("final", F.round("final", 6)).orderBy(F.desc("final"), key).limit(top_k(k))


def eval_metrics(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """Per query: nDCG@k (gain 2^grade - 1), reciprocal rank, precision@k, recall@k and average precision. run: (qid, pos, doc_id) with
    positions from 1; qrels: (qid, doc_id, grade), of which grades above 0 are relevant. Judged queries without any hit, and queries without
    relevant documents, score 0. Lists are a query's hits, not a corpus: a query's rows are in one task."""
    rel = qrels.where("grade > 0")
    ideal = rel.withColumn("i", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("grade"), "doc_id")))
    gain = lambda g, p: (F.pow(F.lit(2.0), g) - 1) / F.log2(p + 1)
    per_q = ideal.groupBy("qid").agg(F.count(F.lit(1)).alias("n_rel"), F.sum(F.when(F.col("i") <= k, gain(F.col("grade"), F.col("i")))).alias("idcg"))
    hit = run.join(rel, ["qid", "doc_id"], "left").withColumn("r", F.col("grade").isNotNull().cast("int"))
    hit = hit.withColumn("found", F.sum("r").over(Window.partitionBy("qid").orderBy("pos")))
    top = F.col("pos") <= k
    agg = hit.groupBy("qid").agg(
        F.sum(F.when(top & (F.col("r") == 1), gain(F.col("grade"), F.col("pos"))).otherwise(0.0)).alias("dcg"),
        F.min(F.when(F.col("r") == 1, F.col("pos"))).alias("first"),
        F.sum(F.when(top, F.col("r")).otherwise(0)).alias("hits"),
        F.sum(F.when(F.col("r") == 1, F.col("found") / F.col("pos")).otherwise(0.0)).alias("ap"),
    )
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    asked = qrels.select("qid").unionByName(run.select("qid")).distinct()
    return asked.join(agg, "qid", "left").join(per_q, "qid", "left").select(
        "qid", zero(F.col("dcg") / F.col("idcg")).alias("ndcg"), zero(1 / F.col("first")).alias("rr"), zero(F.col("hits") / k).alias("precision"), zero(F.col("hits") / F.col("n_rel")).alias("recall"), zero(F.col("ap") / F.col("n_rel")).alias("ap")
    )


def eval_report(metrics: DataFrame, config: str | None = None) -> DataFrame:
    """Mean, median and sample deviation (0 for one query) of each measure; with `config`, for each value of that column, to compare runs."""
    keys = [config] if config else []
    names = [c for c in metrics.columns if c not in ("qid", *keys)]
    long = metrics.select("qid", *keys, F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in names))).alias("m")).select(*keys, "m.*")
    return long.groupBy(*keys, "metric").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.median("value"), 6).alias("median"), F.round(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), 6).alias("sd"))


def evaluated(search: Callable[[str], DataFrame], queries: dict[str, str], qrels: DataFrame, key: str = "doc_id", k: int = 10) -> DataFrame:
    """Measures of any search, a function from a query's text to (key, score), over a stated set of queries (qid: text): each query's best 50 hits against its judgements
    (qid, key, grade)."""
    runs = [ranked(search(text).orderBy(F.desc("score"), key).limit(MOST), "score", key, "pos").select(F.lit(qid).alias("qid"), F.col(key).alias("doc_id"), "pos") for qid, text in queries.items()]
    return eval_metrics(reduce(DataFrame.unionByName, runs), qrels.select("qid", F.col(key).alias("doc_id"), "grade"), k)
