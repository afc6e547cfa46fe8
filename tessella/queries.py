"""Registered queries over the supplied tables, each with the SQL that gives the same rows.

Roles: documents and embeddings are what is searched (vec_id is the document's id); orders are decisions, order lines are mentions of parts (entities)
in orders (contexts); events are usage and requests; labels are judgements. The tables have no tenants; customers and users stand for owners.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessella.functions import columns as C
from tessella.operators import analytics as A
from tessella.operators import chunking as K
from tessella.operators import graph as G
from tessella.operators import index as X
from tessella.operators import ingest as I
from tessella.operators import search as S
from tessella.operators import vectors as V
from tessella.plans import hybrid
from tessella.registry import ORACLES, QUERIES, query
from tessella.sources.tables import load, shared_dir, spread
from tessella.streaming import rates

TERMS = "The and: with"
AS_OF = "2024-02-01"


_VECTOR = "SELECT e.vec_id, round((1 + list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])) / 2, 6) AS certainty FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY certainty DESC, vec_id LIMIT {k}"
_WORDS = r"SELECT doc_id, list_filter(string_split(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', ' ', 'g'), ' '), lambda w: w <> '') AS w FROM documents"
_COVERS = """p AS (SELECT doc_id, i AS pos, w[i] AS term FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM {words} WHERE list_has_all(w, {terms})) WHERE w[i] IN (SELECT unnest({terms}))),
 l AS (SELECT doc_id, term, list(pos) AS at FROM p GROUP BY ALL), e AS (SELECT p.doc_id, p.pos, min(list_max(list_filter(l.at, lambda x: x <= p.pos))) AS start, count(list_max(list_filter(l.at, lambda x: x <= p.pos))) AS n FROM p JOIN l ON p.doc_id = l.doc_id GROUP BY p.doc_id, p.pos),
 c AS (SELECT doc_id, start, min(pos) AS stop FROM e WHERE n = len({terms}) GROUP BY doc_id, start), o AS (SELECT c.doc_id, start, stop, count(*) AS inside FROM c JOIN p ON p.doc_id = c.doc_id AND p.pos BETWEEN start AND stop GROUP BY ALL)"""
_KEYWORD = f"WITH {_COVERS.format(words='(' + _WORDS + ')', terms="['the', 'and', 'with']")} SELECT doc_id, round(sum(0.1::DOUBLE / (1 + (stop - start + 1 - inside))), 6) AS score FROM o GROUP BY doc_id"
_FUSED = f"""near AS ({_VECTOR.format(k=20)}), kw AS (SELECT * FROM ({_KEYWORD}) ORDER BY score DESC, doc_id LIMIT 20),
 s AS (SELECT vec_id AS doc_id, certainty, row_number() OVER (ORDER BY certainty DESC, vec_id) AS semantic_rank FROM near),
 k AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS keyword_rank FROM kw),
 fused AS (SELECT doc_id, semantic_rank, keyword_rank, certainty, round(coalesce(0.75 / (60 + semantic_rank), 0) + coalesce(0.25 / (60 + keyword_rank), 0), 9) AS rrf FROM s FULL JOIN k USING (doc_id))"""


def _hybrid(spark, d):
    e = load(spark, d, "embeddings")
    return X.index_of(spark, d), e, e.where("vec_id = 0")


@query(_VECTOR.format(k=10))
def vector_topk(spark, d):
    e = load(spark, d, "embeddings")
    return S.vector_topk(e, e.where("vec_id = 0"))


_NEAR = """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT q.vec_id AS query, e.vec_id, round((1 + list_cosine_similarity(e.v, q.v)) / 2, 6) AS certainty FROM e, e q WHERE q.vec_id % 50 = 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY certainty DESC, vec_id)::INT AS rank FROM s)"""


@query(f"{_NEAR} SELECT query, vec_id, rank, certainty FROM r WHERE rank <= 10")
def vector_neighbours(spark, d):
    """The ten nearest of all vectors for each whose id is divisible by 50, by one scan."""
    e = load(spark, d, "embeddings")
    return V.in_blocks(e.where("vec_id % 50 = 0"), lambda asked: V.neighbours(e, asked))


def _vector_index(spark, d):
    e = load(spark, d, "embeddings")
    return e, V.build(e, f"{shared_dir(spark)}/vector-cells-{uuid.uuid4().hex}")


@query("SELECT count(*) AS queries, 10 * count(*) AS wanted, TRUE AS enough FROM embeddings WHERE vec_id % 50 = 0")
def vector_index_recall(spark, d):
    """Whether an index of all vectors, with as many cells read as at most 200 other queries were found to need, gives 0.9 or more of what the scan gives
    for each id divisible by 50."""
    e, index = _vector_index(spark, d)
    probes = V.calibrated(index, e, e.where("vec_id % 50 = 25").orderBy("vec_id").limit(200))
    got = V.recall(V.in_blocks(e.where("vec_id % 50 = 0"), lambda asked: V.search(index, asked, probes=probes)), vector_neighbours(spark, d))
    return got.agg(F.count(F.lit(1)).alias("queries"), F.sum("wanted").cast("long").alias("wanted"), (F.sum("found") >= 0.9 * F.sum("wanted")).alias("enough"))


@query(f"SELECT term, count(*) AS docs, sum(n)::BIGINT AS occurrences FROM (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(w) AS term FROM ({_WORDS})) GROUP BY ALL) GROUP BY term ORDER BY docs DESC, term LIMIT 100")
def index_terms(spark, d):
    """The index built, where there is none yet, and the 100 terms that most documents hold."""
    return X.most_used(X.index_of(spark, d), 100)


@query(_KEYWORD)
def keyword_and_match(spark, d):
    return X.lookup(X.index_of(spark, d), TERMS)


@query(_KEYWORD)
def keyword_scan(spark, d):
    """The same without an index: one scan of all texts."""
    return S.keyword_matches(spread(load(spark, d, "documents")), TERMS)


@query(f"WITH {_FUSED} SELECT doc_id, semantic_rank, keyword_rank, rrf FROM fused")
def rrf_fusion(spark, d):
    return hybrid.fused(*_hybrid(spark, d), TERMS).select("doc_id", "semantic_rank", "keyword_rank", "rrf")


@query(f"""WITH {_FUSED}, x AS (SELECT *, certainty AS cos, CASE WHEN semantic_rank IS NULL THEN 0 WHEN doc_id % 30 = 0 THEN 1 ELSE 1 / (1 + exp(((doc_id % 30) - 7) / (7.0::DOUBLE / 3))) END AS fresh,
 min(rrf) OVER () AS lo, max(rrf) OVER () AS hi FROM fused)
 SELECT doc_id, semantic_rank, keyword_rank, round((0.6 * coalesce(cos, 0) + 0.3 * (rrf - lo) / (CASE WHEN hi = lo THEN 1 ELSE hi - lo END)) * (1 + 0.1 * fresh), 6) AS final FROM x ORDER BY final DESC, doc_id LIMIT 10""")
def rerank_recency(spark, d):
    return hybrid.search(*_hybrid(spark, d), TERMS)


_RUN = "run AS (SELECT source AS qid, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS pos FROM documents WHERE source <> 'src3'), judged AS (SELECT d.source AS qid, l.doc_id, l.quality * (1 + l.doc_id % 3) AS grade FROM labels l JOIN documents d USING (doc_id)), rel AS (SELECT * FROM judged WHERE grade > 0)"
_METRICS = f"""{_RUN}, q AS (SELECT DISTINCT qid FROM run UNION SELECT qid FROM judged), ideal AS (SELECT qid, count(*) AS n_rel, sum(CASE WHEN i <= 10 THEN (pow(2, grade) - 1) / log2(i + 1) END) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, doc_id) AS i FROM rel) GROUP BY qid),
 hit AS (SELECT r.qid, r.pos, rel.grade, (rel.grade IS NOT NULL)::INT AS r, sum((rel.grade IS NOT NULL)::INT) OVER (PARTITION BY r.qid ORDER BY r.pos) AS found FROM run r LEFT JOIN rel USING (qid, doc_id)),
 agg AS (SELECT qid, sum(CASE WHEN pos <= 10 AND r = 1 THEN (pow(2, grade) - 1) / log2(pos + 1) ELSE 0 END) AS dcg, min(CASE WHEN r = 1 THEN pos END) AS first, sum(CASE WHEN pos <= 10 THEN r ELSE 0 END) AS hits, sum(CASE WHEN r = 1 THEN found / pos ELSE 0 END) AS ap FROM hit GROUP BY qid),
 m AS (SELECT q.qid, round(coalesce(dcg / idcg, 0), 6) AS ndcg, round(coalesce(1.0::DOUBLE / first, 0), 6) AS rr, round(coalesce(hits / 10.0::DOUBLE, 0), 6) AS "precision", round(coalesce(hits::DOUBLE / n_rel, 0), 6) AS recall, round(coalesce(ap / n_rel, 0), 6) AS ap FROM q LEFT JOIN agg USING (qid) LEFT JOIN ideal USING (qid))"""


def _metrics(spark, d):
    """Sources stand for queries. Documents of src3 are judged but never returned, so that query scores 0."""
    docs = load(spark, d, "documents").select("doc_id", "source", "n_chars")
    run = S.positions(docs.where("source <> 'src3'").withColumnRenamed("source", "qid"), "qid", [F.desc("n_chars"), F.col("doc_id")])
    qrels = load(spark, d, "labels").join(docs, "doc_id").select(F.col("source").alias("qid"), "doc_id", (F.col("quality") * (1 + F.col("doc_id") % 3)).alias("grade"))
    return S.eval_metrics(run, qrels)


@query(f"WITH {_METRICS} SELECT * FROM m")
def eval_metrics_per_query(spark, d):
    return _metrics(spark, d)


@query(f"WITH {_METRICS}, long AS (UNPIVOT m ON ndcg, rr, \"precision\", recall, ap INTO NAME metric VALUE value) SELECT metric, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(coalesce(stddev_samp(value), 0), 6) AS sd FROM long GROUP BY metric")
def eval_report(spark, d):
    return S.eval_report(_metrics(spark, d))


@query("SELECT source, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY source")
def source_stats(spark, d):
    return load(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.sum("n_chars").alias("chars"))


@query("SELECT event_type, count(*) AS calls, round(sum(value), 4) AS total, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def usage_by_type(spark, d):
    return load(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("value"), 4).alias("total"), F.countDistinct("user_id").alias("users"))


@query("SELECT hour(ts)::INT AS hour, count(*) AS n FROM events GROUP BY 1")
def hour_histogram(spark, d):
    return A.hour_histogram(load(spark, d, "events"), "ts")


@query("WITH h AS (SELECT hour(ts)::INT AS hour, count(*) AS n FROM events GROUP BY 1), t AS (SELECT ((hour - o + 24) % 24)::INT AS s, n FROM h, (SELECT unnest([0, 1, 2]) AS o)), a AS (SELECT s, sum(n)::BIGINT AS n FROM t GROUP BY s) SELECT s AS start, ((s + 3) % 24)::INT AS \"end\", n FROM a ORDER BY n DESC, s LIMIT 1")
def peak_window_circular(spark, d):
    return A.peak_hours(A.hour_histogram(load(spark, d, "events"), "ts"))


@query("SELECT l_partkey, count(*) AS mentions FROM lineitem GROUP BY 1 HAVING count(*) >= 3 ORDER BY mentions DESC, l_partkey LIMIT 10")
def top_themes_having(spark, d):
    return load(spark, d, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("mentions")).where("mentions >= 3").orderBy(F.desc("mentions"), "l_partkey").limit(10)


@query("SELECT source, count(*) FILTER (WHERE quality = 1) AS positive, count(*) FILTER (WHERE quality = 0) AS negative, count(*) FILTER (WHERE toxic = 1) AS toxic FROM labels JOIN documents USING (doc_id) GROUP BY source")
def feedback_filter_counts(spark, d):
    return load(spark, d, "labels").join(load(spark, d, "documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("positive"), F.count_if(F.col("quality") == 0).alias("negative"), F.count_if(F.col("toxic") == 1).alias("toxic"))


@query("SELECT o_custkey, o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def latest_per_type(spark, d):
    return A.latest_per(load(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_orderdate"), ["o_custkey", "o_orderpriority"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).drop("o_orderdate")


@query("SELECT doc_id, source, n_chars, (SELECT count(*) FROM documents WHERE lang = 'en') AS total, (SELECT count(*) FROM documents WHERE lang = 'en') > 70 AS has_more FROM documents WHERE lang = 'en' ORDER BY n_chars DESC, doc_id LIMIT 50 OFFSET 20")
def page_with_total(spark, d):
    return A.page(load(spark, d, "documents").where("lang = 'en'").select("doc_id", "source", "n_chars"), [F.desc("n_chars"), F.col("doc_id")], 20, 80)


@query("SELECT o_orderkey, o_orderpriority, due FROM (SELECT *, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderdate END AS due, CASE WHEN o_orderpriority LIKE '1%' THEN 0 WHEN o_orderpriority LIKE '2%' THEN 1 ELSE 2 END AS p FROM orders) ORDER BY p, due NULLS LAST, o_orderkey LIMIT 50")
def nulls_last_priority_sort(spark, d):
    o = load(spark, d, "orders").withColumn("due", F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate")))
    p = F.when(F.col("o_orderpriority").startswith("1"), 0).when(F.col("o_orderpriority").startswith("2"), 1).otherwise(2)
    return o.orderBy(p, F.asc_nulls_last("due"), "o_orderkey").limit(50).select("o_orderkey", "o_orderpriority", "due")


@query("SELECT p_partkey, p_name FROM part WHERE starts_with(lower(p_name), 're') ORDER BY p_name, p_partkey LIMIT 20")
def prefix_autocomplete(spark, d):
    return load(spark, d, "part").where(F.lower("p_name").startswith("re")).orderBy("p_name", "p_partkey").limit(20).select("p_partkey", "p_name")


@query("SELECT doc_id, source, left(text, 100) AS preview FROM documents WHERE text ILIKE '%tion th%' ORDER BY doc_id LIMIT 50")
def ilike_title_search(spark, d):
    return load(spark, d, "documents").where(F.ilike(F.col("text"), F.lit("%tion th%"))).orderBy("doc_id").limit(50).select("doc_id", "source", F.substring("text", 1, 100).alias("preview"))


@query("SELECT conv_id, arg_min(text, turn) AS first_text, count(*) AS n FROM conversations GROUP BY conv_id")
def first_chunk_per_doc(spark, d):
    return load(spark, d, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("first_text"), F.count(F.lit(1)).alias("n"))


@query("SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_partkey <> 1 AND l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_partkey = 1) GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 10")
def co_mention_neighbours(spark, d):
    return G.neighbours_by_context(load(spark, d, "lineitem").select("l_orderkey", "l_partkey"), "l_orderkey", "l_partkey", 1)


_PAIRS = "SELECT l.l_suppkey AS a, r.l_suppkey AS b, count(*) AS n, count(DISTINCT l.l_orderkey) AS contexts, max(greatest(l.l_shipdate, r.l_shipdate)) AS last FROM lineitem l JOIN lineitem r ON l.l_orderkey = r.l_orderkey AND l.l_suppkey < r.l_suppkey GROUP BY 1, 2"


def _pairs(spark, d):
    return G.co_occurrences(load(spark, d, "lineitem"), "l_orderkey", "l_suppkey", "l_shipdate")


@query(_PAIRS)
def co_occurrence_pairs(spark, d):
    return _pairs(spark, d)


_WEIGHTS = f"SELECT a, b, n, round(least(greatest(0.3 * exp(-0.01 * date_diff('day', last::DATE, DATE '2002-01-01')) + 0.1 * (n - 1), 0), 1), 6) AS weight FROM ({_PAIRS})"


@query(f"SELECT * FROM ({_WEIGHTS}) WHERE weight >= 0.05")
def edge_weights(spark, d):
    return G.weighted(_pairs(spark, d), F.lit("2002-01-01").cast("date")).select("a", "b", "n", "weight")


@query(f"SELECT a, b, CASE WHEN a % 2 = 1 THEN 'KNOWS' ELSE 'RELATED_TO' END AS edge_type, n FROM ({_PAIRS}) WHERE a % 2 = b % 2 AND n >= CASE WHEN a % 2 = 1 THEN 2 ELSE 3 END")
def derived_edges(spark, d):
    """Suppliers with odd keys stand for persons, those with even keys for topics."""
    person = F.col("a") % 2 == 1
    return _pairs(spark, d).where((F.col("a") % 2 == F.col("b") % 2) & (F.col("n") >= F.when(person, 2).otherwise(3))).select("a", "b", F.when(person, "KNOWS").otherwise("RELATED_TO").alias("edge_type"), "n")


_CHAIN = "SELECT DISTINCT o_custkey AS a, o_custkey + 1 + o_orderkey % 3 AS b FROM orders WHERE o_orderkey % 2 = 0"


@query(f"""WITH RECURSIVE e AS ({_CHAIN}), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), w(node, hops) AS (SELECT (SELECT min(a) FROM e), 0 UNION SELECT u.b, w.hops + 1 FROM w JOIN u ON u.a = w.node WHERE w.hops < 3)
 SELECT node, min(hops)::INT AS hops FROM w GROUP BY node HAVING min(hops) > 0""")
def khop_neighbours(spark, d):
    """A sparse graph of customers: half of the orders link their customer to one of the next three."""
    o = load(spark, d, "orders").where("o_orderkey % 2 = 0")
    edges = o.select(F.col("o_custkey").alias("a"), (F.col("o_custkey") + 1 + F.col("o_orderkey") % 3).alias("b")).distinct()
    return G.k_hop(edges, edges.agg(F.min("a").alias("a")), 3)


@query(f"WITH top AS (SELECT l_suppkey FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, l_suppkey LIMIT 50) SELECT a, b, n FROM ({_PAIRS}) WHERE a IN (SELECT * FROM top) AND b IN (SELECT * FROM top)")
def induced_subgraph(spark, d):
    top = load(spark, d, "lineitem").groupBy("l_suppkey").count().orderBy(F.desc("count"), "l_suppkey").limit(50).select("l_suppkey")
    return G.induced(_pairs(spark, d), top).select("a", "b", "n")


@query("SELECT l_partkey, count(DISTINCT l_orderkey) AS contexts, min(l_shipdate) AS first_seen, max(l_shipdate) AS last_seen FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' - INTERVAL 30 DAY AND l_shipdate < TIMESTAMP '1998-01-01' GROUP BY 1 HAVING count(DISTINCT l_orderkey) >= 3")
def recurring_themes(spark, d):
    t = F.col("l_shipdate")
    seen = load(spark, d, "lineitem").where((t >= F.lit("1997-12-02").cast("timestamp")) & (t < F.lit("1998-01-01").cast("timestamp")))
    return seen.groupBy("l_partkey").agg(F.countDistinct("l_orderkey").alias("contexts"), F.min(t).alias("first_seen"), F.max(t).alias("last_seen")).where("contexts >= 3")


@query("SELECT w AS window_start, event_type, count(*) AS n, round(count(*) / 5.0::DOUBLE, 6) AS per_minute FROM (SELECT event_type, date_trunc('minute', ts) - INTERVAL (o) MINUTE AS w FROM events, (SELECT unnest([0, 1, 2, 3, 4]) AS o)) GROUP BY 1, 2")
def sliding_event_rate(spark, d):
    return rates.sliding_rate(load(spark, d, "events"), "ts", "event_type")


_BOUNDS = (1, 5, 10, 50, 100)


@query("SELECT event_type, le, count(*) FILTER (WHERE value <= le) AS n FROM events, (SELECT unnest([1.0, 5.0, 10.0, 50.0, 100.0])::DOUBLE AS le) GROUP BY 1, 2")
def bucket_histogram(spark, d):
    e = load(spark, d, "events").groupBy("event_type").agg(*(F.count_if(F.col("value") <= b).alias(str(b)) for b in _BOUNDS))
    return e.select("event_type", F.explode(F.array(*(F.struct(F.lit(float(b)).alias("le"), F.col(str(b)).alias("n")) for b in _BOUNDS))).alias("x")).select("event_type", "x.*")


@query("SELECT date_trunc('hour', ts) AS window_start, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) AS n, round(count(*) FILTER (WHERE event_type = 'error') / count(*)::DOUBLE, 6) AS ratio FROM events GROUP BY 1")
def error_ratio_window(spark, d):
    return rates.error_ratio(load(spark, d, "events"), "ts", F.col("event_type") == "error")


_SNAP = "SELECT event_type || ':' || user_id AS k, count(*) AS n FROM events WHERE ts {0} TIMESTAMP '2024-01-15' AND hour(ts) < 4 GROUP BY 1"


@query(f"SELECT * FROM (SELECT coalesce(o.k, n.k) AS k, o.n AS old, n.n AS new, CASE WHEN o.n IS NULL THEN 'added' WHEN n.n IS NULL THEN 'removed' WHEN o.n <> n.n THEN 'changed' END AS state, coalesce(n.n, 0) - coalesce(o.n, 0) AS delta FROM ({_SNAP.format('<')}) o FULL JOIN ({_SNAP.format('>=')}) n ON o.k = n.k) WHERE state IS NOT NULL")
def snapshot_diff(spark, d):
    e = load(spark, d, "events").where(F.hour("ts") < 4).withColumn("k", F.concat("event_type", F.lit(":"), "user_id"))
    cut, snap = F.lit("2024-01-15").cast("timestamp"), lambda df: df.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    return G.snapshot_diff(snap(e.where(F.col("ts") < cut)), snap(e.where(F.col("ts") >= cut)), "k", "n")


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 52")
def rolling_retention(spark, d):
    return A.latest_per(load(spark, d, "events").select("event_id", "user_id", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 52).select("event_id", "user_id")


@query(r"""SELECT * FROM (SELECT word, count(*) AS n, list_sort(list(DISTINCT p_brand)) AS sources FROM (SELECT trim(lower(w), '.,;:!?()[]{}"''') AS word, p_brand FROM (SELECT unnest(regexp_split_to_array(p_name, '\s+')) AS w, p_brand FROM part) WHERE length(w) > 2) WHERE word NOT IN ('the', 'and', 'for') GROUP BY word ORDER BY n DESC, word LIMIT 10) WHERE n >= 2""")
def title_word_topics(spark, d):
    return A.title_topics(load(spark, d, "part"), "p_name", "p_brand", ["the", "and", "for"])


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents WHERE doc_id % 3 = 0")
def content_hash_changed(spark, d):
    """Every third document is taken to have been stored with another text."""
    docs = load(spark, d, "documents").select("doc_id", "text")
    old = docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")))
    return I.changed(old, docs, "doc_id", "text").select("doc_id", "content_hash")


_KINDS = ["google_calendar", "google_docs", "notion", "obsidian", "zoom", "slack", "outlook_mail", "gmail"]


@query("SELECT doc_id, kind, DATE '2024-01-01' + CASE WHEN kind IN ('google_docs', 'notion', 'obsidian') THEN 730 WHEN kind = 'zoom' THEN 180 ELSE 365 END AS expires FROM (SELECT doc_id, ['google_calendar', 'google_docs', 'notion', 'obsidian', 'zoom', 'slack', 'outlook_mail', 'gmail'][(doc_id % 8 + 1)::INT] AS kind FROM documents)")
def expiry_by_source(spark, d):
    k = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("doc_id") % 8 + 1).cast("int"))
    return load(spark, d, "documents").select("doc_id", k.alias("kind")).withColumn("expires", F.date_add(F.lit("2024-01-01").cast("date"), C.retention_days(F.col("kind"))))


@query(r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<style[^>]*>.*?</style>', '', 'gsi'), '<script[^>]*>.*?</script>', '', 'gsi'), '<br\s*/?>|</(p|div|tr|li)>', E'\n', 'gi'), '<[^>]+>', '', 'g'), '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '\n{3,}', E'\n\n', 'g'), E' \n\t\r') AS text FROM pages""")
def html_strip(spark, d):
    """The pages use some of the entities that are decoded, which the SQL names."""
    return I.html_texts(spread(load(spark, d, "pages")), "page_id", "html")


@query(r"SELECT doc_id, (i - 1)::INT AS chunk_index, p[i] AS chunk FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, list_filter(list_transform(string_split(text, E'\n'), lambda x: trim(x)), lambda x: length(x) >= 1) AS p FROM documents))")
def paragraph_chunks(spark, d):
    """The texts have no blank lines; their lines are the paragraphs here."""
    return I.paragraphs(load(spark, d, "documents"), "doc_id", "text")


@query(r"SELECT DISTINCT doc_id, lower(e) AS email FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS e FROM documents)")
def rule_ner_emails(spark, d):
    return I.emails(load(spark, d, "documents"), "doc_id", "text")


@query(r"SELECT conv_id, string_agg(text, E'\n---\n' ORDER BY turn) AS thread, array_to_string(list_sort(list_distinct(list(role))), ',') AS speakers, count(*) AS n FROM conversations GROUP BY conv_id")
def thread_concat(spark, d):
    return I.threads(load(spark, d, "conversations"), "conv_id", "turn", "text")


@query("SELECT user_id, date_trunc('hour', ts) AS window_start, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def rate_window_violations(spark, d):
    return rates.over_limit(load(spark, d, "events"), "ts", "user_id", 1)


@query("SELECT event_id, n FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW) AS n FROM events) WHERE n > 1")
def cooldown_hits(spark, d):
    return load(spark, d, "events").select("event_id", A.within_seconds(None, "user_id", "ts", 3600).alias("n")).where("n > 1")


@query("SELECT doc_id, list_filter(['password', 'token', 'invoice'], lambda k: contains(lower(text), k)) AS matched FROM documents WHERE contains(lower(text), 'password') OR contains(lower(text), 'token') OR contains(lower(text), 'invoice')")
def keyword_trigger_matches(spark, d):
    keys = F.array(*map(F.lit, ("password", "token", "invoice")))
    low = load(spark, d, "documents").select("doc_id", F.lower("text").alias("t"))
    return low.select("doc_id", F.filter(keys, lambda k: F.contains(F.col("t"), k)).alias("matched")).where(F.size("matched") > 0)


@query("SELECT l_partkey, max(l_shipdate) AS last_seen FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 25) GROUP BY 1 HAVING max(l_shipdate) < TIMESTAMP '2001-01-01'")
def inactive_without_reminder(spark, d):
    """Parts over size 25 are taken to have a pending reminder."""
    seen = load(spark, d, "lineitem").groupBy("l_partkey").agg(F.max("l_shipdate").alias("last_seen"))
    pending = load(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"))
    return I.inactive(seen, "last_seen", F.lit("2001-01-31").cast("timestamp"), 30).join(pending, "l_partkey", "left_anti")


@query("SELECT doc_id, lang, CASE WHEN doc_id % 4 = 0 THEN 'pending' ELSE 'done' END AS status FROM documents WHERE doc_id % 5 <> 1 OR doc_id % 4 = 0")
def upsert_merge(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "lang")
    return I.upsert(docs.where("doc_id % 5 <> 1").withColumn("status", F.lit("done")), docs.where("doc_id % 4 = 0").withColumn("status", F.lit("pending")), ["doc_id"])


@query("SELECT source, doc_id, running_tokens FROM (SELECT source, doc_id, sum(n_chars // 4) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS running_tokens FROM documents) WHERE running_tokens <= 8000")
def budget_prefix_trim(spark, d):
    docs = load(spark, d, "documents").select("source", "doc_id", F.expr("n_chars div 4").alias("tokens"))
    return A.budget_prefix(docs, "source", "doc_id", "tokens", 8000).drop("tokens")


@query("SELECT user_id, ts::DATE AS day, count(*) AS calls, round(sum(value * CASE event_type WHEN 'purchase' THEN 15 WHEN 'click' THEN 3 ELSE 1 END / 1e6), 8) AS cost, greatest(0, 100 - count(*)) AS remaining FROM events GROUP BY 1, 2")
def llm_cost_rollup(spark, d):
    rate = F.when(F.col("event_type") == "purchase", 15).when(F.col("event_type") == "click", 3).otherwise(1)
    return load(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum(F.col("value") * rate / 1e6), 8).alias("cost")).withColumn("remaining", F.greatest(F.lit(0), 100 - F.col("calls")))


@query("SELECT o_orderpriority, round(avg(date_diff('second', o_orderdate, done) / 86400.0::DOUBLE), 6) AS days FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS done FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey GROUP BY 1")
def decision_latency(spark, d):
    done = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("done"))
    return load(spark, d, "orders").join(done, "o_orderkey").groupBy("o_orderpriority").agg(F.round(F.avg((F.unix_timestamp("done") - F.unix_timestamp("o_orderdate")) / 86400.0), 6).alias("days"))


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def status_histogram(spark, d):
    return load(spark, d, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_name, count(*) AS members, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name = 'EUROPE') GROUP BY n_name")
def organisation_members(spark, d):
    region = load(spark, d, "region").where("r_name = 'EUROPE'").select(F.col("r_regionkey").alias("n_regionkey"))
    nations = load(spark, d, "nation").join(region, "n_regionkey", "left_semi")
    return load(spark, d, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("members"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def count_per_owner(spark, d):
    return load(spark, d, "customer").join(load(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def tombstones(spark, d):
    return I.tombstones(load(spark, d, "documents"), load(spark, d, "labels"), "doc_id")


@query("WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS t FROM documents), c AS (SELECT doc_id, t, unnest(range(0, greatest(ceil((len(t) - 128) / 112.0)::BIGINT + 1, 1))) AS i FROM t) SELECT doc_id, i::INT AS chunk_index, len(t[i * 112 + 1 : i * 112 + 128])::INT AS n_tokens, md5(array_to_string(t[i * 112 + 1 : i * 112 + 128], ' ')) AS chunk_md5 FROM c")
def fixed_token_windows(spark, d):
    out = K.fixed_windows(load(spark, d, "documents"), "doc_id", "text", 128, 16)
    return out.select("doc_id", "chunk_index", "n_tokens", F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"))


@query("SELECT conv_id, turn, (i - 1)::INT AS position, s[i] AS sentence FROM (SELECT conv_id, turn, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(text, '[.!?\\n]'), lambda x: trim(x)), lambda x: length(x) >= 10) AS s FROM conversations))")
def sentence_split(spark, d):
    c = load(spark, d, "conversations").withColumn("k", F.struct("conv_id", "turn"))
    return K.sentences(c, "k", "text").select("k.conv_id", "k.turn", "position", "sentence")


@query("""WITH v AS (SELECT label, vec_id, embedding::DOUBLE[] AS e, lag(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings), s AS (SELECT label, vec_id, round(list_cosine_similarity(e, b), 6) AS similarity FROM v WHERE b IS NOT NULL),
 m AS (SELECT *, lag(similarity) OVER w AS l, lead(similarity) OVER w AS r, avg(similarity) OVER (PARTITION BY label) - coalesce(stddev_samp(similarity) OVER (PARTITION BY label), 0) AS t FROM s WINDOW w AS (PARTITION BY label ORDER BY vec_id)) SELECT label, vec_id, similarity FROM m WHERE similarity < l AND similarity < r AND similarity < t""")
def coherence_breaks(spark, d):
    return K.coherence_breaks(load(spark, d, "embeddings"), "label", "vec_id", "embedding")


@query("SELECT *, CASE WHEN previous = 0 THEN 'new' WHEN current = 0 THEN 'gone' WHEN current > previous THEN 'up' WHEN current < previous THEN 'down' ELSE 'steady' END AS direction FROM (SELECT user_id, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-15') AS previous, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-15') AS current FROM events GROUP BY 1)")
def theme_shifts(spark, d):
    return K.theme_shifts(load(spark, d, "events"), "user_id", "ts", F.lit("2024-01-15").cast("timestamp"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def pending_decisions(spark, d):
    """Open orders without a returned line: decisions that nothing supersedes."""
    done = load(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return load(spark, d, "orders").where("o_orderstatus = 'O'").join(done, "o_orderkey", "left_anti").select("o_orderkey", "o_custkey")


@query("""WITH c AS (SELECT event_type, b.le, b.lo, count(*) FILTER (WHERE value > coalesce(b.lo, -1) AND (b.le IS NULL OR value <= b.le)) AS n FROM events, (VALUES (0.0::DOUBLE, 1.0::DOUBLE), (1, 5), (5, 10), (10, 50), (50, 100), (100, 300), (300, NULL)) AS b(lo, le) GROUP BY ALL),
 w AS (SELECT *, sum(n) OVER (PARTITION BY event_type) AS total, sum(n) OVER (PARTITION BY event_type ORDER BY lo) - n AS below FROM c),
 x AS (SELECT event_type, unnest([0.5, 0.95, 0.9999])::DOUBLE AS q, lo, le, n, total, below FROM w)
 SELECT event_type, q, round(arg_min(CASE WHEN le IS NULL THEN 300 ELSE lo + (le - lo) * (q * total - below) / n END, lo), 6) AS value, any_value(total)::BIGINT AS n FROM x WHERE below + n >= q * total AND n > 0 GROUP BY event_type, q""")
def latency_quantiles(spark, d):
    """Interpolated within buckets, as from a histogram of fixed bounds; beyond the last bound, that bound."""
    return rates.bucket_quantiles(load(spark, d, "events"), "event_type", "value", (1.0, 5.0, 10.0, 50.0, 100.0, 300.0), (0.5, 0.95, 0.9999))


@query("SELECT event_type, arg_max(value, event_id) AS last_value, max(ts) AS last_ts FROM events GROUP BY 1")
def gauge_last_value(spark, d):
    return load(spark, d, "events").groupBy("event_type").agg(F.max_by("value", "event_id").alias("last_value"), F.max("ts").alias("last_ts"))


_PATHS = "SELECT CASE page_id % 3 WHEN 0 THEN '/api/v1' WHEN 1 THEN '/api/v2' ELSE '' END || regexp_replace(regexp_replace(url, '^https?://[^/]*', ''), '[?].*$', '') AS path FROM pages"


@query(f"SELECT CASE WHEN len(p) >= 3 AND p[1] = 'api' AND p[2] = 'v1' THEN p[3] ELSE 'other' END AS endpoint_group, count(*) AS n FROM (SELECT string_split(trim(path, '/'), '/') AS p FROM ({_PATHS})) GROUP BY 1")
def endpoint_groups(spark, d):
    """Paths of pages; a third of them is taken to lie below /api/v1, another below /api/v2."""
    below = F.when(F.col("page_id") % 3 == 0, "/api/v1").when(F.col("page_id") % 3 == 1, "/api/v2").otherwise("")
    path = F.concat(below, F.regexp_replace(F.regexp_replace("url", "^https?://[^/]*", ""), "[?].*$", ""))
    return load(spark, d, "pages").groupBy(C.endpoint_group(path).alias("endpoint_group")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey, coalesce(max(o_orderkey), 0) + 1 AS next_version FROM orders GROUP BY 1")
def next_version(spark, d):
    return load(spark, d, "orders").groupBy("o_custkey").agg((F.coalesce(F.max("o_orderkey"), F.lit(0)) + 1).alias("next_version"))


@query("SELECT l_partkey, count(*) AS mentions, min(l_shipdate) AS first_seen, max(l_shipdate) AS last_seen, count(*) FILTER (WHERE l_shipdate < TIMESTAMP '1996-01-01') = 0 AS is_new FROM lineitem GROUP BY 1")
def entity_upsert(spark, d):
    """Mentions before 1996 are taken to be stored, later ones to be found now."""
    m, cut = load(spark, d, "lineitem").select("l_partkey", "l_shipdate"), F.lit("1996-01-01").cast("timestamp")
    entities = lambda df: df.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("mentions"), F.min("l_shipdate").alias("first_seen"), F.max("l_shipdate").alias("last_seen"))
    return G.merged_entities(entities(m.where(F.col("l_shipdate") < cut)), entities(m.where(F.col("l_shipdate") >= cut)), "l_partkey")


@query("SELECT l_partkey, l_suppkey, count(*) AS n, max(l_shipdate) AS last FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 25) AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY 1, 2")
def edge_merge(spark, d):
    parts = load(spark, d, "part").where("p_size <= 25").select(F.col("p_partkey").alias("l_partkey"))
    suppliers = load(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return G.merged_edges(load(spark, d, "lineitem"), parts, suppliers, "l_partkey", "l_suppkey", "l_shipdate")


@query("SELECT event_type, round(count(*) / (30 / 7.0::DOUBLE), 1) AS per_week FROM events WHERE ts >= TIMESTAMP '2024-02-01' - INTERVAL 30 DAY AND ts < TIMESTAMP '2024-02-01' GROUP BY 1")
def weekly_load(spark, d):
    until = F.lit(AS_OF).cast("timestamp")
    seen = load(spark, d, "events").where((F.col("ts") >= until - F.expr("INTERVAL 30 DAYS")) & (F.col("ts") < until))
    return seen.groupBy("event_type").agg(F.round(F.count(F.lit(1)) / (30 / 7.0), 1).alias("per_week"))


from tessella.catalog import answers, contexts, entities, feeds, knowledge, operations, retrieval, texts  # noqa: E402, F401  they register their queries
