"""Queries over model answers, templates, flat blocks and chunk search."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import answers as A
from tessella.operators import enrich as E
from tessella.operators import search as S
from tessella.registry import query
from tessella.sources.tables import load, spread


def _answers(spark, d):
    """Answers about orders: broken, fenced with faults, whole with faults, without confidences, and a list."""
    k = F.col("o_orderkey").cast("string")
    text = (
        F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("no json for "), k))
        .when(F.col("o_orderkey") % 5 == 1, F.concat(F.lit('Here:\n```json\n{"persons": [{"name": " Ann  '), k, F.lit('", "role": "lead", "confidence": 0.9}, {"name": " ", "confidence": 0.9}, {"role": "x"}], "topics": "none"}\n```')))
        .when(F.col("o_orderkey") % 5 == 2, F.concat(F.lit('{"decisions": [{"what": "ship '), k, F.lit('", "by": "Bob", "confidence": 0.5}, {"what": "Stop '), k, F.lit('", "by": "Bob", "date": "2024-01-02", "confidence": 0.95}, {"what": "odd", "confidence": 7}], "goals": ["x"]}')))
        .when(F.col("o_orderkey") % 5 == 3, F.concat(F.lit('{"open_questions": [{"text": "why '), k, F.lit('?"}], "risks": [{"description": "late '), k, F.lit('", "severity": "high"}]}')))
        .otherwise("[1, 2]")
    )
    return load(spark, d, "orders").select("o_orderkey", text.alias("text"))


@query("""SELECT o_orderkey, 'persons' AS list, 0 AS position, 'person' AS kind, 'Ann  ' || o_orderkey AS name, 'ann ' || o_orderkey AS normalized, 0.9::DOUBLE AS confidence, 'role=lead' AS details FROM orders WHERE o_orderkey % 5 = 1
 UNION ALL SELECT o_orderkey, 'decisions', 1, 'decision', 'Stop ' || o_orderkey, 'stop ' || o_orderkey, 0.95::DOUBLE, 'by=Bob,date=2024-01-02' FROM orders WHERE o_orderkey % 5 = 2
 UNION ALL SELECT o_orderkey, 'risks', 0, 'risk', 'late ' || o_orderkey, 'late ' || o_orderkey, 0.8::DOUBLE, 'severity=high' FROM orders WHERE o_orderkey % 5 = 3""")
def typed_entities(spark, d):
    """Entities of answers by their lists, of a confidence of 0.75 or more."""
    found = A.typed_entities(_answers(spark, d), "o_orderkey", "text")[0]
    return found.withColumn("details", F.array_join(F.transform(F.array_sort(F.map_entries("details")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","))


@query("""SELECT o_orderkey, NULL AS list, -1 AS position, CASE o_orderkey % 5 WHEN 0 THEN 'no JSON' ELSE 'no object' END AS reason FROM orders WHERE o_orderkey % 5 IN (0, 4)
 UNION ALL SELECT o_orderkey, 'persons', 2, 'without a name' FROM orders WHERE o_orderkey % 5 = 1 UNION ALL SELECT o_orderkey, 'topics', -1, 'no list' FROM orders WHERE o_orderkey % 5 = 1
 UNION ALL SELECT o_orderkey, 'decisions', 2, 'confidence' FROM orders WHERE o_orderkey % 5 = 2 UNION ALL SELECT o_orderkey, 'goals', 0, 'no object' FROM orders WHERE o_orderkey % 5 = 2""")
def refused_answers(spark, d):
    """What of the answers is refused, with the reason."""
    return A.typed_entities(_answers(spark, d), "o_orderkey", "text")[1]


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 7 > 0 THEN 'Order ' || o_orderkey || ' of customer ' || o_custkey || ': ' || CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority ELSE '' END || '. {{ note }}' END AS prompt,
 CASE WHEN o_custkey % 7 = 0 THEN 'customer' END AS missing FROM orders""")
def rendered_prompts(spark, d):
    """A template filled from orders; without a customer there is no text but the name of what is missing."""
    values = {"key": F.col("o_orderkey"), "customer": F.when(F.col("o_custkey") % 7 > 0, F.col("o_custkey")), "priority": F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")), "shown": F.lit("{{ note }}")}
    text, missing = A.rendered("Order {{key}} of customer {{ customer }}: {{ priority }}{{ absent }}. {{ shown }}", values, ("key", "customer"))
    return load(spark, d, "orders").select("o_orderkey", text.alias("prompt"), missing.alias("missing"))


_BLOCKS = "b AS (SELECT 'b' || p_partkey AS block, CASE WHEN p_partkey < 40 THEN 'p' || (p_partkey % 5) ELSE 'b' || (p_partkey // 3) END AS parent, p_partkey // 100 AS page_no, (p_partkey * 7) % 100 AS position, p_brand FROM part)"


@query(f"""WITH RECURSIVE {_BLOCKS}, t AS (SELECT b.parent AS page, 0 AS depth, '/' || lpad(page_no::VARCHAR, 8, '0') || '.' || lpad(position::VARCHAR, 8, '0') AS path, block FROM b WHERE parent LIKE 'p%'
 UNION ALL SELECT t.page, t.depth + 1, t.path || '/' || lpad(b.page_no::VARCHAR, 8, '0') || '.' || lpad(b.position::VARCHAR, 8, '0'), b.block FROM t JOIN b ON b.parent = t.block WHERE t.depth < 4)
 SELECT page, depth, path, block FROM t""")
def block_paths(spark, d):
    """Parts as flat blocks whose parents are other blocks or five pages, put in order by paths down to the fifth level."""
    k = F.col("p_partkey")
    parent = F.when(k < 40, F.concat(F.lit("p"), (k % 5).cast("string"))).otherwise(F.concat(F.lit("b"), F.expr("p_partkey div 3").cast("string")))
    blocks = load(spark, d, "part").select(F.concat(F.lit("b"), k.cast("string")).alias("block"), parent.alias("parent"), F.expr("p_partkey div 100").alias("page_no"), (k * 7 % 100).alias("position"))
    pages = blocks.where("parent LIKE 'p%'").select(F.col("parent").alias("page")).distinct()
    return A.block_paths(blocks, pages).select("page", "depth", "path", "block")


_CHUNKS = "(SELECT doc_id * 1000000 + i AS doc_id, substr(text, 200 * i + 1, 200) || ' ' || substr(text, 1, 40) AS text FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 199) // 200)) AS i FROM documents WHERE source = 'src1'))"
_CHUNK_WORDS = rf"(SELECT doc_id, list_filter(string_split(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'), ' '), lambda w: w <> '') AS w FROM {_CHUNKS})"


def _chunk_sql() -> str:
    from tessella.queries import _COVERS

    covers = _COVERS.format(words=_CHUNK_WORDS, terms="['the', 'and']")
    return f"""WITH {covers}, s AS (SELECT doc_id AS chunk_id, round(sum(0.1::DOUBLE / (1 + (stop - start + 1 - inside))), 6) AS score FROM o GROUP BY doc_id)
 SELECT chunk_id % 1000000 AS chunk_index, d.doc_id, substr(d.text, 1, 40) AS title, d.lang, score FROM s JOIN documents d ON d.doc_id = chunk_id // 1000000 ORDER BY score DESC, d.doc_id, chunk_index LIMIT 50"""


_ASKED = {"q1": "the and", "q2": "with", "q3": "and with"}


def _evaluated_sql() -> str:
    from tessella.queries import _COVERS, _WORDS

    def run(qid: str, terms: list[str]) -> str:
        covers = _COVERS.format(words=f"({_WORDS})", terms=terms)
        return f"(SELECT '{qid}' AS qid, doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS pos FROM (SELECT * FROM (WITH {covers} SELECT doc_id, round(sum(0.1::DOUBLE / (1 + (stop - start + 1 - inside))), 6) AS score FROM o GROUP BY doc_id) ORDER BY score DESC, doc_id LIMIT 50))"

    runs = " UNION ALL ".join(run(q, t.split()) for q, t in _ASKED.items())
    return f"""WITH run AS (SELECT * FROM ({runs})), rel AS (SELECT q.qid, doc_id, quality + 1 AS grade FROM labels, (SELECT unnest(['q1', 'q2', 'q3']) AS qid) q WHERE quality = 1),
 hit AS (SELECT run.qid, run.pos, (rel.doc_id IS NOT NULL)::INT AS r FROM run LEFT JOIN rel USING (qid, doc_id)), n AS (SELECT qid, count(*) AS n FROM rel GROUP BY qid)
 SELECT qid, round(coalesce(sum(r) FILTER (WHERE pos <= 10), 0) / 10.0::DOUBLE, 6) AS "precision", round(coalesce(1.0::DOUBLE / min(pos) FILTER (WHERE r = 1), 0), 6) AS rr, round(coalesce(sum(r) FILTER (WHERE pos <= 10), 0)::DOUBLE / any_value(n.n), 6) AS recall FROM hit JOIN n USING (qid) GROUP BY qid"""


@query(_evaluated_sql())
def evaluated_search(spark, d):
    """Keyword search measured over three queries, with documents of good quality as what is relevant to each."""
    docs = spread(load(spark, d, "documents"))
    qrels = load(spark, d, "labels").where("quality = 1").select("doc_id", (F.col("quality") + 1).alias("grade"), F.explode(F.array(*map(F.lit, _ASKED))).alias("qid"))
    return S.evaluated(lambda text: S.keyword_matches(docs, text), _ASKED, qrels).select("qid", "precision", "rr", "recall")


@query("""SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN ['project', 'risk'] WHEN 'MACHINERY' THEN ['topic'] ELSE ['person', 'project'] END AS priorities,
 CASE c_mktsegment WHEN 'BUILDING' THEN 1.5 WHEN 'MACHINERY' THEN 1.2 ELSE 1.0 END::DOUBLE AS boost FROM customer""")
def customer_profiles(spark, d):
    """Customers with the priorities and boost of their segment's profile; segments without one have the general profile."""
    table = [("general", ["person", "project"], 1.0), ("Building", ["project", "risk"], 1.5), ("machinery", ["topic"], 1.2)]
    profiles = spark.createDataFrame(table, "profile string, priorities array<string>, boost double")
    customers = load(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("profile"))
    return E.profiled(customers, "profile", profiles, "general").select("c_custkey", "priorities", "boost")


@query(_chunk_sql())
def keyword_chunks(spark, d):
    """The 50 best chunks of one owner (a source) by cover density over chunk and title, joined to their documents."""
    docs = load(spark, d, "documents").where("source = 'src1'").withColumn("title", F.substring("text", 1, 40))
    chunks = spread(docs).select("doc_id", "title", "text", F.explode(F.expr("sequence(0L, CAST((length(text) + 199) div 200 AS BIGINT) - 1)")).alias("chunk_index")).where("chunk_index >= 0 AND length(text) > 0")
    rows = chunks.select(F.struct("doc_id", "chunk_index").alias("key"), F.concat(F.expr("substring(text, CAST(200 * chunk_index + 1 AS INT), 200)"), F.lit(" "), F.col("title")).alias("body"))
    best = S.keyword_matches(rows, "the and", "key", "body").orderBy(F.desc("score"), "key").limit(S.MOST)
    return best.select("key.*", "score").join(docs.select("doc_id", "title", "lang"), "doc_id").select("chunk_index", "doc_id", "title", "lang", "score")
