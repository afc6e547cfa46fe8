"""Queries that bring names together and check what texts cite."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.catalog.notes import briefings
from tessella.functions import columns as C
from tessella.operators import ground as D
from tessella.operators import resolve as R
from tessella.registry import query
from tessella.sources.tables import load, pieces


@query("SELECT doc_id, trim(regexp_replace(strip_accents(replace(replace(replace(replace(lower(trim(left(text, 60))), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss')), '\\s+', ' ', 'g')) AS name FROM documents WHERE text IS NOT NULL")
def normal_names(spark, d):
    """The beginnings of texts in four languages as names."""
    return load(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", R.normalized(F.substring("text", 1, 60)).alias("name"))


def _people(spark, d):
    """Customers are stored as persons by nation; every third is found again with a letter doubled, every fifth as it was, every seventh with a prefix."""
    c, k = load(spark, d, "customer"), F.col("c_custkey")
    name = F.concat(F.lit("maria "), F.translate(F.lpad(k.cast("string"), 6, "0"), "0123456789", "bcdfghklmn"), F.lit(" nordstrom"))
    stored = c.select(F.col("c_nationkey").alias("owner"), F.lit("person").alias("kind"), name.alias("name"))
    found = F.when(k % 3 == 0, F.replace(name, F.lit("nordstrom"), F.lit("nordstroem"))).when(k % 5 == 0, name).when(k % 7 == 0, F.concat(F.lit("prof anna "), name))
    return stored, c.select("c_custkey", F.col("c_nationkey").alias("owner"), F.lit("person").alias("kind"), found.alias("name")).where(F.col("name").isNotNull())


@query()
def near_names(spark, d):
    """Names found again, with the nearest stored one of the same owner; tests compare the search with all pairs."""
    stored, found = _people(spark, d)
    return R.near_names(found, stored, ["owner", "kind"])


@query("""WITH s AS (SELECT l_suppkey % 50 AS owner, 'topic' AS kind, 'part ' || l_partkey AS name, count(*) AS mentions, min(l_shipdate) AS first_seen, max(l_shipdate) AS last_seen FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01' GROUP BY ALL),
 f AS (SELECT l_suppkey % 50 AS owner, 'topic' AS kind, 'part ' || l_partkey AS name, count(*) AS mentions, min(l_shipdate) AS first_seen, max(l_shipdate) AS last_seen FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' GROUP BY ALL)
 SELECT coalesce(s.owner, f.owner) AS owner, coalesce(s.kind, f.kind) AS kind, coalesce(s.name, f.name) AS name, coalesce(s.mentions, 0) + coalesce(f.mentions, 0) AS mentions, least(s.first_seen, f.first_seen) AS first_seen, greatest(s.last_seen, f.last_seen) AS last_seen, s.owner IS NULL AS is_new FROM s FULL JOIN f USING (owner, kind, name)""")
def resolved_entities(spark, d):
    """Topics named in order lines: those before 1997 are stored, later ones found, under other case and blanks."""
    return _resolved(spark, d)[0]


@query("SELECT l_suppkey % 50 AS owner, 'topic' AS kind, 'part ' || l_partkey AS name, l_orderkey AS chunk, max(CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0.85 END)::DOUBLE AS confidence FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' GROUP BY ALL")
def resolved_mentions(spark, d):
    """Mentions of the found ones, each entity once a chunk, with the best confidence."""
    return _resolved(spark, d)[1].drop("rule")


def _resolved(spark, d):
    line, cut = load(spark, d, "lineitem").withColumn("owner", F.col("l_suppkey") % 50), F.lit("1997-01-01").cast("timestamp")
    name = F.concat(F.lit("part "), F.col("l_partkey").cast("string"))
    old = line.where(F.col("l_shipdate") < cut).repartition(pieces(line), "owner", "l_partkey").groupBy("owner", "l_partkey", F.lit("topic").alias("kind")).agg(F.count(F.lit(1)).alias("mentions"), F.min("l_shipdate").alias("first_seen"), F.max("l_shipdate").alias("last_seen")).withColumn("name", name)
    said = F.concat(F.lit(" PART   "), F.col("l_partkey").cast("string"))
    new = line.where(F.col("l_shipdate") >= cut).select("owner", F.col("l_orderkey").alias("chunk"), F.lit("topic").alias("kind"), said.alias("name"), F.when(F.col("l_quantity") > 25, 1.0).otherwise(0.85).alias("confidence"), F.lit("rule").alias("rule"), F.col("l_shipdate").alias("at"))
    return R.resolve(new, old, "owner")


@query("""WITH d AS (SELECT p_partkey AS doc, lower(trim(p_name || ' ' || p_partkey)) AS t FROM part), a AS (SELECT DISTINCT CASE WHEN s_suppkey % 2 = 0 THEN d.t ELSE trim(left(d.t, 9)) END AS title FROM supplier JOIN d ON d.doc = s_suppkey)
 SELECT title, CASE WHEN min(CASE WHEN t = title THEN doc END) IS NOT NULL THEN min(CASE WHEN t = title THEN doc END) ELSE min(doc) END AS doc, CASE WHEN count(*) FILTER (WHERE t = title) > 0 THEN 1.0 ELSE 0.9 END::DOUBLE AS score FROM a JOIN d ON contains(t, title) OR contains(title, t) GROUP BY title""")
def cited_documents(spark, d):
    """Titles of parts cited whole or by their beginning, so that each is equal to or contained in one."""
    p = load(spark, d, "part").select(F.col("p_partkey").alias("doc"), F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("title"))
    refs = load(spark, d, "supplier").join(p, F.col("s_suppkey") == F.col("doc")).select(F.when(F.col("s_suppkey") % 2 == 0, F.upper("title")).otherwise(F.substring(F.trim("title"), 1, 9)).alias("title"))
    return R.match_titles(refs.select(F.col("title")), p)


@query("""WITH c AS (SELECT c_custkey AS k, c_custkey % 20 AS o FROM customer), s AS (
 SELECT k, 0 AS position, '# Report ' || k AS statement, 0 AS n_valid, 0 AS n_invalid, 'high' AS confidence FROM c UNION ALL SELECT k, 1, '', 0, 0, 'high' FROM c UNION ALL SELECT k, 2, 'Orders went out.', 0, 0, 'low' FROM c
 UNION ALL SELECT k, 3, 'Stock is fine [Quelle: Part ' || (k % 50) || ', 01.02.2024].', (o <> 3 OR k % 50 = 3)::INT, (o = 3 AND k % 50 <> 3)::INT, CASE WHEN o <> 3 OR k % 50 = 3 THEN 'high' ELSE 'medium' END FROM c WHERE k % 2 = 0
 UNION ALL SELECT k, 3 + (k % 2 = 0)::INT, 'Prices rose [Quelle: Unknown thing, 02.03.2024].', (o = 19)::INT, (o <> 19)::INT, CASE WHEN o = 19 THEN 'high' ELSE 'medium' END FROM c WHERE k % 3 = 0
 UNION ALL SELECT k, 3 + (k % 2 = 0)::INT + (k % 3 = 0)::INT, '- bullet stays. As one', 0, 0, 'low' FROM c)
 SELECT k AS c_custkey, position, statement, n_valid, n_invalid, confidence, CASE WHEN n_invalid > 0 THEN regexp_replace(statement, '\\[Quelle[^\\]]*\\]', '') ELSE statement END || CASE WHEN confidence = 'low' THEN ' (?)' ELSE '' END AS cleaned FROM s""")
def grounded_statements(spark, d):
    """Statements of briefings with their references checked: owner 19 knows no title, so that all count; owner 3 knows only part 3; others know all parts."""
    texts = briefings(spark, d).withColumn("owner", F.col("c_custkey") % 20)
    owners = load(spark, d, "customer").select((F.col("c_custkey") % 20).alias("owner")).distinct().where("owner != 19")
    wide = owners.where("owner != 3").select("owner", F.explode(F.array(*(F.concat(F.lit("Part "), F.lit(str(i))) for i in range(50)))).alias("title"))
    titles = wide.unionByName(owners.where("owner = 3").select("owner", F.lit("part 3").alias("title")))
    return D.grounded(texts, "c_custkey", "text", titles, "owner", mark=" (?)")


@query("""WITH c AS (SELECT c_custkey AS k FROM customer) SELECT k AS c_custkey, '# Report ' || k || E'\\n\\nOrders went out.' || CASE WHEN k % 2 = 0 THEN ' Stock is fine [Quelle: Part ' || (k % 50) || ', 01.02.2024].' ELSE '' END || CASE WHEN k % 3 = 0 THEN ' Prices rose .' ELSE '' END || E'\\n- bullet stays. As one' AS text, (k % 2 = 0)::BIGINT + (k % 3 = 0)::BIGINT AS n_refs, (k % 3 = 0)::BIGINT AS n_removed FROM c""")
def validated_sources(spark, d):
    """Briefings without the references that match no part."""
    b = briefings(spark, d).withColumn("refs", C.citations(F.col("text")))
    known = F.array(*(F.lit(f"part {i}") for i in range(50)))
    bad = F.transform(F.filter("refs", lambda r: ~F.array_contains(known, F.lower(r["title"]))), lambda r: r["raw"])
    return b.select("c_custkey", D.without_references(F.col("text"), bad).alias("text"), F.size("refs").cast("long").alias("n_refs"), F.size(bad).cast("long").alias("n_removed"))


_NEAREST = """WITH e AS (SELECT vec_id, vec_id // 25 AS brief, vec_id % 5 = 0 AS is_sentence, embedding::DOUBLE[] AS v FROM embeddings),
 p AS (SELECT s.brief, s.vec_id AS sentence, c.vec_id AS chunk, greatest(0, list_cosine_similarity(s.v, c.v)) AS s FROM e s JOIN e c ON s.brief = c.brief AND s.is_sentence AND NOT c.is_sentence),
 b AS (SELECT brief, sentence, arg_min(chunk, (-s, chunk)) AS chunk, round(max(s), 6) AS confidence FROM p GROUP BY ALL)"""


@query(f"{_NEAREST} SELECT *, CASE WHEN confidence > 0.7 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS level FROM b")
def nearest_sources(spark, d):
    """Vectors dealt into briefings of 25; every fifth stands for a sentence, the others for its sources."""
    e = load(spark, d, "embeddings").select(F.expr("vec_id div 25").alias("brief"), "vec_id", F.col("embedding").alias("vector"))
    return D.nearest_sources(e.where("vec_id % 5 = 0").withColumnRenamed("vec_id", "sentence"), e.where("vec_id % 5 != 0").withColumnRenamed("vec_id", "chunk"), "brief")


@query(f"{_NEAREST} SELECT brief, count(*) AS n, round(avg(confidence), 6) AS overall, round(avg((confidence < 0.5)::INT), 6) AS low_ratio, round(avg((confidence < 0.5)::INT), 6) <= 0.3 AS is_valid FROM b GROUP BY brief")
def briefing_quality(spark, d):
    return D.quality(nearest_sources(spark, d), "brief")
