"""Queries around search: enrichment, filters, owners' rights, caches, order by themes, and relational shapes of the search's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import columns as C
from tessella.operators import enrich as E
from tessella.operators import search as S
from tessella.registry import query
from tessella.sources.tables import load

_KINDS = ["google_calendar", "notion", "zoom", "obsidian", "fax"]
_DAY = "TIMESTAMP '2024-01-01' + to_days((doc_id % 28)::INT)"


def _documents(spark, d):
    """Documents with a title, a source, the source's id and a date, all made from their id and text."""
    k = F.col("doc_id")
    kind = F.get(F.array(*map(F.lit, _KINDS)), F.pmod(k, F.lit(5)).cast("int"))
    return load(spark, d, "documents").select("doc_id", F.when(k % 4 == 0, "").otherwise(F.substring("text", 1, 30)).alias("title"), kind.alias("source"), F.concat(F.lit("s"), k.cast("string")).alias("source_id"), F.timestamp_add("DAY", (k % 28).cast("int"), F.lit("2024-01-01").cast("timestamp")).alias("created_at"))


def _hits(spark, d):
    e = load(spark, d, "embeddings")
    near = S.vector_topk(e, e.where("vec_id = 3"), 50)
    return S.ranked(near.select(F.col("vec_id").alias("chunk_id"), (F.col("certainty") * 1.6).alias("score"), F.lit("untitled").alias("title")), "score", "chunk_id", "rank")


def _chunks(spark, d):
    """A chunk for each vector; every fourth belongs to another owner, and some lie in documents that aren't there."""
    return load(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.when(F.col("vec_id") % 7 == 0, -1 - F.col("vec_id")).otherwise(F.col("vec_id")).alias("doc_id"), F.when(F.col("vec_id") % 4 == 1, 2).otherwise(1).alias("owner"))


_ENRICHED = f"""WITH near AS (SELECT e.vec_id, round((1 + list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])) / 2, 6) AS c FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 3) q ORDER BY c DESC, vec_id LIMIT 50),
 h AS (SELECT vec_id AS chunk_id, c * 1.6 AS score, row_number() OVER (ORDER BY c * 1.6 DESC, vec_id) AS rank FROM near),
 x AS (SELECT rank, chunk_id, doc_id, CASE WHEN doc_id % 4 = 0 OR text IS NULL OR text = '' THEN 'untitled' ELSE left(text, 30) END AS title, ['google_calendar', 'notion', 'zoom', 'obsidian', 'notion'][(doc_id % 5 + 1)::INT] AS source, {_DAY} AS created_at, greatest(0, least(1, score))::DOUBLE AS relevance,
  CASE doc_id % 5 WHEN 0 THEN 'https://calendar.google.com/calendar/event?eid=s' || doc_id WHEN 1 THEN 'https://notion.so/s' || doc_id WHEN 2 THEN 'https://zoom.us/rec/s' || doc_id END AS url FROM h JOIN documents ON doc_id = chunk_id WHERE chunk_id % 4 <> 1 AND chunk_id % 7 <> 0)"""


@query(f"{_ENRICHED} SELECT * FROM x")
def enriched_hits(spark, d):
    """Hits of one owner with titles, sources, addresses and a relevance held to 1."""
    return E.enriched(_hits(spark, d), _chunks(spark, d), _documents(spark, d), F.lit(1))


@query(f"{_ENRICHED} SELECT * FROM x WHERE source IN ('notion', 'zoom', 'google_calendar') AND created_at BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-20' AND source <> 'zoom'")
def filtered_hits(spark, d):
    """The same by sources and dates, without one source whatever its case."""
    at = lambda day: F.lit(day).cast("timestamp")
    return E.filtered(enriched_hits(spark, d), ["notion", "zoom", "google_calendar"], at("2024-01-03"), at("2024-01-20"), ["ZOOM"])


@query("SELECT c_nationkey AS org_id, c_custkey AS user_id FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def permitted_members(spark, d):
    """Customers as members of nations whose segment is their role: two roles may write."""
    c = load(spark, d, "customer").select(F.col("c_nationkey").alias("org_id"), F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("role"))
    return E.permitted(c.select("org_id", "user_id"), c, "write", {"BUILDING": ["read", "write"], "MACHINERY": ["write"], "HOUSEHOLD": ["read"]})


@query("""SELECT p_partkey, contains(lower(p_name), 'red')::INT + contains(lower(p_name), 'bolt')::INT + contains(lower(p_name), 'gear')::INT AS theme_hits FROM part""")
def theme_order(spark, d):
    """Parts that name a user's themes first."""
    return E.by_themes(load(spark, d, "part"), ["red", "bolt", "gear"], F.col("p_name"), "p_partkey").select("p_partkey", "theme_hits")


@query("""WITH l AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS ids FROM lineitem GROUP BY l_orderkey), e AS (SELECT l_orderkey, unnest(ids) AS p_partkey, unnest(range(0, len(ids)))::INT AS position FROM l)
 SELECT l_orderkey, position, p_partkey, p_name, round(greatest(0, 1.0::DOUBLE - position * 0.05), 6) AS relevance FROM e JOIN part USING (p_partkey) WHERE p_size < 40""")
def resolved_lists(spark, d):
    """The parts of each order in its order, with falling relevance; parts of great size are taken not to exist."""
    lists = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))), lambda x: x["l_partkey"]).alias("ids"))
    return E.resolved(lists, "l_orderkey", "ids", load(spark, d, "part").where("p_size < 40").select("p_partkey", "p_name"), "p_partkey")


@query("""WITH s AS (SELECT vec_id AS answer_id, label % 3 AS scope, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY label % 3 ORDER BY vec_id DESC) AS n FROM embeddings WHERE vec_id % 10 <> 0),
 a AS (SELECT vec_id AS ask_id, label % 3 AS scope, CASE WHEN vec_id % 20 = 0 THEN list_transform(embedding::DOUBLE[], lambda x: x * 2) ELSE embedding::DOUBLE[] END AS v FROM embeddings WHERE vec_id % 20 IN (0, 1)),
 x AS (SELECT ask_id, arg_max(answer_id, answer_id) AS answer_id, 1.0::DOUBLE AS similarity FROM a JOIN s ON a.scope = s.scope AND array_to_string(list_transform(a.v, lambda z: printf('%.4f', z)), ',') = array_to_string(list_transform(s.v, lambda z: printf('%.4f', z)), ',') GROUP BY ask_id),
 y AS (SELECT ask_id, arg_min(answer_id, n) AS answer_id, arg_min(round(list_cosine_similarity(a.v, s.v), 6), n) AS similarity FROM a JOIN s ON a.scope = s.scope WHERE n <= 100 AND round(list_cosine_similarity(a.v, s.v), 6) >= 0.3 AND ask_id NOT IN (SELECT ask_id FROM x) GROUP BY ask_id)
 SELECT a.ask_id, coalesce(x.answer_id, y.answer_id) AS answer_id, coalesce(x.similarity, y.similarity) AS similarity FROM a LEFT JOIN x USING (ask_id) LEFT JOIN y USING (ask_id)""")
def cached_answers(spark, d):
    """Questions answered from stored ones of their scope: some vectors are the same, others have only a direction in common. The threshold is lower
    than usual, since the vectors are random."""
    e = load(spark, d, "embeddings").withColumn("scope", F.col("label") % 3).withColumn("vector", F.col("embedding").cast("array<double>"))
    stored = e.where("vec_id % 10 != 0").select("scope", F.col("vec_id").alias("answer_id"), F.col("vec_id").alias("at"), "vector")
    asked = e.where("vec_id % 20 IN (0, 1)").select("scope", F.col("vec_id").alias("ask_id"), F.when(F.col("vec_id") % 20 == 0, F.transform("vector", lambda x: x * 2)).otherwise(F.col("vector")).alias("vector"))
    return E.cached(asked, stored, ["scope"], similar=0.3)


@query("SELECT vec_id, left(sha256(array_to_string(list_transform(embedding, lambda z: printf('%.4f', z::DOUBLE)), ',')), 16) AS hash, CASE WHEN label = 0 THEN 'nf' ELSE left(sha256('label=' || label || '&type=v'), 16) END AS filters FROM embeddings")
def vector_hashes(spark, d):
    f = F.when(F.col("label") != 0, F.create_map(F.lit("type"), F.lit("v"), F.lit("label"), F.col("label").cast("string")))
    return load(spark, d, "embeddings").select("vec_id", E.vector_hash(F.col("embedding")).alias("hash"), E.filter_hash(f).alias("filters"))


@query("SELECT p_partkey, p_name, (SELECT count(*) FROM part WHERE p_name ILIKE '%re%' AND p_type IN ('SMALL', 'ECONOMY')) AS total, first FROM part JOIN (SELECT l_partkey, arg_min(l_orderkey, (l_shipdate, l_orderkey)) AS first FROM lineitem GROUP BY 1) ON l_partkey = p_partkey WHERE p_name ILIKE '%re%' AND p_type IN ('SMALL', 'ECONOMY') ORDER BY p_name, p_partkey LIMIT 20")
def public_search(spark, d):
    """Parts by name and kind, with their number and each one's first mention. The few hits are chosen before mentions are read."""
    found = load(spark, d, "part").where(F.ilike("p_name", F.lit("%re%")) & F.col("p_type").isin("SMALL", "ECONOMY")).select("p_partkey", "p_name")
    page = found.orderBy("p_name", "p_partkey").limit(20)
    total = found.agg(F.count(F.lit(1)).alias("total"))
    first = load(spark, d, "lineitem").join(F.broadcast(page.select(F.col("p_partkey").alias("l_partkey"))), "l_partkey", "left_semi").groupBy("l_partkey").agg(F.min_by("l_orderkey", F.struct("l_shipdate", "l_orderkey")).alias("first"))
    return page.join(F.broadcast(total), F.lit(True)).join(first, page.p_partkey == first.l_partkey).drop("l_partkey")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT unnest(list(l_orderkey)) FROM lineitem WHERE l_partkey = 7) OR o_orderkey IN (1, 2, 3)")
def any_of_ids(spark, d):
    """Orders named in arrays: the ids are exploded and joined, so that arrays of any length do."""
    arrays = load(spark, d, "lineitem").where("l_partkey = 7").groupBy("l_suppkey").agg(F.collect_set("l_orderkey").alias("ids"))
    ids = arrays.select(F.explode("ids").alias("o_orderkey")).unionByName(spark.range(1, 4).select(F.col("id").alias("o_orderkey"))).distinct()
    return load(spark, d, "orders").join(ids, "o_orderkey", "left_semi").select("o_orderkey", "o_orderstatus")


@query("SELECT event_id, (props::JSON ->> 'k')::INT AS k FROM events WHERE (props::JSON ->> 'k')::INT >= 90")
def json_fields(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    return load(spark, d, "events").where(k >= 90).select("event_id", k.alias("k"))


@query("SELECT o_orderkey FROM (SELECT *, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderdate END AS expires FROM orders) WHERE expires IS NULL OR expires > TIMESTAMP '1999-06-01'")
def not_expired(spark, d):
    """Rows that never expire or do so later."""
    expires = F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate"))
    return load(spark, d, "orders").where(expires.isNull() | (expires > F.lit("1999-06-01").cast("timestamp"))).select("o_orderkey")


@query("SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING bool_or(1 - l_discount >= 0.93 AND l_quantity > 40)")
def any_sure_mention(spark, d):
    """Orders with any line above a threshold."""
    lines = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_discount", "l_quantity")).alias("ms"))
    return lines.where(F.exists("ms", lambda m: (1 - m["l_discount"] >= 0.93) & (m["l_quantity"] > 40))).select("l_orderkey")


@query("SELECT o_orderkey, l_partkey AS first_part FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_linenumber = 1 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey) = 1) ON l_orderkey = o_orderkey WHERE o_orderdate >= TIMESTAMP '1998-03-01' AND o_orderdate < TIMESTAMP '1998-03-08'")
def events_with_first_chunk(spark, d):
    """Orders of some days with their first line, if any: the condition is part of the join."""
    day = F.col("o_orderdate")
    first = load(spark, d, "lineitem").where("l_linenumber = 1").groupBy("l_orderkey").agg(F.min(F.struct("l_partkey", "l_suppkey")).alias("m"))
    orders = load(spark, d, "orders").where((day >= F.lit("1998-03-01").cast("timestamp")) & (day < F.lit("1998-03-08").cast("timestamp")))
    return orders.join(first, orders.o_orderkey == first.l_orderkey, "left").select("o_orderkey", F.col("m.l_partkey").alias("first_part"))


@query("SELECT c_custkey, coalesce(list_sort(list(o_orderkey) FILTER (WHERE o_orderkey IS NOT NULL)), []) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def documents_with_chunk_lists(spark, d):
    """Each customer with its orders as an array, empty without any."""
    o = load(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("orders"))
    return load(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("orders", F.array().cast("array<bigint>")).alias("orders"))


@query("SELECT p_type, count(*) AS mentions, count(DISTINCT l_orderkey) AS chunks FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_type")
def entity_mentions(spark, d):
    return load(spark, d, "lineitem").join(load(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_type").agg(F.count(F.lit(1)).alias("mentions"), F.countDistinct("l_orderkey").alias("chunks"))


@query("WITH x AS (SELECT DISTINCT o_custkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_partkey = 11) SELECT o_custkey, (SELECT count(*) FROM x) AS total FROM x ORDER BY o_custkey LIMIT 10 OFFSET 5")
def entity_documents(spark, d):
    """The customers that an entity's mentions lead to, each once: a page and the number of all."""
    mentions = load(spark, d, "lineitem").where("l_partkey = 11").select(F.col("l_orderkey").alias("o_orderkey"))
    x = load(spark, d, "orders").join(mentions, "o_orderkey", "left_semi").select("o_custkey").distinct()
    return x.orderBy("o_custkey").offset(5).limit(10).join(F.broadcast(x.agg(F.count(F.lit(1)).alias("total"))), F.lit(True))


@query("WITH o AS (SELECT l_orderkey, list_distinct(list(l_partkey % 20)) AS a, list_distinct(list(l_suppkey % 20)) AS b FROM lineitem GROUP BY 1) SELECT l_orderkey, list_sort(list_intersect(a, b)) AS both, list_sort(list_filter(a, lambda x: NOT list_contains(b, x))) AS only_first, list_sort(list_distinct(list_concat(a, b))) AS either FROM o")
def set_operations(spark, d):
    """Common, lone and united values of two sets in each group."""
    o = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_partkey") % 20).alias("a"), F.collect_set(F.col("l_suppkey") % 20).alias("b"))
    return o.select("l_orderkey", F.array_sort(F.array_intersect("a", "b")).alias("both"), F.array_sort(F.array_except("a", "b")).alias("only_first"), F.array_sort(F.array_union("a", "b")).alias("either"))


@query("SELECT conv_id, turn, list_transform(list_filter(range(1, len(w) + 1), lambda i: list_position(w, w[i]) = i), lambda i: w[i]) AS words FROM (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations WHERE length(text) < 200)")
def first_occurrences(spark, d):
    """Words of short turns, each at its first place."""
    return load(spark, d, "conversations").where(F.length("text") < 200).select("conv_id", "turn", F.array_distinct(F.split("text", " ")).alias("words"))


@query("SELECT event_id, strftime(ts, '%d.%m.%Y') AS day, strftime(ts, '%H:%M') AS clock, date_trunc('month', ts)::DATE - INTERVAL 2 MONTH AS cutoff, printf('%02d:%02d', floor(value / 60)::INT, (floor(value) % 60)::INT) AS length FROM events")
def shown_times(spark, d):
    e = load(spark, d, "events")
    return e.select("event_id", F.date_format("ts", "dd.MM.yyyy").alias("day"), F.date_format("ts", "HH:mm").alias("clock"), C.month_start_back(F.to_date("ts"), 2).cast("timestamp").alias("cutoff"), C.minutes_seconds(F.col("value")).alias("length"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{"k": 1}' WHEN 1 THEN props WHEN 2 THEN '{"a": [2]}' END AS json FROM events""")
def extracted_json(spark, d):
    """JSON in answers: whole, in a fenced block, bare among words, and none."""
    k = F.col("event_id") % 4
    raw = F.when(k == 0, '  {"k": 1} ').when(k == 1, F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```\nDone {x}"))).when(k == 2, 'Well, {"a": [2]} it is').otherwise("no {json here")
    return load(spark, d, "events").select("event_id", C.json_in(raw).alias("json"))
