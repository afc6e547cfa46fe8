"""Queries about running things: limits, breakers, states, triggers, health, exports, merges and deletions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import columns as C
from tessella.operators import analytics as A
from tessella.operators import sinks as K
from tessella.operators import state as S
from tessella.operators import triggers as T
from tessella.registry import query
from tessella.sources.tables import load


def _requests(spark, d):
    return load(spark, d, "events").select("event_id", "user_id", "event_type", "value", F.unix_timestamp("ts").alias("at"))


_STEPS = "r AS (SELECT event_id, user_id, event_type, value, epoch(date_trunc('second', ts))::BIGINT AS secs, row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('second', ts), event_id) AS i FROM events)"


@query(f"""WITH RECURSIVE {_STEPS}, f AS (SELECT user_id, 0::BIGINT AS i, []::BIGINT[] AS log, 0::BIGINT AS event_id, true AS accepted, 0 AS remaining FROM (SELECT DISTINCT user_id FROM events)
 UNION ALL SELECT r.user_id, r.i, CASE WHEN len(w) < 2 THEN list_append(w, r.secs) ELSE w END, r.event_id, len(w) < 2, CASE WHEN len(w) < 2 THEN (1 - len(w))::INT ELSE 0 END FROM (SELECT f.user_id, r.i, r.secs, r.event_id, list_filter(f.log, lambda t: t >= r.secs - 7200) AS w FROM f JOIN r ON r.user_id = f.user_id AND r.i = f.i + 1) r)
 SELECT event_id, accepted, remaining FROM f WHERE i > 0""")
def sliding_limiter(spark, d):
    """Two requests a user in two hours; refused ones don't count."""
    return S.limited(_requests(spark, d).select("user_id", "at", "event_id"), "user_id", "at", ["at", "event_id"], 2, 7200).select("event_id", "accepted", "remaining")


@query(f"""WITH RECURSIVE {_STEPS}, f AS (SELECT user_id, 0::BIGINT AS i, 0 AS failed, NULL::BIGINT AS opened, 0::BIGINT AS event_id, '' AS met, true AS passed, '' AS after FROM (SELECT DISTINCT user_id FROM events)
 UNION ALL SELECT user_id, i, CASE WHEN met = 'open' THEN failed WHEN ok THEN 0 ELSE failed + 1 END, CASE WHEN met = 'open' THEN opened WHEN ok THEN NULL WHEN met = 'half_open' OR failed + 1 >= 3 THEN secs ELSE NULL END, event_id, met, met <> 'open', CASE WHEN met = 'open' THEN 'open' WHEN ok THEN 'closed' WHEN met = 'half_open' OR failed + 1 >= 3 THEN 'open' ELSE 'closed' END
  FROM (SELECT r.*, f.failed, f.opened, r.event_type NOT IN ('error', 'view', 'click') AS ok, CASE WHEN f.opened IS NULL THEN 'closed' WHEN r.secs - f.opened >= 18000 THEN 'half_open' ELSE 'open' END AS met FROM f JOIN r ON r.user_id = f.user_id AND r.i = f.i + 1))
 SELECT event_id, met, passed, after FROM f WHERE i > 0""")
def circuit_breaker(spark, d):
    """A breaker for each user: three failures in a row open it for five hours."""
    calls = _requests(spark, d).withColumn("ok", ~F.col("event_type").isin("error", "view", "click"))
    return S.breaker(calls, "user_id", "at", "ok", ["at", "event_id"], seconds=18000.0).select("event_id", "met", "passed", "after")


_STATUS = "SELECT user_id, event_id, ts, ['open', 'revised', 'confirmed', 'refuted', 'lost'][CASE WHEN value > 200 THEN 3 WHEN value > 195 THEN 4 WHEN event_type = 'error' THEN 5 WHEN event_type = 'view' THEN 2 ELSE 1 END] AS s FROM events"


@query(f"WITH c AS ({_STATUS}), x AS (SELECT user_id, arg_min(s, (ts, event_id)) AS s, min((ts, event_id)) AS at FROM c WHERE s IN ('confirmed', 'refuted') GROUP BY 1) SELECT c.user_id, coalesce(any_value(x.s), arg_max(c.s, (c.ts, c.event_id)) FILTER (WHERE c.s <> 'lost'), 'open') AS status, count(*) FILTER (WHERE c.s = 'lost' OR (x.at IS NOT NULL AND (c.ts, c.event_id) > x.at)) AS n_refused FROM c LEFT JOIN x USING (user_id) GROUP BY 1")
def assumption_states(spark, d):
    """Changes of state made from events: unknown states and changes after an end are refused."""
    v, e = F.col("value"), F.col("event_type")
    status = F.when(v > 200, "confirmed").when(v > 195, "refuted").when(e == "error", "lost").when(e == "view", "revised").otherwise("open")
    return S.latest_valid_status(load(spark, d, "events").select("user_id", "ts", "event_id", status.alias("s")), "user_id", ["ts", "event_id"], "s")


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'acknowledged' WHEN 1 THEN 'snoozed' ELSE 'dismissed' END AS status, CASE WHEN o_orderkey % 3 = 1 THEN TIMESTAMP '1999-01-04' ELSE o_orderdate END AS due_at, CASE WHEN o_orderkey % 3 <> 1 THEN TIMESTAMP '1999-01-01' END AS resolved_at FROM orders")
def reminder_updates(spark, d):
    action = F.when(F.col("o_orderkey") % 3 == 0, "acknowledged").when(F.col("o_orderkey") % 3 == 1, "snoozed").otherwise("dismissed")
    return load(spark, d, "orders").select("o_orderkey", S.reminder_after(action, F.lit("1999-01-01").cast("timestamp"), F.col("o_orderdate")).alias("r")).select("o_orderkey", "r.*")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_orderkey % 2 = 0 AND o_orderdate < TIMESTAMP '1998-01-01' THEN 'high' ELSE 'normal' END AS urgency FROM orders")
def escalated_reminders(spark, d):
    r = load(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "pending").otherwise("dismissed").alias("status"), F.when(F.col("o_orderkey") % 2 == 0, "follow_up").otherwise("inactive_topic").alias("kind"), F.col("o_orderdate").alias("due_at"), F.lit("normal").alias("urgency"))
    return S.escalated(r, F.lit("1998-01-01").cast("timestamp")).select("o_orderkey", "urgency")


@query("""SELECT 'all' AS rule, doc_id FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'and') UNION ALL SELECT 'any', doc_id FROM documents WHERE contains(lower(text), 'invoice') OR contains(lower(text), 'token') OR contains(lower(text), 'nicht')
 UNION ALL SELECT 'source', doc_id FROM documents WHERE source IN ('src1', 'src2') UNION ALL SELECT 'every', doc_id FROM documents""")
def workflow_triggers(spark, d):
    """Rules of three kinds against all documents: keywords, all or any of them, sources, and new documents of any source."""
    rules = T.rules(spark, [("all", "keyword_match", ["THE", "and"], True, None), ("any", "keyword_match", ["invoice", "token", "nicht"], False, None), ("none", "keyword_match", [], False, None), ("source", "new_document", [], False, ["src1", "src2"]), ("every", "new_document", [], False, None), ("timed", "schedule", [], False, None)])
    return T.triggered(load(spark, d, "documents").select("doc_id", F.lit("").alias("title"), F.col("text").alias("content"), "source", F.lit("new_document").alias("event_type")), rules, "doc_id")


@query("SELECT sum(CASE WHEN n >= 0 THEN n ELSE 0 END)::BIGINT AS total_pending, bool_or(n < 0) AS any_error, CASE WHEN bool_or(n < 0) THEN 'degraded' ELSE 'up' END AS status FROM (SELECT event_type, CASE WHEN event_type = 'error' THEN -1 ELSE count(*) END AS n FROM events GROUP BY 1)")
def queue_health(spark, d):
    """Depths of queues, one of which can't be read."""
    depth = load(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).select(F.when(F.col("event_type") == "error", -1).otherwise(F.col("n")).alias("depth"))
    return A.queue_health(depth, "depth", workers=3)


@query("SELECT a.event_type, round(a.v / b.v, 6) AS ratio FROM (SELECT event_type, arg_max(value, (ts, event_id)) AS v FROM events WHERE user_id % 2 = 0 GROUP BY 1) a JOIN (SELECT event_type, arg_max(value, (ts, event_id)) AS v FROM events WHERE user_id % 2 = 1 GROUP BY 1) b USING (event_type)")
def gauge_ratio(spark, d):
    """The last value of one gauge by that of another."""
    last = lambda odd, name: load(spark, d, "events").where(F.col("user_id") % 2 == odd).groupBy("event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias(name))
    return last(0, "a").join(last(1, "b"), "event_type").select("event_type", F.round(F.try_divide("a", "b"), 6).alias("ratio"))


@query("SELECT c_custkey, n AS used, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL WHEN c_mktsegment = 'MACHINERY' THEN 12 ELSE 8 END AS allowed, CASE WHEN c_mktsegment = 'BUILDING' THEN true WHEN c_mktsegment = 'MACHINERY' THEN n < 12 ELSE n < 8 END AS may FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def plan_quotas(spark, d):
    """Use against plans' limits; one plan has none."""
    used = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("used"))
    plans = load(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("plan"))
    return A.quota(plans.join(used, "c_custkey"), "plan", "used", {"BUILDING": None, "MACHINERY": 12}, 8).select("c_custkey", "used", "allowed", "may")


@query("SELECT o_orderkey, title || '.md' AS name, '# ' || t || E'\\n\\n*Generiert: 2024-01-01 | 1.0 | Typ: weekly*\\n\\n---\\n\\nStatus ' || o_orderstatus || E'\\n' || CASE WHEN o_orderkey % 2 = 0 THEN E'\\n---\\n\\n## Quellenverzeichnis\\n\\n1. A & B\\n2. ' || o_orderpriority || E'\\n' ELSE '' END AS content FROM (SELECT *, 'Order/' || o_orderkey || ': \"x\"' AS t, 'Order_' || o_orderkey || '_ _x_' AS title FROM orders)")
def markdown_exports(spark, d):
    o = _exported(spark, d)
    return o.select("o_orderkey", K.file_name(F.col("title"), ".md").alias("name"), K.markdown(*_parts()).alias("content"))


@query("SELECT o_orderkey, '<h1>Order/' || o_orderkey || ': &quot;x&quot;</h1>' || E'\\n<p><em>Generiert: 2024-01-01 | 1.0 | Typ: weekly</em></p>\\n<hr/>\\n<p>Status ' || o_orderstatus || '</p>' || CASE WHEN o_orderkey % 2 = 0 THEN E'\\n<hr/>\\n<h2>Quellenverzeichnis</h2>\\n<ol>\\n<li>A &amp; B</li>\\n<li>' || o_orderpriority || E'</li>\\n</ol>' ELSE '' END AS content FROM orders")
def xhtml_exports(spark, d):
    return _exported(spark, d).select("o_orderkey", K.storage_xhtml(*_parts()).alias("content"))


def _exported(spark, d):
    k = F.col("o_orderkey")
    sources = F.when(k % 2 == 0, F.array(F.lit("A & B"), "o_orderpriority")).otherwise(F.array().cast("array<string>"))
    return load(spark, d, "orders").select("o_orderkey", F.concat(F.lit("Order/"), k.cast("string"), F.lit(': "x"')).alias("title"), F.concat(F.lit("Status "), "o_orderstatus").alias("content"), sources.alias("sources"))


def _parts():
    return F.col("title"), F.col("content"), F.lit("2024-01-01"), F.lit("1.0"), F.lit("weekly"), F.col("sources")


@query("SELECT 'documents/' || conv_id || '.md' AS name, string_agg(text, E'\\n\\n' ORDER BY turn) AS content FROM conversations GROUP BY conv_id")
def export_files(spark, d):
    """Conversations as files of a data export."""
    return K.chunk_files(load(spark, d, "conversations"), "conv_id", "turn", "text")


@query("SELECT 'orders' AS name, count(*) AS rows FROM orders WHERE o_custkey % 10 <> 3 UNION ALL SELECT 'customer', count(*) FROM customer WHERE c_custkey % 10 <> 3 UNION ALL SELECT 'lines', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 10 = 3)")
def cascade_deletes(spark, d):
    """Rows left in three tables when a tenth of the customers is deleted, with their orders and these orders' lines."""
    gone = load(spark, d, "customer").where("c_custkey % 10 = 3").select(F.col("c_custkey").alias("owner"))
    orders = load(spark, d, "orders")
    lines = load(spark, d, "lineitem").join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey", "left")
    left = K.without_owners({"orders": (orders, "o_custkey"), "customer": (load(spark, d, "customer"), "c_custkey"), "lines": (lines, "o_custkey")}, gone)
    one, two, three = (df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("name"), "rows") for n, df in left.items())
    return one.unionByName(two).unionByName(three)


@query("SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber > 2 AND (l_orderkey, l_partkey) NOT IN (SELECT (l_orderkey, l_partkey) FROM lineitem WHERE l_linenumber <= 2)")
def new_mentions(spark, d):
    """Mentions that aren't stored yet, each once; the first lines of orders are stored."""
    m = load(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    return K.new_rows(m.where("l_linenumber > 2").select("l_orderkey", "l_partkey"), m.where("l_linenumber <= 2"), ["l_orderkey", "l_partkey"])


@query("SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2")
def last_feedback(spark, d):
    """The last value that each user gave for each kind."""
    e = load(spark, d, "events").select("user_id", "event_type", "value", "ts", "event_id")
    return A.latest_per(e, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "value")


@query("SELECT event_type, round(avg(score), 6) AS rating, count(*) AS n FROM (SELECT event_type, user_id, arg_max((value::INT % 5) + 1, (ts, event_id)) AS score FROM events GROUP BY 1, 2) GROUP BY 1")
def plugin_ratings(spark, d):
    """Mean rating from each user's last one."""
    e = load(spark, d, "events").select("event_type", "user_id", "ts", "event_id", (F.rint("value").cast("int") % 5 + 1).alias("score"))
    return A.latest_per(e, ["event_type", "user_id"], [F.desc("ts"), F.desc("event_id")]).groupBy("event_type").agg(F.round(F.avg("score"), 6).alias("rating"), F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, user_id, ts FROM events WHERE event_type = 'error' AND user_id = 7 ORDER BY ts DESC, event_id DESC LIMIT 20")
def audit_feed(spark, d):
    return A.newest(load(spark, d, "events").where("event_type = 'error' AND user_id = 7"), [F.desc("ts"), F.desc("event_id")], 20).select("event_id", "user_id", "ts")


@query("SELECT (SELECT count(*) FROM customer WHERE c_nationkey = 3) AS members, (SELECT count(*) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)) AS documents, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)) AS open_items")
def organisation_dashboard(spark, d):
    """Counts of one organisation in one row, the large table read once."""
    c = load(spark, d, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    o = load(spark, d, "orders").join(c, "o_custkey", "left_semi").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("o_orderstatus") == "O").alias("open_items"))
    return c.agg(F.count(F.lit(1)).alias("members")).join(F.broadcast(o), F.lit(True))


@query("SELECT doc_id, source, CASE WHEN doc_id % 8 < 3 THEN 'gone' ELSE 'kept' END AS state FROM documents")
def retention_sweep(spark, d):
    """Documents by source's retention at a day; three of eight sources have expired."""
    k = F.element_at(F.array(*map(F.lit, ["zoom", "zoom", "zoom", "google_docs", "notion", "obsidian", "google_docs", "notion"])), (F.col("doc_id") % 8 + 1).cast("int"))
    docs = load(spark, d, "documents").withColumn("expires_at", F.date_add(F.lit("2023-01-01").cast("date"), C.retention_days(k)))
    stay, gone = K.swept(docs, "expires_at", F.lit("2023-09-01").cast("date"))
    return stay.select("doc_id", "source", F.lit("kept").alias("state")).unionByName(gone.select("doc_id", "source", F.lit("gone").alias("state")))


@query()
def vector_upserts(spark, d):
    """Vectors by owner with a fixed identifier made from owner and key; tests compare it with the standard library's."""
    e = load(spark, d, "embeddings")
    return e.select(F.col("label").alias("owner"), "vec_id", K.uuid5(F.concat_ws(":", F.col("label").cast("string"), F.col("vec_id").cast("string"))).alias("uuid"))


@query("SELECT user_id, list(event_type || ':' || event_id ORDER BY ts, event_id) AS evidence, '{\"n\":' || count(*) || '}' AS meta FROM events WHERE value > 200 GROUP BY user_id")
def evidence_logs(spark, d):
    """Entries appended in order, and a JSON object about them."""
    e = load(spark, d, "events").where("value > 200")
    log = F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type")))
    g = e.groupBy("user_id").agg(log.alias("log"))
    return g.select("user_id", F.transform("log", lambda x: F.concat(x["event_type"], F.lit(":"), x["event_id"].cast("string"))).alias("evidence"), F.to_json(F.struct(F.size("log").alias("n"))).alias("meta"))
