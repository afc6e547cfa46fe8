"""Queries over texts: chunks, mentions, follow-ups, readers' columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.catalog.notes import NOTES, notes
from tessella.operators import recognize as R
from tessella.operators import segments as G
from tessella.registry import query
from tessella.sources import structured as T
from tessella.sources.tables import load, spread

_BOUNDS = G.Bounds(most=120, overlap=24, least=16)


def _packed(split: str, joiner: str) -> str:
    """SQL of greedy packing: sums of tokens before each segment, then from each start the last end that fits, and back by what the overlap holds."""
    return f"""WITH RECURSIVE d AS (SELECT doc_id, text, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS n FROM documents),
 s AS (SELECT doc_id, list_filter({split}, lambda x: trim(x, E' \\n\\t\\r\\f\\v') <> '') AS seg FROM d WHERE n > 120),
 t AS (SELECT doc_id, seg, list_transform(seg, lambda x: len(list_filter(regexp_split_to_array(x, '\\s+'), lambda w: w <> ''))) AS tok FROM s),
 p AS (SELECT doc_id, seg, tok, list_transform(range(0, len(tok) + 1), lambda i: coalesce(list_sum(tok[1:i]), 0)::BIGINT) AS sums FROM t),
 r(doc_id, a, z, step) AS (
  SELECT doc_id, 0::BIGINT, greatest(1, len(list_filter(sums, lambda x: x <= 120)) - 1)::BIGINT, 0 FROM p WHERE len(seg) > 0
  UNION ALL
  SELECT doc_id, b, greatest(b + 1, len(list_filter(sums, lambda x: x <= sums[b + 1] + 120)) - 1)::BIGINT, step + 1 FROM (
   SELECT r.doc_id, r.step, p.sums, len(p.seg) AS m, CASE WHEN r.z = r.a + 1 AND p.tok[r.a + 1] > 120 THEN r.z ELSE greatest(r.a + 1, len(list_filter(p.sums, lambda x: x < p.sums[r.z + 1] - 24)))::BIGINT END AS b,
    r.z < len(p.seg) AS more FROM r JOIN p USING (doc_id)) WHERE more),
 c AS (SELECT r.doc_id, r.step, 0 AS w, array_to_string(p.seg[r.a + 1 : r.z], {joiner}) AS content FROM r JOIN p USING (doc_id) WHERE NOT (r.z = r.a + 1 AND p.tok[r.a + 1] > 120)
  UNION ALL
  SELECT doc_id, step, w, array_to_string(words[w * 96 + 1 : w * 96 + 120], ' ') FROM (SELECT r.doc_id, r.step, list_filter(regexp_split_to_array(p.seg[r.a + 1], '\\s+'), lambda x: x <> '') AS words, unnest(range(0, ceil((p.tok[r.a + 1] - 120) / 96.0)::BIGINT + 1)) AS w FROM r JOIN p USING (doc_id) WHERE r.z = r.a + 1 AND p.tok[r.a + 1] > 120)),
 e AS (SELECT doc_id, 0 AS step, 0 AS w, text AS content FROM d WHERE n <= 120 UNION ALL SELECT * FROM c)
 SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY step, w) - 1)::INT AS chunk_index, md5(content) AS content_md5, len(list_filter(regexp_split_to_array(content, '\\s+'), lambda w: w <> ''))::INT AS token_count FROM e"""


_SENTENCES = "string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"


def _chunked(docs, strategy):
    out = G.chunks(docs.withColumn("how", F.lit(strategy)), "doc_id", "text", "how", _BOUNDS)
    return out.select("doc_id", "chunk_index", F.md5(F.col("content").cast("binary")).alias("content_md5"), "token_count")


@query(_packed(_SENTENCES, "' '"))
def sentence_chunks(spark, d):
    """Sentences packed up to 120 tokens, with an overlap of 24."""
    return _chunked(spread(load(spark, d, "documents")), "semantic")


@query(_packed("regexp_split_to_array(text, '\\n\\s*\\n')", "E'\\n\\n'").replace("SELECT doc_id, text, len(", "SELECT doc_id, replace(text, E'\\n', E'\\n\\n') AS text, len("))
def paragraph_packs(spark, d):
    """Paragraphs packed likewise; the texts' lines are taken for paragraphs."""
    docs = spread(load(spark, d, "documents")).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return _chunked(docs, "paragraph")


VOCABULARY = "word_bpe_49k.json"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@query()
def token_chunks(spark, d, vocabulary=None):
    """Sentences packed up to 256 subword tokens, with an overlap of 32; tests compare the counts with encoding each chunk again."""
    out = G.chunks(spread(load(spark, d, "documents")), "doc_id", "text", bounds=G.file_bounds(vocabulary or default_vocabulary(), 256, 32, 16))
    return out.select("doc_id", "chunk_index", "content", "token_count")


@query()
def coherence_chunks(spark, d):
    """Sentences of each conversation turn grouped by coherence, with hashed words for an embedding; tests compare it with a version by hand."""
    turns = load(spark, d, "conversations").withColumn("key", F.struct("conv_id", "turn"))
    return G.coherence_chunks(turns, "key", "text", G.hashed_words, G.Bounds(most=60, overlap=0, least=8)).select("key.*", "chunk_index", "content", "token_count", F.round("coherence", 6).alias("coherence"))


_MENTIONS = f"""WITH n AS ({NOTES}), m AS (
 SELECT k, 'email' AS rule, 'person' AS kind, 'Ann User' || (k % 11) AS name, 1.0::DOUBLE AS confidence FROM n
 UNION ALL SELECT k, 'at_mention', 'person', 'Clerk ' || (k % 7), 1.0::DOUBLE FROM n
 UNION ALL SELECT k, 'date_iso', 'date_ref', day, 1.0::DOUBLE FROM n WHERE k % 2 = 0
 UNION ALL SELECT k, 'deadline_keyword', 'date_ref', 'Freitag', 0.85::DOUBLE FROM n WHERE k % 6 = 0
 UNION ALL SELECT k, 'decision_keyword', 'decision', 'ship order ' || k || ' by rail', 0.85::DOUBLE FROM n
 UNION ALL SELECT k, 'question_keyword', 'open_question', 'who pays for ' || s || '?', 0.85::DOUBLE FROM n WHERE k % 4 = 0
 UNION ALL SELECT k, 'goal_keyword', 'goal', 'reach ' || k || ' units', 0.85::DOUBLE FROM n WHERE k % 5 = 0
 UNION ALL SELECT k, 'risk_keyword', 'risk', 'late delivery of ' || p, 0.85::DOUBLE FROM n WHERE k % 3 = 0)"""


@query(f"{_MENTIONS} SELECT k AS o_orderkey, rule, kind, name, lower(name) AS normalized, confidence FROM m")
def note_mentions(spark, d):
    """People, dates, decisions, questions, goals and risks in notes; a deadline that repeats a date is left out."""
    return R.mentions(notes(spark, d), "o_orderkey", "text").drop("position")


@query(f"{_MENTIONS} SELECT k AS o_orderkey, kind, lower(name) AS normalized, min(name) AS name, count(*) AS n, max(confidence) AS confidence, min(rule) AS first_rule FROM m GROUP BY k, kind, lower(name)")
def note_entities(spark, d):
    return R.entities(R.mentions(notes(spark, d), "o_orderkey", "text"), "o_orderkey")


@query(f"""WITH n AS ({NOTES}) SELECT k AS o_orderkey, 'follow_up' AS kind, 'I will send the papers by' AS text FROM n WHERE k % 8 = 0 UNION ALL SELECT k, 'follow_up', 'TODO: count boxes' FROM n WHERE k % 9 = 0
 UNION ALL SELECT k, 'open_question', 'Open question: who pays for ' || s || '?' FROM n WHERE k % 4 = 0""")
def note_follow_ups(spark, d):
    return R.follow_ups(notes(spark, d), "o_orderkey", "text").drop("position")


@query(f"WITH n AS ({NOTES}) SELECT k AS o_orderkey, CASE WHEN k % 10 = 0 THEN ['Ann', 'Bob', 'Cy'] ELSE [] END AS people FROM n")
def note_participants(spark, d):
    return notes(spark, d).select("o_orderkey", R.participant_line(F.col("text")).alias("people"))


@query("""SELECT conv_id, 'Kickoff ' || conv_id AS title, 'Kickoff ' || conv_id || coalesce(E'\\n\\n' || nullif(max(text) FILTER (WHERE turn = 0), ''), '') || E'\\n\\nOrt: Room ' || (conv_id % 5) AS content, list(role || turn || '@x.org' ORDER BY turn) FILTER (WHERE turn % 2 = 0) AS participants, count(*) FILTER (WHERE turn % 2 = 0) AS attendee_count,
 conv_id % 3 = 0 AS is_all_day, conv_id % 4 = 0 AS is_recurring, CASE WHEN conv_id % 3 = 0 THEN '2024-01-02' ELSE '2024-01-02T10:00:00+00:00' END AS start_time FROM conversations GROUP BY conv_id""")
def calendar_documents(spark, d):
    """Calendar events in their service's JSON, made from conversations, as documents."""
    c = load(spark, d, "conversations")
    person = F.struct(F.when(F.col("turn") % 2 == 0, F.concat("role", F.col("turn").cast("string"), F.lit("@x.org"))).alias("email"))
    g = c.groupBy("conv_id").agg(F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("description"), F.array_sort(F.collect_list(F.struct("turn", person.alias("p")))).alias("a"))
    k = F.col("conv_id")
    start = F.struct(F.when(k % 3 == 0, "2024-01-02").alias("date"), F.when(k % 3 != 0, "2024-01-02T10:00:00+00:00").alias("dateTime"))
    event = F.struct(
        k.cast("string").alias("id"), F.concat(F.lit("Kickoff "), k.cast("string")).alias("summary"), "description", F.concat(F.lit("Room "), (k % 5).cast("string")).alias("location"),
        F.transform("a", lambda x: x["p"]).alias("attendees"), start.alias("start"), start.alias("end"), F.when(k % 4 == 0, F.array(F.lit("RRULE:FREQ=DAILY"))).alias("recurrence"),
    )
    events = T.calendar_events(g.select("conv_id", F.to_json(event).alias("raw")), "raw")
    return events.select("conv_id", "title", "content", "participants", F.size("participants").cast("long").alias("attendee_count"), "is_all_day", "is_recurring", "start_time")


@query("SELECT conv_id, string_agg(CASE turn % 4 WHEN 0 THEN '# ' || text WHEN 1 THEN '- ' || text WHEN 2 THEN '- [x] ' || text ELSE '> ' || text || E'\\n  child ' || turn END, E'\\n\\n' ORDER BY turn) AS content FROM conversations WHERE text <> '' GROUP BY conv_id")
def block_documents(spark, d):
    """Trees of blocks in JSON, made from conversations, as Markdown."""
    c = load(spark, d, "conversations").where("text != ''")
    rich = F.array(F.struct(F.col("text").alias("plain_text")))
    child = F.array(F.struct(F.lit("paragraph").alias("type"), F.struct(F.array(F.struct(F.concat(F.lit("child "), F.col("turn").cast("string")).alias("plain_text"))).alias("rich_text")).alias("paragraph")))
    m = F.col("turn") % 4
    block = F.struct(
        F.element_at(F.array(*map(F.lit, ("heading_1", "bulleted_list_item", "to_do", "quote"))), (m + 1).cast("int")).alias("type"),
        *(F.when(m == i, F.struct(rich.alias("rich_text"), F.lit(True).alias("checked"))).alias(n) for i, n in enumerate(("heading_1", "bulleted_list_item", "to_do", "quote"))),
        F.when(m == 3, child).alias("_children"),
    )
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.to_json(block).alias("b")))).alias("bs"))
    trees = g.select("conv_id", F.concat(F.lit("["), F.array_join(F.transform("bs", lambda x: x["b"]), ","), F.lit("]")).alias("blocks"))
    return trees.select("conv_id", T.blocks_markdown("blocks").alias("content"))


@query("SELECT conv_id, string_agg(text, E'\\n' ORDER BY turn) AS content FROM conversations WHERE text <> '' AND turn % 3 <> 1 GROUP BY conv_id")
def mail_texts(spark, d):
    """Multipart messages in JSON, made from conversations: their plain parts, base64url decoded, in order; every third part is HTML."""
    c = load(spark, d, "conversations").where("text != ''")
    data = F.translate(F.base64(F.col("text").cast("binary")), "+/=\r\n", "-_")
    part = F.struct(F.when(F.col("turn") % 3 == 1, "text/html").otherwise("text/plain").alias("mimeType"), F.struct(data.alias("data")).alias("body"))
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", part.alias("p")))).alias("ps")).where(F.exists("ps", lambda x: x["turn"] % 3 != 1))
    payload = F.struct(F.lit("multipart/mixed").alias("mimeType"), F.transform("ps", lambda x: x["p"]).alias("parts"))
    return g.select("conv_id", T.mail_text(F.to_json(payload)).alias("content"))


@query("SELECT o_orderkey, 'Order ' || o_orderkey AS title, o_orderstatus AS status, ['a', o_orderpriority] AS tags, strftime(o_orderdate, '%Y-%m-%d') AS due, CASE WHEN o_orderkey % 2 = 0 THEN 'True' ELSE 'False' END AS done, (o_orderkey % 100)::VARCHAR AS price FROM orders")
def page_properties(spark, d):
    """Typed properties of pages in JSON, made from orders, as flat metadata."""
    o = load(spark, d, "orders")
    named = lambda n: F.struct(n.alias("name"))
    props = F.to_json(F.struct(
        F.struct(F.lit("title").alias("type"), F.array(F.struct(F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("plain_text"))).alias("title")).alias("Name"),
        F.struct(F.lit("status").alias("type"), named(F.col("o_orderstatus")).alias("status")).alias("Status"),
        F.struct(F.lit("multi_select").alias("type"), F.array(named(F.lit("a")), named(F.col("o_orderpriority"))).alias("multi_select")).alias("Tags"),
        F.struct(F.lit("date").alias("type"), F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("start")).alias("date")).alias("Due"),
        F.struct(F.lit("checkbox").alias("type"), (F.col("o_orderkey") % 2 == 0).alias("checkbox")).alias("Done"),
        F.struct(F.lit("number").alias("type"), (F.col("o_orderkey") % 100).alias("number")).alias("Price"),
    ))
    p = T.page_properties(props)
    out = o.select("o_orderkey", p.alias("p"))
    one = lambda n: F.get(F.col("p.values")[n], F.lit(0))
    return out.select("o_orderkey", "p.title", one("Status").alias("status"), F.col("p.values")["Tags"].alias("tags"), one("Due").alias("due"), one("Done").alias("done"), one("Price").alias("price"))


@query("SELECT conv_id, 'Call ' || conv_id AS title, list_sort(list_distinct(list(role || (turn % 3)))) AS speakers, string_agg(role || (turn % 3) || ': ' || trim(replace(text, E'\\n', ' ')), E'\\n' ORDER BY turn) AS content FROM conversations WHERE trim(text) <> '' GROUP BY conv_id")
def transcripts(spark, d):
    """Meetings as WebVTT, made from conversations: spoken lines and speakers."""
    c = load(spark, d, "conversations").where("trim(text) != ''")
    cue = F.concat(F.lit("00:00:0"), (F.col("turn") % 10).cast("string"), F.lit(".000 --> 00:00:09.000\n"), "role", (F.col("turn") % 3).cast("string"), F.lit(": "), F.trim(F.replace("text", F.lit("\n"), F.lit(" "))), F.lit("\n\n"))
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", cue.alias("t")))).alias("cs"))
    vtt = g.select("conv_id", F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform("cs", lambda x: x["t"]), "")).alias("vtt"))
    return vtt.select("conv_id", F.concat(F.lit("Call "), F.col("conv_id").cast("string")).alias("title"), T.voices("vtt").alias("speakers"), T.spoken("vtt").alias("content"))


@query("SELECT o_orderkey, 'Note ' || o_orderkey AS title, list_concat(['fm'], CASE WHEN o_orderkey % 2 = 0 THEN ['even'] ELSE [] END) AS tags, ['Page ' || (o_orderkey % 9)] AS links, CASE WHEN o_orderkey % 3 = 0 THEN '2024-05-06' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS created, 'Body [[Page ' || (o_orderkey % 9) || '|shown]]' || CASE WHEN o_orderkey % 2 = 0 THEN ' #even' ELSE '' END AS content FROM orders")
def vault_documents(spark, d):
    """Markdown notes with front matter, made from orders: titles, united tags, links, and the date of the front matter before the file's."""
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    raw = F.concat(
        F.lit("---\ntitle: Note "), k.cast("string"), F.lit("\ntags: [fm]\n"), F.when(k % 3 == 0, "date: 2024-05-06\n").otherwise(""), F.lit("---\n"),
        F.lit("Body [[Page "), (k % 9).cast("string"), F.lit("|shown]]"), F.when(k % 2 == 0, " #even").otherwise(""),
    )
    files = load(spark, d, "orders").select("o_orderkey", F.concat(F.lit("n/"), k.cast("string"), F.lit(".md")).alias("path"), raw.alias("raw"), day.alias("file_day"))
    out = T.vault_documents(files, "path", "raw", "file_day")
    return out.select("o_orderkey", "title", "tags", F.transform("links", lambda x: x["target"]).alias("links"), "created", "content")
