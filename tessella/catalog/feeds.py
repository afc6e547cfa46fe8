"""Queries that read pages behind a cursor, follow feeds of changes, and write through chains. The given tables are put into pages by Spark first."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessella.registry import query
from tessella.sources import paged as P
from tessella.sources.tables import load, shared_dir
from tessella.streaming import chain as H


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _document_pages(spark, d, path: str, half: int) -> None:
    """Half of the documents as pages of 100 by id; every 50th lacks its id."""
    docs = load(spark, d, "documents").where(F.col("doc_id") % 200 >= 100 if half else F.col("doc_id") % 200 < 100)
    item = F.to_json(F.struct(F.when(F.col("doc_id") % 50 != 7, F.col("doc_id")).alias("id"), "lang", "source", F.length("text").alias("size")))
    P.write_pages(docs.select(F.format_string(f"{half}-%012d", F.expr("doc_id div 100")).alias("page"), item.alias("item")), path, "page")


_ITEM = "id long, lang string, source string, size long"


@query("SELECT doc_id AS id, lang, source, length(text)::BIGINT AS size FROM documents WHERE doc_id % 50 <> 7")
def paged_documents(spark, d):
    """Documents read from pages through a stream, in two runs of which the second begins at the first one's cursor; items without id are refused."""
    path, root = _folder(spark, "pages"), _folder(spark, "ingested")
    steps = [("items", "", lambda df: P.normalised(df, _ITEM, ("id",))[0].drop("cursor", "position"))]
    for half in (0, 1):
        _document_pages(spark, d, path, half)
        H.fan_out(P.page_stream(spark, path), root, steps).awaitTermination()
    return H.written(spark, root, "items")


@query("SELECT doc_id // 100 AS page, count(*) AS refused FROM documents WHERE doc_id % 50 = 7 GROUP BY ALL")
def refused_items(spark, d):
    """Items that lack their id, counted by page."""
    path = _folder(spark, "pages")
    _document_pages(spark, d, path, 0)
    _document_pages(spark, d, path, 1)
    bad = P.normalised(P.pages(spark, path), _ITEM, ("id",))[1].where("error = 'without id'")
    return bad.groupBy(F.regexp_extract("cursor", r"-(\d+)/", 1).cast("long").alias("page")).agg(F.count(F.lit(1)).alias("refused"))


@query("SELECT source, count(*) AS docs, sum(length(text))::BIGINT AS chars, count(*) FILTER (WHERE length(text) > 2000) AS long_docs FROM documents WHERE doc_id % 50 <> 7 GROUP BY source")
def chained_counts(spark, d):
    """Pages to items, items to counts by source, each step reading what the one before wrote for the batch; the first batch then runs again."""
    path, root = _folder(spark, "pages"), _folder(spark, "chain")
    count = lambda df: df.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("chars"), F.count_if(F.col("size") > 2000).alias("long_docs"))
    steps = [("items", "", lambda df: P.normalised(df, _ITEM, ("id",))[0]), ("counts", "items", count)]
    for half in (0, 1):
        _document_pages(spark, d, path, half)
        H.fan_out(P.page_stream(spark, path), root, steps).awaitTermination()
    H.run_batch(P.pages(spark, path).where("cursor LIKE 'page=0-%'"), 0, root, steps)
    sums = H.written(spark, root, "counts").groupBy("source")
    return sums.agg(*(F.sum(c).alias(c) for c in ("docs", "chars", "long_docs")))


_LAST = "last AS (SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS price, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY o_custkey)"


@query(f"WITH {_LAST} SELECT c_custkey, c_acctbal AS balance FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM last) UNION ALL SELECT o_custkey, price FROM last WHERE status <> 'F'")
def synced_by_feed(spark, d):
    """Customers as a state and orders as the feed of changes since a token: the last order sets the balance, a finished one is a tombstone."""
    state = load(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("balance"))
    feed = load(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("balance"), "o_orderkey", (F.col("o_orderstatus") == "F").alias("gone"))
    return H.synced(state, feed, lambda: state, "c_custkey", ["o_orderkey"], "gone")


@query("SELECT c_custkey, c_acctbal + 1 AS balance, FALSE AS is_gone FROM customer WHERE c_custkey % 10 <> 3 UNION ALL SELECT c_custkey, NULL, TRUE FROM customer WHERE c_custkey % 10 = 3")
def synced_by_listing(spark, d):
    """The same state where the token is void: a full listing replaces it, and what this lacks is gone."""
    state = load(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("balance"))
    listing = state.where("c_custkey % 10 != 3").withColumn("balance", F.col("balance") + 1)
    now, gone = H.resynced(state, listing, "c_custkey")
    return now.withColumn("is_gone", F.lit(False)).unionByName(gone.withColumn("is_gone", F.lit(True)), allowMissingColumns=True)


@query("SELECT user_id, min(ts) AS ts FROM events WHERE event_id % 3 = 0 GROUP BY user_id")
def first_seen_users(spark, d):
    """Each user's first event, from pages by day whose second half comes in a later run; seen users are state of the stream."""
    path, out = _folder(spark, "pages"), _folder(spark, "seen")
    events = load(spark, d, "events").where("event_id % 3 = 0").select("user_id", "ts", F.date_format("ts", "yyyy-MM-dd").alias("page"))
    middle = str(events.selectExpr("date_from_unix_date(percentile_approx(unix_date(CAST(ts AS DATE)), 0.5))").first()[0])
    for late in (False, True):
        some = events.where(F.col("page") >= F.lit(middle) if late else F.col("page") < F.lit(middle))
        P.write_pages(some.select("page", F.to_json(F.struct("user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"))).alias("item")), path, "page")
        rows = P.page_stream(spark, path).select(F.from_json("item", "user_id long, at string").alias("i")).select("i.user_id", F.col("i.at").cast("timestamp").alias("ts"))
        stream = H.first_seen_stream(rows, "user_id", "ts", "3650 days").writeStream.option("checkpointLocation", f"{out}/_checkpoint").trigger(availableNow=True)
        stream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/rows/batch={n}")).start().awaitTermination()
    return spark.read.schema("user_id long, ts timestamp").parquet(f"{out}/rows").select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
