"""Paged sources, streams that restart, chains whose batches run again, and states that follow feeds."""

import json
import os

from pyspark.sql import functions as F

from tessella.sources import paged as P
from tessella.streaming import chain as H


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def page(folder, name, *items):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w") as f:
        json.dump({"items": items}, f)


def test_pages_after_a_cursor(spark, tmp_path):
    folder = str(tmp_path / "pages")
    page(folder, "0001", {"id": 1}, "odd", {"id": 2})
    page(folder, "0002", {"id": 3})
    open(f"{folder}/0003", "w").write('not json\n{"items": null}\n')
    open(f"{folder}/_SUCCESS", "w").close()
    assert P.FolderClient(folder).healthy() and not P.FolderClient(folder + "x").healthy()
    assert [(r.cursor, r.position, r.item, r.error) for r in P.pages(spark, folder).orderBy("cursor", "position").collect()] == [
        ("0001", 0, '{"id": 1}', None), ("0001", 1, None, "no object: odd"), ("0001", 2, '{"id": 2}', None), ("0002", 0, '{"id": 3}', None), ("0003", 0, None, "no object: not json"),
    ]
    assert [r.item for r in P.pages(spark, "file:" + folder, "0001").where("item IS NOT NULL").collect()] == ['{"id": 3}']
    assert P.pages(spark, folder, "9").count() == 0 and P.pages(spark, folder + "x").count() == 0
    good, bad = P.normalised(P.pages(spark, folder), "id long, name string", ("id",))
    assert rows(good.select("id")) == [(1,), (2,), (3,)] and bad.count() == 2


def test_items_are_refused_with_a_reason(spark):
    df = spark.createDataFrame([("a", i, x, None) for i, x in enumerate(['{"id": 1, "name": "n"}', '{"id": "no number"}', '{"name": "m"}'])], P.SCHEMA)
    good, bad = P.normalised(df, "id long, name string", ("id",))
    assert rows(good.select("id", "name")) == [(1, "n")]
    assert rows(bad.select("position", "error")) == [(1, "not of the schema"), (2, "without id")]


def test_a_stream_goes_on_after_its_cursor(spark, tmp_path):
    folder, root = str(tmp_path / "pages"), str(tmp_path / "out")
    steps = [("items", "", lambda df: df.select("cursor", "item")), ("ids", "items", lambda df: df.select(F.get_json_object("item", "$.id").cast("long").alias("id")))]
    seen = []
    for n in range(3):
        page(folder, f"{n:04d}", {"id": 2 * n}, {"id": 2 * n + 1})
        H.fan_out(P.page_stream(spark, folder), root, steps).awaitTermination(60)  # a new query each time, from the checkpoint
        seen.append(rows(H.written(spark, root, "ids")))
    assert seen == [[(i,) for i in range(2 * n + 2)] for n in range(3)]
    H.fan_out(P.page_stream(spark, folder), root, steps).awaitTermination(60)
    assert rows(H.written(spark, root, "ids")) == seen[-1]


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "chain")
    broken = [True]

    def fails(df):
        if broken:
            broken.clear()
            raise RuntimeError("lost")
        return df.groupBy("k").count()

    steps = [("kept", "", lambda df: df.where("v > 0")), ("counts", "kept", fails), ("flags", "kept", lambda df: df.select("k", (F.col("v") > 1).alias("f")))]
    first = spark.createDataFrame([("a", 1), ("a", 2), ("b", 0)], "k string, v int")
    try:
        H.run_batch(first, 0, root, steps)
    except RuntimeError:
        pass
    for _ in range(2):
        H.run_batch(first, 0, root, steps)
    H.run_batch(spark.createDataFrame([("a", 5)], "k string, v int"), 1, root, steps)
    assert rows(H.written(spark, root, "kept")) == [("a", 1), ("a", 2), ("a", 5)] and rows(H.written(spark, root, "flags")) == [("a", False), ("a", True), ("a", True)]
    assert rows(H.written(spark, root, "counts")) == [("a", 1), ("a", 2)] and rows(H.written(spark, root, "counts", ["k"])) == [("a", 1)]


def test_states_follow_feeds_and_full_listings(spark):
    state = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, v string")
    feed = spark.createDataFrame([(1, "a2", 5, False), (1, "a1", 4, True), (2, None, 6, True), (4, "d", 1, None)], "id int, v string, n int, gone boolean")
    listing = spark.createDataFrame([(3, "c9"), (7, "x")], "id int, v string")
    assert rows(H.synced(state, feed, lambda: listing, "id", ["n"], "gone")) == [(1, "a2"), (3, "c"), (4, "d")]
    assert rows(H.synced(state, None, lambda: listing, "id", ["n"], "gone")) == [(3, "c9"), (7, "x")]
    assert rows(H.resynced(state, listing, "id")[1]) == [(1,), (2,)] and rows(H.followed(state, feed.limit(0), "id", ["n"], "gone")) == rows(state)


def test_recordings_come_once_over_late_and_repeated_pages(spark, tmp_path):
    folder = str(tmp_path / "pages")
    at = lambda day, u: {"uuid": u, "start": f"2024-03-{day:02d} 10:00:00"}
    batches = [[at(1, "a"), at(2, "b"), at(2, "b")], [at(2, "b"), at(3, "c"), at(9, "out")], [at(1, "a"), at(4, "d"), at(3, "c")]]
    got = []
    for n, items in enumerate(batches):
        page(folder, f"{n:04d}", *items)
        items = P.page_stream(spark, folder).select(F.from_json("item", "uuid string, start timestamp").alias("i")).select("i.*")
        q = H.first_seen_stream(items, "uuid", "start", "30 days", "2024-03-01", "2024-03-09").writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).format("parquet").option("path", str(tmp_path / "out")).start()
        q.awaitTermination(90)
        got.append([r.uuid for r in spark.read.parquet(str(tmp_path / "out")).orderBy("uuid").collect()])
    assert got == [["a", "b"], ["a", "b", "c"], ["a", "b", "c", "d"]]


def test_files_that_come_again_are_no_new_rows(spark, tmp_path):
    from tessella.streaming import rates

    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    os.makedirs(folder)
    for n, ids in enumerate(([1, 2], [2, 3, 3], [1, 4])):
        with open(f"{folder}/{n}.json", "w") as f:
            f.writelines(json.dumps({"id": i, "at": f"2024-01-01T00:0{n}:00"}) + "\n" for i in ids)
        stream = rates.ingest_stream(spark, folder, "id long, at timestamp", ["id"], "at")
        stream.writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).format("parquet").option("path", out).start().awaitTermination(60)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2, 3, 4]


def test_many_pages_are_read_by_few_tasks(spark, tmp_path):
    folder = str(tmp_path / "pages")
    for n in range(300):
        page(folder, f"{n:04d}", {"id": n})
    df = P.pages(spark, folder)
    assert df.rdd.getNumPartitions() == 100
    assert [r.item for r in df.orderBy("cursor").select("item").collect()] == [f'{{"id": {n}}}' for n in range(300)]
    assert [len(r.cursors) for r in P._runs([str(i) for i in range(200_001)])] == [1000] * 200 + [1] and P._runs([]) == []
