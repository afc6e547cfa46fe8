"""Search against versions by brute force: cover density over all intervals, nearest vectors by index, all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessella.operators import index as X
from tessella.operators import search as S
from tessella.operators import vectors as V


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def cover_density(words, terms):
    """All intervals that hold every term, of these the ones that hold no other such interval."""
    good = [(a, z) for a in range(len(words)) for z in range(a, len(words)) if set(terms) <= set(words[a : z + 1])]
    least = [(a, z) for a, z in good if not any((a, z) != (b, y) and a <= b and y <= z for b, y in good)]
    return round(sum(0.1 / (1 + sum(w not in terms for w in words[a : z + 1])) for a, z in least), 6) if least else None


def test_ranks_are_cover_densities_over_all_intervals(spark, tmp_path):
    rnd = random.Random(8)
    texts = {i: [rnd.choice("ab ab cd e f g".split() + ["the"]) for _ in range(rnd.randint(0, 25))] for i in range(120)}
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()] + [(500, None), (501, "")], "doc_id long, text string")
    index = X.build(docs, str(tmp_path / "index"), parts=32)
    for q in ("ab", "ab cd", "the e f", "g the ab cd"):
        want = sorted(((i, s) for i, w in texts.items() if (s := cover_density(w, q.split())) is not None), key=repr)
        assert rows(X.lookup(index, q)) == want
        assert rows(S.keyword_matches(docs, q)) == want


def test_index_parts_follow_the_input_and_broken_builds_are_not_read(spark, tmp_path):
    class Plan:
        def __init__(self, size):
            self.size = size

        def __getattr__(self, _):
            return lambda: self.size if _ == "sizeInBytes" else self

    sized = lambda n: type("D", (), {"_jdf": Plan(n)})()
    assert [X.parts_for(sized(n)) for n in (10, 1 << 40, 1 << 50)] == [16, 128, 4096]
    docs = spark.createDataFrame([(1, "a b"), (2, "b")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    first = X.index_of(spark, str(tmp_path))
    assert rows(X.lookup(first, "b")) == [(1, 0.1), (2, 0.1)] and rows(X.most_used(first, 1)) == [("b", 2, 2)]
    docs.where("doc_id = 2").write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert rows(X.lookup(X.index_of(spark, str(tmp_path)), "b")) == [(2, 0.1)]


def test_nearest_vectors_by_scan_and_by_index(spark, tmp_path):
    rnd = np.random.default_rng(3)
    middles = rnd.normal(size=(12, 16))
    data = np.concatenate([middles[rnd.integers(0, 12, 600)] + 0.4 * rnd.normal(size=(600, 16)), np.zeros((1, 16))])
    df = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(data)] + [(5000, None, "x"), (5001, [1.0], "y")], "vec_id long, embedding array<double>, extra string")
    asked = df.where("vec_id % 40 = 0 AND size(embedding) = 16")
    unit = data / np.maximum(np.linalg.norm(data, axis=1, keepdims=True), 1e-300)
    want = [(q, int(i), r + 1, round((1 + float(unit[q] @ unit[i])) / 2, 6)) for q in range(0, 601, 40) for r, i in enumerate(np.lexsort((np.arange(601), -np.round((1 + unit @ unit[q]) / 2, 6)))[:5])]
    scan = V.in_blocks(asked, lambda a: V.neighbours(df, a, 5))
    got = {(r.query, r.rank): (r.vec_id, round(r.certainty, 6)) for r in scan.collect()}
    assert got == {(q, r): (i, s) for q, i, r, s in want}
    index = V.build(df.where("size(embedding) = 16"), str(tmp_path / "cells"))
    probes = V.calibrated(index, df, df.where("vec_id % 7 = 3 AND size(embedding) = 16"), 5, 0.98)
    assert 1 <= probes < len(index.centres) == 24
    found = V.search(index, asked, 5, probes)
    assert V.recall(found, scan).agg({"recall": "avg"}).first()[0] >= 0.9
    assert V.recall(V.search(index, asked, 5, len(index.centres)), scan).where("recall < 1").count() == 0
    plan = index.rows.where("cell = 3")._jdf.queryExecution().executedPlan().toString()
    assert "cell" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    empty = df.where("vec_id < 0")
    assert V.neighbours(df, empty).count() == 0 and V.search(V.build(empty, str(tmp_path / "none")), asked).count() == 0


def test_cells_that_hold_too_little_are_not_searched(spark, tmp_path, monkeypatch):
    rnd = np.random.default_rng(5)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rnd.normal(size=(400, 16)))], "vec_id long, embedding array<double>")
    asked, index, tried, search = df.where("vec_id % 20 = 5"), V.build(df, str(tmp_path / "cells")), [], V.search
    monkeypatch.setattr(V, "search", lambda i, a, k, probes, *more: tried.append(probes) or search(i, a, k, probes, *more))
    probes = V.calibrated(index, df, asked, 5, 0.9)
    assert tried[0] > 1 and (probes == tried[-1] or probes == len(index.centres))
    wanted = V.neighbours(df, asked, 5)
    assert V.recall(search(index, asked, 5, tried[0] // 2), wanted).agg({"recall": "avg"}).first()[0] < 0.9
    assert V.recall(search(index, asked, 5, probes), wanted).agg({"recall": "avg"}).first()[0] >= 0.9


def test_the_best_of_many_scores_are_those_of_all():
    rnd = np.random.default_rng(6)
    best, scores = V._Best(7, 4), np.round(rnd.random((7, 300)), 2)
    order = rnd.permutation(300)
    for at in np.array_split(order, 11):
        best.add_all(np.arange(7), scores[:, at], at)
    for q in range(7):
        first = np.lexsort((np.arange(300), -scores[q]))[:4]
        assert best.ids[q].tolist() == first.tolist() and best.scores[q].tolist() == scores[q, first].tolist()


def test_files_of_an_index_follow_its_size_and_split_a_frequent_term(spark, tmp_path):
    df = spark.range(400).selectExpr("id AS doc_id", "'the ' || id AS text")
    index = X.build(df, str(tmp_path / "i"), parts=4, files=8)
    files = [f for f in index.rows.inputFiles()]
    the = spark.read.parquet(str(tmp_path / "i")).where("term = 'the'").groupBy(F.input_file_name()).count().collect()
    assert len(files) <= 32 and len(the) == 8 and max(r[1] for r in the) < 100
    assert X.lookup(index, "the 7").count() == 1

    class Plan:
        def __init__(self, n):
            self.n = n

        def __getattr__(self, name):
            return (lambda: self.n) if name == "sizeInBytes" else lambda: self

    sized = lambda n: type("D", (), {"_jdf": Plan(n)})()
    assert [X.files_for(sized(n), 16) for n in (10, 1 << 30, 6 << 30)] == [1, 4, 24]


def test_postings_travel_in_packs_smaller_than_the_texts(monkeypatch, spark):
    rnd = random.Random(6)
    words = [f"word{i}" for i in range(3000)]
    docs = [(f"k{i}" if i else None, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 200)))) for i in range(300)]
    df = spark.createDataFrame(docs, "k string, t string")
    monkeypatch.setattr(X, "HELD", 5000)
    got = X.postings(df, 3, 2, "k", "t")
    want = {(w, k, len(t.split()), tuple(i for i, x in enumerate(t.split()) if x == w), X.part_of(w, 3)) for k, t in docs for w in t.split()}
    found = [(r.term, r.k, r.n_words, tuple(r.positions), r.part) for r in got.collect()]
    assert len(found) == len(want) and set(found) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"REPARTITION_BY_NUM|Exchange", plan) and re.search(r"MapInArrow .*number#\d+, pack#", plan)
    vocabulary = {}
    held = [X._read(pa.RecordBatch.from_arrays([pa.array([k for k, _ in docs]), pa.array([0] * 300, pa.int32()), pa.array([t for _, t in docs])], ["k", "file", "text"]), vocabulary, pa.string())]
    assert sum(len(x) for _, x in X._packs(held, vocabulary, 3, 1)) < 0.8 * sum(len(t) for _, t in docs)


def test_building_an_index_shuffles_less_than_twice_its_texts(spark, tmp_path):
    rnd = random.Random(7)
    words = [f"word{i}" for i in range(3000)]
    docs = [(i, " ".join(rnd.choice(words) for _ in range(200))) for i in range(1000)]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    sc = spark.sparkContext._jsc.sc()

    def written():
        sc.listenerBus().waitUntilEmpty(30_000)
        return sc.statusStore().executorList(False).apply(0).totalShuffleWrite()

    before = written()
    index = X.index_of(spark, str(tmp_path))
    assert 0 < written() - before < 2 * sum(len(t) for _, t in docs)
    assert index.rows.count() == sum(len(set(t.split())) for _, t in docs)
