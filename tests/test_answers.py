"""Answers, templates, flat blocks and subword chunks against hand-made cases, recursion and encoding again."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import answers as A
from tessella.operators import recognize as N
from tessella.operators import segments as G
from tessella.sources import tables


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_answers_of_all_kinds(spark):
    texts = [
        json.dumps({"persons": [{"name": "Ann", "confidence": "0.9"}, {"name": None}, {"name": "Low", "confidence": 0.74}, 3, None], "dates": [{"description": "launch", "date": "2024"}], "topics": []}),
        '{"persons": {"name": "Ann"}}', "{}", "null", "", None, "12", '{"risks": [{"description": "a \\"b\\"", "severity": ""}]} trailing', '{"goals": [{"description": "g", "confidence": -1}, {"description": "h", "confidence": "x"}, {"description": "\\t"}]}', '{"unknown": [1]}',
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    good, bad = A.typed_entities(df, "k", "t")
    assert rows(good.select("k", "list", "position", "kind", "name", "confidence", "details")) == [
        (0, "dates", 0, "topic", "launch", 0.8, {"date": "2024"}), (0, "persons", 0, "person", "Ann", 0.9, {}), (7, "risks", 0, "risk", 'a "b"', 0.8, {}),
    ]
    assert rows(bad) == sorted(
        [(0, "persons", 1, "without a name"), (0, "persons", 3, "no object"), (0, "persons", 4, "no object"), (1, "persons", -1, "no list"), (3, None, -1, "no object"), (4, None, -1, "no JSON"), (5, None, -1, "no JSON"), (6, None, -1, "no object"), (8, "goals", 0, "confidence"), (8, "goals", 1, "confidence")],
        key=repr,
    )
    assert A.typed_entities(df.limit(0), "k", "t")[0].count() == 0


def test_templates_name_what_is_missing(spark):
    df = spark.createDataFrame([(1, "x", None), (2, None, "{{ a }}"), (3, "$1 \\ {{b}}", "z")], "k int, a string, b string")
    text, missing = A.rendered("{{a}}-{{ b }}-{{c}}!", {"a": F.col("a"), "b": F.col("b")}, ("a",))
    assert rows(df.select("k", text.alias("t"), missing.alias("m"))) == [(1, "x--!", None), (2, None, "a"), (3, "$1 \\ {{b}}-z-!", None)]
    assert df.select(A.rendered("{{a}}", {"a": F.col("a")}, ("a", "gone"))[1].alias("m")).first().m == "gone"
    assert {r[0] for r in df.select(A.rendered("plain", {})[0]).collect()} == {"plain"}


@pytest.mark.parametrize("seed", [1, 2])
def test_paths_of_blocks_equal_recursion(spark, seed):
    rnd = random.Random(seed)
    blocks = [(f"b{i}", rnd.choice(["p1", "p2", "none", *(f"b{j}" for j in range(max(0, i - 6), i))]), rnd.randint(0, 2), i, f"line {i}") for i in range(60)]
    blocks += [("x1", "x2", 0, 0, "cycle"), ("x2", "x1", 0, 1, "cycle"), ("x1", "p1", 9, 0, "again")]
    children = {}
    for b in blocks:
        children.setdefault(b[1], []).append(b)

    def read(parent, depth, seen):
        for b in sorted(children.get(parent, []), key=lambda b: (b[2], b[3])) if depth < 5 else []:
            if b[0] not in seen:
                yield "  " * depth + b[4]
                yield from read(b[0], depth + 1, [*seen, b[0]])

    df = spark.createDataFrame(blocks, "block string, parent string, page_no int, position int, line string")
    pages = spark.createDataFrame([("p1",), ("p2",), ("p3",)], "page string")
    got = dict(rows(A.page_texts(A.block_paths(df, pages), "line")))
    assert got == {p: "\n".join(t) for p in ("p1", "p2") if (t := list(read(p, 0, [p])))}


def test_blocks_are_merged_not_broadcast(spark, tmp_path):
    made = spark.createDataFrame([("b1", "p1", 0, 0), ("b2", "b1", 0, 0)], "block string, parent string, page_no int, position int")
    made.write.parquet(str(tmp_path / "blocks"))
    blocks = spark.read.parquet(str(tmp_path / "blocks"))
    paths = A.block_paths(blocks, blocks.where("parent LIKE 'p%'").select(F.col("parent").alias("page")))
    paths.collect()
    plan = paths._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("vocabulary", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_counts_of_subword_chunks_equal_encoding_again(spark, vocabulary):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    b = G.file_bounds(public_tokenizers.path(vocabulary), 60, 12, 8)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").where("length(text) > 500").limit(40).collect()]
    for text in texts:
        for strategy in ("semantic", "paragraph"):
            segments = [s for s in (G._PARAGRAPH if strategy == "paragraph" else G._SENTENCE).split(text) if s.strip()]
            joiner = "\n\n" if strategy == "paragraph" else " "
            runs = {joiner.join(segments[i:j]) for i in range(len(segments)) for j in range(i + 1, min(len(segments), i + 40) + 1)}
            for content, n in G.packed(segments, joiner, b):
                assert n <= b.most and (n == b.count(content) if content in runs else any(content in s for s in segments))
    encoded = [0]
    counted = G.Bounds(60, 12, 8, lambda t: encoded.__setitem__(0, encoded[0] + 1) or t.split(), " ".join)
    segments = [f"s{i} t u." for i in range(200)]
    assert G.packed(segments, " ", counted)[0][1] == 60 and encoded[0] == 2 * len(segments) - 1


def test_mentions_read_each_text_once(spark):
    df = spark.createDataFrame([(1, "deadline: 2024-01-02, on 2024-01-02 and 3.4.2024. @ann.b"), (2, None)], "k int, t string")
    found = N.mentions(df, "k", "t")
    assert [(r.rule, r.name) for r in found.orderBy("position").collect()] == [("at_mention", "ann b"), ("date_iso", "2024-01-02"), ("date_iso", "3.4.2024")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_shared_folder_must_be_named_on_a_cluster():
    from types import SimpleNamespace as N_

    cluster = N_(conf=N_(get=lambda *_: None), sparkContext=N_(getCheckpointDir=lambda: None, master="spark://host:7077", applicationId="a"))
    with pytest.raises(RuntimeError):
        tables.shared_dir(cluster)


def test_breaks_are_the_same_whatever_the_parts(spark):
    from tessella.operators import analytics as Y
    from tessella.operators import chunking as K

    rnd = random.Random(6)
    df = spark.createDataFrame([(i % 2 if i % 9 else None, i * i, [rnd.random() + 0.1, rnd.random()]) for i in range(120)], "g int, o long, v array<double>")
    whole = rows(K.coherence_breaks(df, "g", "o", "v", 0.3))
    assert len(whole) > 5 and all(rows(K.coherence_breaks(df, "g", "o", "v", 0.3, part)) == whole for part in (2, 3, 7))
    places = Y.ranked_by_range(df, "g", "o", "n", 3)
    for g in (0, 1, None):
        assert [r.n for r in places.where(F.col("g").eqNullSafe(g)).orderBy("o").collect()] == list(range(df.where(F.col("g").eqNullSafe(g)).count()))


def test_parts_meet_what_contains_them(spark):
    from tessella.operators import ground as D

    rnd = random.Random(4)
    word = lambda n: "".join(rnd.choice("abc ü") for _ in range(rnd.randint(0, n)))
    parts, wholes = [(i % 2, word(5)) for i in range(60)], [(i % 2, word(12)) for i in range(60)]
    want = sorted({(o, t, w) for o, t in parts for p, w in wholes if o == p and t and t in w})
    got = D.containing(spark.createDataFrame(parts, "o int, t string"), spark.createDataFrame(wholes, "o int, w string"), "o")
    assert rows(got) == sorted(want, key=repr) and len(want) > 50
    titles = spark.createDataFrame([("x", " Plan A"), ("y", "")], "owner string, title string")
    texts = spark.createDataFrame([(i, o, f"It is so [Quelle: {t}, 1.1.2024].") for i, (o, t) in enumerate([("x", "plan"), ("x", "The plan A now"), ("x", "other"), ("y", "zzz"), ("z", "any")])], "k int, owner string, t string")
    assert [r.n_valid for r in D.grounded(texts, "k", "t", titles, "owner").orderBy("k").collect()] == [1, 1, 0, 1, 1]


def test_counts_by_pieces_between_blanks_equal_encoding():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    word, byte = (G.FileTokenizer(public_tokenizers.path(v)) for v in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    assert word.blanks_part() and not byte.blanks_part()
    controls = list(word._tokenizer().get_added_tokens_decoder().values())[:3]
    texts = ["", " ", "It's  a\u00a0caf\u0065\u0301,\n\n 12\x1f3\u2028x \u0301y \U0001f600'll", *(f"a{c.content} b {c.content}c" for c in controls)]
    for t in (word, byte):
        assert [t.count(x) for x in texts] == [len(t.encode(x)) for x in texts]
    encoded = [0]
    b = G.Bounds(60, 12, 8, lambda t: encoded.__setitem__(0, encoded[0] + 1) or t.split(), " ".join, blanks_part=lambda: True)
    segments = [f"s{i} t u." for i in range(200)]
    assert G.packed(segments, " ", b)[0][1] == 60 and encoded[0] == len(segments)


def test_chunks_of_many_long_texts_are_sent_on_in_bounded_batches(spark, monkeypatch):
    sizes, bound = [], G.map_rows

    def small(rows, columns, work, schema):
        texts = [["a b. " * 400, None, "", "x"] * 3]
        sizes.extend(len(out[0]) for out in work(iter([[list(range(12)), *texts, ["semantic"] * 12]])))
        return bound(rows, columns, work, schema)

    monkeypatch.setattr(G, "map_rows", small)
    monkeypatch.setattr(G, "HELD", 100)
    df = spark.createDataFrame([(1, "a b. c d."), (2, None), (3, "")], "k int, t string")
    assert rows(G.chunks(df, "k", "t", bounds=G.Bounds(2, 0, 1))) == [(1, 0, "a b.", 2), (1, 1, "c d.", 2), (3, 0, "", 0)]
    assert len(sizes) >= 3
