"""Operators against hand-made cases and versions by brute force."""

import io
import json
import random
import re
import uuid
import zipfile
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tessella.operators import analytics as A
from tessella.operators import enrich as E
from tessella.operators import ground as D
from tessella.operators import index as X
from tessella.operators import ingest as I
from tessella.operators import recognize as N
from tessella.operators import resolve as R
from tessella.operators import search as S
from tessella.operators import segments as G
from tessella.operators import sinks as K
from tessella.operators import state as W
from tessella.sources import structured as T
from tessella.sources import tables
from tessella.streaming import stateful


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_sentences_know_abbreviations():
    text = "Dr. Ann met J. Roe at 3. 14 people came. Art. 5 holds! \"So?\" Yes. vgl. Das geht. end"
    assert G.sentences(text) == ["Dr. Ann met J. Roe at 3. 14 people came.", 'Art. 5 holds! "So?"', "Yes. vgl. Das geht. end"]
    assert G.sentences("  ") == []


def test_coherent_chunks_by_hand():
    embed = lambda parts: [[1.0, 0.0] if "cat" in p else [0.0, 1.0] if "dog" in p else [0.7, 0.7] for p in parts]
    text = "A cat sat. The cat ran. One cat slept. A dog came. The dog ate. One dog left."
    b = G.Bounds(most=12, overlap=0, least=2)
    got = G.coherent(text, embed, b)
    assert [c for c, _, _ in got] == ["A cat sat. The cat ran. One cat slept.", "One cat slept. A dog came. The dog ate. One dog left."]
    assert [round(m, 6) for _, _, m in got] == [1.0, 1.0] and [n for _, n, _ in got] == [9, 12]
    assert [c for c, _, _ in G.coherent(text, embed, G.Bounds(most=4, least=1))][:2] == ["A cat sat.", "A cat sat. The cat ran. One cat slept."[:10] + " The cat ran."]
    assert G.coherent("", embed, b) == [("", 0, 0.0)] and G.coherent("One cat.", embed, b) == [("One cat.", 2, 1.0)]
    assert G.breakpoints([0.9, 0.1, 0.9, 0.1, 0.9, 0.9, 0.9, 0.9], 1.0, 3) == [2] and G.breakpoints([0.9, 0.1]) == []


def test_chunks_with_a_subword_tokenizer(spark):
    b = G.Bounds(most=8, overlap=2, least=3, encode=list, decode="".join)
    df = spark.createDataFrame([(1, "abcdefghijkl"), (2, "ab"), (3, None), (4, "Ab cd. Ef gh. Ij kl.")], "k int, t string")
    got = rows(G.chunks(df, "k", "t", bounds=b))
    assert got == [(1, 0, "abcdefgh", 8), (1, 1, "ghijkl", 6), (2, 0, "ab", 2), (4, 0, "Ab cd.", 6), (4, 1, "Ef gh.", 6), (4, 2, "Ij kl.", 6)]


def test_near_names_equal_all_pairs(spark):
    rnd = random.Random(4)
    stored = ["".join(rnd.choice("abcde ") for _ in range(rnd.randint(1, 24))).strip() or "a" for _ in range(150)]
    asked = []
    for s in stored[:100]:
        x = list(s)
        for _ in range(rnd.randint(0, 3)):
            at = rnd.randrange(len(x) + 1)
            x[at:at] = rnd.choice("abcde")
            if len(x) > 2 and rnd.random() < 0.5:
                del x[rnd.randrange(len(x))]
        asked.append("".join(x).strip())
    frame = lambda names: spark.createDataFrame([(i % 2, n) for i, n in enumerate(names)], "owner int, name string")
    want = set()
    for o in (0, 1):
        known = {n for i, n in enumerate(stored) if i % 2 == o}
        for n in {n for i, n in enumerate(asked) if i % 2 == o and n} - known:
            scored = [(-SequenceMatcher(None, n, k).ratio(), k) for k in known]
            best = min(s for s in scored)
            if -best[0] >= 0.85:
                want.add((o, n, best[1], round(-best[0], 6)))
    assert set(rows(R.near_names(frame(asked), frame(stored), ["owner"]))) == want and len(want) > 20
    assert (R.part_size(0.85), R.part_size(0.6)) == (2, 1)
    low = {(min((-SequenceMatcher(None, n, k).ratio(), k) for k in {k for i, k in enumerate(stored) if i % 2 == o}), o, n) for o, n, *_ in want}
    got = {(o, n): (m, s) for o, n, m, s in rows(R.near_names(frame(asked), frame(stored), ["owner"], 0.6))}
    assert len(got) >= len(want) and all(got[o, n] == (k, round(-s, 6)) for (s, k), o, n in low)


def test_names_a_letter_apart_are_settled_before_parts_are_compared(spark):
    stored = [f"maria {i:04d} nordstrom".translate(str.maketrans("0123456789", "bcdfghklmn")) for i in range(300)] + ["ab", "abcdefgh", "abcdefghij"]
    asked = [s.replace("strom", "stroem") for s in stored[:300:3]] + ["abc", "abcdefgx", "abcdefghijk" * 30, "prof anna " + stored[0]]
    frame = lambda names: spark.createDataFrame([(1, n) for n in names], "owner int, name string")
    known = frame(stored).withColumnRenamed("name", "match")
    settled = {r.name: r.match for r in R.settled_names(frame(asked), known, ["owner"], 0.85).collect()}
    assert settled == {a: a.replace("stroem", "strom") for a in asked[:100]}
    best = [(n, *min((-SequenceMatcher(None, n, k).ratio(), k) for k in stored)) for n in asked]
    want = {(1, n, k, round(-s, 6)) for n, s, k in best if -s >= 0.85}
    assert set(rows(R.near_names(frame(asked), frame(stored), ["owner"]))) == want and len(want) == 101


def test_near_names_broadcasts_only_common_parts(spark, tmp_path, monkeypatch):
    """However small Spark takes the names to be; and parts beyond the most frequent ones change nothing."""
    stored = [f"maria {i:03d} nordstrom".translate(str.maketrans("0123456789", "bcdfghklmn")) for i in range(60)] + ["walter f ingenhoven"]
    asked = [s.replace("strom", "stroem") for s in stored[::3]] + ["walther v. ingenhoven"]
    frame = lambda names: spark.createDataFrame([(1, n) for n in names], "owner int, name string")
    frame(asked).write.parquet(f"{tmp_path}/asked")
    frame(stored).write.parquet(f"{tmp_path}/stored")
    near = R.near_names(spark.read.parquet(f"{tmp_path}/asked"), spark.read.parquet(f"{tmp_path}/stored"), ["owner"])
    joins = re.findall(r"BroadcastHashJoin.*|BroadcastNestedLoopJoin.*", near._jdf.queryExecution().executedPlan().toString())
    assert len(joins) == 2 and all(re.search(r"BroadcastHashJoin \[p#", j) for j in joins)
    want = rows(near)
    assert len(want) == 21 and (1, "walther v. ingenhoven", "walter f ingenhoven") in [r[:3] for r in want]
    monkeypatch.setattr(R, "COMMON", 3)
    assert rows(R.near_names(frame(asked), frame(stored), ["owner"])) == want


def test_common_subsequences_bound_the_ratio():
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 62)))
    a, b = [word() for _ in range(200)], [word() for _ in range(200)]

    def longest(x, y):
        row = [0] * (len(y) + 1)
        for c in x:
            before = row[:]
            for j, d in enumerate(y):
                row[j + 1] = before[j] + 1 if c == d else max(row[j], before[j + 1])
        return row[-1]

    assert R.common_subsequences(a, b).tolist() == [longest(x, y) for x, y in zip(a, b, strict=True)]
    assert R.near_ratios(a + ["x" * 100], b + ["x" * 99 + "y"], 0.5) == [r if (r := R.name_ratio(x, y)) >= 0.5 else None for x, y in zip(a + ["x" * 100], b + ["x" * 99 + "y"], strict=True)]


def test_names_and_titles(spark):
    assert R.normal_name("  Jörg  MÜLLER-Straße É ") == "joerg mueller-strasse e"
    docs = spark.createDataFrame([(1, "Annual plan"), (2, "Plan"), (3, None), (4, "Budget 2024 final")], "doc long, title string")
    refs = spark.createDataFrame([("plan",), ("Annual planing",), ("Budgt 2024 finals",), ("zzz",), ("the budget 2024 final draft",)], "title string")
    got = {r.title: (r.doc, r.score) for r in R.match_titles(refs, docs, most=2).collect()}
    near = round(SequenceMatcher(None, "budgt 2024 finals", "budget 2024 final").ratio(), 6)
    assert got == {"plan": (2, 1.0), "annual planing": (1, 0.9), "budgt 2024 finals": (4, near), "the budget 2024 final draft": (4, 0.9)}


def test_entities_are_resolved(spark):
    stored = spark.createDataFrame([(1, "person", "maria nordstrom", 3, 5, 9)], "owner int, kind string, name string, mentions long, first_seen int, last_seen int")
    found = spark.createDataFrame([(1, 7, "person", "Maria Nordström", 0.8, "email", 2), (1, 7, "person", "Maria Nordstrom", 1.0, "at", 3), (1, 8, "topic", "Maria Nordstron", 1.0, "at", 4)], "owner int, chunk int, kind string, name string, confidence double, rule string, at int")
    merged, links = R.resolve(found, stored, "owner")
    assert rows(merged) == [(1, "person", "maria nordstrom", 5, 2, 9, False), (1, "topic", "maria nordstron", 1, 4, 4, True)]
    assert rows(links) == [(1, "person", "maria nordstrom", 7, 1.0, "email"), (1, "topic", "maria nordstron", 8, 1.0, "at")]


def test_entities_are_grouped_by_tasks_of_one_size(spark, tmp_path, monkeypatch):
    known = [(o, f"part {i}", 2, i, i + 1) for o in range(3) for i in range(0, 40, 2)]
    said = [(i % 3, i, f" PART  {i % 40}", 0.8 + i % 2 / 10, "rule", i) for i in range(400)] + [(0, i, "often", 0.9, "rule", i) for i in range(300)]
    spark.createDataFrame(known, "owner int, name string, mentions long, first_seen int, last_seen int").write.parquet(str(tmp_path / "stored"))
    spark.createDataFrame(said, "owner int, chunk int, name string, confidence double, rule string, at int").write.parquet(str(tmp_path / "found"))
    stored, found = (spark.read.parquet(str(tmp_path / n)).withColumn("kind", F.lit("topic")) for n in ("stored", "found"))
    want = {(o, n): (m, a, b, False) for o, n, m, a, b in known}
    for o, _, n, _, _, at in said:
        m, a, b, new = want.get((o, n := R.normal_name(n)), (0, at, at, True))
        want[o, n] = (m + 1, min(a, at), max(b, at), new)
    for piece, least in ((1 << 30, 4), (1 << 10, 9)):
        monkeypatch.setattr(tables, "PIECE_BYTES", piece)
        merged, links = R.resolve(found, stored, "owner")
        parts = tables.pieces(found, stored)
        assert parts >= least and merged.rdd.getNumPartitions() == links.rdd.getNumPartitions() == parts
        assert {(r.owner, r.name): (r.mentions, r.first_seen, r.last_seen, r.is_new) for r in merged.collect()} == want and links.count() == 700
        dealt = re.findall(r"hashpartitioning\([^\n]*_salt[^\n]*?, (\d+)\), (\w+)", merged._jdf.queryExecution().executedPlan().toString())
        assert set(dealt) == {(str(parts), "REPARTITION_BY_NUM")}


def test_index_equals_scan(spark, tmp_path):
    rnd = random.Random(1)
    words = ["für", "the", "and", "with", "été", "x_1", "b2"]
    docs = spark.createDataFrame([(i, " ".join(rnd.choice(words) + rnd.choice(["", ",", "!"]) for _ in range(rnd.randint(0, 12)))) for i in range(200)] + [(900, None)], "doc_id long, text string")
    index = X.build(docs, str(tmp_path / "index"))
    for q in ("the AND", "für été", "x_1", "nothing", "", "b2 the with"):
        assert rows(X.lookup(index, q)) == rows(S.keyword_matches(docs, q))
    plan = index.rows.where("part = 3 AND term = 'the'")._jdf.queryExecution().executedPlan().toString()
    assert "(part" in plan.split("PartitionFilters")[1].split("PushedFilters")[0] and "EqualTo(term,the)" in plan


def test_upsert_takes_the_last_of_a_key_and_nulls_as_keys(spark):
    old = spark.createDataFrame([(1, None, "old"), (2, "a", "old")], "k int, s string, v string")
    new = spark.createDataFrame([(1, None, "x"), (1, None, "y"), (3, "b", "z")], "k int, s string, v string")
    assert rows(I.upsert(old, new, ["k", "s"], "v")) == [(1, None, "y"), (2, "a", "old"), (3, "b", "z")]
    a, b = spark.createDataFrame([(None, "x"), (1, "y")], "k int, t string"), spark.createDataFrame([(None, "x"), (1, "z"), (2, "y")], "k int, t string")
    assert {r.k for r in I.changed(a, b, "k", "t").collect()} == {1, 2}


def test_budget_prefix_equals_running_sum(spark):
    rnd = random.Random(2)
    data = [(rnd.choice("ab"), i * 3, rnd.randint(0, 9)) for i in range(3000)]
    df = spark.createDataFrame(data, "g string, o long, t int")
    got = {(r.g, r.o): r.running_tokens for r in A.budget_prefix(df, "g", "o", "t", 500, range_rows=16).collect()}
    want = {}
    for g in "ab":
        total = 0
        for _, o, t in sorted(x for x in data if x[0] == g):
            total += t
            if total <= 500:
                want[(g, o)] = total
    assert got == want
    assert A.budget_prefix(df.limit(0), "g", "o", "t", 5).count() == 0


def test_ner_of_metadata_and_dates(spark):
    df = spark.createDataFrame(
        [(1, "Frist: 01.02.2024 und 01.02.2024. Wir haben uns entschieden: los geht es! Ja", [("Ann B", ""), ("", "bob.c@x.org"), ("", "")], [("Plan X", "Project"), ("Y", "odd"), (" ", "topic")])],
        "k int, t string, people array<struct<name:string,email:string>>, links array<struct<title:string,type:string>>",
    )
    got = [(r.rule, r.kind, r.name) for r in N.mentions(df, "k", "t", [N.participants(F.col("people")), N.page_links(F.col("links"))]).orderBy("position").collect()]
    assert got == [("date_iso", "date_ref", "01.02.2024"), ("decision_keyword", "decision", "los geht es"), ("participant", "person", "Ann B"), ("participant", "person", "Bob C"), ("page_link", "project", "Plan X"), ("page_link", "topic", "Y")]


def test_statements_and_clean_up(spark):
    text = "# Head. Two\n\n- a. B\n  Eins. Zwei! drei? Vier\n--- x. Y"
    assert spark.range(1).select(D.statements(F.lit(text)).alias("s")).first().s == ["# Head. Two", "", "- a. B", "Eins.", "Zwei! drei?", "Vier", "--- x. Y"]
    cut = lambda *a: spark.range(1).select(D.without_references(F.lit("a  [x] b [y] [x]"), F.array(F.lit("[x]")), *a).alias("s")).first().s
    assert cut() == "a b [y]" and cut("!") == "a [x] ! b [y] [x] !"


def test_readers_of_trees(spark):
    blocks = [
        {"type": "callout", "callout": {"icon": {"emoji": "*"}, "rich_text": [{"plain_text": "Note"}]}, "_children": [{"type": "toggle", "toggle": {"rich_text": [{"plain_text": "In"}]}}]},
        {"type": "divider"}, {"type": "code", "code": {"language": "py", "rich_text": [{"plain_text": "x"}]}}, {"type": "image", "image": {"external": {"url": "u"}, "caption": [{"plain_text": "c"}]}},
        {"type": "image", "image": {}}, {"type": "child_page", "child_page": {"title": "P"}}, {"type": "bookmark", "bookmark": {"url": "b"}}, {"type": "equation", "equation": {"expression": "e"}}, {"type": "odd", "odd": {}},
        {"type": "paragraph", "paragraph": {"rich_text": [{"plain_text": "Hi ", "type": "text"}, {"plain_text": "@Ann", "type": "mention", "mention": {"type": "user", "user": {"id": "7", "name": "Ann"}}}]}},
    ]
    df = spark.createDataFrame([(json.dumps(blocks),), ("not json",), (None,)], "b string")
    got = df.select(T.blocks_markdown("b").alias("m"), T.block_mentions("b").alias("p")).collect()
    assert got[0].m == "> * Note\n  > **In**\n\n---\n\n```py\nx\n```\n\n![c](u)\n\n[Image: ]\n\n[Page: P]\n\n[b](b)\n\n$$e$$\n\nHi @Ann" and got[1].m == got[2].m == ""
    assert [tuple(x) for x in got[0].p] == [("user", "7", "Ann")]
    doc = {"body": {"content": [{"paragraph": {"paragraphStyle": {"namedStyleType": "HEADING_2"}, "elements": [{"textRun": {"content": "Title\n"}}]}}, {"paragraph": {"bullet": {"nestingLevel": 1}, "elements": [{"textRun": {"content": "item\n"}}]}}, {"table": {"tableRows": [{"tableCells": [{"content": [{"paragraph": {"elements": [{"textRun": {"content": c}}]}}]} for c in row]} for row in ("ab", "cd")]}}]}}
    assert spark.createDataFrame([(json.dumps(doc),)], "d string").select(T.document_markdown("d").alias("m")).first().m == "## Title\n\n  - item\n\n| a | b |\n| --- | --- |\n| c | d |"


def test_archives(spark):
    def packed(files):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for n, t in files:
                z.writestr(n, t)
        return out.getvalue()

    data = [packed([("a/b.md", "B"), ("../up.MD", "U"), (".trash/x.md", "no"), ("c.txt", "no")]), b"broken", None, packed([(f"{i}.md", "") for i in range(T.MOST_FILES + 1)])]
    got = spark.createDataFrame([(i, bytearray(d) if d is not None else None) for i, d in enumerate(data)], "i int, d binary").select("i", T.zip_notes("d").alias("z")).orderBy("i").collect()
    assert [(r.z.error, [tuple(f) for f in r.z.files]) for r in got] == [(None, [("a/b.md", "B"), ("up.MD", "U")]), ("not an archive", []), ("not an archive", []), ("too many files", [])]


def test_notes_recordings_and_cursors(spark):
    files = spark.createDataFrame([("n/a.md", "---\ntitle: 'T'\ntags: [x, \"y\"]\n---\nBody #z", "2024", False), ("n/b.MD", "plain", "2023", False), ("n/c.md", "gone", "2022", True)], "path string, raw string, at string, deleted boolean")
    got = [(r.title, r.tags, r.created, r.content, r.is_deleted) for r in T.vault_documents(files, "path", "raw", "at", "deleted").collect()]
    assert got == [("T", ["x", "y", "z"], "2024", "Body #z", False), ("b", [], "2023", "plain", False), ("c", [], "2022", "", True)]
    meetings = spark.createDataFrame([("u1", "Call", [("Ann", "a@x", None, None), ("Bob", "", "bob.m4a", "participant_audio")], "WEBVTT\n\nAnn: hi", "t.vtt"), ("u1", "Call", [], "", ""), ("u2", None, None, " text ", "t.txt"), ("u3", "", [], "", "")], "uuid string, topic string, files array<struct<user_name:string,user_email:string,file_name:string,recording_type:string>>, transcript string, name string").dropDuplicates(["uuid"])
    out = {r.uuid: (r.title, r.content, r.participants) for r in T.recordings(meetings, spark.createDataFrame([("u3",)], "uuid string")).collect()}
    assert out["u1"] == ("Call", "Ann: hi", ["Ann", "Bob", "a@x", "bob.m4a"]) and out["u2"] == ("", "text", []) and "u3" not in out
    c = spark.createDataFrame([('{"watermark":"w","next_page_token":"p"}',), ("2024-01-01",), ("{bad",)], "c string").select(T.cursor(F.col("c")).alias("x")).collect()
    assert [tuple(r.x) for r in c] == [("w", "p"), ("2024-01-01", None), ("{bad", None)]


def test_exports(spark, tmp_path):
    names = ["Ab c_d-é", "a/b:*", "", "x" * 120]
    assert [r.n for r in spark.createDataFrame([(n,) for n in names], "n string").select(K.file_name(F.col("n")).alias("n")).collect()] == ["Ab c_d-é", "a_b__", "export", "x" * 100]
    assert spark.createDataFrame([("a:1",), (None,)], "n string").select(K.uuid5("n").alias("u")).collect()[0].u == str(uuid.uuid5(uuid.NAMESPACE_DNS, "a:1"))
    chunks = spark.createDataFrame([(1, 1, "b"), (1, 0, "a")], "d int, i int, t string")
    K.export({"chunks": chunks}, K.chunk_files(chunks, "d", "i", "t"), str(tmp_path / "out"))
    assert rows(spark.read.json(str(tmp_path / "out" / "files")).select("name", "content")) == [("documents/1.md", "a\n\nb")] and spark.read.json(str(tmp_path / "out" / "chunks")).count() == 2


def test_breaker_and_window_by_hand():
    b = W.Breaker(3, 100)
    assert [b.call(t, ok) for t, ok in ((0, False), (1, False), (2, False), (50, True), (102, False), (150, True), (203, True), (204, False))] == [
        ("closed", True, "closed"), ("closed", True, "closed"), ("closed", True, "open"), ("open", False, "open"), ("half_open", True, "open"), ("open", False, "open"), ("half_open", True, "closed"), ("closed", True, "closed")
    ]
    closed, half_open = W.Window(1, 10), W.Window(1, 10)
    assert [closed.ask(t, True) for t in (0, 10, 11)] == [(True, 0), (False, 0), (True, 0)] and [half_open.ask(t, False) for t in (0, 10, 19)] == [(True, 0), (True, 0), (False, 0)]


def test_filters_hold_ends_and_cache_prefers_the_newest(spark):
    hits = spark.createDataFrame([(1, "zoom", 1), (2, "notion", 2), (3, "notion", 3)], "chunk_id int, source string, created_at int")
    assert {r.chunk_id for r in E.filtered(hits, None, F.lit(1), F.lit(2), ["ZOOM"]).collect()} == {2}
    stored = spark.createDataFrame([("s", 1, 1, [1.0, 0.0]), ("s", 2, 2, [1.0, 0.01]), ("t", 3, 3, [0.0, 1.0])], "scope string, answer_id int, at int, vector array<double>")
    asked = spark.createDataFrame([("s", 10, [1.0, 0.0]), ("s", 11, [1.0, 0.005]), ("s", 12, [0.0, 1.0])], "scope string, ask_id int, vector array<double>")
    assert [(r[0], r[1]) for r in rows(E.cached(asked, stored, ["scope"]))] == [(10, 1), (11, 2), (12, None)]


def test_limits_on_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    events = [("u", t) for t in (0, 1, 2, 12, 13)] + [("v", 5)]
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps({"who": w, "at": t}) for w, t in events[:3]))
    (tmp_path / "in" / "b.json").write_text("\n".join(json.dumps({"who": w, "at": t}) for w, t in events[3:]))
    stream = spark.readStream.schema("who string, at long").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = stateful.limited_stream(stream, "who", "at", 2, 10).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.read.parquet(str(tmp_path / "out")).select("who", "at", "accepted")) == [("u", 0, True), ("u", 1, True), ("u", 12, True), ("u", 13, True), ("u", 2, False), ("v", 5, True)]


def test_queries_reach_their_branches(spark):
    """Comparisons with SQL say little where a branch has no row."""
    from tessella.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    values = lambda name, column: {r[0] for r in QUERIES[name](spark, sf).select(column).distinct().collect()}
    assert values("snapshot_diff", "state") == {"added", "removed", "changed"} and values("khop_neighbours", "hops") == {1, 2, 3}
    assert values("entity_upsert", "is_new") == {True, False} and values("circuit_breaker", "met") == {"closed", "open", "half_open"}
    assert values("sliding_limiter", "accepted") == {True, False} and values("grounded_statements", "confidence") == {"high", "medium", "low"}
    assert values("assumption_states", "status") >= {"confirmed", "refuted", "revised"} and values("typed_edges", "edge_type") == {"PARTICIPATED_IN", "WORKS_ON", "RELATES_TO"}
    assert QUERIES["prefix_autocomplete"](spark, sf).count() > 0 and values("eval_metrics_per_query", "ndcg") >= {0.0}


@pytest.mark.parametrize("quantile", [0.0, 0.5, 1.0])
def test_bucket_quantiles(spark, quantile):
    from tessella.streaming import rates

    df = spark.createDataFrame([("a", 0.5), ("a", 1.5), ("a", 3.0), ("b", 99.0)], "l string, v double")
    got = {r.l: r.value for r in rates.bucket_quantiles(df, "l", "v", (1.0, 2.0, 4.0), (quantile,)).collect()}
    assert got["a"] == {0.0: 0.0, 0.5: 1.5, 1.0: 4.0}[quantile] and got["b"] == 4.0


def test_values_not_above_zero_lie_in_no_bucket(spark):
    from tessella.streaming import rates

    df = spark.createDataFrame([("a", 0.0), ("a", -1.0), ("a", 0.5), ("a", 1.5), ("a", 3.0), ("b", 0.0), ("c", None)], "l string, v double")
    assert rows(rates.bucket_quantiles(df, "l", "v", (1.0, 2.0, 4.0), (0.5,))) == [("a", 0.5, 1.5, 3)]


def test_a_title_that_a_document_holds_goes_before_a_nearer_ratio(spark):
    docs = spark.createDataFrame([(1, "red rod 13"), (2, "red rod 311"), (3, "red rod 3x"), (4, "blue sky")], "doc int, title string")
    refs = spark.createDataFrame([("Red rod 31",), ("blue sly",), ("red rod 13",), ("nothing like it",)], "title string")
    got = {r.title: (r.doc, r.score) for r in R.match_titles(refs, docs, most=2).collect()}
    assert got == {"red rod 31": (2, 0.9), "blue sly": (4, 0.875), "red rod 13": (1, 1.0)}


def test_a_snapshot_has_each_mentioned_part_once(spark, tmp_path):
    from tessella.queries import QUERIES

    line = [(0, 1), (0, 2), (3, 1), (3, 2), (3, 7), (1, 9)]
    spark.createDataFrame(line, "l_orderkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(k, "n", "t") for k in (1, 1, 2, 70)], "p_partkey long, p_name string, p_type string").write.parquet(str(tmp_path / "part.parquet"))
    assert rows(QUERIES["snapshot_capture"](spark, str(tmp_path))) == [(3, 3, [1, 2, 7], ["1:2=2", "1:7=1", "2:7=1"], [2, 2, 1])]
    assert rows(QUERIES["snapshot_comparison"](spark, str(tmp_path)).select("entities_added", "relationships_added")) == [(1, 2)]


def test_lists_of_a_snapshot_without_pairs_are_null_as_in_sql(spark, tmp_path):
    import duckdb

    from tessella.queries import ORACLES, QUERIES

    spark.createDataFrame([(3 * k, k) for k in range(12)], "l_orderkey long, l_partkey long").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(k, f"n{k}", "t") for k in range(12)], "p_partkey long, p_name string, p_type string").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for name in ("snapshot_capture", "snapshot_comparison"):
        want = con.execute(ORACLES[name])
        names = [x[0] for x in want.description]
        assert rows(QUERIES[name](spark, str(tmp_path)).select(*names)) == want.fetchall()
    assert rows(QUERIES["snapshot_capture"](spark, str(tmp_path)).select("relationships")) == [(None,)]
