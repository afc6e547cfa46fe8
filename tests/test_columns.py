"""Column expressions and readers by hand-computed cases."""

import pytest
from pyspark.sql import functions as F

from tessella.functions import columns as C
from tessella.operators import analytics as A
from tessella.operators import ingest as I
from tessella.operators import search as S
from tessella.sources import structured as D
from tessella.sources import tables as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_recency_and_weights(spark):
    assert one(spark, C.recency(F.lit(7.0))) == pytest.approx(0.5)
    assert one(spark, C.recency(F.lit(-1.0))) == 1 and one(spark, C.recency(F.lit(0.0))) == 1 and one(spark, C.recency(F.lit(None).cast("double"))) == 0
    assert one(spark, C.edge_weight(F.lit(1), F.lit(0))) == pytest.approx(0.3)
    assert one(spark, C.edge_weight(F.lit(30), F.lit(0))) == 1
    assert one(spark, C.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0


def test_text_columns(spark):
    assert one(spark, C.email_name(F.lit("max.muster-mann@x.de"))) == "Max Muster Mann"
    assert one(spark, I.html_stripped(F.lit("<P>a&auml;&#39;&amp;b</P><SCRIPT>bad()</SCRIPT><p>c<BR/>d</p><style>x</script></style>e"))) == "aä'&b\nc\nd\ne"
    assert one(spark, I.html_stripped(F.lit(" a&&ampUn &ltx &copy; &#x41; &nosuch; &notit; b&nbsp;"))) == "a&&ampUn &ltx © A &nosuch; &notit; b\xa0"
    assert one(spark, C.minutes_seconds(F.lit(75.9))) == "01:15"
    assert [tuple(r) for r in one(spark, C.citations(F.lit("so [Quelle: Plan , 01.02.2024].")))] == [("Plan", "01.02.2024", "[Quelle: Plan , 01.02.2024]")]
    assert one(spark, C.words(F.lit("Für café, l'été_2!"))) == ["für", "café", "l", "été_2"]
    assert [one(spark, C.endpoint_group(F.lit(x))) for x in ("/api/v1/user/settings", "/api/v1/", "/api/v2/user", "x")] == ["user", "other", "other", "other"]
    assert [one(spark, C.strategy(F.lit(x), F.lit("Markdown"), {"markdown": "paragraph"})) for x in ("notion", "zoom", "google_calendar", "mail")] == ["paragraph", "semantic", "fixed", "paragraph"]
    assert one(spark, C.strategy(F.lit("mail"))) == "semantic"
    assert [one(spark, C.banded(F.lit(x))) for x in (0.71, 0.7, 0.5, 0.49)] == ["high", "medium", "medium", "low"]
    assert [one(spark, C.briefing_hours(F.lit(x))) for x in ("morning", "meeting", "weekly", "other")] == [24, 48, 168, 24]
    assert [one(spark, C.retention_days(F.lit(x))) for x in ("zoom", "notion", "fax")] == [180, 730, 365]
    assert str(one(spark, C.month_start_back(F.lit("2024-03-15").cast("date"), 3))) == "2023-12-01"
    assert [one(spark, C.json_in(F.lit(x))) for x in ('{"a":1}', "x ```json\n{\"b\":2}\n``` y", 'so {"c":3} it', "none {x", "")] == ['{"a":1}', '{"b":2}', '{"c":3}', None, None]
    vtt = "WEBVTT\n\n1\n00:00:01.000 --> 00:00:02.000\nAnn: Hi: there\n\nplain\n"
    formats = [("a.bin", "  \n" + vtt), ("a.txt", "1\n00:00:01,000 --> 00:00:02,000\nx"), ("a.SRT", ""), ("a.txt", "-" * 500 + "00:00:01,000 --> 00:00:02,000"), (None, "x")]
    assert [one(spark, T.transcript_format(F.lit(n).cast("string"), F.lit(c))) for n, c in formats] == ["vtt", "srt", "srt", "txt", "txt"]
    assert one(spark, D.spoken(F.lit(vtt))) == "Ann: Hi: there\nplain" and one(spark, D.voices(F.lit(vtt))) == ["Ann"]
    assert [tuple(r) for r in one(spark, T.wikilinks(F.lit("[[ B |x]] [[A]] [[A|z]]")))] == [("B", "x"), ("A", None)]
    assert one(spark, T.hashtags(F.lit("#b x#no #ä/c\n#b (#no)"))) == ["b", "ä/c"]


def test_fusion_and_measures(spark):
    s = spark.createDataFrame([(1, 1), (2, 2)], "doc_id long, rank int")
    k = spark.createDataFrame([(2, 1), (3, 2)], "doc_id long, rank int")
    got = {r.doc_id: r.rrf for r in S.rrf(s, k, "doc_id").collect()}
    assert got[1] == pytest.approx(0.75 / 61) and got[2] == pytest.approx(0.75 / 62 + 0.25 / 61) and got[3] == pytest.approx(0.25 / 62)
    run = spark.createDataFrame([("q", 1, 9), ("q", 2, 1), ("q", 3, 2)], "qid string, pos int, doc_id long")
    rel = spark.createDataFrame([("q", 1, 1), ("q", 2, 1)], "qid string, doc_id long, grade int")
    m = S.eval_metrics(run, rel, 2).first()
    assert (m.rr, m.precision, m.recall) == (0.5, 0.5, 0.5) and m.ap == pytest.approx((1 / 2 + 2 / 3) / 2, abs=1e-6)
    judged = rel.unionByName(spark.createDataFrame([("none", 1, 3)], "qid string, doc_id long, grade int"))
    measures = {r.qid: r for r in S.eval_metrics(run, judged, 2).collect()}
    assert set(measures) == {"q", "none"} and tuple(measures["none"])[1:] == (0, 0, 0, 0, 0)
    report = {r.metric: r for r in S.eval_report(S.eval_metrics(run, judged, 2)).collect()}
    assert report["rr"].mean == 0.25 and report["rr"].sd == pytest.approx(0.353553, abs=1e-6)
    both = S.eval_metrics(run, rel, 2).withColumn("config", F.lit("a")).unionByName(S.eval_metrics(run, rel, 1).withColumn("config", F.lit("b")))
    assert {(r.config, r.mean) for r in S.eval_report(both, "config").where("metric = 'recall'").collect()} == {("a", 0.5), ("b", 0.0)}
    assert S.terms_of("Für: co-op, the THE") == ["für", "co", "op", "the"]
    docs = spark.createDataFrame([(1, "Ein Café für alle"), (2, "cafe fur"), (3, None), (4, "für das Café, für uns")], "doc_id long, text string")
    assert {r.doc_id: r.score for r in S.keyword_matches(docs, "café FÜR").collect()} == {1: 0.1, 4: 0.15}
    assert S.keyword_matches(docs, "?!").count() == 0 and S.top_k(0) == 10 and S.top_k(99) == 50


def test_peak_hours_wraps(spark):
    h = spark.createDataFrame([(23, 5), (0, 5), (1, 1), (10, 9)], "hour int, n long")
    assert tuple(A.peak_hours(h).first()) == (23, 2, 11)
    assert tuple(A.peak_hours(h.limit(0)).first()) == (None, None, None)


def test_vault(spark, tmp_path):
    (tmp_path / ".trash").mkdir()
    (tmp_path / "a.md").write_text("# x #tag")
    (tmp_path / ".trash" / "b.md").write_text("gone")
    assert [r.content for r in T.read_vault(spark, str(tmp_path)).collect()] == ["# x #tag"]
