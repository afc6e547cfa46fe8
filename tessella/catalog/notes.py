"""Texts that Spark derives from the order tables: notes with decisions, dates and mentions, and briefings that cite parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.sources.tables import load


def notes(spark, d) -> DataFrame:
    """One note for each order: (o_orderkey, o_custkey, day, text). Which lines it has depends on the order's key."""
    k = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    line = lambda cond, *parts: F.when(cond, F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)))
    text = F.concat_ws(
        "\n",
        line(F.lit(True), "Decision: ship order ", k.cast("string"), " by rail. More text follows."),
        line(k % 2 == 0, "Deadline: ", day, " for all."),
        line(F.lit(True), "cc @Clerk.", (k % 7).cast("string"), " and ann.user", (k % 11).cast("string"), "@example.com"),
        line(k % 3 == 0, "Risk: late delivery of ", F.col("o_orderpriority"), "! Act now"),
        line(k % 4 == 0, "Open question: who pays for ", F.col("o_orderstatus"), "?"),
        line(k % 5 == 0, "Goal: reach ", k.cast("string"), " units."),
        line(k % 6 == 0, "bis Freitag"),
        line(k % 8 == 0, "I will send the papers by tomorrow"),
        line(k % 9 == 0, "TODO: count boxes"),
        line(k % 10 == 0, "Teilnehmer: Ann, Bob ,, Cy"),
    )
    return load(spark, d, "orders").select("o_orderkey", "o_custkey", day.alias("day"), text.alias("text"))


#: The same notes in SQL, for texts that SQL compares.
NOTES = """SELECT o_orderkey AS k, o_custkey AS c, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority AS p, o_orderstatus AS s, o_orderdate FROM orders"""


def briefings(spark, d) -> DataFrame:
    """One briefing for each customer with orders: (c_custkey, text); every second cites a part that exists, every third one that doesn't."""
    k = F.col("c_custkey")
    part = F.concat(F.lit("Part "), (k % 50).cast("string"))
    text = F.concat(
        F.lit("# Report "), k.cast("string"), F.lit("\n\nOrders went out."),
        F.when(k % 2 == 0, F.concat(F.lit(" Stock is fine [Quelle: "), part, F.lit(", 01.02.2024]."))).otherwise(""),
        F.when(k % 3 == 0, F.lit(" Prices rose [Quelle: Unknown thing, 02.03.2024].")).otherwise(""),
        F.lit("\n- bullet stays. As one"),
    )
    return load(spark, d, "customer").select("c_custkey", text.alias("text"))
