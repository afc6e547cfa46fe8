"""Mentions of people, dates, decisions, questions, goals and risks by rules, and follow-ups. All rules are built-in regular expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import columns as C

#: Fixed patterns, in their order: rule, kind of entity, pattern, groups that hold the name, confidence.
RULES = (
    ("email", "person", r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", (0,), 1.0),
    ("at_mention", "person", r"(?<!\w)@([a-zA-Z][a-zA-Z0-9._\-]{0,63})", (1,), 1.0),
    ("date_iso", "date_ref", r"\b(\d{4}-\d{2}-\d{2})\b|\b(\d{1,2}\.\d{1,2}\.\d{4})\b|\b(\d{1,2}/\d{1,2}/\d{4})\b", (1, 2, 3), 1.0),
    (
        "deadline_keyword", "date_ref",
        r"(?iu)(?:deadline|frist|bis zum|bis|due by|due|faellig|fällig)\s*:?\s*(\d{4}-\d{2}-\d{2}|\d{1,2}\.\d{1,2}\.\d{4}|(?:montag|dienstag|mittwoch|donnerstag|freitag|samstag|sonntag"
        r"|monday|tuesday|wednesday|thursday|friday|saturday|sunday|morgen|tomorrow|heute|today|next\s+week|nächste\s+woche|naechste\s+woche"
        r"|end\s+of\s+(?:week|month|quarter|year)|ende\s+(?:der\s+woche|des\s+monats|des\s+quartals|des\s+jahres)))", (1,), 0.85,
    ),
    (
        "decision_keyword", "decision",
        r"(?iu)(?:(?:entscheidung|beschluss|decision|action\s*item|ergebnis)\s*:\s*(.{5,120})"
        r"|(?:wir\s+haben\s+(?:uns\s+)?entschieden|we\s+(?:have\s+)?decided|decision\s+was\s+made)\s*[,:.]?\s*(.{5,120}))", (1, 2), 0.85,
    ),
    (
        "question_keyword", "open_question",
        r"(?iu)(?:offene\s+frage|open\s+question|ungeklaert|ungeklärt|noch\s+zu\s+(?:klaeren|klären)|to\s+be\s+determined|tbd|open\s+item|ausstehend)\s*:?\s*(.{5,200})", (1,), 0.85,
    ),
    ("goal_keyword", "goal", r"(?iu)(?:ziel|goal|objective|milestone|target)\s*:\s*(.{5,200})", (1,), 0.85),
    ("risk_keyword", "risk", r"(?iu)(?:risiko|risk|gefahr|blocker)\s*:\s*(.{5,200})", (1,), 0.85),
)
#: Fixed patterns of commitments and open questions, in their order.
FOLLOW_UPS = (
    r"(?iu)(?:ich|wir)\s+(?:schicke?n?|sende?n?|liefere?n?|mache?n?|erledige?n?|bereite?n?\s+vor|klaere?n?|pruefe?n?)\s+.*?(?:bis|morgen|naechste\s+woche|montag|dienstag|mittwoch|donnerstag|freitag|heute)",
    r"(?iu)(?:bis|deadline|faellig|due)\s*:?\s*\d{1,2}[./]\d{1,2}(?:[./]\d{2,4})?",
    r"(?iu)(?:action\s+item|todo|to-do|follow[- ]?up)\s*:?\s+.{5,}",
    r"(?iu)(?:i(?:'ll| will)|we(?:'ll| will))\s+(?:send|deliver|prepare|check|review|follow up|get back)\s+.*?(?:by|tomorrow|next week|monday|tuesday|wednesday|thursday|friday|today|end of)",
    r"(?iu)(?:bitte|please)\s+(?:bis|by)\s+\w+\s+(?:erledigen|liefern|senden|fertigstellen|submit|complete|deliver)",
)
QUESTIONS = (r"(?iu)(?:offene?\s+frage|open\s+question|ungeklaert|noch\s+zu\s+klaeren|to\s+be\s+determined|tbd)\s*:?\s+.{5,}",)


def squeezed(name: Column) -> Column:
    return F.regexp_replace(C.stripped(F.lower(name)), r"\s+", " ")


def first_sentence(text: Column) -> Column:
    """Up to the first full stop or exclamation mark before a blank, or the line's end; closing marks go."""
    return F.regexp_replace(C.stripped(F.regexp_extract(text, r"(?s)^(.*?)(?:[.!](?=[ \n])|\.(?=[\r\t])|\n|$)", 1)), r"[.!,;:]+$", "")


def _names(text: Column, rule: tuple) -> Column:
    """Mentions of one rule in order: (rule, kind, name, confidence)."""
    label, kind, pattern, groups, confidence = rule
    found = [F.regexp_extract_all(text, F.lit(pattern), g) for g in groups]
    one = found[0] if len(found) == 1 else F.transform(F.arrays_zip(*(f.alias(f"g{i}") for i, f in enumerate(found))), lambda r: F.concat(*(r[f"g{i}"] for i in range(len(found)))))
    shape = {"email": C.email_name, "at_mention": lambda x: F.regexp_replace(x, r"[._\-]", " "), "date_iso": lambda x: x, "deadline_keyword": C.stripped}.get(label, lambda x: first_sentence(C.stripped(x)))
    named = F.filter(F.transform(one, shape), lambda x: x != "")
    return F.transform(named, lambda x: F.struct(F.lit(label).alias("rule"), F.lit(kind).alias("kind"), x.alias("name"), F.lit(confidence).alias("confidence")))


def participants(people: Column) -> Column:
    """Mentions from an array of (name, email): the name, else one made from the address; neither, none."""
    name = lambda p: F.when(F.trim(p["name"]) != "", F.trim(p["name"])).when(F.trim(p["email"]) != "", C.email_name(F.trim(p["email"])))
    known = F.filter(F.transform(F.coalesce(people, F.array()), name), lambda x: x.isNotNull())
    return F.transform(known, lambda x: F.struct(F.lit("participant").alias("rule"), F.lit("person").alias("kind"), x.alias("name"), F.lit(1.0).alias("confidence")))


def page_links(links: Column) -> Column:
    """Mentions from an array of (title, type); unknown types are topics."""
    kinds = {k: k for k in ("person", "project", "topic", "decision")}
    named = F.filter(F.coalesce(links, F.array()), lambda x: F.trim(x["title"]) != "")
    return F.transform(named, lambda x: F.struct(F.lit("page_link").alias("rule"), C.mapped(kinds, F.lower(F.trim(x["type"])), "topic").alias("kind"), F.trim(x["title"]).alias("name"), F.lit(1.0).alias("confidence")))


def mentions(df: DataFrame, key: str, text: str, extra: list[Column] = ()) -> DataFrame:
    """(key, position, rule, kind, name, normalized, confidence) in the order of rules; a date that the text names twice counts once. Each text is read
    once by each rule, and nothing is exchanged."""
    found = F.concat(*(_names(F.col(text), r) for r in RULES), *extra)
    rows = df.select(key, F.transform(found, lambda x: x.withField("normalized", squeezed(x["name"]))).alias("_m"))
    rows = rows.withColumn("_dates", F.transform("_m", lambda x: F.when(x["kind"] == "date_ref", x["normalized"])))
    once = F.filter("_m", lambda x, i: (x["kind"] != "date_ref") | (F.array_position("_dates", x["normalized"]) == i + 1))
    return rows.select(key, F.posexplode(once).alias("position", "m")).select(key, "position", "m.rule", "m.kind", "m.name", "m.normalized", "m.confidence")


def entities(mentions: DataFrame, key: str) -> DataFrame:
    """Mentions of one text with one kind and normalized name, under the first name: (key, kind, normalized, name, n, confidence, first_rule)."""
    return mentions.groupBy(key, "kind", "normalized").agg(
        F.min_by("name", "position").alias("name"), F.count(F.lit(1)).alias("n"), F.max("confidence").alias("confidence"), F.min_by("rule", "position").alias("first_rule")
    )


def _kept(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("kind"), F.substring(C.stripped(x), 1, 200).alias("text"))


def follow_ups(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, position, kind, text): commitments, then open questions, cut to 200 characters, each text once whatever its case."""
    each = [(p, "follow_up") for p in FOLLOW_UPS] + [(p, "open_question") for p in QUESTIONS]
    found = F.concat(*(F.transform(F.regexp_extract_all(F.col(text), F.lit(p), 0), _kept(kind)) for p, kind in each))
    low = F.transform(found, lambda x: F.lower(x["text"]))
    once = F.filter(found, lambda x, i: F.array_position(low, F.lower(x["text"])) == i + 1)
    return df.select(key, F.posexplode(once).alias("position", "m")).select(key, "position", "m.*")


def participant_line(content: Column) -> Column:
    """Names of the first line `Teilnehmer: a, b` or `Participants: a, b`."""
    line = F.regexp_extract(content, r"(?im)^[ \t]*(?:teilnehmer|participants)\s*:\s*(.+)$", 1)
    return F.filter(F.transform(F.split(line, ","), lambda x: C.stripped(x)), lambda x: x != "")
