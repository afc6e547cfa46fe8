"""Column expressions that the operators share; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days that documents are kept, by source; anything else is kept 365 days.
RETENTION_DAYS = {"google_calendar": 365, "google_docs": 730, "notion": 730, "obsidian": 730, "zoom": 180, "slack": 365, "outlook_mail": 365}
#: Hours that a briefing is valid, by kind; anything else 24.
BRIEFING_HOURS = {"morning": 24, "meeting": 48, "weekly": 168}
#: How sources are split; then by content type, if a map is given; anything else by sentences.
STRATEGIES = {"obsidian": "paragraph", "notion": "paragraph", "zoom": "semantic", "google_calendar": "fixed"}
#: Fixed pattern: a reference to a source in a text, with title and date.
REFERENCE = r"\[Quelle:\s*([^,\]]+),\s*([^\]]+)\]"


def stripped(text: Column) -> Column:
    """Without blanks, tabs and line ends on both sides."""
    return F.btrim(text, F.lit(" \t\n\r\f\x0b"))


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def certainty(a: Column, b: Column) -> Column:
    return (1 + cosine(a, b)) / 2


def recency(age_days: Column, boost_days: float = 7.0) -> Column:
    """Sigmoid around `boost_days`; now and the future count 1, no date 0."""
    return F.when(age_days.isNull(), 0.0).when(age_days <= 0, 1.0).otherwise(1 / (1 + F.exp((age_days - boost_days) / (boost_days / 3))))


def reranked(cos: Column, rrf: Column, low: Column, high: Column, fresh: Column) -> Column:
    """(0.6 cosine + 0.3 normalised fusion score) x (1 + 0.1 recency)."""
    norm = (rrf - low) / F.when(high == low, 1.0).otherwise(high - low)
    return (0.6 * F.coalesce(cos, F.lit(0.0)) + 0.3 * norm) * (1 + 0.1 * fresh)


def edge_weight(count: Column, days: Column) -> Column:
    """A base that fades with the days since, and a step for each further occurrence; between 0 and 1."""
    return F.least(F.greatest(0.3 * F.exp(-0.01 * days) + 0.1 * (count - 1), F.lit(0.0)), F.lit(1.0))


def banded(similarity: Column) -> Column:
    return F.when(similarity > 0.7, "high").when(similarity >= 0.5, "medium").otherwise("low")


def retention_days(kind: Column) -> Column:
    return mapped(RETENTION_DAYS, kind, 365)


def briefing_hours(kind: Column) -> Column:
    return mapped(BRIEFING_HOURS, kind, 24)


def words(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores of any alphabet."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " "), " "), lambda w: w != "")


def endpoint_group(path: Column) -> Column:
    """Third segment of /api/v1/ paths, else `other`."""
    p = F.split(F.regexp_replace(path, "^/+|/+$", ""), "/")
    return F.when((F.size(p) >= 3) & (F.get(p, F.lit(0)) == "api") & (F.get(p, F.lit(1)) == "v1"), F.get(p, F.lit(2))).otherwise("other")


def mapped(values: dict, key: Column, default) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[key], F.lit(default))


def email_name(email: Column) -> Column:
    parts = F.filter(F.split(F.substring_index(email, "@", 1), r"[._\-+]"), lambda p: p != "")
    return F.array_join(F.transform(parts, F.initcap), " ")


def strategy(source: Column, content_type: Column | None = None, by_type: dict[str, str] | None = None) -> Column:
    """How a document is split: by its source, else by its content type, else semantic."""
    other = mapped({k.lower(): v for k, v in by_type.items()}, F.lower(content_type), "semantic") if content_type is not None and by_type else F.lit("semantic")
    return F.coalesce(F.create_map(*(F.lit(x) for kv in STRATEGIES.items() for x in kv))[source], other)


def citations(text: Column) -> Column:
    """Title, date and the whole of each reference, in order."""
    parts = [F.regexp_extract_all(text, F.lit(REFERENCE), i) for i in (1, 2, 0)]
    return F.transform(F.arrays_zip(*(p.alias(n) for p, n in zip(parts, ("title", "date", "raw"), strict=True))), lambda r: F.struct(F.trim(r["title"]).alias("title"), F.trim(r["date"]).alias("date"), r["raw"].alias("raw")))


def minutes_seconds(seconds: Column) -> Column:
    s = F.floor(seconds)
    return F.format_string("%02d:%02d", F.floor(s / 60), s % 60)


def month_start_back(as_of: Column, months: int) -> Column:
    return F.add_months(F.trunc(as_of, "month"), -months)


def json_in(text: Column) -> Column:
    """The JSON of an answer: the whole of it, else a fenced block, else what stands from the first to the last brace; null if none can be parsed."""
    tries = (stripped(text), stripped(F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)), F.regexp_extract(text, r"(?s)(\{.*\})", 1))
    return F.coalesce(*(F.when((t != "") & F.try_parse_json(t).isNotNull(), t) for t in tries))
