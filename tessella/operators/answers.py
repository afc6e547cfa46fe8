"""Typed entities from a model's answers, texts from templates, and pages from flat blocks."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import columns as C
from tessella.operators.recognize import squeezed

#: The lists of an answer: kind of entity, field that names it, fields that are kept beside it, confidence where none is given.
LISTS = {
    "persons": ("person", "name", ("role", "context"), 0.8),
    "projects": ("project", "name", ("status",), 0.8),
    "topics": ("topic", "name", (), 0.8),
    "decisions": ("decision", "what", ("by", "date"), 0.8),
    "open_questions": ("open_question", "text", (), 0.7),
    "dates": ("topic", "description", ("date",), 0.8),
    "goals": ("goal", "description", ("status",), 0.8),
    "risks": ("risk", "description", ("severity", "mitigation"), 0.8),
    "hypotheses": ("hypothesis", "statement", ("status",), 0.8),
}


def typed_entities(answers: DataFrame, key: str, text: str, least: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """Entities (key, list, position, kind, name, normalized, confidence, details) of at least `least` confidence, and what is refused (key, list, position,
    reason): an answer without JSON or that is no object, a list that is none, an item that is no object, an item whose name is missing or no text, a confidence that is no
    number from 0 to 1. A blank name is left out; refusing one item keeps the others."""
    read = answers.select(key, C.json_in(F.col(text)).alias("_j")).withColumn("_v", F.try_parse_json("_j"))
    whole = F.when(F.col("_v").isNull(), "no JSON").when(~F.schema_of_variant("_v").startswith("OBJECT"), "no object")
    read = read.withColumn("_bad", whole)
    parts = []
    for name, (kind, named, details, usual) in LISTS.items():
        raw = F.get_json_object("_j", f"$.{name}")
        items = F.from_json(raw, "array<string>")
        wrong = F.when(raw.isNotNull() & ~F.ltrim(raw).startswith("["), "no list")
        get = lambda x, f: F.get_json_object(x, f"$.{f}")
        item = lambda x, i: F.struct(
            F.lit(name).alias("list"), i.alias("position"), F.lit(kind).alias("kind"), x.alias("raw"), get(x, named).alias("name"), get(x, "confidence").alias("confidence"),
            F.map_filter(F.map_from_arrays(F.array(*map(F.lit, details)).cast("array<string>"), F.array(*(get(x, f) for f in details)).cast("array<string>")), lambda k, v: F.coalesce(v, F.lit("")) != "").alias("details"), F.lit(usual).alias("usual"), F.lit(None).cast("string").alias("wrong"),
        )
        none = F.array(F.struct(F.lit(name).alias("list"), F.lit(-1).alias("position"), F.lit(kind).alias("kind"), raw.alias("raw"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("confidence"), F.create_map().cast("map<string,string>").alias("details"), F.lit(usual).alias("usual"), wrong.alias("wrong")))
        parts.append(F.when(wrong.isNotNull(), none).otherwise(F.transform(F.coalesce(items, F.array().cast("array<string>")), item)))
    each = read.where("_bad IS NULL").select(key, F.explode(F.concat(*parts)).alias("m")).select(key, "m.*")
    quoted = F.try_parse_json("raw")
    number = F.col("confidence").try_cast("double")
    reason = (
        F.when(F.col("wrong").isNotNull(), F.col("wrong")).when(F.coalesce(~F.schema_of_variant(quoted).startswith("OBJECT"), F.lit(True)), "no object")
        .when(F.col("name").isNull(), "without a name").when(F.col("confidence").isNotNull() & (number.isNull() | ~number.between(0, 1)), "confidence")
    )
    each = each.withColumn("reason", reason).withColumn("value", F.coalesce(number, F.col("usual")))
    name = C.stripped(F.col("name"))
    good = each.where(F.col("reason").isNull() & (name != "") & (F.col("value") >= least))
    entities = good.select(key, "list", "position", "kind", name.alias("name"), squeezed(name).alias("normalized"), F.col("value").alias("confidence"), "details")
    refused = read.where("_bad IS NOT NULL").select(key, F.lit(None).cast("string").alias("list"), F.lit(-1).alias("position"), F.col("_bad").alias("reason"))
    return entities, refused.unionByName(each.where("reason IS NOT NULL").select(key, "list", "position", "reason"))


_HOLE = re.compile(r"\{\{\s*(\w+)\s*\}\}")


def rendered(template: str, values: dict[str, Column], required: tuple[str, ...] = ()) -> tuple[Column, Column]:
    """A template's text with `{{ name }}` replaced by the columns' values, and the names of required ones that are missing or null, joined by commas, null if none.
    Optional nulls are empty; where a required one is missing there is no text. A value that looks like a hole stays as it is."""
    missing = F.array_compact(F.array(*(F.when(values[n].isNull(), F.lit(n)) if n in values else F.lit(n) for n in required))) if required else F.array().cast("array<string>")
    parts = _HOLE.split(template)  # text and names in turn
    pieces = [F.lit(p) if i % 2 == 0 else F.coalesce(values[p].cast("string"), F.lit("")) if p in values else F.lit("") for i, p in enumerate(parts)]
    none = F.size(missing) == 0
    return F.when(none, F.concat(*pieces)), F.when(~none, F.array_join(missing, ", "))


def block_paths(blocks: DataFrame, pages: DataFrame, depth: int = 5) -> DataFrame:
    """(page, block, depth, path) and the columns of `blocks` (block, parent, page_no, position) for all that hang below the pages (page), at most `depth` levels deep:
    one join by parent for each level, no recursion. `page_no` is the part of a parent's list, in pages, that holds the block; the path orders a page's blocks as they are
    read, each before its children. A block that lists one of its own ancestors is not followed again. Blocks are merged, never broadcast: all of them, five times
    in each task, are more than a task holds once there are millions."""
    step = F.format_string("%08d.%08d", F.col("page_no"), F.col("position"))
    level = pages.select("page", F.col("page").alias("_at"), F.lit("").alias("path"), F.array("page").alias("_seen"))
    found = []
    for at in range(depth):
        held = level.join(blocks.hint("merge"), level["_at"] == blocks["parent"]).where(~F.array_contains("_seen", F.col("block")))
        rows = held.select("page", F.lit(at).alias("depth"), F.concat("path", F.lit("/"), step).alias("path"), *blocks.columns, F.concat("_seen", F.array("block")).alias("_seen"))
        found.append(rows.drop("_seen"))
        level = rows.select("page", F.col("block").alias("_at"), "path", "_seen")
    return reduce(DataFrame.unionByName, found)


def page_texts(paths: DataFrame, line: str) -> DataFrame:
    """(page, text): a page's lines in the order of its blocks, indented by depth."""
    row = F.struct("path", F.concat(F.repeat(F.lit("  "), F.col("depth")), F.col(line)).alias("line"))
    return paths.groupBy("page").agg(F.array_sort(F.collect_list(row)).alias("l")).select("page", F.array_join(F.col("l.line"), "\n").alias("text"))
