"""What leaves the engine: texts in exchange formats, files of a data export, merged and deleted rows."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.arrow import arrow_function


def file_name(name: Column, ending: str = "") -> Column:
    """Letters, digits, blanks, hyphens and underscores stay, others become underscores; 100 characters at most, `export` if nothing is left."""
    safe = F.substring(F.trim(F.regexp_replace(name, r"[^\p{L}\p{N} _-]", "_")), 1, 100)
    return F.concat(F.when(safe == "", "export").otherwise(safe), F.lit(ending))


def escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


#: Fixed formats: the heading of the list of sources, and the line about a text's making.
SOURCES = "Quellenverzeichnis"


def _made(at: Column, version: Column, kind: Column) -> Column:
    return F.concat(F.lit("Generiert: "), at, F.lit(" | "), version, F.lit(" | Typ: "), kind)


def markdown(title: Column, content: Column, at: Column, version: Column, kind: Column, sources: Column) -> Column:
    numbered = F.transform(sources, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s))
    listed = F.when(F.size(sources) > 0, F.concat(F.lit(f"\n---\n\n## {SOURCES}\n\n"), F.array_join(numbered, "\n"), F.lit("\n"))).otherwise("")
    return F.concat(F.lit("# "), title, F.lit("\n\n*"), _made(at, version, kind), F.lit("*\n\n---\n\n"), content, F.lit("\n"), listed)


def storage_xhtml(title: Column, content: Column, at: Column, version: Column, kind: Column, sources: Column) -> Column:
    paragraphs = F.transform(F.split(escaped(content), "\n\n"), lambda p: F.concat(F.lit("<p>"), F.replace(p, F.lit("\n"), F.lit("<br/>")), F.lit("</p>")))
    items = F.transform(sources, lambda s: F.concat(F.lit("<li>"), escaped(s), F.lit("</li>")))
    listed = F.when(F.size(sources) > 0, F.concat(F.lit(f"\n<hr/>\n<h2>{SOURCES}</h2>\n<ol>\n"), F.array_join(items, "\n"), F.lit("\n</ol>"))).otherwise("")
    return F.concat(F.lit("<h1>"), escaped(title), F.lit("</h1>\n<p><em>"), _made(at, version, kind), F.lit("</em></p>\n<hr/>\n"), F.array_join(paragraphs, "\n"), listed)


def chunk_files(chunks: DataFrame, document: str, order: str, text: str) -> DataFrame:
    """(name, content): one Markdown text for each document, its chunks in order parted by a blank line."""
    parts = F.array_sort(F.collect_list(F.struct(order, text)))
    g = chunks.groupBy(document).agg(F.array_join(F.transform(parts, lambda p: p[text]), "\n\n").alias("content"))
    return g.select(F.concat(F.lit("documents/"), file_name(F.col(document).cast("string"), ".md")).alias("name"), "content")


def export(tables: dict[str, DataFrame], files: DataFrame, path: str) -> None:
    """Each table as JSON lines in a folder of its name, and the files, dealt by name, as (name, content) JSON lines. A folder takes the place of an archive, which
    one task would have to write."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")
    files.write.mode("overwrite").json(f"{path}/files")


def new_rows(rows: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key isn't stored yet, each key once: an insert that ignores conflicts."""
    same = stored.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
    condition = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return rows.dropDuplicates(keys).join(same, condition, "left_anti")


@arrow_function("string")
def uuid5(names: pd.Series) -> pd.Series:
    """A fixed identifier for each name."""
    return names.map(lambda x: None if x is None else str(uuid.uuid5(uuid.NAMESPACE_DNS, x)))


def without_owners(tables: dict[str, tuple[DataFrame, str]], owners: DataFrame) -> dict[str, DataFrame]:
    """Each table without the rows of the owners (owner), for a rewrite of them all."""
    return {name: df.join(owners.select(F.col("owner").alias(key)), key, "left_anti") for name, (df, key) in tables.items()}


def swept(documents: DataFrame, expires: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """What stays and what has expired; without a time of expiry a document stays."""
    gone = F.coalesce(F.col(expires) < now, F.lit(False))
    return documents.where(~gone), documents.where(gone)
