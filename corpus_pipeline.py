"""A corpus from raw documents to packed sequences: language ID, near-duplicates, repeated passages, benchmark contamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next stage's docs. All
but the last return the columns of `documents`. Extra columns, whatever their names, travel along unchanged.

In every stage a null text is a text without words, letters or bytes, texts are read whole however long they are, rows that share an id or have
none are rows of their own, and an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import drop_table, keeping, read, table
from tessella.llm.decontaminate import contamination
from tessella.llm.langid import fit_dictionaries, judged, training_rows
from tessella.llm.packing import default_vocabulary, pack
from tessella.llm.simhash import FIRST_ID, set_rows, similar_roots
from tessella.llm.suffixdedup import without_repeats


def _kept(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select("kept.*").select(*(F.col(f"`{c}`") for c in docs.columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the compression classifier accepts; `und` (null, empty or without a letter) and narrow margins go. Equal texts
    go or stay together. Nothing is changed in those that stay."""
    found = judged(docs, fit_dictionaries(training_rows(docs)), docs.columns)
    return _kept(found.where(~F.col("rejected")), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of five-word shingle sets with a similarity of 0.8 or more: that of the smallest id (null first), then of the
    least text hash, then of the least other columns. Fingerprints within 3 of 64 bits, found by the grid of segment popcounts, and prefixes of
    sets, which find what differs in more bits, give the pairs to try; whole sets decide each, so that no chance link of bits holds. Components are of texts, so rows that share an id, or have none, stay apart unless their texts
    are similar. Texts without words are similar to each other."""
    rows = table(set_rows(docs, "doc_id", "text", 5, bits=True), "set-rows")
    roots = similar_roots(docs, rows, "text", 5, 0.8)
    named = rows.join(roots, rows.set_hash == roots.node, "left").select("id", "text_hash", F.coalesce("root", "set_hash").alias("component"))
    stay = named.groupBy("component").agg(F.min(F.struct("id", "text_hash")).alias("s")).select("s.id", "s.text_hash")
    keyed = keeping(docs, docs.columns, "text").select("kept", F.coalesce(F.col("kept").getField("doc_id"), F.lit(FIRST_ID)).alias("id"), F.xxhash64(F.col("kept").getField("text")).alias("text_hash"))
    others = [F.col("kept").getField(f.name) for f in docs.schema if f.name != "text" and not any(x in f.dataType.simpleString() for x in ("map<", "variant", "interval"))]
    first = F.row_number().over(Window.partitionBy("id", "text_hash").orderBy(*others, F.lit(1)))
    return _kept(keyed.join(stay, ["id", "text_hash"], "left_semi").withColumn("first", first).where("first = 1"), docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the passages of 50 bytes or more that a smaller id has; n_chars follows the text (null: null)."""
    out = without_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item; without items, all of them."""
    found = contamination(docs, read(spark, sf_dir, "benchmark"), docs.columns)
    return _kept(found.where(~F.col("contaminated")), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens or a smaller power of two, with their ids; a null or empty text is the end id alone."""
    return pack(docs, default_vocabulary())


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Compression, fingerprints and tokenizing have no SQL; tests/llm compares each stage with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            drop_table(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
