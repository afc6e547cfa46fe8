"""Sharding by proportional stratified interleaving, with DataFrame functions only.

Rows of each stratum (source) are shuffled by a seeded hash and ranked; row r of a stratum of n rows gets the fractional
rank (2r+1)/2n. In the order of fractional rank every stretch of rows has the mixture of the whole, so cutting it into equal
stretches gives shards that match the mixture and whose row counts differ by one at most.

Exact ranks without a task that holds a whole stratum: rows are counted by (stratum, hash range), a running sum over those
few counts gives the rank at which each range starts, and row_number() works inside a range only. The hash spreads a hot
stratum over all ranges. The same is done again for the order of fractional ranks. Texts are never shuffled.

Null text: size 1, crc32 of no bytes. A null stratum or id is a value like any other. Repeated rows keep their number; equal rows
are interchangeable. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import read, table

HASH_BITS = 60

def _positions(rows: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """0-based position `out` of each row inside keys[:-1], by keys[-1] (a range number) and then `order`; `out`_n: rows there."""
    outer = Window.partitionBy(*keys[:-1]) if keys[:-1] else Window.partitionBy()
    before = outer.orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
    starts = counts.select(*keys, F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"), F.sum("_c").over(outer).alias(f"{out}_n"))
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return rows.join(starts, keys).withColumn(out, F.col("_before") + inside).drop("_before")


def interleaved_shards(df: DataFrame, shards: int = 8, seed: int = 17, key: str = "doc_id", text: str = "text", stratum: str = "source", ranges: int = 4096) -> DataFrame:
    """Shard and slot of each row: (doc_id, source, size, text_crc32, shard, slot). `ranges` (a power of two) bounds the tables of
    counts: strata x ranges rows for the first ranking and `ranges` rows for the second."""
    payload = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = df.select(
        F.col(key).alias("doc_id"), F.col(stratum).alias("source"),
        F.when(F.col(stratum).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(stratum).cast("string"))).alias("_s"),
        (F.octet_length(payload) + 1).cast("long").alias("size"), F.crc32(payload).alias("text_crc32"),
    )
    name = F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"), F.col("text_crc32").cast("string"), F.col("size").cast("string"))
    rows = rows.withColumn("_h", F.conv(F.substring(F.md5(name.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long"))
    bits = ranges.bit_length() - 1
    rows = rows.withColumn("_b", F.shiftrightunsigned("_h", HASH_BITS - bits))
    ranked = _positions(rows, ["_s", "_b"], ["_h", "doc_id", "text_crc32", "size"], "_r").drop("_b")
    ranked = ranked.withColumn("_f", (2 * F.col("_r") + 1) / (2 * F.col("_r_n"))).drop("_r", "_r_n")
    ranked = table(ranked.withColumn("_g", F.floor(F.col("_f") * ranges)), "shard-ranks")
    placed = _positions(ranked, ["_g"], ["_f", "_s"], "_p")
    shard = F.expr(f"_p * {shards} div _p_n")
    start = F.expr(f"(shard * _p_n + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard.cast("int")).withColumn("slot", (F.col("_p") - start).cast("long")).select("doc_id", "source", "size", "text_crc32", "shard", "slot")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7, law `rows`: counts at most one apart, each shard with the mixture of sources."""
    out = interleaved_shards(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")
