"""Readers: the supplied Parquet tables, Markdown vaults, and transcripts."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_OWN: dict[str, str | None] = {}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir. Only a session on one machine may lack it (tests): it gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = _OWN.setdefault(spark.sparkContext.applicationId, None) or tempfile.mkdtemp(prefix="spark-shared-")
        _OWN[spark.sparkContext.applicationId] = root
    return root.rstrip("/")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out where a small file would leave most cores idle. A scan of many splits stays as it is, without an exchange."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


PIECE_BYTES, MOST_PIECES, UNKNOWN = 4 << 20, 8192, 1 << 60


def pieces(*frames: DataFrame) -> int:
    """So many parts of the frames' rows that each stands for PIECE_BYTES of the tables that each frame is read from: what a task holds doesn't grow with the tables.
    Frames that Spark holds no size of (not read from files) have the session's shuffle partitions."""
    spark = frames[0].sparkSession
    leaves = [x.optimizedPlan().collectLeaves() for x in (f._jdf.queryExecution() for f in frames)]
    size = max(sum(int(x.apply(i).stats().sizeInBytes()) for i in range(x.size())) for x in leaves)
    least = spark.sparkContext.defaultParallelism
    return min(MOST_PIECES, max(least, -(-size // PIECE_BYTES))) if size < UNKNOWN else max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def read_vault(spark: SparkSession, path: str, modified_after: str | None = None, excluded: tuple[str, ...] = (".obsidian", ".trash", ".git")) -> DataFrame:
    """Markdown files under `path` changed since `modified_after` (ISO time): (path, modified, content). Excluded folders are left out."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md")
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    out = reader.load(path).select("path", F.col("modificationTime").alias("modified"), F.col("content").cast("string").alias("content"))
    for folder in excluded:
        out = out.where(~F.col("path").contains(f"/{folder}/"))
    return out


def wikilinks(text: Column) -> Column:
    """Target and display of [[target|display]] links in order, each target once; without a display it is null."""
    raw = F.transform(F.regexp_extract_all(text, F.lit(r"\[\[([^\]]+)\]\]"), 1), lambda r: F.struct(F.trim(F.substring_index(r, "|", 1)).alias("target"), F.when(F.contains(r, F.lit("|")), F.trim(F.regexp_replace(r, r"^[^|]*\|", ""))).alias("display")))
    targets = F.transform(raw, lambda r: r["target"])
    return F.filter(raw, lambda r, i: F.array_position(targets, r["target"]) == i + 1)


def hashtags(text: Column) -> Column:
    """#tag and #parent/child at a line's start or after a blank, sorted, each once."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?U)(?m)(?:^|(?<=\s))#(\w[\w/\-]*)"), 1)))


def transcript_format(name: Column, content: Column) -> Column:
    """By the file's ending vtt or srt, else by its content: vtt, srt (times in the first 500 characters) or txt."""
    low = F.lower(F.coalesce(name, F.lit("")))
    srt = F.substring(content, 1, 500).rlike(r"\d{2}:\d{2}:\d{2}[,.]\d{3}\s*-->\s*\d{2}:\d{2}:\d{2}[,.]\d{3}")
    return F.when(low.endswith(".vtt"), "vtt").when(low.endswith(".srt"), "srt").when(F.trim(F.regexp_replace(content, r"^\s+", "")).startswith("WEBVTT"), "vtt").when(srt, "srt").otherwise("txt")
