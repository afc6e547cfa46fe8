"""Small helpers shared by the training-data operators: table access, shared scratch tables, Arrow maps."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH_ROWS, BATCH_BYTES = 2000, 16_000_000
ASCII_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the supplied tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches hold at most BATCH_ROWS rows and begin anew after BATCH_BYTES, because single texts can be very long. Smaller bounds of the
    session stay."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = int(spark.conf.get(f"spark.sql.execution.arrow.{name}").removesuffix("b"))
        if not 0 < now <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A folder of our own is set only where the session names none and runs on one machine
    (tests); on a cluster that would lose the tables, so it is an error there."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(root)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def table(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write the rows to the shared folder and read them again, so that no lost executor repeats the work."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete what table() wrote; only files in the shared folder are ever touched."""
    spark = df.sparkSession
    root = shared_dir(spark)
    for path in {os.path.dirname(f) for f in df.inputFiles()}:
        if path.replace("///", "/").startswith(root.replace("///", "/")):
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def arrow_schema(schema: str | T.StructType) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def with_kept(rows: DataFrame, ddl: str) -> T.StructType:
    """The schema of a map that gives back the struct column `kept`, in which columns of any name travel, and then others."""
    return T.StructType([rows.schema["kept"], *T.StructType.fromDDL(ddl).fields])


def keeping(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    """The `keep` columns as the struct `kept`, so that no name can clash, and the text as `text` where they lack it."""
    kept = F.struct(*(F.col(f"`{c}`") for c in keep)).alias("kept")
    return df.select(kept) if text in keep else df.select(kept, F.col(text).alias("text"))


def map_rows(df: DataFrame, columns: list[str], work: Callable[[Iterator[list]], Iterable[list]], schema: str | T.StructType, arrow: bool = False) -> DataFrame:
    """Arrow map over `columns` only: `work` gets an iterator of column lists (one list of values for each column and batch; with
    `arrow`, Arrow arrays) and yields column lists that match `schema`. Other columns, whatever their names, are never sent to Python."""
    fields = arrow_schema(schema)
    bound_batches(df.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = (b.columns if arrow else [c.to_pylist() for c in b.columns] for b in batches if b.num_rows)
        for cols in work(source):
            yield pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(cols, target, strict=True)], schema=target)
        pa.default_memory_pool().release_unused()  # workers live on for other tasks

    return df.select(*columns).mapInArrow(run, fields)


_LONG_REFERENCE = re.compile(r"&#0*([0-9]+)")


class LenientParser(HTMLParser):
    """The standard parser, which reads on where that one gives up: a marked section of an unknown kind is a comment up to the next `>`, and a
    character reference of many digits is what any number beyond the last character is."""

    def parse_html_declaration(self, i: int) -> int:
        try:
            return super().parse_html_declaration(i)
        except (AssertionError, ValueError):
            end = self.rawdata.find(">", i)
            return end + 1 if end >= 0 else len(self.rawdata)

    def read(self, html: str) -> None:
        """A whole page."""
        if "&#" in html:
            html = _LONG_REFERENCE.sub(lambda m: "&#" + (m[1] if len(m[1]) < 8 else "9999999"), html)
        self.feed(html)
        self.close()


def crc_bucket(column: str, modulus: int):
    """crc32 of the id as text, modulo `modulus` (the fixed folds of the contracts). A null id falls into bucket of the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus
