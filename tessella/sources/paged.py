"""Incremental sources: pages of JSON items behind a cursor, read as a table or as a stream whose offset is the cursor.

A client lists the pages after a cursor and reads one; the source plans tasks for runs of pages, TASKS of them or so until a run has MOST_PAGES, so that pages are
read by executors and many small ones don't cost a task each. Reading again from the same
cursor gives the same items. An item that is no JSON object is a row with an error and no item, not a failure of the page. A stream that restarts from its
checkpoint goes on after the last page it has committed: no item is lost or repeated.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

TASKS, MOST_PAGES = 128, 1000
SCHEMA = "cursor string, position int, item string, error string"


class FolderClient:
    """Pages as files of a folder that all machines reach, in the order of their paths: a page's path is its cursor. A page is a JSON object with the
    list `items`, or such objects one a line."""

    def __init__(self, path: str) -> None:
        self.path = path

    def _open(self) -> tuple[fs.FileSystem, str]:
        if "://" in self.path or self.path.startswith("file:"):
            uri = self.path if "://" in self.path else "file://" + self.path.removeprefix("file:")
            return fs.FileSystem.from_uri(uri)
        return fs.LocalFileSystem(), os.path.abspath(self.path)

    def healthy(self) -> bool:
        system, root = self._open()
        return system.get_file_info(root).type == fs.FileType.Directory

    def after(self, cursor: str) -> list[str]:
        """Cursors of the pages after one, in order; hidden files are none."""
        system, root = self._open()
        files = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        names = (f.path[len(root) :].lstrip("/") for f in files if f.type == fs.FileType.File)
        return sorted(n for n in names if n > cursor and not any(part[:1] in ("_", ".") for part in n.split("/")))

    def items(self, cursor: str) -> Iterator[object]:
        system, root = self._open()
        with system.open_input_stream(f"{root.rstrip('/')}/{cursor}") as f:
            text = f.read().decode("utf-8", "replace")
        for line in filter(str.strip, text.splitlines()):
            try:
                page = json.loads(line)
            except ValueError:
                yield line
                continue
            yield from page.get("items") or [] if isinstance(page, dict) else [page]


@dataclass
class Pages(InputPartition):
    """Pages in a row, by their cursors."""

    cursors: list[str]


def _runs(cursors: list[str]) -> list[Pages]:
    size = min(MOST_PAGES, max(1, -(-len(cursors) // TASKS)))
    return [Pages(cursors[i : i + size]) for i in range(0, len(cursors), size)]


def _read(client: FolderClient, pages: Pages) -> Iterator[tuple]:
    for cursor in pages.cursors:
        for at, item in enumerate(client.items(cursor)):
            good = isinstance(item, dict)
            yield cursor, at, json.dumps(item, ensure_ascii=False) if good else None, None if good else f"no object: {str(item)[:200]}"


class _Table(DataSourceReader):
    def __init__(self, client: FolderClient, cursor: str) -> None:
        self.client, self.cursor = client, cursor

    def partitions(self) -> list[Pages]:
        return _runs(self.client.after(self.cursor))

    def read(self, partition: Pages) -> Iterator[tuple]:
        yield from _read(self.client, partition) if partition else ()


class _Stream(DataSourceStreamReader):
    def __init__(self, client: FolderClient, cursor: str) -> None:
        self.client, self.cursor = client, cursor

    def initialOffset(self) -> dict:
        return {"cursor": self.cursor}

    def latestOffset(self) -> dict:
        return {"cursor": max(self.client.after(self.cursor), default=self.cursor)}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        return _runs([c for c in self.client.after(start["cursor"]) if c <= end["cursor"]])

    def read(self, partition: Pages) -> Iterator[tuple]:
        yield from _read(self.client, partition)

    def commit(self, end: dict) -> None:
        self.cursor = end["cursor"]  # pages before are not listed again


class PagedSource(DataSource):
    """format("paged") with the options `path` and, to begin after a page, `cursor`. Another client is another `client()`."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return SCHEMA

    def client(self) -> FolderClient:
        return FolderClient(self.options["path"])

    def reader(self, schema) -> DataSourceReader:
        return _Table(self.client(), self.options.get("cursor", ""))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.client(), self.options.get("cursor", ""))


def pages(spark: SparkSession, path: str, cursor: str = "") -> DataFrame:
    """(cursor, position, item, error) of the pages after a cursor."""
    spark.dataSource.register(PagedSource)
    return spark.read.format("paged").option("path", path).option("cursor", cursor).load()


def page_stream(spark: SparkSession, path: str, cursor: str = "") -> DataFrame:
    """The same as a stream, whose checkpoint holds the cursor."""
    spark.dataSource.register(PagedSource)
    return spark.readStream.format("paged").option("path", path).option("cursor", cursor).load()


def write_pages(items: DataFrame, path: str, page: str, item: str = "item") -> None:
    """Items (JSON texts) as pages under `path`, one folder for each value of `page`, whose order is the cursor's."""
    made = items.groupBy(F.col(page).alias("page")).agg(F.concat(F.lit('{"items":['), F.array_join(F.array_sort(F.collect_list(item)), ","), F.lit("]}")).alias("value"))
    made.write.mode("append").partitionBy("page").text(path)


def normalised(rows: DataFrame, schema: str, required: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Items by a schema, and the refused ones (cursor, position, item, error): no object, not of the schema, or without a required value."""
    read = rows.withColumn("v", F.from_json("item", f"{schema}, _broken string", {"columnNameOfCorruptRecord": "_broken"}))
    missing = [F.when(F.col(f"v.{c}").isNull(), F.lit(c)) for c in required]
    reason = F.coalesce(F.col("error"), F.when(F.col("v._broken").isNotNull(), "not of the schema"), F.when(F.size(F.array_compact(F.array(*missing))) > 0, F.concat(F.lit("without "), F.array_join(F.array(*missing), ", "))))
    read = read.withColumn("reason", reason)
    good = read.where("reason IS NULL").select("cursor", "position", "v.*").drop("_broken")
    return good, read.where("reason IS NOT NULL").select("cursor", "position", "item", F.col("reason").alias("error"))
