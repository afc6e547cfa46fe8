"""A positional inverted index for keyword search, built as its own step and read by term, and ranks by cover density.

Postings (term, key, n_words, positions) lie in folders by the term's hash, sorted by term in files by the key's hash, so that a lookup reads one folder for
each term and in it the row groups whose range of terms fits. The number of folders follows the square root of the input, and there are so many files
in each that one stands for some FILE_BYTES of the input: neither a task that writes a file nor one that reads it grows with the corpus, however frequent a term is.

Postings travel to their files in packs, one for each file and some HELD postings: the documents of a pack once, then its terms, and for each posting the
place of its document, compressed. As rows they would take several times the input's size on disk.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.operators.search import cover_ranks, terms_of
from tessella.sources.tables import load, shared_dir, spread

_WORD = re.compile(r"\w+")
PART_BYTES, FILE_BYTES, LEAST_PARTS, MOST_PARTS, UNKNOWN = 64 << 20, 16 << 20, 16, 8192, 1 << 60
#: Postings that a task holds before it packs them.
HELD = 2_000_000
_PACK = ["keys", "sizes", "terms", "docs", "at", "times", "positions"]


@dataclass(frozen=True)
class Index:
    """Postings and the number of folders they lie in."""

    rows: DataFrame
    parts: int


def _size_of(docs: DataFrame) -> int:
    return int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def files_for(docs: DataFrame, parts: int) -> int:
    """Files of each folder: all of them stand for FILE_BYTES of the table each."""
    size = _size_of(docs)
    return max(1, parts // LEAST_PARTS, -(-size // (FILE_BYTES * parts)) if size < UNKNOWN else 1)


def parts_for(docs: DataFrame) -> int:
    """Folders for a table: the square root of its size in pieces of 64 MB, so that each folder has as many files of that size. Rows that Spark holds no
    size of (not read from files) count as few."""
    size = _size_of(docs)
    return min(MOST_PARTS, max(LEAST_PARTS, math.isqrt(size // PART_BYTES))) if size < UNKNOWN else LEAST_PARTS


def part_of(term: str, parts: int) -> int:
    """The folder of a term."""
    return zlib.crc32(term.encode()) % parts


def _read(b: pa.RecordBatch, vocabulary: dict[str, int], kind: pa.DataType) -> list:
    """Keys, files and numbers of words of a batch's documents; of each posting its document, its term's number and how many positions it has; all positions."""
    at, terms, times, positions, sizes = [], [], [], [], []
    for row, t in enumerate(b.column(2)):
        found: dict[str, list[int]] = {}
        words = _WORD.findall(t.as_py() or "")
        for i, w in enumerate(words):
            if w in found:
                found[w].append(i)
            else:
                found[w] = [i]
        for w, places in found.items():
            terms.append(vocabulary.setdefault(w, len(vocabulary)))
            times.append(len(places))
            positions += places
        at += [row] * len(found)
        sizes.append(len(words))
    return [b.column(0).cast(kind), b.column(1).to_numpy(), *(np.array(x, np.int32) for x in (sizes, at, terms, times, positions))]


def _packs(held: list[list], vocabulary: dict[str, int], parts: int, files: int) -> Iterator[tuple[int, bytes]]:
    """(file's number, pack) of what _read gave: postings sorted by file, term and document."""
    before = np.cumsum([0, *(len(x[2]) for x in held)])
    keys, (file, sizes, terms, times, positions) = pa.concat_arrays([x[0] for x in held]), (np.concatenate([x[i] for x in held]) for i in (1, 2, 4, 5, 6))
    at = np.concatenate([x[3] + n for x, n in zip(held, before, strict=False)])
    words = sorted(vocabulary)
    rank, part = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    rank[[vocabulary[w] for w in words]] = np.arange(len(words))
    part[rank.argsort()] = [part_of(w, parts) for w in words]
    number = part[terms] * files + file[at]
    order = np.argsort(number * len(words) + rank[terms], kind="stable")
    starts = np.cumsum(times) - times
    number, at, terms, times, starts = number[order], at[order], rank[terms[order]], times[order], starts[order]
    ends = np.cumsum(times)
    positions = positions[np.repeat(starts - (ends - times), times) + np.arange(ends[-1] if len(ends) else 0)]
    words, codec = pa.array(words, pa.string()), pa.Codec("zstd")
    cuts = np.flatnonzero(np.diff(number, prepend=-1, append=-1))
    for a, z in zip(cuts, cuts[1:]):
        docs, local = np.unique(at[a:z], return_inverse=True)
        first = np.flatnonzero(np.diff(terms[a:z], prepend=-1))
        columns = [keys.take(pa.array(docs)), sizes[docs], words.take(pa.array(terms[a:z][first])), np.diff(first, append=z - a), local, times[a:z], positions[ends[a] - times[a] : ends[z - 1]]]
        columns = [c if isinstance(c, pa.Array) else pa.array(c.astype(np.int32)) for c in columns]
        raw = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns], _PACK).serialize()
        yield int(number[a]), raw.size.to_bytes(8, "little") + codec.compress(raw, asbytes=True)


def _unpacked(number: int, pack: bytes, kind: pa.DataType, files: int, names: list[str]) -> pa.RecordBatch:
    raw = pa.Codec("zstd").decompress(memoryview(pack)[8:], int.from_bytes(pack[:8], "little"))
    i = pa.int32()
    schema = pa.schema([(n, pa.list_(t)) for n, t in zip(_PACK, (kind, i, pa.string(), i, i, i, i), strict=True)])
    keys, sizes, terms, docs, at, times, positions = (c.values for c in pa.ipc.read_record_batch(raw, schema).columns)
    offsets = np.concatenate([[0], np.cumsum(times.to_numpy())]).astype(np.int32)
    columns = [terms.take(pa.array(np.repeat(np.arange(len(terms)), docs.to_numpy()))), keys.take(at), sizes.take(at).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), positions)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(at), number // files, np.int32))], names)


def postings(docs: DataFrame, parts: int, files: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, key, n_words, positions, part), one row for each term of a document, dealt to one task for each file; positions count words from 0."""
    from pyspark.sql.pandas.types import to_arrow_type

    field = docs.select(key).schema[0]
    kind, names = to_arrow_type(field.dataType), ["term", key, "n_words", "positions", "part"]
    integer = T.IntegerType()
    schema = T.StructType([T.StructField(n, t) for n, t in zip(names, (T.StringType(), field.dataType, T.LongType(), T.ArrayType(integer), integer), strict=True)])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, vocabulary = [], {}

        def packed() -> pa.RecordBatch:
            rows = list(_packs(held, vocabulary, parts, files))
            return pa.RecordBatch.from_arrays([pa.array([n for n, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["number", "pack"])

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                held.append(_read(batch.slice(at, 500), vocabulary, kind))
                if sum(len(x[3]) for x in held) >= HELD:
                    yield packed()
                    held.clear(), vocabulary.clear()
        if held:
            yield packed()

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield _unpacked(number, x.as_py(), kind, files, names)

    file = F.pmod(F.xxhash64(key), F.lit(files)).cast("int").alias("file")
    sent = docs.select(key, file, F.lower(F.col(text)).alias("text")).mapInArrow(pack, "number int, pack binary")
    return sent.repartitionById(parts * files, "number").mapInArrow(unpack, schema)


def build(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", parts: int | None = None, files: int | None = None) -> Index:
    """The index of a table, written under `path`, by one task for each file."""
    parts = parts or parts_for(docs)
    files = files or files_for(docs, parts)
    rows = postings(docs, parts, files, key, text)
    rows.sortWithinPartitions("part", "term", key).write.mode("overwrite").option("compression", "zstd").partitionBy("part").parquet(path)
    return Index(docs.sparkSession.read.parquet(path), parts)


def lookup(index: Index, query: str, key: str = "doc_id") -> DataFrame:
    """Documents that hold all terms: (key, score), by cover density. No terms, no rows."""
    terms = terms_of(query)
    if not terms:
        return index.rows.select(key, F.lit(0.0).alias("score")).limit(0)
    hits = index.rows.where(reduce(or_, ((F.col("part") == part_of(t, index.parts)) & (F.col("term") == t) for t in terms)))
    held = hits.groupBy(key).agg(F.collect_list(F.struct("term", "positions")).alias("p")).where(F.size("p") == len(terms))
    places = held.select(key, F.explode("p").alias("p")).select(key, "p.term", F.explode("p.positions").alias("pos"))
    return cover_ranks(places, terms, key)


def most_used(index: Index, most: int, key: str = "doc_id") -> DataFrame:
    """(term, docs, occurrences) of the terms that most documents hold."""
    return index.rows.groupBy("term").agg(F.count(key).alias("docs"), F.sum(F.size("positions")).cast("long").alias("occurrences")).orderBy(F.desc("docs"), "term").limit(most)


def _state_of(docs: DataFrame) -> str:
    """A name for the files of a table as they are now, from their paths, sizes and times."""
    files = docs.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    found = files.agg(F.count(F.lit(1)), F.sum(F.xxhash64("file_path", "file_size", "file_modification_time").cast("decimal(38,0)"))).first()
    return hashlib.sha256(repr(tuple(found)).encode()).hexdigest()[:16]


def index_of(spark: SparkSession, sf_dir: str) -> Index:
    """The index of the documents of a folder. It is built where the shared folder has none for the files as they are, under a name of its own that is
    then changed, so that a broken build is never read and two applications use one index."""
    docs = load(spark, sf_dir, "documents")
    root, parts = shared_dir(spark), parts_for(docs)
    path = f"{root}/keyword-packs-{_state_of(docs)}-{parts}"
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        made = f"{root}/building-{uuid.uuid4().hex}"
        build(spread(docs.select("doc_id", "text")), made, parts=parts, files=files_for(docs, parts))
        if not fs.rename(hadoop.Path(made), at) and not fs.exists(at):
            raise RuntimeError(f"the index can't be moved to {path}")
    return Index(spark.read.parquet(path), parts)
