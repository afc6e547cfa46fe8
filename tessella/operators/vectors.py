"""Nearest vectors: exactly by one scan for a block of queries, and by an index of cells.

The index has coarse cells, learned by k-means on a stated sample (at most SAMPLE vectors, chosen by the hash of their ids), and holds every vector: in the
folder of its cell, as a code of one byte per dimension of what it differs from the cell's centre, beside the vector itself. A search reads the folders of
the cells nearest to each query, ranks their codes, and ranks the best of these anew by their vectors. How many cells that takes is measured:
`calibrated` compares with the exact answer on a few queries and chooses the least number that reaches the wanted recall. Distances are cosines; a vector of norm
0 is at cosine 0 to all.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE, MOST_CELLS, BLOCK, SALTS = 50_000, 4096, 4000, 64
#: So many scores are made at a time.
SCORES = 1 << 22
#: How many times k are ranked by codes before they are ranked by vectors.
OVERFETCH = 8


@dataclass(frozen=True)
class Cells:
    """An index: rows (cell, id, scale, code, vector), and the centres of its cells."""

    rows: DataFrame
    centres: np.ndarray


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, n, out=np.zeros_like(v), where=n > 0)


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)


def _asked(queries: DataFrame, key: str, vector: str) -> tuple[list, np.ndarray]:
    """A block of queries; a stated set of at most BLOCK rows."""
    rows = queries.select(key, F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull()).orderBy(key).limit(BLOCK + 1).collect()
    if len(rows) > BLOCK:
        raise ValueError(f"more than {BLOCK} queries in a block")
    return [r[0] for r in rows], np.array([r["v"] for r in rows], np.float64).reshape(len(rows), -1 if rows else 0)


def in_blocks(queries: DataFrame, find: Callable[[DataFrame], DataFrame], key: str = "vec_id") -> DataFrame:
    """What `find` gives for all queries, some BLOCK / 2 at a time by the hash of their ids."""
    blocks = -(-queries.count() // (BLOCK // 2)) or 1
    parts = [find(queries.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b)) for b in range(blocks)]
    return reduce(DataFrame.unionByName, parts)


class _Best:
    """The k best (score, then least id) for each query, of what is added batch by batch."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.scores, self.ids, self.least = k, [np.empty(0)] * queries, [np.empty(0, np.int64)] * queries, np.full(queries, -np.inf)

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate([self.scores[q], scores]), np.concatenate([self.ids[q], ids])
        if len(s) > self.k:
            near = np.flatnonzero(s >= np.partition(s, len(s) - self.k)[len(s) - self.k])
            s, i = s[near], i[near]
        best = np.lexsort((i, -s))[: self.k]
        self.scores[q], self.ids[q] = s[best], i[best]
        if len(best) == self.k:
            self.least[q] = s[best[-1]]

    def add_all(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """A row of scores for each of these queries; what is worse than the k-th so far is left out at once."""
        good = scores >= self.least[queries, None]
        for j in np.flatnonzero(good.any(1)):
            self.add(queries[j], scores[j, good[j]], ids[good[j]])


def _parts(rows: int, queries: int) -> Iterator[slice]:
    step = max(1, SCORES // max(1, queries))
    return (slice(i, i + step) for i in range(0, rows, step))


def _found(rows: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """The k best of each query: first of each of 64 parts of the tasks' lists, then of these."""
    order = [F.desc("score"), F.col(keys[1])]
    some = rows.withColumn("salt", F.pmod(F.xxhash64(keys[1]), F.lit(SALTS))).withColumn("_n", F.row_number().over(Window.partitionBy(keys[0], "salt").orderBy(*order))).where(F.col("_n") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy(keys[0]).orderBy(*order))).where(F.col("rank") <= k).drop("_n", "salt")


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query, key, rank, certainty): the k nearest vectors of each query (at most BLOCK of them), by one scan; certainty is (1 + cosine) / 2 to six
    places, and ties go to the least id. Ids are whole numbers. Rows without vector, or of another dimension than the queries, are no neighbours."""
    ids, asked = _asked(queries, key, vector)
    schema = f"query long, `{key}` long, score double"
    if not ids:
        return vectors.sparkSession.createDataFrame([], f"query long, `{key}` long, rank int, certainty double")
    units, dimension, every = _unit(asked), asked.shape[1], np.arange(len(ids))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(ids), k)
        for b in batches:
            if b.num_rows:
                sent, own = _unit(_matrix(b.column(1), dimension)), b.column(0).to_numpy()
                for at in _parts(len(sent), len(ids)):
                    best.add_all(every, np.round((1 + units @ sent[at].T) / 2, 6), own[at])
        yield from _rows(best, ids, key)

    sent = vectors.select(F.col(key).cast("long"), F.col(vector).cast("array<double>").alias("v")).where(F.size("v") == dimension)
    return _found(sent.mapInArrow(work, schema), k, ["query", key]).select("query", key, "rank", F.col("score").alias("certainty"))


def _rows(best: _Best, ids: list, key: str) -> Iterator[pa.RecordBatch]:
    n = [len(s) for s in best.scores]
    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n).astype(np.int64)), pa.array(np.concatenate(best.ids).astype(np.int64)), pa.array(np.concatenate(best.scores))], ["query", key, "score"])


def cells_for(n: int) -> int:
    return min(MOST_CELLS, max(1, math.isqrt(n)))


def _centres(sample: np.ndarray, cells: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Spherical k-means on the sample; an empty cell begins anew at a vector of the sample."""
    rnd = np.random.default_rng(seed)
    centres = sample[rnd.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(rounds):
        own = np.concatenate([np.argmax(part @ centres.T, 1) for part in np.array_split(sample, max(1, len(sample) // 4096))])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        centres = _unit(sums)
        empty = np.flatnonzero(~centres.any(1))
        centres[empty] = sample[rnd.integers(0, len(sample), len(empty))]
    return centres


def build(vectors: DataFrame, path: str, key: str = "vec_id", vector: str = "embedding", cells: int | None = None) -> Cells:
    """The index of a table, written under `path`. All vectors have one dimension; rows without vector are not held."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")).where(F.col("vector").isNotNull())
    n = rows.count()
    share = max(1, -(-n // SAMPLE))
    sample = [r[0] for r in rows.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0).orderBy("id").limit(2 * SAMPLE).select("vector").collect()]
    centres = _centres(_unit(np.array(sample)), cells or cells_for(n)) if sample else np.zeros((1, 1))
    dimension = centres.shape[1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                units = _unit(_matrix(b.column(1), dimension))
                own = np.argmax(units @ centres.T, 1)
                rest = units - centres[own]
                scale = np.maximum(np.abs(rest).max(1), 1e-12) / 127
                codes = np.round(rest / scale[:, None]).astype(np.int8)
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), b.column(0), pa.array(scale.astype(np.float32)), pa.array([c.tobytes() for c in codes], pa.binary()), b.column(1)], ["cell", "id", "scale", "code", "vector"])

    schema = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("id", T.LongType()), T.StructField("scale", T.FloatType()), T.StructField("code", T.BinaryType()), T.StructField("vector", T.ArrayType(T.DoubleType()))])
    size = max(1, n * (dimension * 9 + 20) // len(centres) >> 27)  # files of 128 MB in a cell
    dealt = rows.mapInArrow(work, schema).repartition("cell", F.pmod(F.xxhash64("id"), F.lit(size)))
    dealt.sortWithinPartitions("cell", "id").write.mode("overwrite").partitionBy("cell").parquet(path)
    return Cells(spark.read.schema(T.StructType([*schema.fields[1:], schema.fields[0]])).parquet(path), centres)


def _nearest_cells(units: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argsort(-(units @ centres.T), 1, kind="stable")


def search(index: Cells, queries: DataFrame, k: int = 10, probes: int = 8, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query, key, rank, certainty) from the `probes` nearest cells of each query (at most BLOCK of them): OVERFETCH times k by codes, then k by
    vectors. Queries of another dimension have none. The ids found by codes, at most BLOCK times OVERFETCH times k, go to where the vectors are."""
    ids, asked = _asked(queries, key, vector)
    if not ids or asked.shape[1] != index.centres.shape[1]:
        return index.rows.sparkSession.createDataFrame([], f"query long, `{key}` long, rank int, certainty double")
    units, centres = _unit(asked), index.centres
    near = _nearest_cells(units, centres)[:, :probes]
    asking = {int(c): np.flatnonzero((near == c).any(1)) for c in np.unique(near)}
    at_centres = units @ centres.T

    def by_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(ids), OVERFETCH * k)
        for b in batches:
            cell, own = b.column(0).to_numpy(), b.column(1).to_numpy()
            for c in np.unique(cell):
                at = np.flatnonzero(cell == c)
                codes = np.frombuffer(b"".join(x.as_py() for x in b.column(3).take(pa.array(at))), np.int8).reshape(len(at), -1)
                rest = codes * b.column(2).to_numpy()[at, None].astype(np.float64)
                near = asking[int(c)]
                for part in _parts(len(at), len(near)):
                    best.add_all(near, at_centres[near, c, None] + units[near] @ rest[part].T, own[at[part]])
        yield from _rows(best, list(range(len(ids))), "id")

    chosen = index.rows.where(F.col("cell").isin(sorted(asking)))
    some = _found(chosen.select("cell", "id", "scale", "code").mapInArrow(by_codes, "query long, id long, score double"), OVERFETCH * k, ["query", "id"]).select(F.col("query").alias("q"), "id")

    def by_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                q = b.column(0).to_numpy()
                scores = np.round((1 + (_unit(_matrix(b.column(2), units.shape[1])) * units[q]).sum(1)) / 2, 6)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)[q]), b.column(1), pa.array(scores)], ["query", key, "score"])

    exact = chosen.select("id", "vector").join(F.broadcast(some), "id").select("q", "id", "vector").mapInArrow(by_vectors, f"query long, `{key}` long, score double")
    return _found(exact, k, ["query", key]).select("query", key, "rank", F.col("score").alias("certainty"))


def recall(found: DataFrame, wanted: DataFrame, key: str = "vec_id") -> DataFrame:
    """(query, wanted, found, recall): how many of the wanted neighbours of each query were found."""
    hits = wanted.select("query", key).join(found.select("query", key, F.lit(1).alias("hit")), ["query", key], "left")
    return hits.groupBy("query").agg(F.count(F.lit(1)).alias("wanted"), F.count("hit").alias("found")).withColumn("recall", F.round(F.col("found") / F.col("wanted"), 6))


def calibrated(index: Cells, vectors: DataFrame, queries: DataFrame, k: int = 10, least: float = 0.95, key: str = "vec_id", vector: str = "embedding") -> int:
    """The least number of cells, doubled from one, at which the mean recall of these queries (at most BLOCK of them) against the exact answer reaches `least`; all
    cells at the end. A search finds only what lies in the cells it reads, so that a number of cells that hold too few of the wanted ones is not tried."""
    wanted = [(r[0], r[1]) for r in neighbours(vectors, queries, k, key, vector).collect()]
    if not wanted:
        return 1
    probes, most, n = 1, len(index.centres), Counter(q for q, _ in wanted)
    ids, asked = _asked(queries, key, vector)
    if asked.shape[1] != index.centres.shape[1]:
        return most

    def mean(found: Counter) -> float:
        return sum(round(found[q] / n[q], 6) for q in n) / len(n)

    held = index.rows.sparkSession.createDataFrame([(i,) for i in {i for _, i in wanted}], "id long")
    cells: dict[int, list[int]] = {}
    for i, c in index.rows.select("id", "cell").join(F.broadcast(held), "id").collect():
        cells.setdefault(i, []).append(c)
    rank = dict(zip(ids, np.argsort(_nearest_cells(_unit(asked), index.centres), 1), strict=True))
    places = [(q, min((rank[q][c] for c in cells.get(i, ())), default=most)) for q, i in wanted]
    while probes < most:
        if mean(Counter(q for q, at in places if at < probes)) >= least - 1e-9:
            found = {(r[0], r[1]) for r in search(index, queries, k, probes, key, vector).collect()}
            if mean(Counter(q for q, i in wanted if (q, i) in found)) >= least:
                break
        probes = min(2 * probes, most)
    return probes
