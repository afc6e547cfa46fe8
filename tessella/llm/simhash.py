"""SimHash near-duplicates by segment-popcount embedding.

A fingerprint's 64 bits fall into 32 segments of two; the counts of one bits in them embed it into a grid of 32 dimensions. The Manhattan
distance of two such points is a lower bound of the Hamming distance. Points within distance 3 differ in at most 3 dimensions; the dimensions are
dealt into 7 blocks, so at least 4 blocks agree, and a range join needs only the cells given by each choice of 4 blocks (35 cells a
point). Within a cell the lower bound is checked first, then the fingerprints themselves.

Only distinct fingerprints take part, copies being classes of one. A cell gives out a spanning forest of its links, never all pairs. A
cell beyond `cell_limit` points goes another way, exact and linear in its size: x and y differ by at most 3 bits if x with at most one bit and y with
at most two bits turned over become equal, so all that meet at a value are linked through the least of each kind.

With a `similarity`, texts whose sets of shingles have that Jaccard similarity are linked too, however many bits their fingerprints differ in.
The search is exact: sets are put in one order of all shingles (those that are common in a sample last), and similar sets share a shingle of their
prefixes, which leave out so many that the rest alone is too few. A shingle is a cell; a pair is taken from it only if sizes and places
allow the similarity (no more than what follows a first common shingle can be common). A cell of more than CROWD sets first gives pairs of neighbours; what
these join counts as one. Then it gives some pairs that are still apart, and last all that still are. A pair goes on only if counts of its sets' hashes by
ranges, a byte each, allow the similarity (no more can be common than the smaller count of each range). What is left is decided by whole sets. The sample and
the first rounds only save work.

Null or empty text: fingerprint zero, linked like any other; its set is empty and similar to no other by similarity. A null id is the smallest.
Texts of any length are hashed in parts. Repeated rows stay. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from itertools import accumulate, combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import ASCII_LOWER, drop_table, map_rows, read, table
from tessella.llm.components import component_roots

DISTANCE, SHINGLE, CELL_LIMIT = 3, 3, 4096
CROWD, NEIGHBOURS, SAMPLE, SHARE, COMMON, BROADCAST_IDS = 4, (1, 4, 64, None), 5_000, 8, 500_000, 1_000_000
FIRST_ID = -(1 << 63)
BLOCKS = (5, 5, 5, 5, 4, 4, 4)
SEGMENT = 1 << 20
_BLANK = re.compile(rb"[\x09-\x0D\x20]")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_hashes(text: bytes | None, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """XXH64 of every shingle, repeats included, in parts of some SEGMENT bytes of text, of which each takes up the last words of the one before."""
    data, at, words, short = text or b"", 0, [], True
    while at < len(data):
        blank = _BLANK.search(data, at + SEGMENT) if at + SEGMENT < len(data) else None
        end = blank.start() if blank else len(data)
        words += data[at:end].translate(ASCII_LOWER).split()
        at = end
        if len(words) >= shingle:
            yield _hashed(words, shingle)
            words, short = words[len(words) - shingle + 1 :], False
    if words and short:
        yield _hashed(words, len(words))


def _hashed(words: list[bytes], k: int) -> np.ndarray:
    data, ends = b" ".join(words), [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(data[a:z], 42) for a, z in zip(starts[: len(words) - k + 1], ends[k - 1 :], strict=True)], "<u8")


def _majority(parts: Iterable[np.ndarray]) -> int:
    n, ones = 0, np.zeros(64, np.int64)
    for h in parts:
        n += len(h)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    return _majority(shingle_hashes(text, shingle))


def shingle_set(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes, sorted."""
    return np.unique(np.concatenate([np.zeros(0, "<u8"), *shingle_hashes(text, shingle)]))


def set_hash(distinct: np.ndarray) -> int:
    return _signed(xxhash.xxh64_intdigest(distinct.tobytes()))


def sketch(distinct: np.ndarray) -> bytes:
    """How many hashes lie in each of 2^k equal ranges, about one to two on average; empty if a count doesn't fit a byte."""
    k = max(3, (len(distinct) // 2).bit_length())
    counts = np.bincount((distinct >> np.uint64(64 - k)).astype(np.int64), minlength=1 << k)
    return counts.astype(np.uint8).tobytes() if counts.max(initial=0) < 255 else b""


def most_common(a: bytes, b: bytes) -> float:
    """A bound of how many hashes two sets have in common, from their sketches."""
    if not a or not b:
        return math.inf
    x, y = np.frombuffer(a, np.uint8).astype(np.uint16), np.frombuffer(b, np.uint8).astype(np.uint16)
    while len(x) > len(y):
        x = x[::2] + x[1::2]
    while len(y) > len(x):
        y = y[::2] + y[1::2]
    return int(np.minimum(x, y).sum())


class Sketches:
    """Sketches of the sets of a cell, those of one length together."""

    def __init__(self, sketches: list[bytes]) -> None:
        self.sketches, self.length = sketches, np.array([len(x) for x in sketches])
        self.place, self.tables = np.zeros(len(sketches), np.int64), {}
        for n in np.unique(self.length).tolist():
            at = np.flatnonzero(self.length == n)
            self.place[at] = np.arange(len(at))
            self.tables[n] = np.frombuffer(b"".join(sketches[i] for i in at.tolist()), np.uint8).reshape(len(at), n)

    def most_common(self, i: int, js: np.ndarray) -> np.ndarray:
        """A bound of how many hashes set i has in common with each of js."""
        n = int(self.length[i])
        same = self.length[js] == n
        out = np.full(len(js), np.inf)
        if n and same.any():
            mine = self.tables[n][self.place[i]]
            out[same] = np.minimum(self.tables[n][self.place[js[same]]], mine).sum(1, dtype=np.int64)
        for k in np.flatnonzero(~same).tolist():
            out[k] = most_common(self.sketches[i], self.sketches[js[k]])
        return out


def ordered_prefix(distinct: np.ndarray, common: np.ndarray, rank: np.ndarray, _counts: object, similarity: float) -> np.ndarray:
    """The first shingles of a set, one more than it can lack in a similar one. `common`: sorted hashes that come last, by their rank."""
    at = np.minimum(np.searchsorted(common, distinct), max(0, len(common) - 1))
    last = np.where(common[at] == distinct, rank[at], 0) if len(common) else np.zeros(len(distinct), np.int64)
    return distinct[np.argsort(last, kind="stable")[: len(distinct) - math.ceil(similarity * len(distinct) - 1e-6) + 1]]


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp) of every row, fp as a signed long."""

    def work(batches: Iterator[list]):
        for ids, texts in batches:
            yield [ids, [_signed(fingerprint(t, shingle)) for t in texts.cast("binary").to_pylist()]]

    rows = df.select(F.coalesce(F.col(key), F.lit(FIRST_ID)).alias("id"), F.col(text).alias("text"))
    return map_rows(rows, ["id", "text"], work, "id long, fp long", arrow=True)


def set_rows(df: DataFrame, key: str, text: str, shingle: int, bits: bool = False) -> DataFrame:
    """(id, text_hash, n, set_hash, sketch) of every row and, with `bits`, its fp, in one pass over its text."""

    def one(t: bytes | None) -> tuple:
        parts = list(shingle_hashes(t, shingle))
        distinct = np.unique(np.concatenate(parts)) if parts else np.zeros(0, "<u8")
        return len(distinct), set_hash(distinct), sketch(distinct), *([_signed(_majority(parts))] if bits else [])

    def work(batches: Iterator[list]):
        for ids, hashes, texts in batches:
            yield [ids, hashes, *map(list, zip(*map(one, texts.cast("binary").to_pylist()), strict=True))]

    rows = df.select(F.coalesce(F.col(key), F.lit(FIRST_ID)).alias("id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    return map_rows(rows, ["id", "text_hash", "text"], work, "id long, text_hash long, n int, set_hash long, sketch binary" + ", fp long" * bits, arrow=True)


def block_masks() -> list[int]:
    """One mask of bits for each choice of all but DISTANCE blocks of segments."""
    ends = list(accumulate(2 * n for n in BLOCKS))
    blocks = [((1 << (e - s)) - 1) << s for s, e in zip([0, *ends[:-1]], ends, strict=True)]
    return [sum(c) for c in combinations(blocks, len(BLOCKS) - DISTANCE)]


def embedding(fp: Column) -> Column:
    """Counts of ones of the 32 segments, each in unary (0, 1, 3) in its two bits: the Hamming distance of two is their Manhattan distance."""
    low = F.lit(0x5555555555555555)
    a, b = fp.bitwiseAND(low), F.shiftrightunsigned(fp, 1).bitwiseAND(low)
    return a.bitwiseOR(b).bitwiseOR(F.shiftleft(a.bitwiseAND(b), 1))


def _points(fp: int) -> int:
    a, b = fp & 0x5555555555555555, fp >> 1 & 0x5555555555555555
    return a | b | (a & b) << 1


def forest(fps: list[int], most: int = DISTANCE) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among unsigned fingerprints."""
    n, parent = len(fps), list(range(len(fps)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    out = []

    def link(i: int, j: int) -> None:
        a, b = find(i), find(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((fps[i], fps[j]))

    if n <= 24:
        points = [_points(x) for x in fps]
        for i in range(n):
            for j in range(i):
                if (points[i] ^ points[j]).bit_count() <= most and (fps[i] ^ fps[j]).bit_count() <= most:
                    link(i, j)
        return out
    x = np.array(fps, np.uint64)
    p = np.array([_points(f) for f in fps], np.uint64)
    for i in range(1, n):
        near = np.flatnonzero(np.bitwise_count(p[:i] ^ p[i]) <= most)
        near = near[np.bitwise_count(x[near] ^ x[i]) <= most]
        for j in near.tolist():
            link(i, j)
    return out


def _cell_links(fps: DataFrame, cell_limit: int) -> DataFrame:
    """(u, v): links found in cells; (u, null): a point of a cell beyond the limit."""

    def work(batches: Iterator[list[list]]):
        cell, members, over = None, [], False
        out: list[list] = [[], []]

        def close() -> None:
            if len(members) > 1:
                for a, b in forest([m & 0xFFFFFFFFFFFFFFFF for m in members]):
                    out[0].append(_signed(a)), out[1].append(_signed(b))

        for combos, cells, points in batches:
            for c, k, fp in zip(combos, cells, points, strict=True):
                if (c, k) != cell:
                    close()
                    cell, members, over = (c, k), [], False
                if over:
                    out[0].append(fp), out[1].append(None)
                    continue
                members.append(fp)
                if len(members) > cell_limit:
                    out[0].extend(members), out[1].extend([None] * len(members))
                    members, over = [], True
            if len(out[0]) > 1000:
                yield out
                out = [[], []]
        close()
        if out[0]:
            yield out

    cells = F.explode(F.array(*(F.struct(F.lit(i).alias("combo"), F.col("p").bitwiseAND(F.lit(_signed(m))).alias("cell")) for i, m in enumerate(block_masks())))).alias("c")
    rows = fps.select("fp", embedding(F.col("fp")).alias("p")).select("fp", cells).select("c.combo", "c.cell", "fp")
    return map_rows(rows.repartition("combo", "cell").sortWithinPartitions("combo", "cell", "fp"), ["combo", "cell", "fp"], work, "u long, v long")


def _flipped(fps: DataFrame, most: int) -> DataFrame:
    """(value, fp): each fingerprint with up to `most` bits turned over."""
    masks = [0] + [sum(1 << b for b in c) for n in range(1, most + 1) for c in combinations(range(64), n)]
    table_of = fps.sparkSession.createDataFrame([(_signed(m),) for m in masks], "m long")
    all_masks = table_of.agg(F.collect_list("m").alias("ms")).first()["ms"]
    return fps.select("fp", F.explode(F.array(*map(F.lit, all_masks))).alias("m")).select(F.col("fp").bitwiseXOR(F.col("m")).alias("value"), "fp")


def meeting_links(fps: DataFrame) -> DataFrame:
    """(u, v): links that connect all fingerprints within distance 3, for any number of them close together."""
    a, b = _flipped(fps, 1), _flipped(fps, 2)
    least_a, least_b = a.groupBy("value").agg(F.min("fp").alias("m")), b.groupBy("value").agg(F.min("fp").alias("m"))
    return a.join(least_b, "value").select(F.col("fp").alias("u"), F.col("m").alias("v")).unionByName(b.join(least_a, "value").select(F.col("fp").alias("u"), F.col("m").alias("v"))).where("u != v").distinct()


def _texts_of(df: DataFrame, text: str, classes: DataFrame) -> DataFrame:
    """(text_hash, text): the rows whose text is one of `classes`."""
    ids = classes.select("text_hash").distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return df.select(F.xxhash64(text).alias("text_hash"), F.col(text).alias("text")).join(ids, "text_hash", "left_semi")


def _whole_sets(df: DataFrame, text: str, shingle: int, classes: DataFrame) -> DataFrame:
    """(set_hash, h): the sets of `classes` (text_hash of one of their texts), each once in a task."""

    def work(batches: Iterator[list]):
        seen: set[int] = set()
        for hashes, texts in batches:
            for at in range(0, len(hashes), 100):  # some sets are large
                out: list[list] = [[], []]
                for x, t in zip(hashes[at : at + 100].to_pylist(), texts[at : at + 100].cast("binary").to_pylist(), strict=True):
                    if x not in seen:
                        seen.add(x)
                        distinct = shingle_set(t, shingle)
                        out[0].append(set_hash(distinct)), out[1].append(distinct.view(np.int64))
                if out[0]:
                    yield out

    return map_rows(_texts_of(df, text, classes), ["text_hash", "text"], work, "set_hash long, h array<long>", arrow=True)


def _counted(hashes: DataFrame) -> DataFrame:
    return hashes.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 2")


def _common_shingles(df: DataFrame, text: str, shingle: int, similarity: float, classes: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes that many sets share, sorted, and their ranks by how many. They decide the order of shingles, never a result. First those in three or
    more of a few thousand sets; then, of the first part of each set in that order, those in three or more of every SHARE-th set, so that what stays
    unknown is in few sets, however many there are."""
    total = classes.count()
    below = lambda part: F.xxhash64("set_hash") <= -(1 << 63) + min((1 << 64) - 1, int((1 << 64) * part))
    few = _counted(_whole_sets(df, text, shingle, classes.where(below(SAMPLE / max(1, total)))).select(F.explode("h").alias("h")))
    scale = max(1.0, total / SAMPLE)
    known = _ranked([(r.h, r.c * scale) for r in few.orderBy(F.desc("c"), "h").limit(COMMON).collect()])
    if total <= SAMPLE:
        return known
    shared = df.sparkSession.sparkContext.broadcast(known)

    def work(batches: Iterator[list]):
        seen: set[int] = set()
        for hashes, texts in batches:
            out = [np.zeros(0, "<u8")]
            for x, t in zip(hashes.to_pylist(), texts.cast("binary").to_pylist(), strict=True):
                if x not in seen:
                    seen.add(x)
                    out.append(ordered_prefix(shingle_set(t, shingle), *shared.value, 2 * similarity - 1))
            yield [np.concatenate(out).view(np.int64)]

    more = _counted(map_rows(_texts_of(df, text, classes.where(below(1 / SHARE))), ["text_hash", "text"], work, "h long", arrow=True))
    found = dict(zip(known[0].view(np.int64).tolist(), known[2].tolist(), strict=True))
    for r in more.orderBy(F.desc("c"), "h").limit(COMMON).collect():
        found[r.h] = max(found.get(r.h, 0), r.c * SHARE)
    return _ranked(list(found.items()))


def _ranked(counts: list[tuple[int, float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes, their ranks (the rarest first) and their counts."""
    ordered = sorted(counts, key=lambda x: (x[1], x[0]))
    h, c = np.array([x for x, _ in ordered], np.int64).view(np.uint64), np.array([n for _, n in ordered], np.float64)
    order = np.argsort(h)
    return h[order], order + 1, c[order]


def _prefix_rows(df: DataFrame, text: str, shingle: int, similarity: float, common: tuple[np.ndarray, ...]) -> DataFrame:
    """(cell, set_hash, n, at): the shingles of each set's prefix and their places; copies of a text only once in a task."""
    shared = df.sparkSession.sparkContext.broadcast(common)

    def work(batches: Iterator[list]):
        seen: set[int] = set()
        for (texts,) in batches:
            cells, sets, sizes, places = [np.zeros(0, "<u8")], [], [], []
            for t in texts.cast("binary").to_pylist():
                distinct = shingle_set(t, shingle)
                x = set_hash(distinct)
                if not len(distinct) or x in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(x)
                prefix = ordered_prefix(distinct, *shared.value, similarity)
                cells.append(prefix), sets.append((x, len(prefix))), sizes.append(len(distinct)), places.append(np.arange(len(prefix), dtype=np.int32))
            each = [k for _, k in sets]
            yield [np.concatenate(cells).view(np.int64), np.repeat(np.array([x for x, _ in sets], np.int64), each), np.repeat(np.array(sizes, np.int32), each), np.concatenate([np.zeros(0, np.int32), *places])]

    return map_rows(df.select(F.col(text).alias("text")), ["text"], work, "cell long, set_hash long, n int, at int", arrow=True)


def _cells(batches: Iterator[list], objects: int = 0) -> Iterator[list[np.ndarray]]:
    """The columns of each cell of two or more rows, from batches of sorted cells; each set once. The last `objects` columns hold no numbers."""
    held: list[list[np.ndarray]] = []

    def closed(cols: list[np.ndarray], last: bool) -> Iterator[list[np.ndarray]]:
        ends = [*(np.flatnonzero(np.diff(cols[0])) + 1).tolist(), len(cols[0])]
        held.clear()
        if not last:
            start = ends[-2] if len(ends) > 1 else 0
            held.append([c[start:] for c in cols])
            ends.pop()
        start = 0
        for end in ends:
            if end - start > 1:
                part = [c[start:end] for c in cols]
                first = np.concatenate([[True], part[1][1:] != part[1][:-1]])
                if first.sum() > 1:
                    yield [c[first] for c in part]
            start = end

    for cols in batches:
        plain = len(cols) - objects
        now = [c.to_numpy(zero_copy_only=False) for c in cols[:plain]] + [np.fromiter(c.to_pylist(), object, len(c)) for c in cols[plain:]]
        if held and held[0][0][0] == now[0][-1]:
            held.append(now)
        else:
            yield from closed([np.concatenate(c) for c in zip(*held, now, strict=True)], False)
    if held:
        yield from closed([np.concatenate(c) for c in zip(*held, strict=True)], True)


def _near_in_cell(cell: list[np.ndarray], similarity: float, before: int | None, labels: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(i, js): the rows j < i of a cell, ordered by size, whose sizes and places allow the similarity to row i; among the `before` rows
    before it, if given; with `labels`, those of another label."""
    n, at = cell[2].astype(np.float64), cell[3]
    partner = (n - at) * (1 + similarity) / similarity - n + 1e-6  # the largest size of a similar set, if this is their first common shingle
    low = np.searchsorted(n, similarity * n - 1e-6)
    high = np.minimum(np.arange(len(n)), np.searchsorted(n, partner, side="right"))
    if before is not None:
        low = np.maximum(low, np.arange(len(n)) - before)
    most, others = None, None
    if labels is not None:
        values, counts = np.unique(labels, return_counts=True)
        if len(values) == 1:
            return
        most = values[np.argmax(counts)]
        others = np.flatnonzero(labels != most)
    for i in np.flatnonzero(high > low).tolist():
        if labels is not None and labels[i] == most:
            js = others[np.searchsorted(others, low[i]) : np.searchsorted(others, high[i])]
        else:
            js = np.arange(low[i], high[i])
            if labels is not None:
                js = js[labels[js] != labels[i]]
        js = js[partner[js] >= n[i]]
        if len(js):
            yield i, js


def _pairs_of(cell: list[np.ndarray], found: Iterator[tuple[int, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for i, js in found:
        yield np.minimum(cell[1][i], cell[1][js]), np.maximum(cell[1][i], cell[1][js])


def _first_pairs(entries: DataFrame, similarity: float) -> DataFrame:
    """(a, b, null...): pairs of cells, only of neighbours in crowded ones; (null, null, cell, set_hash, n, at): the rows of crowded cells."""

    def work(batches: Iterator[list]):
        a, b, rows, size = [], [], [], 0

        def block() -> list:
            import pyarrow as pa

            pairs, crowd = [np.concatenate([np.zeros(0, np.int64), *x]) for x in (a, b)], [np.concatenate([np.zeros(0, np.int64), *x]) for x in (list(zip(*rows, strict=True)) or [()] * 4)]
            return [pa.concat_arrays([pa.array(x), pa.nulls(len(crowd[0]), pa.int64())]) for x in pairs] + [pa.concat_arrays([pa.nulls(len(pairs[0]), pa.int64()), pa.array(x.astype(np.int64))]) for x in crowd]

        for cell in _cells(batches):
            crowded = len(cell[0]) > CROWD
            if crowded:
                rows.append(cell)
                size += len(cell[0])
            for x, y in _pairs_of(cell, _near_in_cell(cell, similarity, NEIGHBOURS[0] if crowded else None)):
                a.append(x), b.append(y)
                size += len(x)
            if size > 100_000:
                yield block()
                a, b, rows, size = [], [], [], 0
        if size:
            yield block()

    ordered = entries.repartition("cell").sortWithinPartitions("cell", "n", "set_hash")
    return map_rows(ordered, ["cell", "set_hash", "n", "at"], work, "a long, b long, cell long, set_hash long, n long, at long", arrow=True)


def _rows_apart(crowded: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """(cell, set_hash, n, at, label): the rows of crowded cells that sizes and places let be similar to a row of another component. Rows, not pairs, are given out."""

    def work(batches: Iterator[list]):
        for cell in _cells(batches):
            wanted = np.zeros(len(cell[0]), bool)
            for i, js in _near_in_cell(cell, similarity, None, cell[4]):
                wanted[i] = True
                wanted[js] = True
            if wanted.any():
                yield [c[wanted] for c in cell]

    named = crowded.join(roots, crowded.set_hash == roots.node, "left").select("cell", "set_hash", "n", "at", F.coalesce("root", "set_hash").alias("label"))
    ordered = named.repartition("cell").sortWithinPartitions("cell", "n", "set_hash")
    return map_rows(ordered, ["cell", "set_hash", "n", "at", "label"], work, "cell long, set_hash long, n int, at int, label long", arrow=True)


def _pairs_apart(rows: DataFrame, classes: DataFrame, similarity: float, before: int | None) -> DataFrame:
    """(a, b): pairs of such rows whose sketches allow the similarity too; all of them, or at most `before` for each row of a cell."""
    share = similarity / (1 + similarity)

    def work(batches: Iterator[list]):
        for cell in _cells(batches, objects=1):
            a, b, size, bounds = [], [], 0, Sketches(cell[5].tolist())
            for i, js in _near_in_cell(cell[:5], similarity, None, cell[4]):
                near = js[bounds.most_common(i, js) >= share * (cell[2][i] + cell[2][js]) - 1e-9][-(before or 0) :]
                if len(near):
                    a.append(np.minimum(cell[1][i], cell[1][near])), b.append(np.maximum(cell[1][i], cell[1][near]))
                    size += len(near)
                if size > 100_000:
                    yield [np.concatenate(a), np.concatenate(b)]
                    a, b, size = [], [], 0
            if size:
                yield [np.concatenate(a), np.concatenate(b)]

    known = rows.join(classes.select("set_hash", "sketch"), "set_hash").select("cell", "set_hash", "n", "at", "label", "sketch")
    ordered = known.repartition("cell").sortWithinPartitions("cell", "n", "set_hash")
    return map_rows(ordered, ["cell", "set_hash", "n", "at", "label", "sketch"], work, "a long, b long", arrow=True).distinct()


def _possible(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose sketches allow the similarity, as a table."""
    share = similarity / (1 + similarity)

    def work(batches: Iterator[list]):
        for a, b, n, m, x, y in batches:
            keep = [most_common(p, q) >= share * (i + j) - 1e-9 for i, j, p, q in zip(n.to_pylist(), m.to_pylist(), x.to_pylist(), y.to_pylist(), strict=True)]
            yield [a.filter(keep), b.filter(keep)]

    sides = [classes.select(F.col("set_hash").alias(e), F.col("n").alias(f"n{e}"), F.col("sketch").alias(f"s{e}")) for e in ("a", "b")]
    both = pairs.join(sides[0], "a").join(sides[1], "b")
    return table(map_rows(both, ["a", "b", "na", "nb", "sa", "sb"], work, "a long, b long", arrow=True), "possible")


def _similar(df: DataFrame, possible: DataFrame, text: str, shingle: int, similarity: float, classes: DataFrame) -> DataFrame:
    """(u, v): the pairs whose whole sets have the similarity. Sets are exchanged once, by their hash, and both ends read that exchange."""
    ids = possible.select(F.col("a").alias("set_hash")).unionByName(possible.select(F.col("b").alias("set_hash"))).distinct()
    needed = table(classes.select("set_hash", "text_hash").join(ids, "set_hash", "left_semi"), "sets-needed")
    sets = _whole_sets(df, text, shingle, needed).dropDuplicates(["set_hash"])
    both = possible.join(sets.select(F.col("set_hash").alias("a"), F.col("h").alias("x")), "a").join(sets.select(F.col("set_hash").alias("b"), F.col("h").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    out = table(both.where(common >= similarity * (F.size("x") + F.size("y") - common) - 1e-9).select(F.col("a").alias("u"), F.col("b").alias("v")), "similar")
    drop_table(needed)
    return out


def similar_roots(df: DataFrame, rows: DataFrame, text: str, shingle: int, similarity: float) -> DataFrame:
    """(node, root): components of set hashes of `rows` linked by the similarity; a node that is its own root is left out. Where `rows` have fp, pairs within
    3 bits are tried too, from the grid of fingerprints; whole sets decide either kind."""
    classes = table(rows.where("n > 0").groupBy("set_hash").agg(F.min("text_hash").alias("text_hash"), F.any_value("n").alias("n"), F.any_value("sketch").alias("sketch")), "sets-of-texts")
    found = table(_first_pairs(_prefix_rows(df, text, shingle, similarity, _common_shingles(df, text, shingle, similarity, classes)), similarity), "cells")
    by_sets = found.where(F.col("a").isNotNull()).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = table((by_sets.unionByName(_pairs_by_fingerprint(rows)) if "fp" in rows.columns else by_sets).distinct(), "pairs")
    possible = _possible(pairs, classes, similarity)
    more = _similar(df, possible, text, shingle, similarity, classes)
    roots = component_roots(more)
    drop_table(pairs), drop_table(possible), drop_table(more)
    crowded = found.where(F.col("cell").isNotNull()).select("cell", "set_hash", "n", "at")
    for before in NEIGHBOURS[1:]:
        rows_apart = table(_rows_apart(crowded, roots, similarity), "rows-apart")
        apart = table(_pairs_apart(rows_apart, classes, similarity, before), "pairs-apart")
        drop_table(rows_apart)
        if apart.isEmpty():
            drop_table(apart)
            break
        more = _similar(df, apart, text, shingle, similarity, classes)
        joined = more
        for e in ("u", "v"):  # what is joined already is one node
            joined = joined.join(roots.select(F.col("node").alias(e), F.col("root").alias("to")), e, "left").withColumn(e, F.coalesce("to", e)).drop("to")
        links = roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(joined.where("u != v").select("u", "v").distinct())
        roots = component_roots(links)
        drop_table(apart), drop_table(more)
    drop_table(found), drop_table(classes)
    return roots


def near_duplicate_components(
    df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, cell_limit: int = CELL_LIMIT, similarity: float | None = None
) -> DataFrame:
    """(id, fp, component): one row per input row; the component is the smallest id reachable, FIRST_ID standing for null. With a
    `similarity`, sets of shingles that have it are linked as well."""
    if similarity is None:
        return _by_fingerprint(table(fingerprints(df, key, text, shingle), "fingerprints"), cell_limit)
    rows = table(set_rows(df, key, text, shingle, bits=True), "fingerprints")
    near = table(_by_fingerprint(rows.select("id", "fp"), cell_limit), "near")
    sets = similar_roots(df, rows.drop("fp"), text, shingle, similarity)
    named = rows.join(sets, rows.set_hash == sets.node, "left").select("fp", F.coalesce("root", "set_hash").alias("label"))
    both = named.join(near.select("fp", "component").distinct(), "fp").select("label", "component").distinct()
    least = both.groupBy("label").agg(F.min("component").alias("v"))
    roots = component_roots(both.join(least, "label").select(F.col("component").alias("u"), "v").where("u != v").distinct())
    return near.join(roots, near.component == roots.node, "left").select("id", "fp", F.coalesce("root", "component").alias("component"))


def _links_of(fps: DataFrame, cell_limit: int) -> DataFrame:
    """(u, v): links that connect all distinct fingerprints within distance 3, by cells and, for crowded ones, by values at which they meet."""
    found = table(_cell_links(fps, cell_limit), "links")
    links = found.where(F.col("v").isNotNull())
    crowded = found.where(F.col("v").isNull()).select(F.col("u").alias("fp")).distinct()
    return links if crowded.isEmpty() else links.unionByName(meeting_links(crowded))


def _pairs_by_fingerprint(rows: DataFrame) -> DataFrame:
    """(a, b): sets whose fingerprints are equal or linked; a fingerprint's least set stands for it in links."""
    sets = rows.where("n > 0").select("fp", "set_hash").distinct()
    least = sets.groupBy("fp").agg(F.min("set_hash").alias("rep"))
    equal = sets.join(least, "fp").where("set_hash != rep").select(F.col("rep").alias("a"), F.col("set_hash").alias("b"))
    ends = [least.select(F.col("fp").alias(e), F.col("rep").alias(n)) for e, n in (("u", "a"), ("v", "b"))]
    linked = _links_of(least.select("fp"), CELL_LIMIT).distinct().join(ends[0], "u").join(ends[1], "v").select("a", "b")
    return equal.unionByName(linked).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _by_fingerprint(rows: DataFrame, cell_limit: int) -> DataFrame:
    """The components by fingerprints alone."""
    classes = rows.groupBy("fp").agg(F.min("id").alias("rep"))
    roots = component_roots(_links_of(classes.select("fp"), cell_limit))
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component"))
    return rows.join(rooted.join(least, "root").select("fp", "component"), "fp").select("id", "fp", "component")


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    out = near_duplicate_components(read(spark, sf_dir, "documents"))
    back = lambda c: F.when(F.col(c) != FIRST_ID, F.col(c))
    return out.select(back("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), back("component").alias("component_id"))
