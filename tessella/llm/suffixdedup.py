"""Removal of repeated byte passages by a sparse suffix array, built as a distributed merge sort that knows common prefixes.

A byte goes if it lies in a `window`-byte string (50) that also starts in a document with a smaller id. Sorting every suffix of a corpus
would write many times its size, so suffixes are taken at anchors only: of the k-byte strings inside a window the leftmost with the
least hash. Equal windows have their anchor at the same place, so nothing is missed. What an anchor owns, all windows that chose it, is one
string around it: the suffix from the anchor, and some bytes before it.

1. Anchors are hashed; hash ranges are exchanged as packed (hash, id) arrays, and what occurs in one document only is dropped. A string
   that several documents of a batch share travels once for the batch, whatever the number of copies.
2. The suffixes at the remaining anchors are sorted within each batch, equal ones collapsed to the smallest id (the others are repeats
   already), front-coded and exchanged as runs.
3. A loser tree merges the runs. Each run's head keeps the length of the prefix that it shares with the last suffix put out; the longer of
   two such prefixes decides without looking at the bytes, and equal ones are compared from there on only.
4. Anchors with the same k bytes stand together in the merged order. Where they agree in all they own, the smallest id keeps its copy; where
   they differ, their windows are compared one by one.

A string of k bytes in more than HOT documents could bring as many contexts together (some 30 MB). Its windows hold LONGER bytes more on its right or on
its left; they are dealt by these longer strings instead, to other buckets, so that no task gets all.

The number of buckets follows the bytes of the input, so that one holds about BUCKET_BYTES of text, up to MOST_BUCKETS of them (of 1 TB
each has 16 MB, of 100 TB 400 MB). An anchor's hash is the least of 31, so that most are small: they are multiplied before their high bits name a
bucket, else the first one has 16 times its share. Sorting makes keys for one bucket of a batch at a time; merging decodes runs as it reads them.

Null text: no bytes. Documents under 50 bytes are never touched. A null id comes before all others; rows with equal ids don't count as
each other's copies. Texts of any length are searched for anchors in segments; the places of their shared anchors are in memory at once. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import map_rows, read, table, with_kept

WINDOW, ANCHOR, LONGER, HOT, SEGMENT = 50, 20, 15, 100_000, 2_000_000
BUCKETS, MOST_BUCKETS, BUCKET_BYTES = 1024, 1 << 18, 16_000_000
FIRST_ID = -(1 << 63)
_LAST = np.uint64(1)
_MUL, _MIX1, _MIX2, _EVEN = 0xD6E8FEB86659FD93, np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
#: Bits of an anchor's hash that travel; equal ones are candidates only, whole strings decide.
_SENT = np.uint64((1 << 64) - (1 << 16))


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of each k-byte string, by joining hashes of lengths 1, 2, 4, ...; len(data) - k + 1 of them."""
    part, length = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), 1
    whole, done = None, 0
    while True:
        if k & length:
            if whole is None:
                whole = part
            else:
                n = len(part) - done
                whole = whole[:n] * np.uint64(pow(_MUL, length, 1 << 64)) + part[done : done + n]
            done += length
        if done == k:
            break
        part = part[:-length] * np.uint64(pow(_MUL, length, 1 << 64)) + part[length:]
        length *= 2
    whole = (whole ^ (whole >> np.uint64(30))) * _MIX1
    whole = (whole ^ (whole >> np.uint64(27))) * _MIX2
    return whole ^ (whole >> np.uint64(31))


def anchors(data: np.ndarray, window: int = WINDOW, k: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, evened out, 48 bits; position, first, last window start owned) of each anchor of a text, segment by segment."""
    parts = []
    for at in range(0, max(1, len(data) - window + 1), SEGMENT):
        seg = data[at : at + SEGMENT + window - 1]
        if len(seg) < window:
            break
        value = gram_hashes(seg, k)
        h, width, span = value, window - k + 1, 1
        pos = np.arange(len(value), dtype=np.int32)
        while span < width:
            step = min(span, width - span)
            left = value[:-step] <= value[step:]
            value, pos = np.where(left, value[:-step], value[step:]), np.where(left, pos[:-step], pos[step:])
            span += step
        first = np.flatnonzero(np.concatenate([[True], pos[1:] != pos[:-1]]))
        x = pos[first]
        last = np.concatenate([first[1:], [len(pos)]]) - 1
        parts.append((h[x] * _EVEN & _SENT, x.astype(np.int64) + at, first + at, last + at))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))


def _pack(*arrays: np.ndarray) -> bytes:
    import zstandard

    head = np.array([len(a) for a in arrays], "<u4").tobytes()
    planes = (a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes() for a in arrays)  # all first bytes, all second ones, ...
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(planes))


def _unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    lens, at, out = np.frombuffer(raw, "<u4", len(kinds)), 4 * len(kinds), []
    for n, kind in zip(lens.tolist(), kinds, strict=True):
        size = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, n * size, at)
        out.append(planes if size == 1 else planes.reshape(size, n).T.copy().view(kind).ravel())
        at += n * size
    return out


def buckets_for(docs: DataFrame) -> int:
    """A power of two that follows the bytes of text."""
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(MOST_BUCKETS, max(BUCKETS, 1 << (n_bytes // BUCKET_BYTES).bit_length()))


def _gathered(batches: Iterator[list], text_at: int, buckets: int) -> Iterator[list]:
    """Batches joined until they have about a kilobyte of text for each bucket, so that many buckets don't make tiny parts."""
    import pyarrow as pa

    least, held, size = min(64_000_000, 1000 * buckets), [], 0
    for cols in batches:
        held.append(cols)
        size += cols[text_at].nbytes
        if size >= least:
            yield [pa.concat_arrays(c) for c in zip(*held, strict=True)] if len(held) > 1 else cols
            held, size = [], 0
    if held:
        yield [pa.concat_arrays(c) for c in zip(*held, strict=True)]


def _by_bucket(batches: Iterator[list[list]]) -> Iterator[tuple[int, list[list]]]:
    """Rows of one bucket at a time, from rows sorted by bucket (first column)."""
    bucket, held = None, []
    for cols in batches:
        for row in zip(*cols, strict=True):
            if row[0] != bucket:
                if held:
                    yield bucket, held
                bucket, held = row[0], []
            held.append(row)
    if held:
        yield bucket, held


def _dealt(df: DataFrame, buckets: int) -> DataFrame:
    """By bucket. Fewer partitions than buckets, so that each has several and they even out."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(1, min(parts, buckets)), "b").sortWithinPartitions("b")


def shared_anchors(docs: DataFrame, buckets: int = BUCKETS, hot: int = HOT) -> DataFrame:
    """(id, h): anchor hashes of each document that occur in another document too; the last bit tells whether in more than `hot`."""
    bits = np.uint64(64 - (buckets.bit_length() - 1))

    def exchange(batches: Iterator[list]):
        for ids, texts in _gathered(batches, 1, buckets):
            hs, ds = [], []
            for d, t in zip(ids.to_pylist(), texts.cast("binary").to_pylist(), strict=True):
                if t and len(t) >= WINDOW:
                    h = np.unique(anchors(np.frombuffer(t, np.uint8))[0])
                    hs.append(h)
                    ds.append(np.full(len(h), d, np.int64))
            if not hs:
                continue
            h, d = np.concatenate(hs), np.concatenate(ds)
            order = np.argsort(h, kind="stable")
            h, d = h[order], d[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            size = np.diff(np.concatenate([first, [len(h)]]))
            several = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)
            known = np.repeat(several, size)
            out_b, out_blob = [], []
            b = (h[first] >> bits).astype(np.int64)
            cuts = np.searchsorted(b, np.arange(buckets + 1))
            for i in range(buckets):
                f = slice(cuts[i], cuts[i + 1])
                if cuts[i] < cuts[i + 1]:
                    rows = first[f]
                    one = d[rows]
                    a, z = first[cuts[i]], first[cuts[i + 1]] if cuts[i + 1] < len(first) else len(h)
                    here = known[a:z]
                    base = one.min()
                    out_b.append(i)
                    out_blob.append(_pack(np.array([base], "<i8"), h[rows].astype("<u8"), (one - base).astype("<i8"), several[f].astype("u1"), h[a:z][here].astype("<u8"), d[a:z][here].astype("<i8")))
            yield [out_b, out_blob]

    def meet(batches: Iterator[list[list]]):
        for _, rows in _by_bucket(batches):
            hs, ds, fs, kh, kd = [], [], [], [], []
            for _, blob in rows:
                base, h, d, f, h2, d2 = _unpack(blob, "<i8", "<u8", "<i8", "u1", "<u8", "<i8")
                hs.append(h), ds.append(d + base[0]), fs.append(f), kh.append(h2), kd.append(d2)
            h, d, f = np.concatenate(hs), np.concatenate(ds), np.concatenate(fs)
            order = np.argsort(h, kind="stable")
            h, d, f = h[order], d[order], f[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            shared = (np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)) | (np.maximum.reduceat(f, first) > 0)
            pick = np.repeat(shared, np.diff(np.concatenate([first, [len(h)]]))) & (f == 0)
            ids, found = np.concatenate([d[pick], *kd]), np.concatenate([h[pick], *kh])
            _, at, count = np.unique(found, return_inverse=True, return_counts=True)
            found = found & ~_LAST | (count > hot)[at].astype(np.uint64)
            for at in range(0, len(ids), 100_000):
                yield [ids[at : at + 100_000], found[at : at + 100_000].view(np.int64)]

    sent = map_rows(docs, ["id", "text"], exchange, "b int, blob binary", arrow=True)
    return map_rows(_dealt(sent, buckets), ["b", "blob"], meet, "id long, h long")


def common_prefix(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of a and b, of which the first `at` bytes are known to agree."""
    n = min(len(a), len(b))
    while at < n:
        x, y = a[at : at + 8], b[at : at + 8]
        if x != y:
            m = min(len(x), len(y))
            for i in range(m):
                if x[i] != y[i]:
                    return at + i
            return at + m
        at += len(x)
    return n


class Run:
    """A front-coded run: sorted keys, each as the length of what it shares with the one before, and the rest."""

    __slots__ = ("key", "shared", "value", "_next")

    def __init__(self, lcps: Iterable[int], lens: Iterable[int], rest: bytes | memoryview, values: Iterable) -> None:
        self._next = self._read(lcps, lens, rest, values)
        self.key: bytes | None = b""
        self.shared = 0
        self.advance()

    @staticmethod
    def _read(lcps, lens, rest, values):
        key, at = b"", 0
        for lcp, n, value in zip(lcps, lens, values, strict=True):
            key = key[:lcp] + rest[at : at + n]
            at += n
            yield key, lcp, value

    def advance(self) -> None:
        """The next key; `shared` is then what it has in common with the one just left."""
        self.key, self.shared, self.value = next(self._next, (None, 0, None))


def front_code(keys: list[bytes]) -> tuple[list[int], list[int], bytes]:
    lcps, lens, rest, last = [], [], [], b""
    for key in keys:
        lcp = common_prefix(last, key, 0)
        lcps.append(lcp)
        lens.append(len(key) - lcp)
        rest.append(key[lcp:])
        last = key
    return lcps, lens, b"".join(rest)


def merge_runs(runs: list[Run]) -> Iterator[tuple[bytes, int, object]]:
    """(key, prefix shared with the key before, value) in order, by a loser tree. Every head in the tree carries the length of the prefix
    it shares with the last winner of its node. Both contenders are not less than that winner, so the one that shares more with it is
    the smaller; only if both share the same length are bytes compared, from that length on."""
    runs = [r for r in runs if r.key is not None]
    size = 1
    while size < len(runs):
        size *= 2
    if not runs:
        return
    loser: list[Run | None] = [None] * size

    def less(a: Run | None, b: Run | None) -> bool:
        """Whether a wins; the loser's `shared` then counts against the winner."""
        if b is None or b.key is None:
            return True
        if a is None or a.key is None:
            return False
        if a.shared != b.shared:
            return a.shared > b.shared
        at = common_prefix(a.key, b.key, a.shared)
        ka, kb = a.key, b.key
        if at == len(ka) or at < len(kb) and ka[at] < kb[at]:
            b.shared = at
            return True
        a.shared = at
        return False

    def build(node: int) -> Run | None:
        if node >= size:
            return runs[node - size] if node - size < len(runs) else None
        a, b = build(2 * node), build(2 * node + 1)
        if less(a, b):
            loser[node] = b
            return a
        loser[node] = a
        return b

    leaf = {id(r): size + i for i, r in enumerate(runs)}
    winner = build(1) if size > 1 else runs[0]
    while winner is not None and winner.key is not None:
        yield winner.key, winner.shared, winner.value
        node = leaf[id(winner)] // 2
        winner.advance()
        while node:
            other = loser[node]
            if not less(winner, other):
                loser[node] = winner
                winner = other
            node //= 2


def repeated_windows(group: list[tuple[bytes, int, int, int]], k: int, window: int) -> Iterator[tuple[int, int, int, int]]:
    """(id, row, start, end) of what is repeated among suffixes with the same first k bytes; each is (key, id, row, position)."""
    least: dict[bytes, int] = {}
    for key, d, _, _ in group:
        if key not in least or d < least[key]:
            least[key] = d
    if len(least) == 1:
        ((key, smallest),) = least.items()
        size = len(key) - 3
        for _, d, row, x in group:
            if d > smallest:
                start = x - key[k + 2]
                yield d, row, start, start + size
        return
    first: dict[bytes, int] = {}
    strings = {}
    for key, d in least.items():
        right, before = key[k + 1], key[k + 2]
        cut = right + 3
        s = key[cut : cut + before] + key[1 : k + 1] + key[k + 3 : cut]
        strings[key] = s
        for i in range(len(s) - window + 1):
            w = s[i : i + window]
            if d < first.get(w, d + 1):
                first[w] = d
    for key, d, row, x in group:
        s, start, open_at = strings[key], x - key[k + 2], None
        n = len(s) - window + 1
        for i in range(n + 1):
            hit = i < n and first[s[i : i + window]] < d
            if hit and open_at is None:
                open_at = i
            elif not hit and open_at is not None:
                yield d, row, start + open_at, start + i - 1 + window
                open_at = None


def _key(data: bytes, x: int, first: int, last: int, k: int, window: int) -> bytes:
    """Sort key of an anchor's suffix: k, its first k bytes, the lengths after and before the anchor, the rest after it, what is before it."""
    end = last + window
    return bytes((k,)) + data[x : x + k] + bytes((end - x, x - first)) + data[x + k : end] + data[first:x]


def _entries(t: bytes, shared: np.ndarray, bits: int) -> np.ndarray:
    """Rows of (bucket, position, first, last window start, k) of a text's shared anchors, a hot one by the longer strings of its windows."""
    h, x, first, last = anchors(np.frombuffer(t, np.uint8))
    plain, hot = h & ~_LAST, shared[(shared & _LAST) > 0]
    found = np.isin(plain, shared & ~_LAST if len(hot) else shared)
    out = []
    if len(hot):
        is_hot = np.isin(plain, hot & ~_LAST)
        found &= ~is_hot
        k = ANCHOR + LONGER
        longer = lambda at: xxhash.xxh64_intdigest(t[at : at + k]) >> bits
        for a, f, z in zip(x[is_hot].tolist(), first[is_hot].tolist(), last[is_hot].tolist(), strict=True):
            middle = max(f, a - LONGER)
            if middle <= z:  # windows with so many bytes on the anchor's right
                out.append((longer(a), a, middle, z, k))
            if f < middle:  # on its left
                at = a - LONGER
                out.append((longer(at), at, f, min(z, middle - 1), k))
    cold = np.flatnonzero(found)
    places = np.stack([(h[cold] >> np.uint64(bits)).astype(np.int32), x[cold], first[cold], last[cold], np.full(len(cold), ANCHOR)], axis=1, dtype=np.int32, casting="unsafe")
    return np.concatenate([places, np.array(out, np.int32)]) if out else places


def repeats(docs: DataFrame, shared: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(id, row, start, end): byte ranges that repeat what a document with a smaller id has. `row` is the hash of the text, which tells
    rows with one id apart."""
    bits = 64 - (buckets.bit_length() - 1)

    def runs(batches: Iterator[list]):
        for ids, row_ids, texts, hashes in _gathered(batches, 2, min(buckets, 16_000)):
            ids, row_ids, texts = ids.to_pylist(), row_ids.to_pylist(), texts.cast("binary").to_pylist()
            found = [(i, _entries(t, hs.values.to_numpy().view(np.uint64), bits)) for i, (t, hs) in enumerate(zip(texts, hashes, strict=True)) if t and len(t) >= WINDOW]
            if not found:
                continue
            places, at = np.concatenate([e for _, e in found]), np.repeat(np.array([i for i, _ in found], np.int32), [len(e) for _, e in found])
            order = np.argsort(places[:, 0], kind="stable")
            places, at = places[order], at[order]
            cuts = np.flatnonzero(np.diff(places[:, 0], prepend=-1, append=-1)).tolist()
            out: list[list] = [[], []]
            done: list[tuple[int, int, int, int]] = []
            keys, values = [], []

            def close(bucket: int) -> None:
                lcps, lens, rest = front_code(keys)
                out[0].append(bucket)
                out[1].append(_pack(np.array(lcps, "u1"), np.array(lens, "u1"), np.frombuffer(rest, "u1"), *(np.array([v[i] for v in values], "<i8") for i in range(3)), *_marks(done)))
                done.clear(), keys.clear(), values.clear()

            for a, z in zip(cuts, cuts[1:]):
                entries = sorted((_key(texts[i], x, f, e, k, WINDOW), ids[i], row_ids[i], x) for i, (_, x, f, e, k) in zip(at[a:z].tolist(), places[a:z].tolist(), strict=True))
                before, smallest = None, 0
                for key, d, row, x in entries:
                    if key != before:
                        before, smallest = key, d
                    if d > smallest:  # a repeat within this batch
                        start = x - key[key[0] + 2]
                        done.append((d, row, start, start + len(key) - 3))
                    else:
                        keys.append(key)
                        values.append((d, row, x))
                close(int(places[a, 0]))
            if out[0]:
                yield out

    def merge(batches: Iterator[list[list]]):
        for _, rows in _by_bucket(batches):
            read_runs = []
            for i, (_, blob) in enumerate(rows):
                lcps, lens, rest, d, r, x, *marks = _unpack(blob, "u1", "u1", "u1", *["<i8"] * 7)
                rows[i] = blob = None
                read_runs.append(Run(lcps.tobytes(), lens.tobytes(), memoryview(rest), _few(d, r, x)))
                if len(marks[0]):
                    yield marks
            group: list[tuple[bytes, int, int, int]] = []
            out: list[tuple[int, int, int, int]] = []
            k = 0
            for key, agree, value in merge_runs(read_runs):
                if agree <= k and group:
                    if len(group) > 1:
                        out += repeated_windows(group, k, WINDOW)
                    if len(out) >= 50_000:
                        yield _marks(out)
                        out = []
                    group = []
                k = key[0]
                group.append((key, *value))
            if len(group) > 1:
                out += repeated_windows(group, k, WINDOW)
            if out:
                yield _marks(out)

    with_hashes = docs.join(shared.groupBy("id").agg(F.collect_list("h").alias("hs")), "id")
    sent = map_rows(with_hashes, ["id", "row", "text", "hs"], runs, "b int, blob binary", arrow=True)
    return map_rows(_dealt(sent, buckets), ["b", "blob"], merge, "id long, row long, start int, end int")


def _few(*columns: np.ndarray, step: int = 64) -> Iterator[tuple]:
    """Rows of the columns, of which only a few are Python's numbers at a time."""
    for at in range(0, len(columns[0]), step):
        yield from zip(*(c[at : at + step].tolist() for c in columns), strict=True)


def _marks(rows: list[tuple[int, int, int, int]]) -> list[np.ndarray]:
    a = np.array(rows, "<i8").reshape(-1, 4)
    return [a[:, i].copy() for i in range(4)]


def united(starts: Iterable[int], ends: Iterable[int]) -> list[tuple[int, int]]:
    """Maximal runs that the ranges cover."""
    out: list[list[int]] = []
    for a, z in sorted(zip(starts, ends, strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


def _spans(own, rows, starts, ends) -> Iterator[list[tuple[int, int]]]:
    """Each row's maximal ranges: of those of its id, the ones that are for its text."""
    for me, r, a, z in zip(own.to_pylist(), rows.to_pylist(), starts.to_pylist(), ends.to_pylist(), strict=True):
        mine = [(s, e) for x, s, e in zip(r, a, z, strict=True) if x == me] if r else []
        yield united([s for s, _ in mine], [e for _, e in mine])


def removal_spans(df: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The documents as (id, row, text) and, for ids with any, the ranges as arrays (id, rows, starts, ends). Both joins with the
    documents are by id alone, so that one exchange of the texts serves both."""
    docs = df.select(F.coalesce(F.col(key), F.lit(FIRST_ID)).alias("id"), F.xxhash64(text).alias("row"), F.col(text).alias("text"))
    buckets = buckets_for(docs)
    shared = table(shared_anchors(docs, buckets), "suffix-anchors")
    marks = repeats(docs, shared, buckets)
    return docs, marks.groupBy("id").agg(F.collect_list("row").alias("rows"), F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))


def dedup_digests(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    def work(batches: Iterator[list]):
        for ids, own, texts, rows, starts, ends in batches:
            out: list[list] = [[], [], [], [], []]
            for d, t, spans in zip(ids.to_pylist(), texts.cast("binary").to_pylist(), _spans(own, rows, starts, ends), strict=True):
                data = t or b""
                kept, at = hashlib.sha256(), 0
                for s, e in spans:
                    kept.update(data[at:s])
                    at = e
                kept.update(data[at:])
                for c, v in zip(out, (None if d == FIRST_ID else d, len(data), sum(e - s for s, e in spans), len(spans), kept.hexdigest()), strict=True):
                    c.append(v)
            yield out

    docs, spans = removal_spans(df, key, text)
    joined = docs.join(spans, "id", "left")
    return map_rows(joined, ["id", "row", "text", "rows", "starts", "ends"], work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", arrow=True)


def without_repeats(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows with what remains of their texts; a character cut in two goes whole. Other columns, of any name, stay as they are."""

    def work(batches: Iterator[list]):
        for kept, texts, own, rows, starts, ends in batches:
            out = []
            for t, spans in zip(texts.cast("binary").to_pylist(), _spans(own, rows, starts, ends), strict=True):
                parts, at = [], 0
                for s, e in spans:
                    parts.append(t[at:s])
                    at = e
                out.append(None if t is None else "".join(p.decode("utf-8", "ignore") for p in [*parts, t[at:]]))
            yield [kept, out]

    _, spans = removal_spans(df, key, text)
    rows = df.select(F.struct(*(c for c in df.columns if c != text)).alias("kept"), F.col(text).alias("text"), F.coalesce(F.col(key), F.lit(FIRST_ID)).alias("id"), F.xxhash64(text).alias("row"))
    out = map_rows(rows.join(spans, "id", "left"), ["kept", "text", "row", "rows", "starts", "ends"], work, with_kept(rows, "remains string"), arrow=True)
    return out.select(*(F.col("remains").alias(text) if c == text else F.col("kept").getField(c).alias(c) for c in df.columns))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document when passages of 50 bytes that a smaller id has are removed."""
    return dedup_digests(read(spark, sf_dir, "documents"))
