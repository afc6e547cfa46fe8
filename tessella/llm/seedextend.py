"""Substring dedup by seed and extend: every word inside a window of words that also starts anywhere else goes.

Seeds are winnowed anchors: of the 26 ten-word strings in a window of 35 words the one of least hash (the last of equal ones), so that equal
windows have the same anchor at the same place. Documents are joined on the anchors. A seed is extended both ways as far as neighbouring windows
have the same anchor; this stretch of words is a zone, in numbers some 1/13 of the words. Where all zones of a shared anchor are equal, the match
holds over all of them. Where they differ, equal zones still match whole, and one zone of each kind is extended window by window, from
the anchor to both sides, against the others of its anchor. Runs of matched windows are the maximal repeats. No pairs are formed: zones and windows
are counted by their content, which also combines the copies of a hot passage before an exchange, and the joins back are by key, which Spark
may split.

Only a second scan of the texts knows the windows of a zone. It picks the zones to extend by a Bloom filter of fixed size (16 MB); what this lets
through beyond them are other windows of the corpus, so it costs time only. Hashes have 64 bits; windows are equal by that of the anchor and that
of the whole, texts by hash and length.

A null or empty text has no words, one of fewer words than a window loses none. Long texts are read in segments, and a zone ends with its segment.
Repeated rows are places like any other: of two equal texts of 35 words nothing stays. Rows that share an id, or have none, stay
rows of their own. An empty table gives no rows; extra columns are ignored, or kept by `without_repeated_windows`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import drop_table, map_rows, read, table, with_kept
from tessella.llm.membership import filter_of, held

LENGTH, ANCHOR = 35, 10
SEGMENT, CACHED = 1 << 20, 500_000
_BLANK = re.compile(rb"[\x09-\x0D\x20]")
_FACTOR = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = []


class WordHashes(dict):
    """Hashes of words, the latest some 500 000 of them kept."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def segments(text: bytes, most: int = SEGMENT) -> Iterator[list[bytes]]:
    """The words of a text, in lists of some `most` bytes; words are never cut."""
    at = 0
    while at < len(text):
        blank = _BLANK.search(text, at + most) if at + most < len(text) else None
        end = blank.start() if blank else len(text)
        if words := text[at:end].split():
            yield words
        at = end


def blocks(text: bytes, hashes: WordHashes, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """(place of the first word, hashes of words) of parts of a text, of which each begins with the last length - 1 words of the one before, so
    that every window lies in exactly one."""
    rest, base = np.empty(0, np.uint64), 0
    for words in segments(text):
        w = np.concatenate([rest, np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))])
        if len(w) >= length:
            yield base, w
            base += len(w) - length + 1
            w = w[len(w) - length + 1 :]
        rest = w


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(factor: int, n: int) -> np.ndarray:
    out = np.full(n, factor, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Prefixes:
    """Hashes of any stretch of words, from sums of the words' hashes times powers of an odd number."""

    def __init__(self, words: np.ndarray) -> None:
        if not _POWERS or len(_POWERS[0]) <= len(words):
            size = 1 << len(words).bit_length()
            _POWERS[:] = _powers(_FACTOR, size), _powers(pow(_FACTOR, -1, 1 << 64), size)
        up, self.down = _POWERS
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * up[: len(words)], out=self.sums[1:])

    def of(self, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[: len(self.sums)][start])

    def grams(self, k: int) -> np.ndarray:
        return self.of(slice(0, len(self.sums) - k), slice(k, None))


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """For each stretch of `width` values the place of the least, the last of equal ones."""
    at, size = np.arange(len(values), dtype=np.int32), 1
    while size < width:
        step = min(size, width - size)
        left, right = at[:-step], at[step:]
        at = np.where(values[right] <= values[left], right, left)
        size += step
    return at


def zones(words: np.ndarray, length: int, anchor: int) -> tuple[Prefixes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The stretches of windows with one anchor: (hashes, first window, number of windows, anchor's hash, hash of all words)."""
    p = Prefixes(words)
    grams = p.grams(anchor)
    chosen = least_places(grams, length - anchor + 1)
    start = np.concatenate([[0], np.flatnonzero(chosen[1:] != chosen[:-1]) + 1])
    n = np.diff(np.append(start, len(chosen)))
    return p, start, n, grams[chosen[start]], p.of(start, start + n + length - 1) ^ n.astype(np.uint64)


def _place_key(z: np.ndarray, h: int, start: np.ndarray) -> np.ndarray:
    s = start.astype(np.uint64)
    return z ^ np.uint64(h & 0xFFFFFFFFFFFFFFFF) ^ (s << np.uint64(13)) ^ (s << np.uint64(40))


def place_key() -> Column:
    """The same of the columns z, h and s."""
    s = F.col("s").cast("long")
    return F.col("z").bitwiseXOR(F.col("h")).bitwiseXOR(F.shiftleft(s, 13)).bitwiseXOR(F.shiftleft(s, 40))


def _text_key(text: str) -> list[Column]:
    """What tells texts apart in the joins: hash and length."""
    t = F.col(f"`{text}`")
    return [F.xxhash64(t).alias("h"), F.coalesce(F.octet_length(t), F.lit(0)).alias("b")]


def seeds(texts: DataFrame, length: int, anchor: int) -> DataFrame:
    """(h, b, s, n, a, z): the zones of all texts, as text, first window, number of windows, anchor and content."""

    def work(batches: Iterator[list]):
        hashes = WordHashes()
        for hs, bs, values in batches:
            parts: list[list[np.ndarray]] = [[], [], [], [], [], []]
            for h, b, t in zip(hs.to_pylist(), bs.to_pylist(), values.cast("binary"), strict=True):
                for base, w in blocks(t.as_py() or b"", hashes, length):
                    _, s, n, a, z = zones(w, length, anchor)
                    for c, v in zip(parts, (np.full(len(s), h, np.int64), np.full(len(s), b, np.int32), (s + base).astype(np.int32), n.astype(np.int32), a.view(np.int64), z.view(np.int64)), strict=True):
                        c.append(v)
            if parts[0]:
                yield [np.concatenate(c) for c in parts]

    return map_rows(texts, ["h", "b", "text"], work, "h long, b int, s int, n int, a long, z long", arrow=True)


def windows(texts: DataFrame, chosen: np.ndarray, length: int, anchor: int) -> DataFrame:
    """(h, b, s, a, x): each window of the chosen zones, as text, place, anchor and content."""
    sent = texts.sparkSession.sparkContext.broadcast(chosen)

    def work(batches: Iterator[list]):
        hashes = WordHashes()
        for hs, bs, values in batches:
            parts: list[list[np.ndarray]] = [[], [], [], [], []]
            for h, b, t in zip(hs.to_pylist(), bs.to_pylist(), values.cast("binary"), strict=True):
                for base, w in blocks(t.as_py() or b"", hashes, length):
                    p, s, n, a, z = zones(w, length, anchor)
                    hit = held(sent.value, _place_key(z, h, s + base))
                    if hit.any():
                        at = np.flatnonzero(np.repeat(hit, n))
                        for c, v in zip(parts, (np.full(len(at), h, np.int64), np.full(len(at), b, np.int32), (at + base).astype(np.int32), np.repeat(a[hit], n[hit]).view(np.int64), p.of(at, at + length).view(np.int64)), strict=True):
                            c.append(v)
            if parts[0]:
                yield [np.concatenate(c) for c in parts]

    return map_rows(texts, ["h", "b", "text"], work, "h long, b int, s int, a long, x long", arrow=True)


def repeated_windows(df: DataFrame, text: str = "text", length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """(h, b, s, n): runs of n windows from window s on, of the texts of hash h and b bytes, that start somewhere else too."""
    texts = df.select(*_text_key(text), F.col(f"`{text}`").alias("text"))
    zone = table(seeds(texts, length, anchor), "seed-zones")
    shared = zone.groupBy("a").agg(F.count(F.lit(1)).alias("c"), (F.min("z") == F.max("z")).alias("alike")).where("c > 1").drop("c")
    linked = table(zone.join(shared, "a"), "seed-links")
    drop_table(zone)
    mixed = linked.where("not alike").withColumn("u", place_key())
    kinds = mixed.groupBy("a", "z").agg(F.count(F.lit(1)).alias("c"), F.min("u").alias("one"))
    kept = table(mixed.join(kinds, ["a", "z"]).select("h", "b", "s", "n", "u", (F.col("c") > 1).alias("whole"), (F.col("u") == F.col("one")).alias("extend")), "seed-kinds")
    single = table(windows(texts, filter_of(kept.where("extend"), "u"), length, anchor), "seed-windows")
    again = single.groupBy("a", "x").agg(F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    parts = single.join(again, ["a", "x"], "left_semi").select("h", "b", "s", F.lit(1).alias("n"))
    return linked.where("alike").select("h", "b", "s", "n").unionByName(kept.where("whole").select("h", "b", "s", "n")).unionByName(parts)


def _marked(df: DataFrame, text: str, length: int, anchor: int) -> DataFrame:
    """(h, b, runs): the runs of repeated windows of each text, each as start << 20 | number."""
    run = F.shiftleft(F.col("s").cast("long"), 20).bitwiseOR(F.col("n").cast("long")).alias("run")
    return repeated_windows(df, text, length, anchor).select("h", "b", run).groupBy("h", "b").agg(F.collect_set("run").alias("runs"))


def spans(runs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in words, of the maximal repeats that runs of windows cover."""
    runs = np.sort(runs)
    s = runs >> 20
    e = np.maximum.accumulate(s + (runs & 0xFFFFF) - 1 + length) if len(runs) else s
    first = np.flatnonzero(np.concatenate([[True], s[1:] > e[:-1]])) if len(runs) else np.empty(0, np.int64)
    return s[first], e[np.append(first[1:], len(e)) - 1] if len(runs) else e


def kept_words(text: bytes, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
    """(number of words, those outside the spans) of each segment of a text."""
    base = 0
    for words in segments(text):
        stop = base + len(words)
        kept, at = [], 0
        for i in range(int(np.searchsorted(end, base, "right")), int(np.searchsorted(start, stop))):
            kept += words[at : max(0, int(start[i]) - base)]
            at = int(end[i]) - base
        kept += words[at:]
        yield len(words), kept
        base = stop


def _row_spans(runs, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for r in runs:
        yield spans(r.values.to_numpy() if r.is_valid else np.empty(0, np.int64), length)


def maximal_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """(key, start, end): the maximal runs of words of each row's text that repeated windows cover."""

    def work(batches: Iterator[list]):
        for keys, runs in batches:
            found = list(_row_spans(runs, length))
            yield [keys.take(np.repeat(np.arange(len(found)), [len(s) for s, _ in found])), np.concatenate([s for s, _ in found]), np.concatenate([e for _, e in found])]

    rows = df.select(F.col(f"`{key}`").alias("key"), *_text_key(text)).join(_marked(df, text, length, anchor), ["h", "b"])
    return map_rows(rows, ["key", "runs"], work, f"`{key}` {df.schema[key].dataType.simpleString()}, start long, end long", arrow=True)


def without_repeated_windows(df: DataFrame, text: str = "text", length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """The rows with the words that stay, joined by one blank where any word goes; other texts and columns stay as they are."""

    def work(batches: Iterator[list]):
        for kept, values, runs in batches:
            out = []
            for t, (s, e) in zip(values.cast("binary"), _row_spans(runs, length), strict=True):
                out.append(b" ".join(w for _, words in kept_words(t.as_py(), s, e) for w in words).decode() if len(s) else t.as_py() and t.as_py().decode())
            yield [kept, [None if not v.is_valid else o or "" for v, o in zip(values, out, strict=True)]]

    others = F.struct(*(F.col(f"`{c}`") for c in df.columns if c != text), F.lit(None).alias("_")).alias("kept")
    rows = df.select(others, F.col(f"`{text}`").alias("text"), *_text_key(text)).join(_marked(df, text, length, anchor), ["h", "b"], "left")
    out = map_rows(rows, ["kept", "text", "runs"], work, with_kept(rows, "remains string"), arrow=True)
    return out.select(*(F.col("remains").alias(text) if c == text else F.col("kept").getField(c).alias(c) for c in df.columns))


def repeat_digests(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each row."""

    def work(batches: Iterator[list]):
        for keys, values, runs in batches:
            out: list[list] = [[], [], []]
            for t, (s, e) in zip(values.cast("binary"), _row_spans(runs, length), strict=True):
                digest, n, stay = hashlib.sha256(), 0, 0
                for count, words in kept_words(t.as_py() or b"", s, e):
                    if words:
                        digest.update(b" " * (stay > 0) + b" ".join(words))
                    n, stay = n + count, stay + len(words)
                for c, v in zip(out, (n, n - stay, digest.hexdigest()), strict=True):
                    c.append(v)
            yield [keys, *out]

    rows = df.select(F.col(f"`{key}`").alias("key"), *_text_key(text), F.col(f"`{text}`").alias("text")).join(_marked(df, text, length, anchor), ["h", "b"], "left")
    return map_rows(rows, ["key", "text", "runs"], work, f"doc_id {df.schema[key].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string", arrow=True)


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document when all words inside repeated windows of 35 words are removed."""
    return repeat_digests(read(spark, sf_dir, "documents"))
