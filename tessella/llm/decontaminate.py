"""Benchmark decontamination with Wu-Manber search over words.

Patterns are the windows of ten consecutive words of benchmark items (an item of fewer words is one window). For each pattern length m a
table of block shifts says how far the search may move after seeing a block of two words (one, for one-word patterns) at the end of its
window: m - 1 for a block that no pattern holds. Where the shift is zero, the bucket of patterns that end with this block is taken
and the whole window compared directly.

Tables are broadcast. Words are numbered and patterns kept as arrays of numbers, each different one once; a task builds from them one
dictionary of words and one of blocks for each length. Their size is bounded: long items are cut into overlapping parts, which hold each window
once, all parts are counted in words first, and beyond `block_words` they are dealt into as many blocks, each of which passes over all
documents in turn. A block of 1.5 million words takes about 300 MB in a task.

Null text: no words. Texts of any length are searched whole. Items without words match nothing. Items with a null id are searched like
others (n_hit, contaminated); having no id, they are not in n_items and items_sha256. Equal windows of several items count for each.
Repeated rows stay; extra columns are ignored; an empty table on either side gives no hits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import keeping, map_rows, read, table, with_kept

WINDOW, BLOCK_WORDS, PART_WORDS = 10, 1_500_000, 10_000
#: A-Z in lower case; what isn't a digit, a letter or beyond ASCII separates words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class Patterns:
    """Different windows of one length as rows of word numbers, ordered by their last block; the items of window i are
    items[bounds[i] : bounds[i + 1]]."""

    def __init__(self, windows: np.ndarray, owners: np.ndarray, words: int) -> None:
        self.m, self.b = windows.shape[1], min(2, windows.shape[1])
        last = windows[:, -1].astype(np.int64) + (windows[:, -2].astype(np.int64) * words if self.b == 2 else 0)
        order = np.lexsort((owners, *windows.T[::-1], last))
        windows, owners, last = windows[order], owners[order], last[order]
        new = np.concatenate([[True], (windows[1:] != windows[:-1]).any(1)])
        fresh = new | np.concatenate([[True], owners[1:] != owners[:-1]])
        self.items, first = owners[fresh], np.flatnonzero(new)
        self.bounds = np.append(np.cumsum(fresh)[first] - 1, fresh.sum())
        self.windows, self.last = windows[first], last[first]

    def shifts(self, words: int) -> dict[int, int]:
        """By block, the least distance from its end to a window's end; windows that end with it are at -1 - shift of the ones sorted."""
        out: dict[int, int] = {}
        for end in range(self.b, self.m):
            block = self.windows[:, end - 1].astype(np.int64) + (self.windows[:, end - 2].astype(np.int64) * words if self.b == 2 else 0)
            out.update(zip(np.unique(block).tolist(), repeat(self.m - end)))
        keys, first = np.unique(self.last, return_index=True)
        out.update(zip(keys.tolist(), (-first).tolist()))
        return out


class WuManber:
    """The search for the patterns of one length in lists of words."""

    def __init__(self, patterns: Patterns, index: dict[bytes, int]) -> None:
        self.p, self.index, self.words = patterns, index, len(index)
        self.table = patterns.shifts(self.words)

    def find(self, words: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """Start and items of each occurrence."""
        p, number, table, vocabulary = self.p, self.index.get, self.table.get, self.words
        m, n, most = p.m, len(words), p.m - p.b + 1
        i = m - 1
        while i < n:
            block = number(words[i], -1)
            if block >= 0 and p.b == 2:
                before = number(words[i - 1], -1)
                block = block + before * vocabulary if before >= 0 else -1
            shift = table(block, most) if block >= 0 else most
            if shift > 0:
                i += shift
                continue
            here, at = None, -shift
            while at < len(p.last) and p.last[at] == block:
                if here is None:
                    here = np.fromiter(map(number, words[i - m + 1 : i + 1], repeat(-1)), np.int64, m)
                if (p.windows[at] == here).all():
                    yield i - m + 1, p.items[p.bounds[at] : p.bounds[at + 1]].tolist()
                    break
                at += 1
            i += 1


class WindowSearch:
    """All windows of a block of items. What is sent to tasks are arrays; dictionaries are built there, once for each worker."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int = WINDOW) -> None:
        index: dict[bytes, int] = {}
        names: dict[str | None, int] = {}
        by_length: dict[int, list[tuple[np.ndarray, int]]] = {}
        for item, text in items:
            words = words_of(text)
            if words:
                numbers = np.array([index.setdefault(w, len(index)) for w in words], np.int32)
                by_length.setdefault(min(window, len(words)), []).append((numbers, names.setdefault(item, len(names))))
        self.words, self.names = list(index), list(names)
        self.patterns = []
        for m, parts in sorted(by_length.items()):
            rows = [np.lib.stride_tricks.sliding_window_view(n, m) for n, _ in parts]
            self.patterns.append(Patterns(np.concatenate(rows), np.repeat(np.array([i for _, i in parts], np.int32), [len(r) for r in rows]), len(index)))
        self.searches: list[WuManber] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"searches": None}

    def mark(self, words: list[bytes], hits: bytearray, items: set[str]) -> None:
        if self.searches is None:
            index = {w: i for i, w in enumerate(self.words)}
            self.searches = [WuManber(p, index) for p in self.patterns]
        for s in self.searches:
            for start, found in s.find(words):
                hits[start : start + s.p.m] = b"\x01" * s.p.m
                items.update(x for x in map(self.names.__getitem__, found) if x is not None)


def _pass(df: DataFrame, text: str, search: WindowSearch, carried: bool, last: bool) -> DataFrame:
    """One block of items over all documents. Between passes the hit words (one byte each) and item ids travel with the rows."""
    shared, inside = df.sparkSession.sparkContext.broadcast(search), "text" not in df.columns

    def work(batches: Iterator[list]):
        for cols in batches:
            texts, before = (cols[0].field(text), cols[1:]) if inside else (cols[1], cols[2:])
            out: list[list] = [[] for _ in range(5 if last else 2)]
            for i, t in enumerate(texts.cast("binary").to_pylist()):
                words = words_of(t)
                hits = bytearray(before[0][i].as_py() if carried else len(words))
                items = set(before[1][i].as_py() if carried else ())
                shared.value.mark(words, hits, items)
                if last:
                    row = [len(words), hits.count(1), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), 1 in hits]
                else:
                    row = [bytes(hits), sorted(items)]
                for c, v in zip(out, row, strict=True):
                    c.append(v)
            yield [cols[0], *out] if last or inside else [*cols[:2], *out]

    schema = with_kept(df, "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean" if last else "text string, "[: 0 if inside else None] + "hits binary, items array<string>")
    return map_rows(df, df.columns, work, schema, arrow=True)


def parts_of_items(benchmark: DataFrame, item: str, text: str, window: int, part: int = PART_WORDS) -> DataFrame:
    """(i, t, n): the items as text and, where they are long, in parts of which each window lies in exactly one; and a bound of their words."""
    low = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")
    rows = benchmark.where(F.col(text).isNotNull()).select(F.col(item).cast("string").alias("i"), words.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)), F.lit(part))
    cut = rows.select("i", "w", F.explode(starts).alias("s")).select("i", F.slice("w", F.col("s") + 1, F.lit(part + window - 1)).alias("w"))
    return cut.select("i", F.array_join("w", " ").alias("t"), F.size("w").alias("n")).distinct()


def find_contamination(df: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """`keep` columns, then n_words, n_hit, n_items, items_sha256, contaminated."""
    return contamination(df, benchmark, keep, text, item, item_text, window, block_words).select("kept.*", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def contamination(df: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(kept, n_words, n_hit, n_items, items_sha256, contaminated), the `keep` columns as one struct, whatever their names."""
    items = parts_of_items(benchmark, item, item_text, window)
    words = items.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-words // block_words))
    if blocks > 1:
        items = table(items.withColumn("b", F.pmod(F.xxhash64("i", "t"), F.lit(blocks))), "benchmark-parts")
    df = keeping(df, keep, text)
    for b in range(blocks):
        mine = items.where(F.col("b") == b) if blocks > 1 else items
        search = WindowSearch([(r.i, r.t.encode()) for r in mine.select("i", "t").collect()], window)
        df = _pass(df, text, search, b > 0, b == blocks - 1)
        if b % 8 == 7:
            df = table(df, "decontaminate")
    return df


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words inside benchmark windows."""
    return find_contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), ["doc_id"])
