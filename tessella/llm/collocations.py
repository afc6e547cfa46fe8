"""Phrase collocation mining with counts from HAT-tries.

Which phrases may be frequent is found level by level, over the corpus written once as ids of frequent words: a phrase can only be frequent if both
phrases that are one word shorter are. A level adds up marks of 40 bits of the phrases that a Bloom filter (16 MB) of the level before lets through. Marks
travel as sorted runs of differences, some 3 bytes each, so that rare phrases, which are most, cost little; those of enough occurrences
are the next filter. What a mark or filter lets through in error is counted exactly below and found rare.

Then phrases of all lengths are counted in one pass. A task counts in HAT-tries: inner nodes by word id, at most two deep, and below them hash
containers of the remaining ids, which burst into a node when they grow. When a trie is full, its largest subtrees are given out whole, each in the
order of its keys, and freed. These sorted runs are dealt by prefix (all words of a phrase but the last), so that a frequent first word alone is
no hot partition, and those of a prefix partition are merged, some at a time. Each language has word ids of its own.

Ids are 64-bit hashes of language and word. Scores are whole numbers from decimals of 38 digits, which hold 1000 a n up to 10^38. A null text is empty, a null language
`und`; punctuation alone has no words, texts of any length are read in segments, within which no phrase is lost or counted twice. Repeated rows
count each, ids and extra columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import ASCII_LOWER, drop_table, map_rows, read, table
from tessella.llm.membership import filter_of, held
from tessella.llm.seedextend import Prefixes, mixed

LONGEST, LEAST, TOP = 5, 100, 2000
SEGMENT, CACHED = 1 << 20, 500_000
#: Entries of a task's trie, and of a container before it bursts.
FULL, BURST = 400_000, 20_000
SALTS = 64
#: Bits of a phrase's mark, and marks that are added up at a time.
MARK_BITS, RUN = 40, 4_000_000
_BREAKS = re.compile(rb"[.,;:!?\x0A-\x0D]+")
_END = re.compile(rb"[.,;:!?\x09-\x0D\x20]")
BREAK = b"."


def tokens(text: bytes) -> Iterator[list[bytes]]:
    """The lower-cased words of a text in lists of some SEGMENT bytes, with a break, which no word equals, between pieces."""
    at = 0
    while at < len(text):
        cut = _END.search(text, at + SEGMENT) if at + SEGMENT < len(text) else None
        end = cut.end() if cut else len(text)
        yield _BREAKS.sub(b" . ", text[at:end].translate(ASCII_LOWER)).split()
        at = end


class Ids(dict):
    """Ids of the words of one language; the break has id 0."""

    def __init__(self, lang: str) -> None:
        super().__init__()
        self.seed = xxhash.xxh64_intdigest(lang.encode())

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED:
            self.clear()
        v = self[word] = 0 if word == BREAK else xxhash.xxh64_intdigest(word, self.seed) or 1
        return v


class HatTrie:
    """Counts of phrases of a fixed number of ids."""

    def __init__(self, width: int, full: int = FULL, burst: int = BURST) -> None:
        self.width, self.full, self.burst_at = width, full, burst
        self.root: dict[bytes, dict] = {}
        self.sizes: Counter = Counter()
        self.burst: set[bytes] = set()

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Phrases, as rows of ids in big-endian order, each once."""
        raw, size = keys.astype(">u8").tobytes(), 8 * self.width
        for i, c in enumerate(counts.tolist()):
            first, rest = raw[size * i : size * i + 8], raw[size * i + 8 : size * i + size]
            node = self.root.get(first)
            if node is None:
                node = self.root[first] = {}
            box = node
            if first in self.burst:
                box = node.get(rest[:8])
                if box is None:
                    box = node[rest[:8]] = {}
                rest = rest[8:]
            before = box.get(rest)
            if before is None:
                box[rest] = c
                self.sizes[first] += 1
                if box is node and self.width > 2 and len(node) > self.burst_at:
                    self._burst(first)
            else:
                box[rest] = before + c

    def _burst(self, first: bytes) -> None:
        node: dict[bytes, dict] = {}
        for rest, c in self.root[first].items():
            node.setdefault(rest[:8], {})[rest[8:]] = c
        self.root[first] = node
        self.burst.add(first)

    def _run(self, first: bytes) -> Iterator[tuple[bytes, int]]:
        """A subtree in the order of its keys; it is freed."""
        node = self.root.pop(first)
        del self.sizes[first]
        for key in sorted(node):
            if first in self.burst:
                yield from ((first + key + rest, node[key][rest]) for rest in sorted(node[key]))
            else:
                yield first + key, node[key]
        self.burst.discard(first)

    def spilled(self, to: int) -> Iterator[list[np.ndarray]]:
        """The largest subtrees as sorted runs, until `to` entries stay."""
        left, subtrees = sum(self.sizes.values()), []
        for first, n in self.sizes.most_common():
            if left <= to:
                break
            subtrees.append(first)
            left -= n
        keys, counts = [], []
        for at, first in enumerate(subtrees):
            for key, c in self._run(first):
                keys.append(key)
                counts.append(c)
            if len(keys) > 50_000 or at == len(subtrees) - 1:
                ids = np.frombuffer(b"".join(keys), ">u8").reshape(-1, self.width).astype(np.uint64).view(np.int64)
                yield [*(np.ascontiguousarray(ids[:, i]) for i in range(self.width)), np.array(counts, np.int64)]
                keys, counts = [], []


def _by_language(df: DataFrame, text: str, lang: str) -> DataFrame:
    return df.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").alias("text"))


def word_counts(texts: DataFrame, least: int) -> DataFrame:
    """(lang, id, word, a) of words with a >= least, and a row without word for each language, where a is the number of all its words."""

    def given(counts: dict[str, Counter]):
        for lang, c in counts.items():
            ids, words = Ids(lang), list(c)
            found = np.fromiter(map(ids.__getitem__, words), np.uint64, len(words)).view(np.int64)
            yield [[lang] * (len(c) + 1), [None, *found.tolist()], [None, *words], [sum(c.values()), *c.values()]]

    def work(batches: Iterator[list]):
        counts: dict[str, Counter] = {}
        for langs, values in batches:
            for lang, t in zip(langs.to_pylist(), values.cast("binary"), strict=True):
                own = counts.setdefault(lang, Counter())
                for words in tokens(t.as_py() or b""):
                    own.update(words)
                del own[BREAK]
                if len(own) > FULL:
                    yield from given({lang: counts.pop(lang)})
            if sum(map(len, counts.values())) > FULL:
                yield from given(counts)
                counts = {}
        yield from given(counts)

    rows = map_rows(texts, ["lang", "text"], work, "lang string, id long, word binary, a long", arrow=True)
    return rows.groupBy("lang", "word").agg(F.max("id").alias("id"), F.sum("a").alias("a")).where(F.col("word").isNull() | (F.col("a") >= least)).select("lang", "id", F.col("word").cast("string").alias("word"), "a")


def encoded(texts: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(skip, ids): texts as ids of frequent words, 0 for anything between them and at the end. The first `skip` ids of a part are the last of the
    part of the text before it."""
    sent = texts.sparkSession.sparkContext.broadcast(frequent)

    def work(batches: Iterator[list]):
        known: dict[str, Ids] = {}
        for langs, values in batches:
            skips, parts = [], []
            for lang, t in zip(langs.to_pylist(), values.cast("binary"), strict=True):
                if len(known) > 100 and lang not in known:
                    known.clear()
                ids, carry = known.setdefault(lang, Ids(lang)), np.empty(0, np.uint64)
                for words in tokens(t.as_py() or b""):
                    v = np.fromiter(map(ids.__getitem__, words), np.uint64, len(words))
                    v[~held(sent.value, v)] = 0
                    v = np.concatenate([carry, v])
                    stays = v != 0
                    stays[1:] |= v[:-1] != 0
                    if len(carry):
                        stays[: len(carry)] = True
                    v = v[stays]
                    if len(v) > len(carry):
                        skips.append(len(carry))
                        parts.append(np.append(v, np.uint64(0)))
                    carry = v[max(0, len(v) - LONGEST + 1) :]
            if parts:
                offsets = np.cumsum([0, *map(len, parts)]).astype(np.int32)
                yield [skips, pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts).view(np.int64)))]

    return map_rows(texts, ["lang", "text"], work, "skip int, ids array<long>", arrow=True)


def _starts(v: np.ndarray, k: int, shorter: np.ndarray | None) -> tuple[Prefixes, np.ndarray]:
    """Hashes, and places of k ids without a gap of which both parts that are one shorter may be frequent."""
    p = Prefixes(v)
    good = v != 0
    ok = good[: len(v) - k + 1].copy()
    for i in range(1, k):
        ok &= good[i : len(v) - k + 1 + i]
    if shorter is not None:
        for i in (0, 1):
            at = np.flatnonzero(ok)
            ok[at] = held(shorter, _marks(p, at + i, k - 1))
    return p, np.flatnonzero(ok)


def _marks(p: Prefixes, at: np.ndarray, k: int) -> np.ndarray:
    """What the filters know a phrase by: its mark of 40 bits, mixed."""
    return mixed(p.of(at, at + k) >> np.uint64(64 - MARK_BITS))


def _parts(batches: Iterator[list], shortest: int) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """The ids of a batch, and which of them are not repeated from the part before."""
    for skips, parts in batches:
        v = parts.flatten().to_numpy().view(np.uint64)
        if len(v) >= shortest:
            skip, fresh = skips.to_numpy(zero_copy_only=False), None
            if skip.any():
                sizes = parts.value_lengths().to_numpy(zero_copy_only=False)
                fresh = np.arange(len(v)) - np.repeat(np.cumsum(sizes) - sizes, sizes) >= np.repeat(skip, sizes)
            yield v, fresh


def _fresh(at: np.ndarray, k: int, fresh: np.ndarray | None) -> np.ndarray:
    return at if fresh is None else at[fresh[at + k - 1]]


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.empty(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(k) else c


def _planes(values: np.ndarray) -> bytes:
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _values(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def pieces_for(corpus: DataFrame) -> int:
    """Ranges of marks: a power of two that follows the size of the corpus in pieces of 16 MB."""
    size = int(corpus._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) >> 24
    return min(1 << 14, max(1 << 8, 1 << size.bit_length())) if size < 1 << 36 else 1 << 8


def frequent_marks(corpus: DataFrame, k: int, shorter: np.ndarray | None, least: int, pieces: int) -> DataFrame:
    """(u): mixed marks of all phrases of k words that may be frequent. Only marks travel: sorted, as differences, in one run for each task and range."""
    sent = corpus.sparkSession.sparkContext.broadcast(shorter)
    low = MARK_BITS - (pieces.bit_length() - 1)

    def runs(batches: Iterator[list]):
        squeeze = zstandard.ZstdCompressor(1).compress
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []

        def given():
            marks, n = _summed(keys, counts)
            ends = np.searchsorted(marks, np.arange(1, pieces + 1, dtype=np.uint64) << np.uint64(low))
            out: list[list] = [[], [], [], []]
            for i, (a, z) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)):
                if a < z:
                    rest = (marks[a:z] & np.uint64((1 << low) - 1)).astype(np.uint32)
                    for c, x in zip(out, (i, z - a, squeeze(_planes(np.diff(rest, prepend=np.uint32(0)))), squeeze(_planes(np.minimum(n[a:z], least)))), strict=True):
                        c.append(x)
            keys.clear(), counts.clear()
            return out

        for v, fresh in _parts(batches, k):
            p, at = _starts(v, k, sent.value)
            at = _fresh(at, k, fresh)
            for some in range(0, len(at), RUN):
                marks, n = np.unique(p.of(at[some : some + RUN], at[some : some + RUN] + k) >> np.uint64(64 - MARK_BITS), return_counts=True)
                keys.append(marks)
                counts.append(n)
                if sum(map(len, keys)) > RUN:
                    yield given()
        if keys:
            yield given()

    def merge(batches: Iterator[list[list]]):
        rows = ((i, n, rest, c) for cols in batches for i, n, rest, c in zip(*cols, strict=True))
        for i, group in groupby(rows, key=lambda r: r[0]):
            blobs = list(group)
            slices = -(-sum(n for _, n, _, _ in blobs) // RUN)
            expand = zstandard.ZstdDecompressor().decompress
            for x in range(slices):  # a range that is too large is added up in slices
                keys, counts = [], []
                for _, _, rest, c in blobs:
                    marks = np.cumsum(_values(expand(rest)), dtype=np.uint64)
                    a, z = (int(y) for y in np.searchsorted(marks, [np.uint64((x << low) // slices), np.uint64(((x + 1) << low) // slices)]))
                    keys.append(marks[a:z])
                    counts.append(_values(expand(c))[a:z].astype(np.int64))
                marks, n = _summed(keys, counts)
                yield [mixed(marks[n >= least] | np.uint64(i << low)).view(np.int64)]

    sent_runs = map_rows(corpus, ["skip", "ids"], runs, "i int, n int, marks binary, counts binary", arrow=True)
    return map_rows(sent_runs.repartition(pieces, "i").sortWithinPartitions("i"), ["i", "n", "marks", "counts"], merge, "u long")


def _distinct(keys: list[bytes], counts: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Phrases, as big-endian ids, each once and in order, with the sums of their counts."""
    rows, where = np.unique(np.frombuffer(b"".join(keys), f"S{8 * k}"), return_inverse=True)
    return rows, np.bincount(where, np.concatenate(counts), len(rows)).astype(np.int64)


def phrase_counts(corpus: DataFrame, frequent: list[np.ndarray], least: int, pieces: int) -> DataFrame:
    """(ids, a) of all phrases of two words or more with a >= least. frequent: the filter of each length, from two on."""
    sent = corpus.sparkSession.sparkContext.broadcast(frequent)

    def work(batches: Iterator[list]):
        tries = {k: HatTrie(k, FULL // len(sent.value)) for k in range(2, len(sent.value) + 2)}
        squeeze = zstandard.ZstdCompressor(1).compress

        def given(k: int, to: int):
            for *ids, c in tries[k].spilled(to):
                prefix, keys = np.zeros(len(c), np.uint64), np.stack(ids, 1).astype(">u8")
                for w in ids[:-1]:
                    prefix = mixed(prefix ^ w.view(np.uint64))
                piece = (prefix % np.uint64(pieces)).astype(np.int64)
                order = np.argsort(piece, kind="stable")
                cuts = np.flatnonzero(np.diff(piece[order], prepend=-1, append=pieces))
                runs = [(int(piece[order[a]]), order[a:z]) for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
                yield [[p for p, _ in runs], [k] * len(runs), [squeeze(keys[at].tobytes()) for _, at in runs], [squeeze(c[at].astype("<i8").tobytes()) for _, at in runs]]

        for v, fresh in _parts(batches, 2):
            p, at = _starts(v, 2, None)
            for k, found in enumerate(sent.value, 2):
                if k > 2:  # a phrase starts where one that is a word shorter does, and another at its second word
                    at = at[:-1][np.diff(at) == 1]
                at = at[held(found, _marks(p, at, k))]
                new = _fresh(at, k, fresh)
                _, first, counts = np.unique(p.of(new, new + k), return_index=True, return_counts=True)
                for some in range(0, len(first), FULL // 4):
                    starts = new[first[some : some + FULL // 4]]
                    tries[k].add(np.stack([v[starts + i] for i in range(k)], 1), counts[some : some + FULL // 4])
                    if sum(tries[k].sizes.values()) > tries[k].full:
                        yield from given(k, tries[k].full // 2)
        for k in tries:
            yield from given(k, 0)

    def merge(batches: Iterator[list[list]]):
        expand = zstandard.ZstdDecompressor().decompress
        rows = (r for cols in batches for r in zip(*cols, strict=True))
        for (_, k), group in groupby(rows, key=lambda r: (r[0], r[1])):
            keys, counts, size = [], [], 0
            for _, _, some, c in group:
                keys.append(expand(some))
                counts.append(np.frombuffer(expand(c), "<i8"))
                size += len(counts[-1])
                if size > RUN:  # what is there is added up before more runs are taken
                    ids, sums = _distinct(keys, counts, k)
                    keys, counts, size = [ids.tobytes()], [sums], 0
            ids, sums = _distinct(keys, counts, k)
            good = np.frombuffer(ids.tobytes(), ">u8").reshape(-1, k)[sums >= least].astype(np.uint64).view(np.int64)
            offsets = np.arange(len(good) + 1, dtype=np.int32) * k
            yield [pa.ListArray.from_arrays(pa.array(offsets), pa.array(good.ravel())), sums[sums >= least]]

    runs = map_rows(corpus, ["skip", "ids"], work, "piece int, k int, ids binary, counts binary", arrow=True)
    return map_rows(runs.repartition(pieces, "piece").sortWithinPartitions("piece", "k"), ["piece", "k", "ids", "counts"], merge, "ids array<long>, a long")


def scored(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, ids, a, l, r, n, score) of all phrases of two words or more, by their lowest cut."""
    parts = phrases.select("ids", "a").unionByName(words.where("word IS NOT NULL").select(F.array("id").alias("ids"), "a"))
    totals = words.where("word IS NULL").select("lang", F.col("a").alias("n"))
    named = phrases.withColumn("first", F.col("ids")[0]).join(words.select(F.col("id").alias("first"), "lang"), "first").join(totals, "lang").select("lang", "ids", "a", "n")
    cuts = named.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)))
    cuts = cuts.withColumn("left", F.expr("slice(ids, 1, k)")).withColumn("right", F.expr("slice(ids, k + 1, size(ids) - k)"))
    cuts = cuts.join(parts.select(F.col("ids").alias("left"), F.col("a").alias("l")), "left").join(parts.select(F.col("ids").alias("right"), F.col("a").alias("r")), "right")
    score = F.expr("CAST(1000 AS DECIMAL(38, 0)) * CAST(a AS DECIMAL(20, 0)) * CAST(n AS DECIMAL(20, 0)) div (CAST(l AS DECIMAL(38, 0)) * CAST(r AS DECIMAL(20, 0)))")
    lowest = cuts.groupBy("lang", "ids", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return lowest.select("lang", "ids", "a", "cut.l", "cut.r", "n", "cut.score")


def without_parts(phrases: DataFrame) -> DataFrame:
    """Phrases that lie in no longer one with as many occurrences."""
    size = F.size("ids")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: F.slice("ids", i, m))))
    covered = phrases.where(size > 2).select("a", F.explode(inner).alias("ids")).groupBy("ids").agg(F.max("a").alias("most"))
    return phrases.join(covered, "ids", "left").where(F.col("most").isNull() | (F.col("most") < F.col("a"))).drop("most")


def best_by_language(phrases: DataFrame, words: DataFrame, top: int) -> DataFrame:
    """The first `top` phrases of each language, with their texts; the best of each of 64 parts of a language go on to the ranking."""
    named = phrases.select("ids", F.posexplode("ids").alias("at", "id")).join(words.where("word IS NOT NULL").select("id", "word"), "id")
    texts = named.groupBy("ids").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w")).select("ids", F.concat_ws(" ", "w.word").alias("phrase"))
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    rows = phrases.join(texts, "ids").withColumn("salt", F.pmod(F.hash("ids"), F.lit(SALTS)))
    some = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations(df: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP, longest: int = LONGEST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases of two to `longest` (at most five) words with `least` occurrences."""
    texts = _by_language(df, text, lang)
    words = table(word_counts(texts, least), "collocation-words")
    corpus = table(encoded(texts, filter_of(words.where("id IS NOT NULL"), "id")), "collocation-corpus")
    frequent, pieces = [], pieces_for(corpus)
    for k in range(2, longest + 1):
        frequent.append(filter_of(frequent_marks(corpus, k, frequent[-1] if frequent else None, least, pieces), "u"))
    phrases = table(phrase_counts(corpus, frequent, least, pieces), "collocation-phrases")
    drop_table(corpus)
    return best_by_language(without_parts(scored(phrases, words)), words, top)


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2000 strongest phrases of two to five words in all documents."""
    return collocations(read(spark, sf_dir, "documents"))
