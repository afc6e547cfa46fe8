"""Language-model scores from a hashed maximum-entropy model with a class-factored softmax.

Counts of all training tokens are summed on Spark. The commonest words (at most `head`, the bound on what is broadcast, and seen more than once) are
sorted by their ends and cut into classes of equal mass, each class into groups and each group into leaves; all other words fall into a
few classes by their last byte, so that words seen once teach where unknown ones stand. A token's probability is P(class | features) P(group | class, features) P(leaf | group, features) P(word | leaf): the first
three factors are softmaxes of WIDTH outcomes over hashed features (the word before, the two words before together, and the word before the
last, skipping one; within a class or group each together with it), the last comes from counts. A common word is alone in its leaf, so
features choose the very word. Of the words beyond the head, features choose the class only.

Every text is tokenized once into a table of word numbers; training and scoring read that. Training is distributed: in each round every
task takes gradient steps over its part of all training documents, in sparse numpy batches, and gives out the changes of the feature rows
it met with their numbers of visits; the changes are averaged by visits and broadcast as the next round's start. The weights have a fixed
size and begin with the counts as biases.

Words outside the broadcast head are scored by a join with the counts.

Null text: no words, one end. Unknown words share one part of their class, as large as that of the words seen once. A null id counts as the empty text for the folds. Texts of
any length are scored in batches of tokens. Repeated rows stay; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import crc_bucket, map_rows, read, table, with_kept

WIDTH, TAIL_CLASSES = 16, 4
HEAD_CLASSES = WIDTH - TAIL_CLASSES
GROUPS = HEAD_CLASSES * WIDTH
HEAD, FEATURE_BITS, ROUNDS, RATE, BATCH = 100_000, 14, 2, 0.2, 1 << 16
FEATURE_ROWS, FEATURES, LEVELS = 1 << FEATURE_BITS, 3, 3
#: Rows of the weights: a table for each level and feature, then the biases of the root, the classes and the groups.
BIAS = LEVELS * FEATURES * FEATURE_ROWS
SIZE = BIAS + 1 + HEAD_CLASSES + GROUPS
END = b"\n"  # no word, as words hold no white space
_START, _NEVER, _BLOCK = 0x9E3779B9, -30.0, 512
_MIX, _PAIR, _NODE = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_SHIFT = np.uint64(64 - FEATURE_BITS)


def batch_tokens(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The tokens of a batch of texts: its different words, the number among them of each token, and where each text ends. Words are split and
    numbered by Arrow; the last word is the end."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = split.flatten().dictionary_encode()
    words, numbers = flat.dictionary.cast("binary").to_pylist(), flat.indices.to_numpy(zero_copy_only=False)
    bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))])
    real = np.ones(len(numbers), bool)
    if b"" in words:  # blanks at a text's sides
        real = numbers != words.index(b"")
    before = np.concatenate([[0], np.cumsum(real)])[bounds]
    ends = before[1:] + np.arange(1, len(bounds))
    tokens = np.full(int(ends[-1]) if len(ends) else 0, len(words), np.int64)
    inside = np.ones(len(tokens), bool)
    inside[ends - 1] = False
    tokens[inside] = numbers[real]
    return [*words, END], tokens, ends


def count_tokens(df: DataFrame, text: str = "text", most: int = 400_000) -> DataFrame:
    """(w, c) summed over all rows. A task adds up what it can hold before rows are exchanged."""

    def work(batches: Iterator[list]):
        held: Counter = Counter()
        for (texts,) in batches:
            words, tokens, _ = batch_tokens(texts)
            counts = np.bincount(tokens, minlength=len(words))
            held.update({w: c for w, c in zip(words, counts.tolist(), strict=True) if c})
            if len(held) > most:
                yield [list(held), list(held.values())]
                held = Counter()
        if held:
            yield [list(held), list(held.values())]

    return map_rows(df, [text], work, "w binary, c long", arrow=True).groupBy("w").agg(F.sum("c").alias("c"))


def tail_class(word: bytes) -> int:
    return zlib.crc32(word[-1:]) % TAIL_CLASSES


class Vocabulary:
    """What tasks know of words: number, leaf, hash and log10 P(word | leaf) of head words, and of each class of the tail how many tokens it
    has and how many words that were seen once. Unknown words together count as often as those."""

    def __init__(self, head: list[tuple[bytes, int]], tail_sums: dict[int, tuple[int, int]], total: int, distinct: int) -> None:
        self.total, self.distinct = total, distinct
        head = sorted(head, key=lambda x: (-x[1], x[0]))  # small numbers for common words
        self.index = {w: i for i, (w, _) in enumerate(head)}
        counts = np.array([c for _, c in head], np.float64)
        ends = np.array(sorted(range(len(head)), key=lambda i: head[i][0][::-1]), np.int64)
        before = np.cumsum(counts[ends]) - counts[ends]
        leaves = GROUPS * WIDTH
        self.leaf = np.zeros(len(head), np.int32)
        self.leaf[ends] = np.minimum(leaves - 1, before * leaves / max(1.0, counts.sum())).astype(np.int32)
        mass = np.bincount(self.leaf, counts, minlength=leaves)
        self.inner = np.log10(counts / mass[self.leaf])
        self.base = np.log10((counts + 1) / (total + distinct + 1))
        self.hash = np.array([zlib.crc32(w) for w, _ in head], np.uint32)
        tail = [tail_sums.get(k, (0, 0)) for k in range(TAIL_CLASSES)]
        self.unknown = [once + 1 for _, once in tail]
        self.tail_log = [math.log10(n + once + 1) for n, once in tail]
        groups = mass.reshape(-1, WIDTH)
        classes = groups.sum(1).reshape(-1, WIDTH)
        root = np.concatenate([classes.sum(1), np.array([n + 1 for n, _ in tail], np.float64)])
        rows = np.concatenate([root[None], classes, groups])
        sums = rows.sum(1, keepdims=True)
        self.bias = np.where(rows > 0, np.log(np.maximum(rows, 1e-9) / np.maximum(sums, 1e-9)), np.where(sums > 0, _NEVER, 0.0)).astype(np.float32)

    def start(self) -> np.ndarray:
        weights = np.zeros((SIZE, WIDTH), np.float32)
        weights[BIAS:] = self.bias
        return weights


def encode(df: DataFrame, vocabulary, keep: list[str], text: str = "text") -> DataFrame:
    """The table that training and scoring read: (row, kept, n, known, base, ids, tail_hash, tail). `ids` has four bytes for each token, the
    number of a head word or -1 - k for a word of the tail's class k; `tail_hash` the hashes of the latter; `tail` their counts by word."""

    def work(batches: Iterator[list]):
        v = vocabulary.value
        for kept, texts in batches:
            words, tokens, ends = batch_tokens(texts)
            starts = np.concatenate([[0], ends[:-1]])
            number = np.fromiter(map(v.index.get, words, repeat(-1)), np.int32, len(words))
            for i in np.flatnonzero(number < 0).tolist():
                number[i] = -1 - tail_class(words[i])
            at = number[tokens]
            tail = np.flatnonzero(at < 0)
            own, doc = tokens[tail], np.searchsorted(ends, tail, side="right")
            crc = np.zeros(len(words), "<u4")
            for i in np.unique(own).tolist():
                crc[i] = zlib.crc32(words[i])
            data, bounds = crc[own].tobytes(), np.searchsorted(doc, np.arange(len(ends) + 1)).tolist()
            hashes = [data[4 * a : 4 * b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            pairs, n = np.unique(doc * len(words) + own, return_counts=True)
            mine = pairs % len(words)
            each = pa.StructArray.from_arrays([pa.array(words, pa.binary()).take(pa.array(mine)), pa.array(n, pa.int64()), pa.array(-1 - number[mine], pa.int32())], ["w", "n", "k"])
            tails = pa.ListArray.from_arrays(pa.array(np.searchsorted(pairs // len(words), np.arange(len(ends) + 1)), pa.int32()), each)
            base = np.where(at >= 0, v.base[np.maximum(at, 0)] if len(v.base) else 0.0, 0.0)
            data = at.astype("<i4").tobytes()
            yield [kept, np.diff(ends, prepend=0), np.add.reduceat((at >= 0).astype(np.int64), starts), np.add.reduceat(base, starts), [data[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], hashes, tails]

    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("kept"), F.col(text).alias("text"))
    schema = with_kept(rows, "n long, known long, base double, ids binary, tail_hash binary, tail array<struct<w:binary,n:long,k:int>>")
    return table(map_rows(rows, ["kept", "text"], work, schema, arrow=True).withColumn("row", F.monotonically_increasing_id()), "encoded")


class Tokens:
    """The tokens of a batch of encoded texts and the features of each."""

    def __init__(self, v: Vocabulary, ids: list[bytes], tail_hash: list[bytes]) -> None:
        self.ids = np.frombuffer(b"".join(ids), "<i4")
        self.ends = np.cumsum([len(x) // 4 for x in ids])
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        head = self.ids >= 0
        at = np.maximum(self.ids, 0)
        h = (v.hash[at] if len(v.hash) else np.zeros(len(at), np.uint32)).astype(np.uint64)
        h[~head] = np.frombuffer(b"".join(tail_hash), "<u4")
        leaf = v.leaf[at] if len(v.leaf) else np.zeros(len(at), np.int32)
        self.head, self.leaf = head, leaf
        self.cls = np.where(head, leaf // (WIDTH * WIDTH), HEAD_CLASSES - 1 - self.ids)
        one, two = np.empty_like(h), np.empty_like(h)
        one[1:], two[2:] = h[:-1], h[:-2]
        one[self.starts] = two[self.starts] = _START
        second = self.starts + 1
        two[second[second < self.ends]] = _START
        self.features = (one + np.uint64(1), one * _PAIR + two + np.uint64(7), two + np.uint64(3))

    def parts(self, a: int, b: int) -> Iterator[tuple[int, np.ndarray | slice, list[np.ndarray], np.ndarray, np.ndarray]]:
        """For each level, of the tokens a to b: (level, which of them, rows of each feature, node, outcome)."""
        feats, cls, leaf = [f[a:b] for f in self.features], self.cls[a:b], self.leaf[a:b]
        yield 0, slice(None), [(f * _MIX >> _SHIFT).astype(np.uint16) for f in feats], np.zeros(len(cls), np.int32), cls
        some = np.flatnonzero(self.head[a:b])
        which: np.ndarray | slice = slice(None) if len(some) == len(cls) else some
        if len(some):
            feats, leaf = [f[which] for f in feats], leaf[which]
            for level, node, y in ((1, 1 + leaf // (WIDTH * WIDTH), leaf // WIDTH % WIDTH), (2, 1 + HEAD_CLASSES + leaf // WIDTH, leaf % WIDTH)):
                salt = node.astype(np.uint64) * _NODE
                yield level, which, [((f + salt) * _MIX >> _SHIFT).astype(np.uint16) for f in feats], node, y


def table_of(w: np.ndarray, level: int, feature: int) -> np.ndarray:
    at = (level * FEATURES + feature) * FEATURE_ROWS
    return w[at : at + FEATURE_ROWS]


def exponents(w: np.ndarray, level: int, rows: list[np.ndarray], node: np.ndarray) -> np.ndarray:
    """The sums of the weights of each token's features and node, one column for each outcome."""
    z = w[BIAS:].take(node, 0, mode="clip")  # numbers are within bounds; clip spares a check
    for k, r in enumerate(rows):
        z += table_of(w, level, k).take(r, 0, mode="clip")
    return z


_ONES = np.ones(WIDTH, np.float32)


def log_probabilities(w: np.ndarray, tokens: Tokens, a: int, b: int) -> np.ndarray:
    """Natural log P(leaf, or class of the tail | features) of the tokens a to b."""
    out = np.zeros(b - a)
    for level, which, rows, node, y in tokens.parts(a, b):
        z = exponents(w, level, rows, node)
        own = z[np.arange(len(y)), y]
        out[which] += own - np.log(np.exp(z, out=z) @ _ONES)
    return out


def step(w: np.ndarray, squares: np.ndarray, visits: np.ndarray, level: int, rows: list[np.ndarray], node: np.ndarray, y: np.ndarray, rate: float) -> None:
    """One gradient step of a level over a batch, on the feature rows it touches, with rates that fall by the squares each row has met. Biases
    of classes and groups stay what counts made them."""
    g = exponents(w, level, rows, node)
    np.exp(g, out=g)
    g /= (g @ _ONES)[:, None]
    g[np.arange(len(y)), y] -= 1
    for k, r in enumerate(rows):
        order = np.argsort(r, kind="stable")
        s = r[order]
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        at = s[first].astype(np.intp)
        sums = np.add.reduceat(g.take(order, 0, mode="clip").view(np.complex64), first, axis=0).view(np.float32)  # two columns at a time
        part = slice((level * FEATURES + k) * FEATURE_ROWS, (level * FEATURES + k + 1) * FEATURE_ROWS)
        seen = squares[part]
        seen[at] += np.einsum("ij,ij->i", sums, sums)
        sums *= (-rate / np.sqrt(seen[at] / WIDTH + 1e-3))[:, None]
        sums += w[part].take(at, 0)
        w[part][at] = sums
        visits[part][at] += np.diff(np.append(first, len(s)))
    if level == 0:
        sums = g.sum(0)
        squares[BIAS] += sums @ sums
        w[BIAS] -= rate * sums / np.sqrt(squares[BIAS] / WIDTH + 1e-3)
        visits[BIAS] += len(y)


def _train_round(rows: DataFrame, vocabulary, weights: np.ndarray, rate: float) -> np.ndarray:
    """Weights after a round over all of `rows`."""
    import zstandard

    sc = rows.sparkSession.sparkContext
    start = sc.broadcast(weights)
    blocks = -(-SIZE // _BLOCK)

    def learn(batches: Iterator[list]):
        v = vocabulary.value
        w, squares, visits = start.value.copy(), np.zeros(SIZE, np.float32), np.zeros(SIZE, np.int64)
        for ids, hashes in batches:
            t = Tokens(v, ids, hashes)
            for a in range(0, len(t.ids), BATCH):
                for level, _, r, node, y in t.parts(a, min(len(t.ids), a + BATCH)):
                    step(w, squares, visits, level, r, node, y, rate)
        delta, pack = (w - start.value).astype(np.float16), zstandard.ZstdCompressor(level=1).compress
        for b in range(blocks):
            s = slice(b * _BLOCK, (b + 1) * _BLOCK)
            if visits[s].any():
                yield [[b], [pack(visits[s].astype("<i8").tobytes() + delta[s].tobytes())]]

    def mix(batches: Iterator[list[list]]):
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        unpack = zstandard.ZstdDecompressor().decompress
        for ids, blobs in batches:
            for b, blob in zip(ids, blobs, strict=True):
                n_rows = min(_BLOCK, SIZE - b * _BLOCK)
                raw = unpack(blob)
                n, d = np.frombuffer(raw, "<i8", n_rows), np.frombuffer(raw, np.float16, n_rows * WIDTH, 8 * n_rows).reshape(n_rows, WIDTH)
                total, change = sums.setdefault(b, (np.zeros(n_rows, np.int64), np.zeros((n_rows, WIDTH))))
                total += n
                change += n[:, None] * d.astype(np.float64)
        for b, (total, change) in sums.items():
            yield [[b], [(change / np.maximum(1, total)[:, None]).astype(np.float32).tobytes()]]

    sent = map_rows(rows, ["ids", "tail_hash"], learn, "b int, blob binary")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mixed = map_rows(sent.repartition(min(parts, blocks), "b"), ["b", "blob"], mix, "b int, blob binary")
    out = weights.copy()
    for b, blob in mixed.collect():  # the weights, whose size is fixed
        out[b * _BLOCK : (b + 1) * _BLOCK] += np.frombuffer(blob, np.float32).reshape(-1, WIDTH)
    start.destroy()
    return out


def learn_vocabulary(docs: DataFrame, text: str = "text", head: int = HEAD) -> tuple[DataFrame, object]:
    """Counts of all tokens (a table) and the broadcast vocabulary."""
    counts = table(count_tokens(docs, text), "token-counts")
    total, distinct = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    # Word counts by sixteenths of a power of two: the lowest step down to which the head holds at most `head` words.
    step_of = F.floor(F.log2("c") * 16).cast("int")
    lowest, held = None, 0
    for r in sorted(counts.where("c > 1").groupBy(step_of.alias("s")).count().collect(), key=lambda r: -r["s"]):
        held += r["count"]
        if held > head:
            break
        lowest = r["s"]
    in_head = step_of >= lowest if lowest is not None else F.lit(False)
    top = [(bytes(r.w), r.c) for r in counts.where(in_head).collect()]
    tail_of = F.crc32(F.substring("w", -1, 1)) % TAIL_CLASSES
    tail = {int(r.k): (int(r.n), int(r.once)) for r in counts.where(~in_head).groupBy(tail_of.alias("k")).agg(F.sum("c").alias("n"), F.count_if(F.col("c") == 1).alias("once")).collect()}
    v = Vocabulary(top, tail, int(total or 0), int(distinct or 0))
    return counts, docs.sparkSession.sparkContext.broadcast(v)


def train(rows: DataFrame, vocabulary, rounds: int = ROUNDS, rate: float = RATE) -> np.ndarray:
    """Weights learned from encoded rows, each of which is used in every round."""
    weights = vocabulary.value.start()
    for r in range(rounds):
        weights = _train_round(rows, vocabulary, weights, rate / (1 + r))
    return weights


def score_encoded(rows: DataFrame, counts: DataFrame, vocabulary, weights: np.ndarray) -> DataFrame:
    """The kept columns, then n_tokens, n_known, train_tokens, base_score, score."""
    total, distinct = vocabulary.value.total, vocabulary.value.distinct
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def work(batches: Iterator[list]):
        v, w = vocabulary.value, shared.value
        for row, kept, n, known, base, ids, hashes in batches:
            t = Tokens(v, ids.to_pylist(), hashes.to_pylist())
            each = np.concatenate([log_probabilities(w, t, a, min(len(t.ids), a + BATCH)) for a in range(0, len(t.ids), BATCH)]) / math.log(10)
            if len(v.inner):
                each += np.where(t.head, v.inner[np.maximum(t.ids, 0)], 0.0)
            yield [kept, row, n, known, base, np.add.reduceat(each, t.starts)]

    done = map_rows(rows, ["row", "kept", "n", "known", "base", "ids", "tail_hash"], work, with_kept(rows, "row long, n long, known long, base double, model double"), arrow=True)
    tail = rows.select("row", F.explode("tail").alias("t")).select("row", "t.*").join(counts, "w", "left")
    c = F.coalesce("c", F.lit(0)) + 1
    of_class = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("k") + 1)
    inner = F.log10(F.coalesce("c", of_class(vocabulary.value.unknown)).cast("double")) - of_class(vocabulary.value.tail_log)
    sums = tail.groupBy("row").agg(F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("tail_known"), F.sum(F.col("n") * F.log10(c / F.lit(float(total + distinct + 1)))).alias("tail_base"), F.sum(F.col("n") * inner).alias("tail_model"))
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return done.join(sums, "row", "left").select(
        "kept.*", F.col("n").alias("n_tokens"), plus("known", "tail_known").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), plus("base", "tail_base").alias("base_score"), plus("model", "tail_model").alias("score")
    )


def fit(docs: DataFrame, text: str = "text", head: int = HEAD, rounds: int = ROUNDS, rate: float = RATE) -> tuple[DataFrame, object, np.ndarray]:
    """Counts (a table), the broadcast vocabulary and the weights, learned from `docs`."""
    counts, vocabulary = learn_vocabulary(docs, text, head)
    return counts, vocabulary, train(encode(docs.select(F.col(text).alias("text"), F.lit(0).alias("k")), vocabulary, ["k"]), vocabulary, rounds, rate)


def score(df: DataFrame, model: tuple[DataFrame, object, np.ndarray], keep: list[str], text: str = "text") -> DataFrame:
    """`keep` columns, then n_tokens, n_known, train_tokens, base_score, score."""
    counts, vocabulary, weights = model
    return score_encoded(encode(df, vocabulary, keep, text), counts, vocabulary, weights)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of those outside the fixed held-out fold. Both use one table of encoded texts."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", (crc_bucket("doc_id", 7) == 2).alias("held_out"))
    counts, vocabulary = learn_vocabulary(docs.where(~F.col("held_out")))
    rows = encode(docs, vocabulary, ["doc_id", "held_out"])
    return score_encoded(rows, counts, vocabulary, train(rows.where("NOT kept.held_out"), vocabulary))
