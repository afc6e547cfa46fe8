"""Chunks of texts within token bounds: by sentences, paragraphs or fixed windows with overlap, and by breaks of coherence between sentences.

A document is split as one row of a bounded Arrow batch; documents are spread over tasks by Spark. The tokenizer and the embedding are
parameters. Null text: no chunks. An empty or short text is one chunk.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import map_rows

#: Bounds in tokens, and words before a full stop that end no sentence.
MAX_TOKENS, OVERLAP_TOKENS, MIN_TOKENS = 512, 64, 32
ABBREVIATIONS = frozenset("dr mr mrs ms prof inc ltd jr sr vs etc ca bzw vgl nr abs art st ft approx dept est govt assn".split())
_SENTENCE, _PARAGRAPH = re.compile(r"(?<=[.!?])\s+"), re.compile(r"\n\s*\n")
_BOUNDARY = re.compile(r"[.!?][\"')]?\s+(?=[A-ZÄÖÜ\d])")

Encode = Callable[[str], list]
Decode = Callable[[list], str]


def blank_tokens(text: str) -> list[str]:
    return text.split()


def join_tokens(tokens: list[str]) -> str:
    return " ".join(tokens)


@dataclass(frozen=True)
class Bounds:
    """Token bounds, and how tokens are made and joined. A subword tokenizer is given by its functions; with `places`, the characters from and to
    which each token stands for, windows are cut from the text itself instead of being decoded. `counted` counts tokens without making them; where
    `blanks_part` says that no token spans a blank, the tokens of texts joined by blanks are those of the texts."""

    most: int = MAX_TOKENS
    overlap: int = OVERLAP_TOKENS
    least: int = MIN_TOKENS
    encode: Encode = blank_tokens
    decode: Decode = join_tokens
    places: Callable[[str], list[tuple[int, int]]] | None = None
    counted: Callable[[str], int] | None = None
    blanks_part: Callable[[], bool] = bool

    def count(self, text: str) -> int:
        return self.counted(text) if self.counted else len(self.encode(text))


#: Fixed patterns of pre-tokenizers that keep what they match, no part of which can be a blank, and drop the rest.
_WITHOUT_BLANKS = frozenset({r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"})
_BLANK, _KEPT_COUNTS = re.compile(r"[ \t\n\r]+"), 300_000


class FileTokenizer:
    """A tokenizer of the tokenizers library by its file, which every machine that runs tasks must have; each worker opens it once. Where no token spans
    a blank, a text's tokens are those of what stands between its blanks: the count of each such piece is kept in a table, emptied at 300 000."""

    _open: dict[str, object] = {}
    _parts: dict[str, bool] = {}
    _counts: dict[str, dict[str, int]] = {}

    def __init__(self, path: str) -> None:
        self.path = path

    def _tokenizer(self):
        if self.path not in self._open:
            from tokenizers import Tokenizer

            self._open[self.path] = Tokenizer.from_file(self.path)
        return self._open[self.path]

    def blanks_part(self) -> bool:
        """Whether a known pattern drops blanks before tokens are made, nothing before it joins across them, and no control string has one."""
        if self.path not in self._parts:
            t = self._tokenizer()
            made = json.loads(t.to_str())
            first, normal = ((made.get(n) or {}) for n in ("pre_tokenizer", "normalizer"))
            first = (first.get("pretokenizers") or [first])[0]
            known = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and first["pattern"].get("Regex") in _WITHOUT_BLANKS
            plain = all(n.get("type") in ("NFC", "Lowercase", None) or (n["type"] == "Replace" and n["pattern"].get("Regex") == r"\s+" and n["content"] == " ") for n in normal.get("normalizers") or [normal])
            self._parts[self.path] = bool(known and plain and not any(_BLANK.search(a["content"]) for a in made.get("added_tokens") or ()))
        return self._parts[self.path]

    def count(self, text: str) -> int:
        if not self.blanks_part():
            return len(self.encode(text))
        known = self._counts.setdefault(self.path, {})
        pieces = _BLANK.split(text)
        try:
            return sum(map(known.__getitem__, pieces))
        except KeyError:
            new = list({p for p in pieces if p not in known})
        if len(known) + len(new) > _KEPT_COUNTS:
            known.clear()
            new = list(set(pieces))
        known.update(zip(new, map(len, self._tokenizer().encode_batch_fast(new, add_special_tokens=False)), strict=True))
        return sum(map(known.__getitem__, pieces))

    def encode(self, text: str) -> list[int]:
        return self._tokenizer().encode(text, add_special_tokens=False).ids

    def decode(self, ids: list[int]) -> str:
        return self._tokenizer().decode(ids)

    def places(self, text: str) -> list[tuple[int, int]]:
        return self._tokenizer().encode(text, add_special_tokens=False).offsets


def file_bounds(path: str, most: int = MAX_TOKENS, overlap: int = OVERLAP_TOKENS, least: int = MIN_TOKENS) -> Bounds:
    t = FileTokenizer(path)
    return Bounds(most, overlap, least, t.encode, t.decode, t.places, t.count, t.blanks_part)


def windows(text: str, b: Bounds, step: int | None = None) -> list[tuple[str, int]]:
    """Windows of `most` tokens, each `step` further, until one reaches the end."""
    tokens = b.encode(text)
    if len(tokens) <= b.most:
        return [(text, len(tokens))]
    step = max(1, step or b.most - b.overlap)
    starts = range(0, max(1, math.ceil((len(tokens) - b.most) / step) + 1) * step, step)
    if b.places:
        at = b.places(text)
        return [(text[at[s][0] : at[min(s + b.most, len(at)) - 1][1]], min(b.most, len(at) - s)) for s in starts]
    return [(b.decode(tokens[s : s + b.most]), len(tokens[s : s + b.most])) for s in starts]


def packed(segments: list[str], joiner: str, b: Bounds) -> list[tuple[str, int]]:
    """Runs of segments that fit, each begun with the last segments of the run before that fit into the overlap. A segment that alone is too
    long is cut into windows. Each segment is encoded alone and, where tokens may span a blank, once with the next, which tells what joining two adds or saves; sums of
    both give the tokens of any run, so that neither packing nor overlaps encode again."""
    sizes = [b.count(s) for s in segments]
    joins = [0] * (len(segments) - 1) if b.blanks_part() and joiner.isspace() else [b.count(x + joiner + y) - n - m for x, y, n, m in zip(segments, segments[1:], sizes, sizes[1:])]
    until = list(accumulate(sizes, initial=0))
    joined = list(accumulate(joins, initial=0))
    tokens = lambda a, z: until[z] - until[a] + joined[z - 1] - joined[a]
    out, at = [], 0
    while at < len(segments):
        end = at + 1
        while end < len(segments) and tokens(at, end + 1) <= b.most:
            end += 1
        if end == at + 1 and sizes[at] > b.most:
            out += windows(segments[at], b)
            at = end
            continue
        out.append((joiner.join(segments[at:end]), tokens(at, end)))
        if end == len(segments):
            break
        back, held = end, 0
        while back - 1 > at and held + sizes[back - 1] <= b.overlap:
            back -= 1
            held += sizes[back]
        at = back
    return out


def chunk(text: str, strategy: str, b: Bounds) -> list[tuple[str, int]]:
    n = b.count(text)
    if n < b.least or n <= b.most:
        return [(text, n)]
    if strategy == "fixed":
        return windows(text, b)
    pattern, joiner = (_PARAGRAPH, "\n\n") if strategy == "paragraph" else (_SENTENCE, " ")
    return packed([s for s in pattern.split(text) if s.strip()], joiner, b) or [("", 0)]


def chunks(df: DataFrame, key: str, text: str, strategy: str | None = None, bounds: Bounds | None = None) -> DataFrame:
    """(key, chunk_index, content, token_count); `strategy` names a column, without one texts are split by sentences."""
    b = bounds or Bounds()

    by = F.col(strategy) if strategy else F.lit("semantic")
    split = lambda t, s: chunk(t, s, b)
    return _in_order(df.select(F.col(key).alias("key"), F.col(text).alias("text"), by.alias("by")), key, split, "content string, token_count int")


#: Characters of chunks that a task holds before it sends them on.
HELD = 4_000_000


def _in_order(rows: DataFrame, key: str, split: Callable[..., list[tuple]], fields: str) -> DataFrame:
    """(key, chunk_index, the fields) of what `split` makes of the columns of `rows` after `key`, of which a null first one has nothing. Batches are bounded by
    rows and bytes, and what is made is sent on piece by piece, so that a task holds little more than one text."""
    made = T.StructType([rows.schema["key"], T.StructField("chunk_index", T.IntegerType()), *T.StructType.fromDDL(fields).fields])

    def work(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        out: list[list] = [[] for _ in made]
        held = 0
        for keys, texts, *more in batches:
            for k, t, *rest in zip(keys, texts, *more, strict=True):
                for i, c in enumerate(split(t, *rest) if t is not None else ()):
                    for column, value in zip(out, (k, i, *c), strict=True):
                        column.append(value)
                    held += len(c[0])
                if held > HELD:
                    yield out
                    out, held = [[] for _ in made], 0
        if out[0]:
            yield out

    return map_rows(rows, rows.columns, work, made).withColumnRenamed("key", key)


def sentences(text: str) -> list[str]:
    """Sentences end at a mark before a blank and a capital letter or digit; not after known abbreviations or single letters, nor between
    two digits."""
    out, start = [], 0
    for m in _BOUNDARY.finditer(text):
        at = m.start()
        if text[at] == ".":
            if at and text[at - 1].isdigit() and text[m.end() : m.end() + 1].isdigit():
                continue
            begin = at
            while begin and text[begin - 1].isalpha():
                begin -= 1
            word = text[begin:at].lower()
            if word in ABBREVIATIONS or len(word) == 1:
                continue
        out.append(text[start : m.end()].strip())
        start = m.end()
    out.append(text[start:].strip())
    return [s for s in out if s]


def breakpoints(similarities: list[float], sensitivity: float = 1.0, min_gap: int = 2) -> list[int]:
    """Sentences at which a new topic begins: after a local minimum of similarity below mean - sensitivity x deviation, `min_gap` or more
    after the one before."""
    n = len(similarities)
    if n < 3:
        return []
    mean = sum(similarities) / n
    low = mean - sensitivity * math.sqrt(sum((s - mean) ** 2 for s in similarities) / (n - 1))
    out: list[int] = []
    for i in range(1, n - 1):
        s = similarities[i]
        if s < similarities[i - 1] and s < similarities[i + 1] and s < low and (not out or i + 1 - out[-1] >= min_gap):
            out.append(i + 1)
    return out


def cosine(a: list[float], b: list[float]) -> float:
    norms = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b, strict=True)) / norms if norms else 0.0


def _halved(group: list[str], b: Bounds) -> list[list[str]]:
    if len(group) <= 1 or b.count(" ".join(group)) <= b.most:
        return [group]
    middle = len(group) // 2
    return _halved(group[:middle], b) + _halved(group[middle:], b)


def coherent(text: str, embed: Callable[[list[str]], list[list[float]]], b: Bounds, sensitivity: float = 1.0, min_gap: int = 2, overlap_sentences: int = 1) -> list[tuple[str, int, float]]:
    """(content, tokens, mean similarity within) of groups of sentences between breakpoints: too long ones are halved, too short ones join the one
    before, and each begins with the last sentences of the one before."""
    parts = sentences(text)
    if not parts:
        return [("", 0, 0.0)]
    if len(parts) == 1:
        return [(c, n, 1.0) for c, n in windows(text.strip(), b, b.most - 20 * overlap_sentences)]
    vectors = embed(parts)
    sims = [cosine(x, y) for x, y in zip(vectors, vectors[1:])]
    edges = [0, *breakpoints(sims, sensitivity, min_gap), len(parts)]
    groups: list[tuple[list[str], float]] = []
    for a, z in zip(edges, edges[1:]):
        inside = sims[a : z - 1]
        groups += [(g, sum(inside) / len(inside) if inside else 1.0) for g in _halved(parts[a:z], b)]
    merged = groups[:1]
    for group, mean in groups[1:]:
        before, old = merged[-1]
        n = b.count(" ".join(group))
        if n < b.least and b.count(" ".join(before)) + n <= b.most:
            merged[-1] = (before + group, (old + mean) / 2)
        else:
            merged.append((group, mean))
    out = []
    for i, (group, mean) in enumerate(merged):
        whole = " ".join((merged[i - 1][0][-overlap_sentences:] if i and overlap_sentences else []) + group)
        out.append((whole, b.count(whole), mean))
    return out


def coherence_chunks(df: DataFrame, key: str, text: str, embed: Callable[[list[str]], list[list[float]]], bounds: Bounds | None = None, **settings) -> DataFrame:
    """(key, chunk_index, content, token_count, coherence)."""
    b = bounds or Bounds()

    return _in_order(df.select(F.col(key).alias("key"), F.col(text).alias("text")), key, lambda t: coherent(t, embed, b, **settings), "content string, token_count int, coherence double")


def hashed_words(parts: list[str], size: int = 64) -> list[list[float]]:
    """A stand-in for an embedding: counts of words by hash. Any function from sentences to vectors will do."""
    import zlib

    out = []
    for p in parts:
        v = [0.0] * size
        for w in p.lower().split():
            v[zlib.crc32(w.encode()) % size] += 1.0
        out.append(v)
    return out
