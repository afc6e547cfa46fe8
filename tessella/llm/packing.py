"""Packing by power-of-two decomposition.

A document's ids (with the end id) are split into pieces whose lengths are powers of two: as many of the full length as fit, then
the set bits of the rest, largest first. A piece is a sequence of its own, so no sequence crosses documents and nothing is padded.
Sequences of one length go to one bucket (log2 of the length), and each task deals a bucket's sequences into batches of BATCH_TOKENS tokens:
a batch holds sequences of one length only, in slots without gaps, and all but the last of each bucket and task are full.

Tokenizing costs most. Neither NFC, lower-casing nor the pre-tokenizer's pattern of the public vocabulary joins anything
across a blank, tab or line end, and its control strings hold none of these, so a text's ids are those of its blank-separated chunks, one after
the other. Each worker encodes a chunk once and keeps its ids in a bounded table of 300 000 chunks (some 50 MB). Control strings in a text get their own ids, as the
tokenizer gives them by default.

Null or empty text: the end id alone. Texts of any length are encoded whole. Repeated rows are packed each on its own. Empty table: no
rows. Extra columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import map_rows, read

VOCABULARY = "word_bpe_49k.json"
MAX_TOKENS, END_ID, BATCH_TOKENS = 2048, 1, 1 << 16


def _byte_alphabet() -> dict[int, int]:
    """The printable stand-ins of byte-level BPE: printable Latin-1 characters stand for themselves, the others follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}


class ChunkEncoder:
    """Token ids of texts, by way of a table of chunks. The table is emptied when it holds `limit` chunks; results don't depend on it.

    A chunk of plain Latin letters, with a comma or full stop behind it or not, is lower-cased and goes to the vocabulary's BPE
    model at once (the letters are one pre-token, the mark another); any other chunk goes through the whole tokenizer."""

    def __init__(self, path: str, limit: int = 300_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model, self.alphabet, self.limit = self.tok.model, _byte_alphabet(), limit
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.pool = np.zeros(1 << 16, np.uint16 if self.tok.get_vocab_size() <= 1 << 16 else np.uint32)
        self.starts, self.lens = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.uint32)
        self.used = 0

    def _ids(self, chunk: str) -> list[int]:
        last = chunk[-1:]
        word = chunk[:-1] if last in (",", ".") else chunk
        if word.isalpha() and max(word) < "\u0250" and "\u0130" not in word:
            word = word.lower()
            ids = [x.id for x in self.model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(self.alphabet))]
            return ids + [x.id for x in self.model.tokenize(last)] if word is not chunk and last in (",", ".") else ids
        return self.tok.encode(chunk, add_special_tokens=False).ids

    def _learn(self, chunks: list[str]) -> None:
        each = [self._ids(c) for c in chunks]
        lens = np.fromiter(map(len, each), np.int64, len(each))
        ids = np.fromiter(chain.from_iterable(each), self.pool.dtype, int(lens.sum()))
        n, k = len(self.index), len(chunks)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while n + k > len(self.starts):
            self.starts, self.lens = np.concatenate([self.starts, np.zeros_like(self.starts)]), np.concatenate([self.lens, np.zeros_like(self.lens)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.lens[n : n + k] = lens
        self.starts[n : n + k] = self.used + np.cumsum(lens) - lens
        self.index.update(zip(chunks, range(n, n + k), strict=True))
        self.used += len(ids)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and where each text's ids start and end (one more than texts)."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        words = split.flatten().dictionary_encode()
        chunks = words.dictionary.to_pylist()
        known = np.fromiter(map(self.index.get, chunks, repeat(-1)), np.int64, len(chunks))
        missing = np.flatnonzero(known < 0)
        if len(missing) and len(self.index) + len(missing) > self.limit:
            self._reset()
            missing = np.arange(len(chunks))
        if len(missing):
            known[missing] = len(self.index) + np.arange(len(missing))
            self._learn([chunks[i] for i in missing.tolist()])
        found = known[words.indices.to_numpy(zero_copy_only=False)]
        lens = self.lens[found].astype(np.int64)
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        shift = (self.starts[found] - (ends - lens)).astype(np.int32)
        ids = self.pool[np.arange(total, dtype=np.int32) + np.repeat(shift, lens)]
        counts = pc.list_value_length(split).to_numpy(zero_copy_only=False)
        return ids, np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder for each Python worker and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def binary_pieces(n: int, most: int = MAX_TOKENS) -> list[int]:
    """Lengths of the pieces of n tokens: full ones, then the binary digits of the rest. `most` is a power of two."""
    return [most] * (n // most) + [1 << b for b in range(most.bit_length() - 2, -1, -1) if n % most >> b & 1]


def pack(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", most: int = MAX_TOKENS, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket, batch_id, batch_slot[, ids])."""
    depth = most.bit_length()

    def work(batches: Iterator[list]):
        enc, end = encoder(vocabulary), np.uint32(end_id)
        dealt, task = [0] * depth, TaskContext.get().partitionId()
        for keys, texts in batches:
            out: list[list] = [[] for _ in range(9)]
            pool, bounds = enc.encode(texts)
            whole: list[np.ndarray] = []
            for k, a, b in zip(keys.to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                ids = np.append(pool[a:b], end).astype("<u4")
                whole.append(ids)
                at = 0
                for length in binary_pieces(len(ids), most):
                    bucket = length.bit_length() - 1
                    batch, slot = divmod(dealt[bucket], max(1, BATCH_TOKENS >> bucket))
                    dealt[bucket] += 1
                    row = (k, at, length, zlib.crc32(ids[at : at + length].tobytes()), len(ids), 0, bucket, ((task << 26) + batch) * depth + bucket, slot)
                    for c, v in zip(out, row, strict=True):
                        c.append(v)
                    at += length
            if with_ids:  # pieces lie in the order of the ids
                starts = np.concatenate([[0], np.cumsum(out[2])]).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(starts), pa.array(np.concatenate(whole).astype(np.int32))))
            yield out

    ids = ", ids array<int>" if with_ids else ""
    pieces = map_rows(df, [key, text], work, f"doc_id long, start long, length long, ids_crc32 long, doc_tokens long, offset long, bucket int, batch_id long, batch_slot int{ids}", arrow=True)
    return pieces.withColumn("sequence_id", F.monotonically_increasing_id())


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op4_packing(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """All documents in sequences of 2048 tokens or a smaller power of two."""
    return pack(read(spark, sf_dir, "documents"), vocabulary or default_vocabulary(), with_ids=False)
