"""Bloom filters of a fixed size over 64-bit keys: what they let through beyond their keys costs time, never results."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import map_rows

FILTER_BITS = 27


def filter_of(keys: DataFrame, key: str, bits: int = FILTER_BITS) -> np.ndarray:
    """A filter with two places for each key, of 2^bits bits (16 MB) however many keys there are. Tasks set the bits of pieces of 8 KB, of which the
    driver gets each once."""
    mask, piece = (1 << bits) - 1, 1 << 16
    places = keys.select(F.explode(F.array(F.col(key).bitwiseAND(F.lit(mask)), F.shiftrightunsigned(key, 32).bitwiseAND(F.lit(mask)))).alias("p"))

    def work(batches: Iterator[list]):
        made: dict[int, np.ndarray] = {}
        for (p,) in batches:
            p = np.unique(p.to_numpy())
            at = np.flatnonzero(np.diff(p >> 16, prepend=-1))
            for some in np.split(p, at[1:]):
                if len(some):
                    made.setdefault(int(some[0] >> 16), np.zeros(piece, bool))[some & (piece - 1)] = True
        yield [list(made), [np.packbits(v, bitorder="little").tobytes() for v in made.values()]]

    pieces = map_rows(places.repartition(F.shiftright("p", 16)), ["p"], work, "i long, bits binary", arrow=True)
    out = np.zeros(1 << bits - 3, np.uint8)
    for r in pieces.toLocalIterator():
        out[r["i"] * (piece >> 3) : (r["i"] + 1) * (piece >> 3)] = np.frombuffer(r["bits"], np.uint8)
    return out.view("<u8")


def held(found: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys a filter may hold; all that it does hold are among them."""
    mask = np.uint64(64 * len(found) - 1)
    one, low = np.uint64(1), np.uint64(63)
    hit = np.ones(len(keys), bool)
    for p in (keys & mask, (keys >> np.uint64(32)) & mask):
        hit &= (found[p >> np.uint64(6)] >> (p & low)) & one == one
    return hit
