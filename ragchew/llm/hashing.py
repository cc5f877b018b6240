"""Vectorised words and hashes of whole Arrow columns of text (numpy, inside tasks).

The bytes of a batch are hashed by one running polynomial sum modulo 2**64, from
which the hash of any byte range follows in constant time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_P, -1, 1 << 64)
_TABLE = np.random.RandomState(20240229).randint(0, 1 << 63, size=256, dtype=np.int64).astype(U) * U(2) + U(1)
_powers = {"up": np.ones(1, U), "down": np.ones(1, U)}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
# letters, digits and all bytes of non-ASCII characters
PLAIN = np.ones(256, bool)
PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, kept between batches."""
    for name, base in (("up", _P), ("down", _INVERSE)):
        if len(_powers[name]) < n:
            with np.errstate(over="ignore"):
                p = np.full(max(n, 1 << 16), U(base), U)
                p[0] = 1
                _powers[name] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x + U((0x9E3779B97F4A7C15 * (salt + 1)) & (2 ** 64 - 1))).astype(U)
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, one after another, and n + 1 offsets; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


class RangeHash:
    """Hashes of byte ranges of one array of bytes."""

    def __init__(self, raw: np.ndarray):
        up, self.down = powers(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, U)
        with np.errstate(over="ignore"):
            np.cumsum(_TABLE[raw] * up[:-1], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[ends] - self.sums[starts]) * self.down[starts]


def word_ranges(raw: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = SPACE):
    """Starts and ends of the words (runs of bytes that are not ``gaps``) and, for
    each text, the number of the first of its words (n + 1 numbers). No word crosses texts."""
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = ~gaps[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | first[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(col: pa.Array, gaps: np.ndarray = SPACE, stem: int = 0, fold: bool = False):
    """64-bit hashes of the lower-cased words of each text of a column: A-Z, or all letters with ``fold``.

    Returns the hashes, the number of the first word of each text (n + 1 numbers) and, if
    ``stem`` is given, the hashes of each word's first ``stem`` bytes.
    """
    raw, offsets = column_bytes(pc.utf8_lower(col) if fold else col)
    raw = LOWER[raw]
    starts, ends, firsts = word_ranges(raw, offsets, gaps)
    h = RangeHash(raw)
    hashes = mix(h.of(starts, ends))
    if not stem:
        return hashes, firsts
    return hashes, firsts, mix(h.of(starts, np.minimum(ends, starts + stem)), 1)


def shingle_hashes(words: np.ndarray, firsts: np.ndarray, n: int = 5):
    """Hashes of every run of ``n`` words within a text; a text of fewer words has its
    whole sequence as one. Returns hashes and the number of each text's first (n + 1 numbers)."""
    count = np.diff(firsts)
    per = np.where(count >= n, count - n + 1, (count > 0).astype(count.dtype))
    starts = np.concatenate([[0], np.cumsum(per)])
    text = np.repeat(np.arange(len(count)), per)
    at = firsts[text] + np.arange(starts[-1]) - starts[text]
    out = np.zeros(len(at), U)
    with np.errstate(over="ignore"):
        for j in range(n):
            there = j < count[text]
            out = (out + np.where(there, mix(words[np.minimum(at + j, max(len(words) - 1, 0))], 11 + j), U(0))).astype(U)
            out *= U(_P)
    return mix(out, 5), starts
