"""Whole-batch byte and word hashing on Arrow text columns.

Texts are UTF-8 bytes; a null text counts as empty.  Hashes chain a 64-bit finaliser over words and over doubling
ranges of words or bytes, so no algebraic structure of a text carries over into them, and no loop over documents is needed.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser: spreads every input bit over the 64 output bits."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all rows, offsets of length rows + 1); null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = 2_000_000, rows: int = 4096) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes (a longer row comes alone) and `rows` rows."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = min(max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1), lo + rows, n)
        yield lo, hi
        lo = hi


#: A-Z become a-z, all other bytes stay.
LOWERCASE = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: All ASCII bytes but letters and digits separate; bytes of longer characters do not.
PLAIN = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: Words of more bytes are hashed one by one.
LONG_WORD = 64


def words(buf: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the runs of bytes outside 0x20 and 0x09-0x0D; runs end with their row."""
    if not len(buf):
        return (np.zeros(0, np.int64),) * 3
    solid = ~space[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:-1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(off, start, "right") - 1


def lanes(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as one little-endian number; behind the end stand zeros."""
    return np.ndarray(len(buf), "<u8", np.append(buf, np.zeros(8, np.uint8)), strides=(1,))


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One hash a word, chained over its lanes; the first step keeps words of up to eight bytes apart for certain."""
    size = end - start
    lane, out = lanes(buf), mix(size.astype(U) + U(0x9E3779B97F4A7C15))
    at, k = np.flatnonzero(size <= LONG_WORD), 0
    while len(at):
        rest = size[at] - k
        mask = np.where(rest >= 8, U(2**64 - 1), (U(1) << (U(8) * np.clip(rest, 0, 7).astype(U))) - U(1))
        out[at] = mix(out[at] ^ (lane[start[at] + k] & mask))
        at, k = at[rest > 8], k + 8
    for i in np.flatnonzero(size > LONG_WORD):
        out[i] = int.from_bytes(blake2b(buf[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def grams(x: np.ndarray, width: int, n: int = 1) -> np.ndarray:
    """Hashes of all runs of `width` units, by start, from numbers that stand for `n` units: their range doubles until it is wide enough."""
    h = mix(x + U(0x632BE59BD9B4E019))
    while n < width:
        step = min(n, width - n)
        h = mix(h[: max(0, len(h) - step)] * U(0xD6E8FEB86659FD93) + mix(h[step:])) if len(h) > step else h[:0]
        n += step
    return h


def byte_grams(buf: np.ndarray, width: int, chunk: int = 1 << 15) -> np.ndarray:
    """Hashes of all runs of `width` bytes (at least eight), by start; worked out in pieces that stay in a processor's cache."""
    lane, n = lanes(buf), max(0, len(buf) - width + 1)
    out = np.empty(n, U)
    for a in range(0, n, chunk):
        b = min(n, a + chunk)
        out[a:b] = grams(lane[a : b + width - 8], width, 8)[: b - a]
    return out
