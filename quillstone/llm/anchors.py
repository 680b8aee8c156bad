"""Equal windows of texts, found exactly: windows hang on anchors, and all that hang on one anchor are sorted together.

A window's anchor is the least gram hash in it, the leftmost of equal ones, so equal windows have the same gram at the
same distance.  Consecutive windows with one anchor form a run, which is carried as one string.  Runs of one gram meet
in a bucket: equal strings are one, and the windows of different strings are sorted by what they consist of.  Hashes
choose who meets; what is equal is decided on words or bytes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quillstone.llm.text import U

#: Low bits of a hash that give way to its place, so that a minimum tells both.
PLACE = 20
CHUNK = 1 << 15
SHIPPED = "kind int, bucket int, blk long, part long, fp long, back int, n long, run binary"
ANSWER = "kind int, blk long, part long, flags binary"
#: Bytes from one sample place to the next.
STRIDE = 16


def least_places(h: np.ndarray, span: int) -> np.ndarray:
    """For each `span` consecutive hashes the place of the least, the leftmost of equal ones."""
    n = max(0, len(h) - span + 1)
    out = np.empty(n, np.int64)
    for a in range(0, n, CHUNK):
        part = h[a : a + CHUNK + span - 1]
        v, k = (part >> U(PLACE) << U(PLACE)) | np.arange(len(part), dtype=U), 1
        while k < span:
            step = min(k, span - k)
            v, k = np.minimum(v[: len(v) - step], v[step:]), k + step
        out[a : a + len(v)] = (v & U((1 << PLACE) - 1)).astype(np.int64) + a
    return out


class Runs:
    """Runs of windows of `width` units with one anchor; `h` are gram hashes of `gram` units, `row` the row of each unit."""

    def __init__(self, h: np.ndarray, row: np.ndarray, width: int, gram: int):
        n = max(0, len(row) - width + 1)
        at = np.flatnonzero(row[:n] == row[width - 1 :]) if n else np.zeros(0, np.int64)
        place = least_places(h, width - gram + 1)[at]
        edge = np.flatnonzero(np.append(True, (np.diff(at) != 1) | (np.diff(place) != 0))) if len(at) else at
        self.width, self.first, self.anchor = width, at[edge], place[edge]
        self.last = at[np.append(edge[1:], len(at)) - 1] if len(at) else at
        self.fp = h[self.anchor]

    def parts(self, chosen: np.ndarray, string: Callable[[int, int], bytes]) -> dict[tuple, list[int]]:
        """(fp, distance to the anchor, string) -> the chosen runs that are so; `string` takes the first unit and the end."""
        out: dict[tuple, list[int]] = {}
        back = self.anchor - self.first
        for i in chosen.tolist():
            out.setdefault((int(self.fp[i]), int(back[i]), string(int(self.first[i]), int(self.last[i]) + self.width)), []).append(i)
        return out

    def shipped(self, chosen: np.ndarray, string: Callable[[int, int], bytes], blk: int, buckets: int, kind: int = 0) -> pa.Table:
        """One row for each different string of the block; `part` is its first run, `kind` the number of the width."""
        found = self.parts(chosen, string)
        fp = np.array([k[0] for k in found], U)
        return pa.table({
            "kind": pa.array([kind] * len(found), pa.int32()), "bucket": pa.array((fp % U(buckets)).astype(np.int32)), "blk": pa.array([blk] * len(found), pa.int64()), "part": pa.array([v[0] for v in found.values()], pa.int64()),
            "fp": pa.array(fp.view(np.int64)), "back": pa.array([k[1] for k in found], pa.int32()), "n": pa.array([len(v) for v in found.values()], pa.int64()), "run": pa.array([k[2] for k in found], pa.binary()),
        })

    def starts(self, answer: pa.Table, string: Callable[[int, int], bytes]) -> np.ndarray:
        """The starts of the windows that the answers call repeated, also in runs with the string of an answered one."""
        parts, flags = answer["part"].to_numpy(), answer["flags"].to_pylist()
        told = dict(zip(parts.tolist(), flags, strict=True))
        out = []
        for runs in self.parts(np.flatnonzero(np.isin(self.fp, np.unique(self.fp[parts]))), string).values():
            if runs[0] in told:
                at = np.flatnonzero(np.unpackbits(np.frombuffer(told[runs[0]], np.uint8)))
                out += [self.first[i] + at for i in runs]
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def pair_ranks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The rank of each pair among all different pairs."""
    order = np.lexsort((b, a))
    out = np.empty(len(a), np.int64)
    out[order] = np.cumsum(np.append(0, (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0))) if len(a) else order
    return out


def deeper(rank: np.ndarray, step: int) -> np.ndarray:
    """Ranks of pairs of places `step` apart; behind the end all is alike."""
    return pair_ranks(rank, np.append(rank[step:], np.zeros(min(step, len(rank)), rank.dtype)))


def tied(*columns: np.ndarray) -> np.ndarray:
    """Which rows equal another in all columns: the rows are sorted, and neighbours compared."""
    order = np.lexsort(columns[::-1])
    differ = np.zeros(max(0, len(order) - 1), bool)
    for c in columns:
        differ |= c[order][1:] != c[order][:-1]
    out = np.zeros(len(order), bool)
    out[order] = np.append(False, ~differ) | np.append(~differ, False) if len(order) else False
    return out


def tied_bytes(runs: list[bytes], group: np.ndarray, back: np.ndarray, width: int) -> list[np.ndarray]:
    """For every string which of its windows of `width` bytes (at least 64) equal a window of another string of the group.

    The strings are laid out with their anchors at multiples of STRIDE, so that equal windows see the sample places at the
    same distances.  Sample suffixes are ranked first, by doubling, to the depth that every window holds behind its
    first sample place.  Then the suffixes of each bucket (a group and a distance to its anchor) are sorted by their
    first bytes, long ties by the rank of the sample suffix, and the rest by their last bytes.
    """
    size = np.array([len(r) for r in runs])
    cell = np.cumsum(np.append(0, (size + 2 * STRIDE) // STRIDE * STRIDE))
    base = cell[:-1] + -back % STRIDE
    flat = np.zeros(cell[-1] + width + 64, np.uint8)
    ends = np.cumsum(size)
    flat[np.arange(ends[-1]) + np.repeat(base - ends + size, size)] = np.frombuffer(b"".join(runs), np.uint8)
    lane = np.ndarray(len(flat) - 8, ">u8", flat, strides=(1,))
    rank, depth, most = pair_ranks(lane[::STRIDE][:-1], lane[8::STRIDE][: len(lane[::STRIDE]) - 1]), STRIDE, (width - STRIDE) // STRIDE * STRIDE
    while depth < most:
        step = min(depth, most - depth)
        rank, depth = deeper(rank, step // STRIDE), depth + step
    starts = size - width + 1
    stop = np.cumsum(starts)
    k = np.arange(stop[-1]) - np.repeat(stop - starts, starts)
    at = np.repeat(base, starts) + k
    bucket = np.repeat(group, starts) * (4 * width) + (k - np.repeat(back, starts)) + 2 * width
    sample = rank[at // STRIDE + 1]
    out = tied(bucket, sample)
    i = np.flatnonzero(out)
    out[i] = tied(bucket[i], lane[at[i]], lane[at[i] + 8], sample[i], *[lane[at[i] + width - 32 + x] for x in (0, 8, 16, 24)])
    return np.split(out, stop[:-1])


def tied_words(runs: list[bytes], group: np.ndarray, back: np.ndarray, width: int) -> list[np.ndarray]:
    """The same for windows of words: words are numbered within the bucket, and wider ranges ranked by doubling."""
    parts = pc.split_pattern(pa.array(runs, pa.large_binary()), pattern=" ")
    size = np.diff(parts.offsets.to_numpy())
    rank, depth = parts.flatten().dictionary_encode().indices.to_numpy().astype(np.int64), 1
    while depth < width:
        step = min(depth, width - depth)
        rank, depth = deeper(rank, step), depth + step
    starts = size - width + 1
    stop = np.cumsum(starts)
    k = np.arange(stop[-1]) - np.repeat(stop - starts, starts)
    ends = np.cumsum(size)
    return np.split(tied(np.repeat(group, starts) * (4 * width) + (k - np.repeat(back, starts)) + 2 * width, rank[np.repeat(ends - size, starts) + k]), stop[:-1])


def settled(shipped: DataFrame, widths: list[int], compare: Callable, units: Callable[[bytes], int]) -> DataFrame:
    """(kind, blk, part, flags): which windows of a string start elsewhere too, for the strings that have such.

    `compare` is tied_bytes or tied_words, `units` the length of a string in such.  Every block sends a string once, so text that fills a third of the corpus comes once a block; a bucket holds the
    different texts around its anchors.
    """

    def solve(bucket: pa.Table) -> pa.Table:
        width = widths[bucket["kind"][0].as_py()]
        strings = bucket["run"].combine_chunks().dictionary_encode()
        if isinstance(strings, pa.ChunkedArray):
            strings = strings.combine_chunks()
        fp, back, n, own = bucket["fp"].to_numpy(), bucket["back"].to_numpy().astype(np.int64), bucket["n"].to_numpy(), strings.indices.to_numpy()
        order = np.lexsort((own, back, fp))
        new = np.append(True, (np.diff(fp[order]) != 0) | (np.diff(back[order]) != 0) | (np.diff(own[order]) != 0))
        kind = np.empty(len(order), np.int64)
        kind[order] = np.cumsum(new) - 1
        one = order[new]
        times = np.bincount(kind, weights=n)
        _, group = np.unique(fp[one], return_inverse=True)
        lone = np.bincount(group, weights=times == 1)
        open_ = np.flatnonzero((np.bincount(group)[group] > 1) & (lone[group] > 0))
        flags: list = [None] * len(one)
        for i in np.flatnonzero(times > 1).tolist():
            flags[i] = np.packbits(np.ones(units(strings.dictionary[int(own[one[i]])].as_py()) - width + 1, bool)).tobytes()
        if len(open_):
            runs = strings.dictionary.take(pa.array(own[one[open_]])).to_pylist()
            for i, found in zip(open_.tolist(), compare(runs, group[open_], back[one[open_]], width), strict=True):
                if flags[i] is None and found.any():
                    flags[i] = np.packbits(found).tobytes()
        told = np.flatnonzero(np.array([f is not None for f in flags])[kind])
        return pa.table({"kind": bucket["kind"].take(pa.array(told)), "blk": bucket["blk"].take(pa.array(told)), "part": bucket["part"].take(pa.array(told)), "flags": pa.array([flags[i] for i in kind[told]], pa.binary())})

    return shipped.groupBy("kind", "bucket").applyInArrow(solve, ANSWER)
