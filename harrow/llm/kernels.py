"""Vectorised hashing of words, bytes and windows, shared by the repeat operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Multiplier of the rolling polynomial (odd, so it has an inverse modulo 2**64).
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Text is worked on in pieces of about this many bytes; one document is never split.
PIECE_BYTES = 1 << 20

_U = np.uint64
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        seq = np.full(max(n, PIECE_BYTES + 64), base, _U)
        seq[0] = 1
        have = np.multiply.accumulate(seq)
        if n <= 4 * PIECE_BYTES:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (splitmix64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x = x * _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class Prefix:
    """Prefix sums of a polynomial over units; gives the hash of any span."""

    def __init__(self, units: np.ndarray):
        n = len(units)
        self.sums = np.zeros(n + 1, _U)
        np.cumsum(units * powers(BASE, n), out=self.sums[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        inv = powers(INVERSE, len(self.sums))
        return mix((self.sums[ends] - self.sums[starts]) * inv[starts] + (ends - starts).astype(_U))

    def rolling(self, width: int) -> np.ndarray:
        m = len(self.sums) - width
        if m <= 0:
            return np.zeros(0, _U)
        inv = powers(INVERSE, len(self.sums))
        return mix((self.sums[width:] - self.sums[:m]) * inv[:m] + _U(width))


def pieces(texts: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of whole texts; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type):
        texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    else:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def is_space(raw: np.ndarray) -> np.ndarray:
    """The bytes 0x20 and 0x09-0x0D."""
    return (raw == 32) | ((raw >= 9) & (raw <= 13))


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each document the number of words before it."""
    if not len(raw):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    word = ~is_space(raw)
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    first = offsets[:-1][offsets[:-1] < len(raw)]
    begin[first] = word[first]
    end = word.copy()
    end[:-1] &= ~word[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    end[last] = word[last]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return Prefix(raw.astype(_U) + _U(1)).spans(starts, ends)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, in time that does not depend on width."""
    n = len(x)
    if n < width:
        return x[:0]
    padded = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    head = np.minimum.accumulate(blocks, axis=1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[: n - width + 1], head[width - 1 : n])


#: Low bits of a key that hold a place; a tile of windows is at most half of that range.
_PLACE = 24
_TILE = 1 << 23


def anchor_runs(units: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> dict[str, np.ndarray]:
    """Runs of consecutive windows of ``length`` units that pick the same anchor.

    The anchor of a window is its leftmost least-hashed ``gram`` of units, so
    equal windows have equal anchors at equal places.  ``bounds``: the number of
    units before each document.  Returns first window, number of windows, place of
    the anchor in the run's region, anchor hash, region hash and document of each run.
    """
    n = len(units)
    if n < length:
        return {k: np.zeros(0, np.int64) for k in ("first", "count", "at", "doc")} | {k: np.zeros(0, _U) for k in ("anchor", "region")}
    prefix = Prefix(units)
    grams = prefix.rolling(gram)
    width = length - gram + 1
    places = []
    high = ~_U((1 << _PLACE) - 1)
    for t in range(0, n - length + 1, _TILE):
        part = grams[t : t + _TILE + width - 1]
        keys = (part & high) | np.arange(len(part), dtype=_U)
        places.append((sliding_min(keys, width) & ~high).astype(np.int64) + t)
    place = np.concatenate(places)
    sizes = np.diff(bounds)
    ends = np.repeat(bounds[1:], sizes)
    index = np.flatnonzero(ends[: n - length + 1] >= np.arange(length, n + 1))
    if not len(index):
        return anchor_runs(units[:0], bounds[:1], length, gram)
    chosen = place[index]
    fresh = np.ones(len(index), bool)
    fresh[1:] = (chosen[1:] != chosen[:-1]) | (index[1:] != index[:-1] + 1)
    b = np.flatnonzero(fresh)
    first, last, at = index[b], index[np.append(b[1:], len(index)) - 1], chosen[b]
    region = mix(prefix.spans(first, last + length) + (at - first).astype(_U))
    return {"first": first, "count": last - first + 1, "at": at - first, "anchor": grams[at], "region": region, "doc": np.searchsorted(bounds, first, side="right") - 1}


def merge_spans(spans: np.ndarray) -> np.ndarray:
    """Sorted, disjoint, non-touching [start, end) rows that cover the same places."""
    if not len(spans):
        return np.zeros((0, 2), np.int64)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    fresh = np.ones(len(spans), bool)
    fresh[1:] = spans[1:, 0] > reach[:-1]
    b = np.flatnonzero(fresh)
    return np.stack([spans[b, 0], reach[np.append(b[1:], len(spans)) - 1]], axis=1)
