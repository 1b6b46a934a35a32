"""Word hashes of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes hashed at a time: bounds the memory of the 64-bit columns beside them.
BLOCK = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_rng = np.random.Generator(np.random.PCG64(0x5EED))
_BYTE = _rng.integers(0, 2**64, 256, dtype=U) | U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads each bit over all."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE^i and _BASE^-i modulo 2^64 for i < n at least."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK * 2)
        up, down = np.full(size, _BASE, U), np.full(size, pow(_BASE, -1, 2**64), U)
        up[0] = down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0], _powers[1]


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold: bool = True, gaps: np.ndarray = _SPACE, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """Hashes of the words of each text, in order, and the n + 1 offsets of the texts in them.

    `gaps` tells by byte what separates words.  For each length in `prefixes` one
    more array follows, of the hashes of the words' first bytes (0 where a word is
    not longer), which are no word's hashes.

    Words are runs of bytes other than space and 0x09-0x0D; `fold` lower-cases
    A-Z.  Equal words have equal hashes; the positional sum modulo 2^64 of random
    byte values, mixed with the length, makes a clash of two given words about
    as rare as 2^-60.
    """
    n = len(data)
    if not n:
        return np.empty(0, U), np.zeros(len(offsets), np.int64), *[np.empty(0, U) for _ in prefixes]
    black = ~gaps[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n + 1, bool)
    before[0], before[1:] = False, black
    here = np.append(black, False)
    starts = np.flatnonzero(here & (~before | edge))
    ends = np.flatnonzero(before & (~here | edge))
    out = np.empty(len(starts), U)
    heads = [np.zeros(len(starts), U) for _ in prefixes]
    at = 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + BLOCK, "right")))
        block = data[base : ends[to - 1]]
        up, down = _power_tables(len(block) + 1)
        total = np.zeros(len(block) + 1, U)
        np.cumsum(_BYTE[_FOLD[block] if fold else block] * up[: len(block)], out=total[1:])
        s, e = starts[at:to] - base, ends[at:to] - base
        out[at:to] = mix((total[e] - total[s]) * down[s] + (e - s).astype(U))
        for length, head in zip(prefixes, heads, strict=True):
            long = np.flatnonzero(e - s > length)
            head[at + long] = mix((total[s[long] + length] - total[s[long]]) * down[s[long]] + U(length + (1 << 40)))
        at = to
    return out, np.searchsorted(starts, offsets), *heads


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text, in order; a text of 1 to k - 1 words has one, the whole of it."""
    n, docs = len(words), len(offsets) - 1
    count = np.diff(offsets)
    if not n:
        return np.empty(0, U), np.zeros(docs + 1, np.int64)
    acc = np.zeros(n, U)
    for j in range(min(k, n)):
        acc[: n - j] += words[j:] * _BYTE[j]
    shingles = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    to = np.zeros(docs + 1, np.int64)
    np.cumsum(shingles, out=to[1:])
    at = np.arange(to[-1]) + np.repeat(offsets[:-1] - to[:-1], shingles)
    out = mix(acc[at] + U(k))
    for d in np.flatnonzero((count > 0) & (count < k)):  # one shingle of fewer words
        w = words[offsets[d] : offsets[d + 1]]
        out[to[d]] = mix((w * _BYTE[: len(w)]).sum(keepdims=True) + U(len(w) * _BASE % 2**64))[0]
    return out, to


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """`batch` in runs of rows whose `column` holds about `most` bytes; a longer text is alone."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), np.int64)
    end, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        before = end[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(end, before + most, "right")))
        yield batch.slice(at, to - at)
        at = to
