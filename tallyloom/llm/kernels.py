"""Vectorised text kernels on Arrow buffers: words, shingles, hashes and per-document sums without a loop per word.

A chunk is a run of whole documents of about ``CHUNK`` bytes (one document, if it is longer), so memory stays
bounded by the longest document and never by the size of an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .scratch import worker_cache

CHUNK = 1 << 18
_rng = np.random.Generator(np.random.PCG64(20240229))
#: A random odd-free 64-bit value for each byte, and an odd base with its inverse modulo 2**64.
BYTE_KEY = _rng.integers(1, 2**63, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15 | 1, -1, 2**64))
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: np.uint64) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def kept_powers(n: int, base: np.uint64) -> np.ndarray:
    """At least n powers; those of a usual chunk stay in the worker (not in a global, which would travel with tasks)."""
    if n > CHUNK + 1:
        return powers(n, base)
    cache = worker_cache()
    if ("powers", int(base)) not in cache:
        cache["powers", int(base)] = powers(CHUNK + 1, base)
    return cache["powers", int(base)]


class Chunk:
    """UTF-8 bytes of consecutive documents; ``rows`` gives their places in the Arrow batch."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first, self.n = data, offsets, first, len(offsets) - 1

    @property
    def rows(self) -> range:
        return range(self.first, self.first + self.n)

    @cached_property
    def letters(self) -> np.ndarray:
        """The bytes that are not white space."""
        return self.data[~SPACES[self.data]]

    def prefix_hash(self) -> np.ndarray:
        n = len(self.data)
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_KEY[self.data] * kept_powers(n, BASE)[:n], out=out[1:])
        return out

    def span_hash(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of each byte span that depends on its bytes only."""
        return mix((prefix[ends] - prefix[starts]) * kept_powers(len(prefix), BASE_INVERSE)[starts] + (ends - starts).astype(np.uint64))

    def per_doc(self, values: np.ndarray) -> np.ndarray:
        """Sums over each document's bytes."""
        total = np.zeros(len(values) + 1, np.int64)
        np.cumsum(values, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def spans(self, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs of bytes that aren't separators, and bounds of each document's runs."""
        inside = ~separators[self.data]
        n = len(inside)
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        starts = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)


def trim() -> None:
    """Give freed memory back to the system: between batches a worker would otherwise keep its peak."""
    cache = worker_cache()
    if "trim" not in cache:
        import ctypes

        cache["trim"] = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if cache["trim"]:
        cache["trim"](0)
    pa.default_memory_pool().release_unused()


def chunks(column: pa.Array | pa.ChunkedArray, lower: bool = False, size: int = CHUNK) -> Iterator[Chunk]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    _, where, bytes_ = column.buffers()
    offsets = np.frombuffer(where, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(bytes_, np.uint8) if bytes_ is not None and bytes_.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        j = min(j, n)
        part = data[offsets[i] : offsets[j]]
        yield Chunk(LOWER[part] if lower else part, (offsets[i : j + 1] - offsets[i]).astype(np.int64), i)
        i = j
    trim()


def rolled_shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k words that start at each word but the last k - 1 (those are of no use)."""
    multiplier = np.uint64(0xD6E8FEB86659FD93)
    rolled = hashes.copy()
    for i in range(1, k):
        whole = max(0, len(rolled) - i)  # a chunk may hold fewer words than a shingle
        rolled[:whole] = rolled[:whole] * multiplier + hashes[i:]
    return mix(rolled)


def shingle_sets(hashes: np.ndarray, bounds: np.ndarray, k: int = 5, weights: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray | None]]:
    """Each document's sorted distinct k-word shingles; with fewer words, the whole sequence as one; none without words.

    With ``weights`` of the words, also the sum of the weights of each shingle's words (the same for equal shingles).
    """
    rolled = rolled_shingles(hashes, k)
    summed = None
    if weights is not None:
        total = np.append(0, np.cumsum(weights))
        summed = total[k:] - total[:-k] if len(total) > k else np.zeros(0, total.dtype)
    multiplier = 0xD6E8FEB86659FD93
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= k:
            x = rolled[a : b - k + 1]
            if summed is None:
                x = np.sort(x)
                out.append((x[np.concatenate(([True], x[1:] != x[:-1]))], None))
            else:
                order = np.argsort(x)
                x = x[order]
                first = np.concatenate(([True], x[1:] != x[:-1]))
                out.append((x[first], summed[a : b - k + 1][order[first]]))
        elif b > a:
            h = b - a
            for w in hashes[a:b].tolist():
                h = (h * multiplier + w) % 2**64
            out.append((mix(np.array([h], np.uint64)), None if summed is None else np.zeros(1, summed.dtype)))
        else:
            out.append((np.zeros(0, np.uint64), None if summed is None else np.zeros(0, summed.dtype)))
    return out


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
