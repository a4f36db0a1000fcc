"""NumPy kernels over the UTF-8 bytes of many texts at once.

Texts are handled as one byte array with offsets. Words are runs of bytes other than ASCII white
space, so that they equal the matches of ``[^\\x20\\x09-\\x0D]+``. A word's 64-bit hash is a
polynomial over its bytes modulo 2**64, taken from running sums, and mixed afterwards.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_STEP = U(0xD6E8FEB86659FD93)
CHUNK_BYTES = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the MurmurHash3 finaliser)."""
    x = x ^ (x >> U(33))
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


_VALUE = mixed(np.arange(1, 257, dtype=U) * U(_BASE))
VALUE_LOWER = _VALUE[LOWER]
VALUE_EXACT = _VALUE
_powers = {}


def _power_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, 1), U(base))
        out[0] = 1
        np.multiply.accumulate(out, out=out)
        if n <= 2 * CHUNK_BYTES:
            _powers[base] = out
        return out
    return have[:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string column; null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``limit`` bytes of text, or one row where that is longer."""
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets = utf8(batch.column(batch.schema.get_field_index(text)))[1]
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def freed() -> None:
    """Hands unused memory back to the system, which allocators else keep in workers that stay for later tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError):  # another C library than GNU's
        ctypes.CDLL(None).malloc_trim(0)


def tidy(rows):
    """A function of batches that leaves no memory behind when a partition ends."""

    @functools.wraps(rows)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from rows(batches)
        finally:
            freed()

    return run


class Words:
    """Where the words of a chunk of texts are: ``starts``, ``ends``, ``off`` (words before each text), ``doc``."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.raw, self.offsets = raw, offsets
        blank = SPACE[raw]
        before = np.empty_like(blank)
        after = np.empty_like(blank)
        if len(raw):
            before[0], before[1:] = True, blank[:-1]
            after[-1], after[:-1] = True, blank[1:]
            full = offsets[1:] > offsets[:-1]
            before[offsets[:-1][full]] = True
            after[offsets[1:][full] - 1] = True
        self.starts = np.flatnonzero(~blank & before)
        self.ends = np.flatnonzero(~blank & after) + 1
        self.off = np.searchsorted(self.starts, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.off))

    def hashes(self, values: np.ndarray = VALUE_LOWER) -> np.ndarray:
        return span_hashes(self.raw, self.starts, self.ends, values)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = VALUE_EXACT) -> np.ndarray:
    """64-bit hashes of byte spans, the length included."""
    n = len(raw)
    sums = np.zeros(n + 1, U)
    np.cumsum(values[raw] * _power_table(_BASE, n), out=sums[1:])
    shift = _power_table(_BASE_INV, n + 1)[starts]
    return mixed((sums[ends] - sums[starts]) * shift + (ends - starts).astype(U) * _STEP)


def windows(hashes: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words within a text, and the index of each run's first word."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    total = np.zeros(n, U)
    for j in range(k):
        total += hashes[j : n + j] * U(pow(_BASE, 2 * j + 1, 1 << 64))
    return mixed(total[at] + U(k * int(_STEP) & (1 << 64) - 1)), at


def shingle_sets(words: Words, k: int = 5) -> tuple[list[np.ndarray], np.ndarray]:
    """Each text's distinct k-word shingles as sorted 64-bit hashes; fewer words make one shingle, none an empty set."""
    h = words.hashes()
    runs, at = windows(h, words.doc, k)
    cut = np.searchsorted(at, words.off)
    out = []
    n_words = np.diff(words.off)
    for d in range(len(n_words)):
        if n_words[d] >= k:
            x = np.sort(runs[cut[d] : cut[d + 1]])
            out.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
        elif n_words[d]:
            w = h[words.off[d] : words.off[d + 1]]
            total = U(0)
            with np.errstate(over="ignore"):
                for j, x in enumerate(w):
                    total = total + x * U(pow(_BASE, 2 * j + 1, 1 << 64))
                out.append(mixed(np.array([total + U(len(w)) * _STEP])))
        else:
            out.append(np.zeros(0, U))
    return out, n_words
