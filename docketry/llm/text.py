"""Vectorised word hashing over Arrow string columns.

All words of a chunk of documents are found and hashed with a handful of numpy passes
over the UTF-8 bytes, so that no Python object is made per word.  A word's hash chains a
mixing function over its blocks of eight bytes, each loaded for all words at once; words
of more than ``LONG`` bytes are hashed one by one with BLAKE2b.  Hashes have 64 bits and
no algebraic structure, so two given words collide with a chance of 2**-64.
"""

from __future__ import annotations

import ctypes
import functools
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SEED = 0x9E3779B97F4A7C15
#: Masks that keep the first k bytes of a little-endian block.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
LONG = 256

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words of characters other than space, tab, line feed, vertical tab, form feed, return.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False

#: Words of ASCII letters, digits and everything beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = True
ALNUM[128:] = True

CHUNK_BYTES = (1 << 19) - 64

#: Bytes of an Arrow batch on its way to Python; with long texts the usual 64 MB, held on
#: both sides of several workers, is most of a small executor's memory.
BATCH_BYTES = 8 << 20


def small_batches(spark) -> None:
    """Lower the session's limit on Arrow batches to BATCH_BYTES where it is higher."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).removesuffix("b")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def frugal(run: Callable) -> Callable:
    """Give memory back to the system when a partition is done.

    Workers live on between tasks and between operators, several to an executor; what their
    allocators keep would otherwise add up over the stages of a long job.
    """

    @functools.wraps(run)
    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return held


def give_back() -> None:
    """Return what the allocators hold but don't use to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another libc: nothing to trim
        pass


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 arrays."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """Words of a chunk: hash, byte span in ``data``; those of document i are first[i]:first[i+1]."""

    data: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray


def string_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    _, offsets, data = col.buffers()
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    o = np.frombuffer(offsets, dtype=kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    b = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return b[o[0] : o[-1]], o - o[0]


def chunks(col: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole documents of about ``limit`` bytes: (first row, end row, bytes, offsets)."""
    b, o = string_bytes(col)
    n, i = len(o) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(o, o[i] + limit, side="right")) - 1)
        yield i, j, b[o[i] : o[j]], o[i : j + 1] - o[i]
        i = j


def words(b: np.ndarray, o: np.ndarray, is_word: np.ndarray, lower: np.ndarray = LOWER) -> Words:
    """Find and hash all words of a chunk given its bytes and its documents' offsets."""
    low, n = lower[b], len(b)
    inside = np.zeros(n + 1, dtype=bool)
    inside[:n] = is_word[b]
    before = np.zeros(n + 1, dtype=bool)
    before[1:] = inside[:n]
    before[o] = False  # a word never crosses into the next document
    after = np.zeros(n + 1, dtype=bool)
    after[:n] = inside[1:]
    cut = o[o > 0] - 1
    after[cut] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(low, _hashes(low, starts, ends), starts, ends, np.searchsorted(starts, o))


def _hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hashes of the byte spans."""
    n, size = len(low), ends - starts
    padded = np.zeros(n + 8, dtype=np.uint8)
    padded[:n] = low
    block = np.ndarray((n + 1,), "<u8", padded, 0, (1,))  # the eight bytes from each byte on
    h = mix(size.astype(np.uint64) * _M2 + np.uint64(_SEED))
    at, k = np.flatnonzero(size <= LONG), 0
    while len(at):
        rest = size[at] - 8 * k
        h[at] = mix(h[at] * _M1 + (block[starts[at] + 8 * k] & _FIRST[np.minimum(rest, 8)]))
        at, k = at[rest > 8], k + 1
    for x in np.flatnonzero(size > LONG):
        h[x] = int.from_bytes(hashlib.blake2b(low[starts[x] : ends[x]].tobytes(), digest_size=8).digest(), "little")
    return h


def word_hashes(text: str, is_word: np.ndarray) -> np.ndarray:
    """The hashes of one text's words."""
    b = np.frombuffer(text.encode(), dtype=np.uint8)
    return words(b, np.array([0, len(b)]), is_word).hashes
