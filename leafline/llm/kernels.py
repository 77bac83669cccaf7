"""Vectorised word splitting and hashing over the bytes of many texts at once.

All functions work on one flat ``uint8`` buffer and document offsets, as Arrow
stores a binary column, so no Python object is made for a word.  Arithmetic is
modulo 2**64 and wraps on purpose.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
MOD = 1 << 64


def return_large_buffers(most_kept: int = 8 << 20) -> None:
    """Buffers above ``most_kept`` bytes go back to the system as soon as they are freed.

    By default the allocators learn to keep them, so that a worker which has once held a large
    chunk stays large for as long as it lives, and the workers of later stages come on top."""
    pa.set_memory_pool(pa.system_memory_pool())
    with contextlib.suppress(AttributeError, OSError):  # another C library
        for option in (-1, -3):  # M_TRIM_THRESHOLD, M_MMAP_THRESHOLD
            ctypes.CDLL(None).mallopt(option, most_kept)


return_large_buffers()
#: Odd multipliers; any odd constants would do, but they must not change between passes.
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xC2B2AE3D27D4EB4F
WORD_BASE_2 = 0xA0761D6478BD642F
BYTE_WINDOW_BASE = 0xD6E8FEB86659FD93
BLOCK_STEP = 0x8EBC6AF09C88C6E3
MIX_1, MIX_2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB

#: The word separators of the contracts: space and 0x09 to 0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Lower case, and every ASCII character that is no letter or digit becomes a space.
BARE = LOWER.copy()
BARE[[c for c in range(128) if not chr(c).isalnum()]] = 0x20

#: Bytes that are hashed at once; bounds the memory of the 8-byte work arrays.
BLOCK_BYTES = 1 << 19


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Flat bytes and ``int64`` offsets of a string or binary column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[off[0] : off[-1]], off - off[0]


def blocks(data: np.ndarray, off: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole documents of about ``most`` bytes: first, end, bytes, offsets from 0."""
    first, n = 0, len(off) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(off, off[first] + most, side="right")) - 1)
        yield first, end, data[off[first] : off[end]], off[first : end + 1] - off[first]
        first = end


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads the low bits of a product hash over the whole word."""
    h = h ^ (h >> U64(30))
    h *= U64(MIX_1)
    h ^= h >> U64(27)
    h *= U64(MIX_2)
    h ^= h >> U64(31)
    return h


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of ``base`` and of its inverse, modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        tables = []
        for b in (base, pow(base, -1, MOD)):
            t = np.full(size, b, dtype=U64)
            t[0] = 1
            tables.append(np.cumprod(t))
        if size > 4 * BLOCK_BYTES:  # one very long text: do not keep its tables
            return tables[0], tables[1]
        have = _POWERS[base] = (tables[0], tables[1])
    return have


def word_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the word offsets of the documents."""
    n = data.size
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = ~SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cut = off[:-1][off[:-1] < off[1:]]  # first bytes of the documents that have any
    begins[cut] = inside[cut]
    last = off[1:][off[:-1] < off[1:]] - 1
    ends[last] = inside[last]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes.

    A word is cut into blocks of eight bytes; each block is mixed with its place, and the
    sums of a word's blocks are mixed again with its length.  A polynomial modulo 2**64 would
    take different words of one structure for equal, whatever its base; here they would
    have to meet by chance."""
    if len(starts) == 0:
        return np.zeros(0, U64)
    size = ends - starts
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    short = size <= 8
    h = np.zeros(len(starts), dtype=U64)
    h[short] = mix(_block(eight, starts[short], size[short]) + U64(BLOCK_STEP))
    at, some = starts[~short], size[~short]
    if len(at):
        blocks = (some + 7) >> 3
        first = np.cumsum(blocks) - blocks
        nth = np.arange(int(blocks.sum()), dtype=np.int64) - np.repeat(first, blocks)
        left = np.repeat(some, blocks) - 8 * nth
        term = _block(eight, np.repeat(at, blocks) + 8 * nth, left) + (nth + 1).astype(U64) * U64(BLOCK_STEP)
        h[~short] = np.add.reduceat(mix(term), first)
    return mix(h + size.astype(U64) * U64(BYTE_BASE))


def _block(eight: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as a number, without those from ``left`` on."""
    x = eight[at].view("<u8").ravel()
    cut = np.maximum(0, 8 - left).astype(U64) * U64(8)
    return (x << cut) >> cut


def windows(x: np.ndarray, length: int, base: int) -> np.ndarray:
    """Rabin-Karp hash of every run of ``length`` values of ``x``, in log2(length) steps.

    The hash of a run is the sum of its values times falling powers of ``base``;
    the hash of two joined runs follows from both, so runs are doubled.
    """
    if len(x) < length:
        return np.zeros(0, U64)
    out, have, h, size, bits = None, 0, x, 1, length
    while True:
        if bits & 1:
            if out is None:
                out, have = h, size
            else:
                m = len(h) - have
                out = out[:m] * U64(pow(base, size, MOD))
                out += h[have : have + m]
                have += size
        bits >>= 1
        if not bits:
            return out
        nxt = h[: len(h) - size] * U64(pow(base, size, MOD))
        nxt += h[size:]
        h, size = nxt, 2 * size


def within(word_off: np.ndarray, total: int, length: int) -> np.ndarray:
    """Whether the run of ``length`` items from each start stays in one document."""
    n = max(0, total - length + 1)
    ok = np.ones(n + 1, dtype=np.int32)
    # starts in [end - length + 1, end) cross the document end
    lo = np.minimum(np.maximum(word_off[1:] - length + 1, word_off[:-1]), n)
    hi = np.minimum(word_off[1:], n)
    step = np.zeros(n + 2, dtype=np.int32)
    np.add.at(step, lo, 1)
    np.add.at(step, hi, -1)
    return (np.cumsum(step)[:n] == 0) & (ok[:n] == 1)


def covered(starts: np.ndarray, length: int, total: int) -> np.ndarray:
    """Whether each of ``total`` items lies in ``[s, s + length)`` of some start."""
    step = np.zeros(total + 1, dtype=np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + length, total), -1)
    return np.cumsum(step[:total]) > 0


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true values."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
