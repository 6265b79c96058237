"""Vectorised helpers over byte strings, shared by the operators that work on raw text bytes.

Hashes are 64-bit and wrap; they depend on content alone, never on where the bytes stand, so equal
substrings hash alike in any document and in any task.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_WORD = 1 << 64


def _give_back() -> None:
    """Let a Python worker, which Spark keeps for later tasks, return freed batches to the system at once.

    Arrow's own pool keeps them; the C library's keeps blocks below a threshold that it raises by itself.
    """
    pa.set_memory_pool(pa.system_memory_pool())
    with contextlib.suppress(OSError, AttributeError):
        # the threshold, M_MMAP_THRESHOLD, stays where it is set
        ctypes.CDLL("libc.so.6").mallopt(-3, 1 << 21)


_give_back()


def _mix_int(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) % _WORD
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) % _WORD
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) % _WORD
    return x ^ (x >> 31)


#: One pseudo-random 64-bit number for each byte value, from a rule.
BYTE_CODE = np.array([_mix_int(b + 1) for b in range(256)], dtype=np.uint64)
_BASE = _mix_int(1000) | 1


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit hashes so that their order and their low bits look random."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def window_hashes(data: np.ndarray, widths: tuple[int, ...]) -> dict[int, np.ndarray]:
    """For each width the hash of every window of so many bytes, by doubling.

    ``out[w][i]`` hashes ``data[i:i + w]``; an array is empty where the data is shorter than ``w``.
    """
    n = len(data)
    out: dict[int, np.ndarray | None] = {w: None for w in widths}
    done = dict.fromkeys(widths, 0)
    block, size = BYTE_CODE[data], 1
    while size <= max(widths):
        for w in widths:
            if w & size and n >= w:
                have = done[w]
                m = n - have - size + 1
                out[w] = block if out[w] is None else out[w][:m] * np.uint64(pow(_BASE, size, _WORD)) + block[have : have + m]
                done[w] += size
        if len(block) <= size:
            break
        block = block[:-size] * np.uint64(pow(_BASE, size, _WORD)) + block[size:]
        size *= 2
    return {w: mix(x) if x is not None and n >= w else np.empty(0, np.uint64) for w, x in out.items()}


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost smallest value of each ``width``-long window (by the top 30 bits)."""
    n = len(values)
    if n < width:
        return np.empty(0, np.int64)
    low_bits = np.uint64((1 << 34) - 1)
    packed = (values & ~low_bits) | np.arange(n, dtype=np.uint64)
    rows = -(-n // width)
    v = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    v[:n] = packed
    v = v.reshape(rows, width)
    ahead = np.minimum.accumulate(v, axis=1).ravel()
    behind = np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[: n - width + 1], ahead[width - 1 : n]) & low_bits).astype(np.int64)


def binary_of(column: pa.Array) -> pa.Array:
    """The UTF-8 bytes of a string column; null becomes empty."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    return column.fill_null(b"") if column.null_count else column


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a ``large_binary`` array without nulls as one ``uint8`` array, and the n + 1 offsets."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, most: int) -> Iterator[tuple[int, pa.Array]]:
    """Cut an array into runs of rows of about ``most`` bytes (one longer row stays whole): (first row, run)."""
    sizes = np.diff(joined(column)[1])
    first, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if total and total + size > most:
            yield first, column.slice(first, i - first)
            first, total = i, 0
        total += size
    if first < len(column):
        yield first, column.slice(first)
