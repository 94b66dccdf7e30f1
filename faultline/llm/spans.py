"""Spans of bytes in whole blocks of texts: words by a byte table, hashes of spans, a hash table of verified spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Bytes of texts that are worked on together.
BLOCK = 1 << 20

_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit numbers, bits well spread."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_STEP))


def blocks(column: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """A binary column without nulls, some rows at a time: (first row, offsets of the rows from 0, their bytes).

    A row of more than ``size`` bytes comes alone.
    """
    width = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    if not len(column):
        return
    _, at, body = column.buffers()
    offsets = np.frombuffer(at, dtype=width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1)
        yield row, offsets[row : end + 1] - offsets[row], data[offsets[row] : offsets[end]]
        row = end


def words(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end, row) of the maximal runs of ``inside`` bytes; no run goes over the end of a row."""
    n = len(inside)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside))
    here = np.concatenate((inside, [False]))
    starts = np.flatnonzero(here & (~before | edge))
    ends = np.flatnonzero(before & (~here | edge))
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    powers = np.full(len(data) + 1, np.uint64(_STEP))
    powers[0] = 1
    sums = np.concatenate(([np.uint64(0)], np.cumsum(_BYTE[data] * np.cumprod(powers)[:-1])))
    powers = np.full(len(data) + 1, np.uint64(_BACK))
    powers[0] = 1
    back = np.cumprod(powers)
    size = (ends - starts).astype(np.uint64) * np.uint64(_STEP)
    return mixed((sums[ends] - sums[starts]) * back[starts] + size)


def equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes at ``a`` and those at ``b`` are the same, byte by byte."""
    same = np.ones(len(a), dtype=bool)
    long = np.flatnonzero(size > 64)
    for i in long.tolist():
        same[i] = np.array_equal(data[a[i] : a[i] + size[i]], data[b[i] : b[i] + size[i]])
    at = np.flatnonzero((size <= 64) & (size > 0))
    reach = np.arange(8)
    depth = 0
    while len(at):
        # Bytes behind the end of a span are read from its last byte, which both then compare again.
        inside = np.minimum(depth + reach[None, :], size[at][:, None] - 1)
        ok = (data[a[at][:, None] + inside] == data[b[at][:, None] + inside]).all(axis=1)
        same[at[~ok]] = False
        depth += 8
        at = at[ok & (size[at] > depth)]
    return same


def representatives(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For each span the number of the first one with the same bytes and ``group``.

    Spans are put into an open-addressed table in rounds. A span that meets an empty slot claims it; one that meets a
    span of the same group, size and hash, and then the same bytes, is represented by it; any other goes to the next slot.
    """
    n = len(starts)
    bits = max(4, int(2 * n).bit_length())
    key = mixed(hashes(data, starts, ends) ^ (group.astype(np.uint64) * np.uint64(_STEP)))
    slot = (key >> np.uint64(64 - bits)).astype(np.int64)
    size = ends - starts
    table = np.full(1 << bits, -1, dtype=np.int64)
    first = np.arange(n)
    todo = np.arange(n)
    while len(todo):
        at = slot[todo]
        free = table[at] < 0
        table[at[free][::-1]] = todo[free][::-1]  # of several claims the last written, the first span, stays
        holder = table[at]
        alike = (key[todo] == key[holder]) & (size[todo] == size[holder]) & (group[todo] == group[holder])
        check = np.flatnonzero(alike & (todo != holder))
        alike[check] = equal(data, starts[todo[check]], starts[holder[check]], size[todo[check]])
        first[todo[alike]] = holder[alike]
        todo = todo[~alike]
        slot[todo] = (slot[todo] + 1) & ((1 << bits) - 1)
    return first
