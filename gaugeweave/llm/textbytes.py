"""Texts as byte arrays: whole Arrow batches are split and hashed with numpy, without a Python string per word.

A block is a run of consecutive texts of about ``BLOCK`` bytes (one text at least), as one byte array and the offsets of
its texts.  Words are hashed by a polynomial over randomised byte values, then mixed; equal words have equal hashes, and
two different ones agree with a chance of about 2**-64.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers (the finaliser of splitmix64)."""
    x = x.astype(U, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> U(shift)
        x *= U(factor)
    x ^= x >> U(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random odd numbers."""
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed)) | U(1)


_BYTE = stream(11, 256)
_STEP = int(stream(12, 1)[0])
_powers: dict[str, np.ndarray] = {"up": np.ones(0, U), "down": np.ones(0, U)}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = np.ones(256, bool)
IN_WORD[[0x20, 9, 10, 11, 12, 13]] = False


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = max(n, BLOCK + 1)
        for name, step in (("up", _STEP), ("down", pow(_STEP, -1, 1 << 64))):
            steps = np.full(size, step, U)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def tidy(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A step for mapInArrow that gives unused memory back to the system at the end of every partition.

    Spark keeps its Python workers for later tasks, and what idle ones hold counts against their executor.
    """

    @functools.wraps(step)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from step(batches)
        finally:
            if len(_powers["up"]) > BLOCK + 1:  # grown for one long text
                _powers.update(up=np.ones(0, U), down=np.ones(0, U))
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only where the C library has it
            if trim:
                trim(0)

    return run


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of each block; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type)
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64 if large else np.int32, len(column) + 1, column.offset * (8 if large else 4)).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def runs(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the maximal runs of member bytes, which end with their text."""
    n = len(member)
    before = np.zeros(n, bool)
    before[1:] = member[:-1]
    heads = offsets[:-1]
    before[heads[heads < n]] = False
    after = np.zeros(n, bool)
    after[:-1] = member[1:]
    tails = offsets[1:] - 1
    after[tails[tails >= 0]] = False
    starts = np.flatnonzero(member & ~before)
    ends = np.flatnonzero(member & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, text numbers and hashes of the words, A-Z lower-cased."""
    starts, ends, text = runs(IN_WORD[data], offsets)
    return starts, ends, text, span_hashes(LOWER[data], starts, ends)
