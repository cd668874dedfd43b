"""Shuffles of Python's seeded generator for many seeds at once.

The generator is the published Mersenne twister MT19937 with its seeding by an array of 32-bit words; a state is a column
of a numpy matrix, so each of its 1,247 seeding steps works on all seeds of a block together. Of the outputs only the
first few are made.
"""

from __future__ import annotations

import numpy as np

# fixed values of MT19937
SIZE, MIDDLE, MATRIX = 624, 397, 0x9908B0DF
UPPER, LOWER = 0x80000000, 0x7FFFFFFF

#: Seeds that are worked on together.
BLOCK = 8192
#: Outputs made of each seed; a shuffle that needs more is left to the caller.
OUTPUTS = 64


def _mixed(before: np.ndarray, factor: int) -> np.ndarray:
    return (before ^ (before >> np.uint32(30))) * np.uint32(factor)


def seeded(words: np.ndarray) -> np.ndarray:
    """States (624, n) of the generators seeded by the columns of ``words`` (k, n), least significant word first."""
    start = np.empty(SIZE, dtype=np.uint64)
    start[0] = 19650218
    for i in range(1, SIZE):
        start[i] = (1812433253 * (int(start[i - 1]) ^ (int(start[i - 1]) >> 30)) + i) & 0xFFFFFFFF
    k, n = words.shape
    state = np.repeat(start.astype(np.uint32)[:, None], n, axis=1)
    offset = words + np.arange(k, dtype=np.uint32)[:, None]
    at = 0
    for step in range(max(SIZE, k)):
        at = at % (SIZE - 1) + 1
        state[at] = (state[at] ^ _mixed(state[at - 1], 1664525)) + offset[step % k]
        if at == SIZE - 1:
            state[0] = state[at]
    for _ in range(SIZE - 1):
        at = at % (SIZE - 1) + 1
        state[at] = (state[at] ^ _mixed(state[at - 1], 1566083941)) - np.uint32(at)
        if at == SIZE - 1:
            state[0] = state[at]
    state[0] = UPPER
    return state


def outputs(state: np.ndarray, count: int = OUTPUTS) -> np.ndarray:
    """The first ``count`` 32-bit outputs (count, n); at most 227, which need no state that is made on the way."""
    y = (state[:count] & np.uint32(UPPER)) | (state[1 : count + 1] & np.uint32(LOWER))
    y = state[MIDDLE : MIDDLE + count] ^ (y >> np.uint32(1)) ^ ((y & np.uint32(1)) * np.uint32(MATRIX))
    y ^= y >> np.uint32(11)
    y ^= (y << np.uint32(7)) & np.uint32(0x9D2C5680)
    y ^= (y << np.uint32(15)) & np.uint32(0xEFC60000)
    return y ^ (y >> np.uint32(18))


def _drawn(made: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """``sample(range(size), size)`` of every column of outputs; and whether the outputs did for it."""
    n = made.shape[1]
    every = np.arange(n)
    pool = np.repeat(np.arange(size)[:, None], n, axis=1)
    out, cursor, enough = np.empty((n, size), dtype=np.int32), np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
    for i in range(size):
        left = size - i
        value = made >> np.uint32(32 - left.bit_length())
        usable = (value < left) & (np.arange(len(made))[:, None] >= cursor)
        first = usable.argmax(axis=0)
        enough &= usable[first, every]
        pick = np.where(enough, value[first, every], 0)
        out[:, i] = pool[pick, every]
        pool[pick, every] = pool[left - 1]
        cursor = first + 1
    return out, enough


def shuffles(seeds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each seed (unsigned 64 bits) what ``random.Random(seed).sample(range(size), size)`` gives, for sizes up to 16;
    and whether it could be told from OUTPUTS outputs (which all but never fails)."""
    out, enough = np.empty((len(seeds), size), dtype=np.int32), np.empty(len(seeds), dtype=bool)
    low, high = (seeds & np.uint64(0xFFFFFFFF)).astype(np.uint32), (seeds >> np.uint64(32)).astype(np.uint32)
    for wide in (True, False):  # a seed below 2**32 is one word
        rows = np.flatnonzero((high > 0) == wide)
        for k in range(0, len(rows), BLOCK):
            at = rows[k : k + BLOCK]
            words = np.stack([low[at], high[at]] if wide else [low[at]])
            out[at], enough[at] = _drawn(outputs(seeded(words)), size)
    return out, enough
