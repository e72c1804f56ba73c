"""Hashes of byte strings, words and windows with NumPy, and rows of sorted Arrow batches group by group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_ODD = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_ODD, -1, 2**64)
#: A random 64-bit value for every byte, drawn from a fixed seed.
BYTE_VALUES = np.random.default_rng(20240229).integers(0, 2**64, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the whole 64-bit value."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd number and of its inverse modulo 2 ** 64, as far as needed so far."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def reach(cls, n: int) -> None:
        if len(cls.up) < n:
            size = max(n, 2 * len(cls.up), 1 << 16)
            grown = lambda base: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, base, np.uint64))])
            cls.up, cls.down = grown(np.uint64(_ODD)), grown(np.uint64(_INVERSE))


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    """Sums from which `window_hashes` gets the hash of any window of `values`."""
    _Powers.reach(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _Powers.up[:len(values)], out=out[1:])
    return out


def window_hashes(prefix: np.ndarray, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
    """Hashes of windows; equal for equal windows wherever they begin."""
    at = _Powers.down[:len(prefix)][start]
    return mixed((prefix[end] - prefix[start]) * at)


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a text given as bytes."""
    edge = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[raw], [True]]).astype(np.int8)))
    return edge[0::2], edge[1::2]


def shingles(text: str, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of all windows of `width` words; of all words together if there are fewer; none for a text without words."""
    raw = np.frombuffer(text.encode(), np.uint8)
    start, end = word_bounds(raw)
    if not len(start):
        return np.zeros(0, np.uint64)
    words = window_hashes(prefix_hashes(BYTE_VALUES[raw]), start, end)
    n = len(words)
    prefix = prefix_hashes(words)
    if n < width:
        return window_hashes(prefix, np.array([0]), np.array([n]))
    return np.unique(window_hashes(prefix, slice(0, n - width + 1), slice(width, n + 1)))


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of batches that arrive sorted by `keys`, one table each. Keys are integers without nulls."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not len(batch):
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(len(batch) - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(batch)]
        if held and last != tuple(c[0] for c in columns):
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            held.append(batch.slice(a, b - a))
            if b < len(batch):
                yield pa.Table.from_batches(held)
                held = []
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)
