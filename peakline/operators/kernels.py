"""Array work done inside tasks. Shipped to the workers by value, so they need no copy of the package."""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEPT, DROPPED, WAITING = 1, 2, 3


def resolve(pos, group, order, distance, low, high, known):
    """Greedy choice among candidates sorted by (group, pos); `order` lists them best first.

    Rows `known` to be kept come first in the order and only push out their neighbours.
    `low` and `high` are the edges of what is visible around each candidate. Closer than `distance`
    to an edge it may have rivals that are not visible: such candidates, and whatever depends on
    them, stay waiting. In every step all candidates that are best among what is left within the
    distance are settled at once, each for itself: they are further apart than the distance.
    """
    import numpy as np

    n = len(pos)
    state, rank = np.zeros(n, dtype=np.int8), np.empty(n, dtype=np.int64)
    rank[order] = np.arange(n)
    blocked = np.zeros(n, dtype=bool)
    near_edge = ~((pos - low >= distance) & (high - pos >= distance))
    # First and last row within the distance; groups are kept apart by their own search ranges.
    ends = np.flatnonzero(np.r_[group[1:] != group[:-1], True]) + 1 if n else np.zeros(0, dtype=np.int64)
    first, last = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    for a, b in zip(np.r_[0, ends[:-1]] if n else [], ends):
        here = pos[a:b]
        first[a:b] = a + _first_within(here, distance)
        last[a:b] = b - _first_within(-here[::-1], distance)[::-1]
    open_ = np.arange(n)
    while len(open_):
        left = np.full(n, n, dtype=np.int64)
        left[open_] = rank[open_]
        best = open_[_least(left, first[open_], last[open_]) == rank[open_]]
        waits = best[~known[best] & (blocked[best] | near_edge[best])]
        keeps = np.setdiff1d(best, waits, assume_unique=True)
        state[waits] = WAITING
        _mark(blocked, first[waits], last[waits])
        gone = np.zeros(n, dtype=bool)
        _mark(gone, first[keeps], last[keeps])
        state[gone] = DROPPED
        state[keeps] = KEPT
        open_ = open_[state[open_] == 0]
    return state


def _first_within(at, distance):
    """For every value of a sorted array, the first index whose value is less than `distance` below it."""
    import numpy as np

    guess = np.searchsorted(at, at - distance, side="right")
    # The rule is on the difference itself; rounding of at - distance may be off by one row.
    while True:
        more = (guess > 0) & (at - at[np.maximum(guess - 1, 0)] < distance)
        less = at - at[guess] >= distance
        if not (more.any() or less.any()):
            return guess
        guess = guess - more + less


def _least(values, first, last):
    """Minimum of values[first:last] for every pair, by doubling windows."""
    import numpy as np

    level = np.floor(np.log2(np.maximum(last - first, 1))).astype(np.int64)
    out = np.empty(len(first), dtype=values.dtype)
    table, width = values, 1
    for k in range(int(level.max(initial=0)) + 1):
        here = level == k
        out[here] = np.minimum(table[first[here]], table[last[here] - width])
        if len(table) > width:
            table = np.minimum(table[:-width], table[width:])
        width *= 2
    return out


def _mark(flags, first, last):
    """Sets flags[first:last] for every pair."""
    import numpy as np

    edge = np.zeros(len(flags) + 1, dtype=np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, last, -1)
    flags |= np.cumsum(edge[:-1]) > 0


def whole_groups(batches, keys):
    """Regroup sorted batches so that no group of equal `keys` is split between two of them."""
    held = []
    for pdf in batches:
        if len(pdf) == 0:
            continue
        starts = (pdf[keys] != pdf[keys].shift()).any(axis=1).to_numpy()
        starts[0] = not held or (held[-1][keys].iloc[-1] != pdf[keys].iloc[0]).any()
        where = starts.nonzero()[0]
        if len(where) == 0:
            held.append(pdf)
            continue
        head = pd.concat([*held, pdf.iloc[:where[0]]]) if held else pdf.iloc[:0]
        if len(head):
            yield head.reset_index(drop=True)
        if where[-1] > where[0]:
            yield pdf.iloc[where[0]:where[-1]].reset_index(drop=True)
        held = [pdf.iloc[where[-1]:]]
    if held:
        yield pd.concat(held).reset_index(drop=True)


def group_numbers(pdf: pd.DataFrame, keys):
    """0-based number of each row's run of equal `keys`."""
    return ((pdf[keys] != pdf[keys].shift()).any(axis=1).cumsum() - 1).to_numpy()


#: Bytes of frames that are stacked at once.
STACK_BYTES = 1 << 20


def _byte_sums(rows):
    """Sums of the rows of a table of bytes, eight bytes at a time: pairs of bytes add up in lanes of 16 bits, 128 pairs before a lane is full."""
    import numpy as np

    n, m = rows.shape
    block = min(128, -(-m // 8)) or 1
    whole = m // (8 * block) * (8 * block)
    low = np.uint64(0x00FF00FF00FF00FF)
    words = np.ascontiguousarray(rows[:, :whole]).view(np.uint64)
    odd = words >> np.uint64(8)
    odd &= low
    odd += words & low
    lanes = odd.reshape(n, -1, block).sum(axis=2, dtype=np.uint64)
    return np.ascontiguousarray(lanes).view(np.uint16).sum(axis=1, dtype=np.int64) + rows[:, whole:].sum(axis=1, dtype=np.int64)


def frame_diff_energy(cur: pd.Series, prev: pd.Series, width: pd.Series, height: pd.Series,
                      net: pd.DataFrame, slot: pd.DataFrame) -> pd.DataFrame:
    """Frame-difference energies of one Arrow batch of 8-bit grey frames held as bytes.

    Frames of one size with the same rectangles, as in a run of one camera, are stacked and differenced together.
    """
    import numpy as np

    out = np.zeros((len(cur), 3))
    numbers = np.column_stack([width, height, net[list("xywh")], slot[list("xywh")]])
    shapes, group = np.unique(numbers, axis=0, return_inverse=True)
    group = group.ravel()
    cur, prev = cur.to_numpy(), prev.to_numpy()
    for g, shape in enumerate(shapes):
        rows = np.flatnonzero(group == g)
        w, h, *rects = map(int, shape)
        step = max(1, STACK_BYTES // max(1, w * h))
        for at in range(0, len(rows), step):
            here = rows[at:at + step]
            a, b = (np.frombuffer(side[here[0]] if len(here) == 1 else b"".join(side[here]), dtype=np.uint8).reshape(-1, h, w) for side in (cur, prev))
            diff = np.maximum(a, b)
            diff -= np.minimum(a, b)
            for column, (x, y, rw, rh) in enumerate((rects[:4], rects[4:], (0, 0, w, h))):
                out[here, column] = _byte_sums(diff[:, y:y + rh, x:x + rw].reshape(len(here), -1))
    return pd.DataFrame(out, columns=["net", "slot", "full"])
