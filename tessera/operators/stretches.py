"""Greedy matching on a line, in stretches of it: what rows outside of a stretch can't change is settled inside."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LIVE, OPEN, DONE = 0, 1, 2


class _Living:
    """The nearest class of a side that still takes part, to the right or to the left; classes only leave."""

    def __init__(self, member: list[bool]) -> None:
        n = len(member)
        self.n = n
        self._right = [k if k < n and member[k] else k + 1 for k in range(n)] + [n]
        self._left = [-1] + [k if member[k - 1] else k - 1 for k in range(1, n + 1)]
        self._left[0] = 0

    def leave(self, k: int) -> None:
        self._right[k], self._left[k + 1] = k + 1, k

    def right(self, k: int) -> int:
        """The first at k or after, ``n`` if there is none."""
        p = self._right
        while p[k] != k:
            p[k] = p[p[k]]
            k = p[k]
        return k

    def left(self, k: int) -> int:
        """The last at k or before, -1 if there is none."""
        p, k = self._left, k + 1
        while p[k] != k:
            p[k] = p[p[k]]
            k = p[k]
        return k - 1


def settled(x: list[float], side: list[int], first: list[int], size: list[int], more: list[bool], h: np.ndarray, low: float | None, high: float | None) -> Iterator[tuple[int, int, int, float]]:
    """(row of side 0, row of side 1, number of rows, distance) of all pairs that are certain.

    A class is what stands at one value, of one side; classes come by value and their rows by hash, which is the order in
    which they are used. ``more``: a class has further rows that aren't here. ``low`` and ``high``: unknown rows of both
    sides may stand there or farther out. Distances are gone through from the least. At a distance the rows of side 0
    choose by hash, each the least hash that it can reach. Once it can't be known which rows of a class are left, the class
    is open: nothing more is taken from it, and what could pair with it at a distance becomes open there."""
    walls = [(v, s) for v in ([] if low is None else [low]) for s in (0, 1)]
    at = len(walls)
    ends = [(v, s) for v in ([] if high is None else [high]) for s in (0, 1)]
    x = [v for v, _ in walls] + x + [v for v, _ in ends]
    side = [s for _, s in walls] + side + [s for _, s in ends]
    pos = [0] * at + first + [0] * len(ends)
    end = [0] * at + [f + n for f, n in zip(first, size, strict=True)] + [0] * len(ends)
    more = [False] * at + more + [False] * len(ends)
    n = len(x)
    state = [OPEN] * at + [LIVE] * (n - at - len(ends)) + [OPEN] * len(ends)
    living = [_Living([state[k] == LIVE and side[k] == s for k in range(n)]) for s in (0, 1)]
    heap: list[tuple[float, int, int]] = []

    def apart(i: int, j: int) -> float:
        return 0.0 if x[i] == x[j] else abs(x[i] - x[j])

    def look_right(i: int, start: int) -> None:
        j = living[1 - side[i]].right(start)
        if j < n:
            heapq.heappush(heap, (apart(i, j), i, j))

    def look_left(i: int, start: int) -> None:
        j = living[1 - side[i]].left(start)
        if j >= 0:
            heapq.heappush(heap, (apart(i, j), i, j))

    def known(c: int) -> int:
        """Rows that can be taken: the last one that is here of a class with more rows stays, so that its hash is known."""
        return end[c] - pos[c] - more[c]

    for i in range(n - len(ends)):
        look_right(i, i + 1)
    for i in range(n - len(ends), n):
        look_left(i, i - 1)
    while heap:
        d = heap[0][0]
        pairs: list[tuple[int, int]] = []
        doubtful: set[int] = set()
        again = []
        while heap and heap[0][0] == d:
            _, i, j = heapq.heappop(heap)
            if state[i] == DONE:
                continue
            if state[j] == LIVE and state[i] == LIVE:
                again.append(i)
                other = living[1 - side[i]]
                while j < n and state[j] == LIVE and apart(i, j) == d:  # several only where distances are rounded
                    pairs.append((i, j) if side[i] == 0 else (j, i))
                    j = other.right(j + 1)
                continue
            if state[j] == LIVE:
                doubtful.add(j)
            if j > i:
                look_right(i, j + 1)
            else:
                look_left(i, j - 1)
        reach: dict[int, list[int]] = {}
        back: dict[int, int] = {}
        for a, b in pairs:
            reach.setdefault(a, []).append(b)
            back[b] = back.get(b, 0) + 1
        choosers = []
        for a, bs in reach.items():
            b = bs[0]
            doubtful.update(c for c in (a, *bs) if known(c) <= 0)
            if len(bs) > 1 or back[b] > 1:
                choosers.append((h[pos[a]], a))
            elif a in doubtful or b in doubtful:
                doubtful.update((a, b))
            else:
                took = min(known(a), known(b))
                yield pos[a], pos[b], took, d
                pos[a] += took
                pos[b] += took
                if (more[a] and not known(a)) or (more[b] and not known(b)):
                    doubtful.update(c for c in (a, b) if pos[c] < end[c])
        heapq.heapify(choosers)
        while choosers:
            _, a = heapq.heappop(choosers)
            left = [b for b in reach[a] if pos[b] < end[b]]
            if not left:
                continue
            b = min(left, key=lambda c: h[pos[c]])
            if a in doubtful or b in doubtful:
                doubtful.update((a, *left))
                continue
            yield pos[a], pos[b], 1, d
            pos[a] += 1
            pos[b] += 1
            doubtful.update(c for c in (a, b) if more[c] and not known(c))
            if pos[a] < end[a]:
                heapq.heappush(choosers, (h[pos[a]], a))
        for c in {c for p in pairs for c in p} | doubtful:
            if pos[c] == end[c] or c in doubtful:
                state[c] = DONE if pos[c] == end[c] else OPEN
                living[side[c]].leave(c)
        for c in doubtful:
            if state[c] == OPEN:
                look_left(c, c - 1)
        for i in again:
            if state[i] != DONE:
                look_right(i, i + 1)


def match_stretches(batches: Iterable[pa.RecordBatch], group: str, rows: int, whole: bool) -> Iterator[pa.RecordBatch]:
    """Sets ``_r`` and ``_s`` of left rows whose partner is certain, and leaves the partner's own row out.

    Rows (group, _x, _h, _l, _r, _s) come in the order of group, value and hash. Stretches of some ``2 * rows`` rows are
    settled, each ending with a value; rows of a value beyond ``rows`` are handed on as they are, so no more is held.
    ``whole``: there are no other partitions, else the first and last group may go on in those."""
    held: list[pa.RecordBatch] = []
    before: tuple | None = None  # group and value before what is held
    cut = False  # rows of the first value held have been handed on
    began = whole

    def work(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, before, cut, began
        t = pa.Table.from_batches(held).combine_chunks()
        held = []
        g, x = t.column(group).combine_chunks(), t.column("_x").to_numpy()
        new_group = np.concatenate([[True], pc.not_equal(g[1:], g[:-1]).to_numpy(zero_copy_only=False)])
        new = new_group | np.concatenate([[True], x[1:] != x[:-1]])
        start = np.flatnonzero(new)
        inside = np.arange(len(x)) - start[np.cumsum(new) - 1]
        size = np.diff(np.append(start, len(x)))
        more = size > rows
        more[0] |= cut
        if (inside >= rows).any():
            yield from t.filter(pa.array(inside >= rows)).to_batches()
            t = t.filter(pa.array(inside < rows))
            new_group, x = new_group[inside < rows], x[inside < rows]
            size = np.minimum(size, rows)
            start = np.append(0, np.cumsum(size)[:-1])
        classes = len(start) if last else len(start) - 1  # the last value may go on
        stop = len(x) if last else int(start[-1])
        here = t.slice(0, stop)
        partner, distance = np.full(stop, -1), np.zeros(stop)
        h, side = t.column("_h").to_numpy(), pc.is_null(t.column("_l")).to_numpy().astype(int)
        g = t.column(group).combine_chunks()
        bounds = [int(k) for k in np.flatnonzero(new_group[start])] + [len(start)]
        for a, b in zip(bounds, bounds[1:], strict=False):
            b_here = min(b, classes)
            if a >= b_here:
                break
            low = high = None
            if a == 0 and before is not None and before[0] == g[0]:
                low = before[1]
            elif a == 0 and not began:
                low = float(x[0])
            if b_here < b:
                high = float(x[start[b_here]])
            elif last and b == len(start) and not whole:
                high = float(x[-1])
            first = start[a:b_here]
            for p, q, n, d in settled(x[first].tolist(), side[first].tolist(), first.tolist(), size[a:b_here].tolist(), more[a:b_here].tolist(), h, low, high):
                partner[p : p + n] = np.arange(q, q + n)
                partner[q : q + n] = -2
                distance[p : p + n] = d
        if stop:
            got = pa.array(partner >= 0)
            mates = here.column("_r").take(pa.array(np.maximum(partner, 0)))
            here = here.set_column(here.schema.get_field_index("_r"), "_r", pc.if_else(got, mates, here.column("_r")))
            here = here.set_column(here.schema.get_field_index("_s"), "_s", pc.if_else(got, pa.array(-distance), here.column("_s")))
            yield from here.filter(pa.array(partner != -2)).to_batches()
            before = (g[stop - 1], float(x[stop - 1]))
        began = began or bool(stop)
        if not last:
            held = t.slice(stop).to_batches()
            cut = bool(more[-1])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= 2 * rows:
            yield from work(False)
    if held:
        yield from work(True)
