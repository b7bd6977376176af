"""Suffix arrays of many texts at once, by linear grouping (no recursion, no renaming).

Phase 1 groups the suffixes of a text by their longest Lyndon prefix. Suffixes start grouped by
their first byte. Groups are taken in descending order. A group's suffixes leave the list of open
positions; the open position to the left of each is its previous smaller suffix. That one's Lyndon
prefix grows by the group's, once for each of the group's suffixes in a row that it precedes, so it moves to
a group of its own at the upper end of its old one, behind those that precede fewer.

Phase 2 emits the order inside each group, groups ascending. A suffix is its Lyndon prefix, repeated as
often as its row goes on, and then the next smaller suffix to the right, which lies in a lower group and has its place
already: the order is by repeats, then by that place.

All texts of a call take their steps together as numpy operations, one group of each text a
step. A text of n bytes takes at most n steps, and all steps together touch each suffix a constant
number of times besides sorting the members of a group.
"""

from __future__ import annotations

import numpy as np


def ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0] .. first[0] + size[0] - 1, then those of first[1], and so on."""
    total = np.cumsum(size)
    return np.repeat(first - (total - size), size) + np.arange(total[-1] if len(total) else 0)


class Suffixes:
    """Texts of one call: text t holds positions and places `start[t]` .. `stop[t]`, of which the last position is its end mark."""

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.stop = np.cumsum(sizes + 1)
        self.start = self.stop - sizes
        self.data = np.frombuffer(b"\0" + b"\0".join(texts) + b"\0", dtype=np.uint8)
        n = len(self.data)
        self.ends = np.zeros(n, dtype=bool)
        self.ends[0] = True
        self.ends[self.stop] = True
        text = np.cumsum(self.ends)
        text[self.stop] -= 1
        text[0] = 0
        letter = self.data.astype(np.int64) + 1
        letter[self.ends] = 0
        key = text * 257 + letter
        self.order = np.argsort(key, kind="stable")
        key = key[self.order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(first, n))
        self.place = np.empty(n, dtype=np.int64)
        self.place[self.order] = np.arange(n)
        self.group = np.empty(n, dtype=np.int64)
        self.group[self.order] = np.repeat(first, size)
        self.size = np.zeros(n, dtype=np.int64)
        self.size[first] = size
        self.repeats = np.zeros(n, dtype=np.int64)
        self.after = np.zeros(n, dtype=np.int64)
        self._group()
        self._emit()

    def _group(self) -> None:
        order, place, group, size = self.order, self.place, self.group, self.size
        n = len(order)
        left, right = np.arange(-1, n - 1), np.arange(1, n + 1)
        moves = np.zeros(n, dtype=bool)
        floor, last = self.start.copy(), self.stop.copy()
        alive = last > floor
        floor, last = floor[alive], last[alive]
        while len(last):
            begin = group[order[last]]
            count = last - begin + 1
            # the members of each text's highest open group, by position
            members = np.sort(order[ranges(begin, count)])
            own = np.repeat(begin, count)
            before, behind = left[members], right[members]
            head, tail = np.flatnonzero(group[before] != own), np.flatnonzero(group[behind] != own)
            smaller, then, row = before[head], behind[tail], tail - head + 1
            right[smaller] = then
            left[then] = smaller
            self.after[members] = np.repeat(then, row)
            self.repeats[members] = np.repeat(tail, row) - np.arange(len(members))
            grown = ~self.ends[smaller]
            if grown.any():
                smaller, row = smaller[grown], row[grown]
                old = group[smaller]
                by = np.lexsort((row, old))
                smaller, row, old = smaller[by], row[by], old[by]
                new_old = np.concatenate(([True], old[1:] != old[:-1]))
                first = np.flatnonzero(new_old)
                moved = np.diff(np.append(first, len(old)))
                holder = old[first]
                edge = holder + size[holder] - moved
                to = ranges(edge, moved)
                # what stays but stands in the way takes the places that come free
                moves[smaller] = True
                there = order[to]
                there = there[~moves[there]]
                free = place[smaller]
                free = free[free < np.repeat(edge, moved)]
                order[free] = there
                place[there] = free
                moves[smaller] = False
                order[to] = smaller
                place[smaller] = to
                size[holder] -= moved
                first = np.flatnonzero(new_old | np.concatenate(([True], row[1:] != row[:-1])))
                count = np.diff(np.append(first, len(old)))
                group[smaller] = np.repeat(to[first], count)
                size[to[first]] = count
            last = begin - 1
            alive = last > floor
            if not alive.all():
                floor, last = floor[alive], last[alive]

    def _emit(self) -> None:
        order, place, group, size = self.order, self.place, self.group, self.size
        slots = np.arange(len(order))
        several = np.flatnonzero((group[order] == slots) & (size > 1))
        if not len(several):
            return
        text = np.searchsorted(self.stop, several)
        step = np.arange(len(several)) - np.searchsorted(text, text)
        by = np.argsort(step, kind="stable")
        several, bounds = several[by], np.searchsorted(step[by], np.arange(step.max() + 2))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            at = ranges(several[a:b], size[several[a:b]])
            members = order[at]
            members = members[np.lexsort((place[self.after[members]], self.repeats[members], group[members]))]
            order[at] = members
            place[members] = at

    def array(self, t: int) -> np.ndarray:
        """Suffix array of text t, without the end mark."""
        return self.order[self.start[t] + 1:self.stop[t] + 1] - self.start[t]
