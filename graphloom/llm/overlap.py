"""T-occurrence search: which sets share at least T elements with a query, by DivideSkip over inverted lists.

The longest lists are set aside; the short ones are merged with a heap that skips ahead wherever too few lists can hold
a number, and what remains is looked up in the long lists by binary search.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left, insort

import numpy as np

#: Fixed value of the method: how many long lists pay off against the logarithm of the longest one.
MU = 0.0085
#: Components of so many sets get an index of their own; so many of their sets are tried before it is searched.
BIG, TRIES = 24, 8


def merge_skip(lists: list[list[int]], least: int) -> list[tuple[int, int]]:
    """(number, lists that hold it) for all numbers in at least `least` of the ascending lists."""
    at = [0] * len(lists)
    heap = [(x[0], i) for i, x in enumerate(lists) if x]
    heapq.heapify(heap)
    found = []
    while len(heap) >= least:
        number, same = heap[0][0], []
        while heap and heap[0][0] == number:
            same.append(heapq.heappop(heap)[1])
        if len(same) >= least:
            found.append((number, len(same)))
            target = number + 1
        else:  # `least` - 1 lists cannot make a result: the others' next number is the first that can be one
            while heap and len(same) < least - 1:
                same.append(heapq.heappop(heap)[1])
            if not heap:
                break
            target = heap[0][0]
        for i in same:
            own = lists[i]
            at[i] = bisect_left(own, target, at[i])
            if at[i] < len(own):
                heapq.heappush(heap, (own[at[i]], i))
    return found


def divide_skip(lists: list[list[int]], least: int) -> list[tuple[int, int]]:
    """As merge_skip, with the longest lists probed instead of merged."""
    lists = sorted((x for x in lists if x), key=len)
    if len(lists) < least or least < 1:
        return []
    longest = len(lists[-1])
    aside = min(int(least / (MU * math.log2(longest) + 1)), least - 1) if longest > 1 else 0
    short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
    found = []
    for number, times in merge_skip(short, least - aside):
        spare = times + len(long) - least  # lists that may lack the number
        for own in long:
            i = bisect_left(own, number)
            if i < len(own) and own[i] == number:
                times += 1
            elif spare == 0:
                break
            else:
                spare -= 1
        else:
            found.append((number, times))
    return found


def linked(a: int, b: int, both: int, num: int, den: int) -> bool:
    """Whether sets of a and b elements with so many in common have a Jaccard similarity of num / den or more."""
    return den * both >= num * (a + b - both)


class Joined:
    """Components of sets under Jaccard links, set by set; the sets come in ascending order of size and have numbers in that
    order.

    A component of many sets leaves the common index: a set that links to one of a few of its sets needs no search
    there, as one link joins it to all of them. Only where none of these links, the component's own index, made then of
    what it has gained, is searched.
    """

    def __init__(self, sets: list[np.ndarray], sizes: list[int], num: int, den: int):
        self.sets, self.sizes, self.num, self.den = sets, sizes, num, den
        self.root = list(range(len(sets)))
        self.small: dict[int, list[int]] = {}
        self.members: dict[int, list[int]] = {}
        self.own: dict[int, list] = {}  # of a large component its index, and how many of its members are in it
        for x in range(len(sets)):
            self._add(x)

    def find(self, x: int) -> int:
        while self.root[x] != x:
            self.root[x] = self.root[self.root[x]]
            x = self.root[x]
        return x

    def _links(self, x: int, y: int) -> bool:
        if self.den * self.sizes[y] < self.num * self.sizes[x]:
            return False
        both = len(np.intersect1d(self.sets[x], self.sets[y], assume_unique=True))
        return linked(self.sizes[x], self.sizes[y], both, self.num, self.den)

    def _search(self, x: int, index: dict[int, list[int]], elements: list[int]) -> list[int]:
        least = -(-self.num * self.sizes[x] // self.den)
        found = divide_skip([index[e] for e in elements if e in index], least)
        return [y for y, both in found if linked(self.sizes[x], self.sizes[y], both, self.num, self.den)]

    def _whole_index(self, r: int) -> dict[int, list[int]]:
        index, done = self.own[r]
        for m in self.members[r][done:]:
            for e in self.sets[m].tolist():
                insort(index.setdefault(e, []), m)
        self.own[r][1] = len(self.members[r])
        return index

    def _add(self, x: int) -> None:
        elements = self.sets[x].tolist()
        hits = self._search(x, self.small, elements)
        for r in self.own:
            m = self.members[r]
            hit = next((y for i in range(TRIES) if self._links(x, y := m[i * (len(m) - 1) // (TRIES - 1)])), None)
            hits += [hit] if hit is not None else self._search(x, self._whole_index(r), elements)[:1]
        roots = sorted({self.find(y) for y in hits}, key=lambda r: (r in self.own, len(self.members[r])))
        self.members[x] = [x]
        large = bool(roots) and (roots[-1] in self.own or 1 + sum(len(self.members[r]) for r in roots) >= BIG)
        if not large:
            for e in elements:
                self.small.setdefault(e, []).append(x)
        into = roots[-1] if roots else x
        for r in [*roots[:-1], *([x] if roots else [])]:
            self.root[r] = into
        if large:
            for r in roots:
                if r not in self.own:  # out of the common index
                    for m in self.members[r]:
                        for e in self.sets[m].tolist():
                            own = self.small[e]
                            del own[bisect_left(own, m)]
            self.own.setdefault(into, [{}, 0])
        for r in [*roots[:-1], *([x] if roots else [])]:
            self.members[into] += self.members.pop(r)
            self.own.pop(r, None)


def components(sets: list[np.ndarray], num: int, den: int) -> list[int]:
    """For each set (distinct elements) the number of a set of its component; sets that can link with none stay apart."""
    if len(sets) < 2:
        return list(range(len(sets)))
    sizes = [len(s) for s in sets]
    _, back, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[back] > 1
    ends = np.cumsum(sizes)
    kept = [back[e - n : e][shared[e - n : e]] for n, e in zip(sizes, ends.tolist(), strict=True)]
    able = sorted((i for i, s in enumerate(kept) if sizes[i] and den * len(s) >= num * sizes[i]), key=lambda i: (sizes[i], i))
    joined = Joined([kept[i] for i in able], [sizes[i] for i in able], num, den)
    out = list(range(len(sets)))
    for k, i in enumerate(able):
        out[i] = able[joined.find(k)]
    return out
