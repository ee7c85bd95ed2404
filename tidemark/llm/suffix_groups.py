"""Suffix arrays by linear grouping construction, in array arithmetic.

The Lyndon prefix of a suffix ends where the next smaller suffix begins. Suffixes with equal Lyndon prefixes form a group.
`lyndon_groups` finds the groups and their order: it goes through them in descending order, follows previous-smaller pointers
from each suffix to the suffix whose Lyndon prefix it continues, and moves those to new groups behind their old ones.
`suffix_order` then emits the order inside all groups: suffixes are placed in the order of the suffixes that follow their
Lyndon prefixes. Nothing is renamed and solved again.

Both take many steps at once: a portion of the highest groups is final as soon as none of its suffixes continues another one
of it, and a filled stretch of the suffix array is expanded as a whole. A text of n symbols takes about sqrt(n) portions.

Symbols below `least` end a string: they are not sorted, suffixes that are equal up to them may follow each other in any
order, and the first and the last symbol must be such ends.
"""

from __future__ import annotations

import numpy as np

_WAITING, _CHOSEN, _DONE, _MOVING = 0, 1, 2, 3
_PORTION = 1024


def turns(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it; the first row counts."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def lengths_of(starts: np.ndarray, end: int) -> np.ndarray:
    return np.diff(starts, append=end)


class _Groups:
    """Suffixes in slots: a group is a stretch of slots and named by its first one."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.at = np.argsort(symbols, kind="stable")
        begins = np.flatnonzero(turns(symbols[self.at]))
        self.size = np.zeros(n, np.int64)
        self.size[begins] = lengths_of(begins, n)
        self.group, self.slot = np.empty(n, np.int64), np.empty(n, np.int64)
        self.group[self.at] = np.repeat(begins, self.size[begins])
        self.slot[self.at] = np.arange(n)

    def split(self, moved: np.ndarray, old: np.ndarray, new: np.ndarray, mark: np.ndarray) -> None:
        """Move suffixes (sorted by their group `old`, then by rank; `new`: the first of a rank) to the end of their groups."""
        begins = np.flatnonzero(turns(old))
        counts = lengths_of(begins, len(old))
        groups = old[begins]
        behind = groups + self.size[groups] - counts  # the first slot of those that move
        target = np.repeat(behind - begins, counts) + np.arange(len(old))
        ranks = np.flatnonzero(new)
        self.size[groups] -= counts
        self.size[target[ranks]] = lengths_of(ranks, len(old))
        mark[moved] = _MOVING
        there = self.at[target]
        there = there[mark[there] != _MOVING]
        slots = self.slot[moved]
        free = slots[slots < np.repeat(behind, counts)]
        mark[moved] = _WAITING
        self.at[free], self.slot[there] = there, free
        self.at[target], self.slot[moved] = moved, target
        self.group[moved] = np.repeat(target[ranks], lengths_of(ranks, len(old)))


def _continued(parent: np.ndarray, child: np.ndarray, groups: _Groups, floor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes that others continue, sorted by their group and by the groups that continue them; their groups; the first of
    each rank. More of a group, and a group more, is a longer and so a larger Lyndon prefix."""
    begins = np.flatnonzero(turns(parent, child))
    counts, parent, child = lengths_of(begins, len(parent)), parent[begins], child[begins]
    first = np.flatnonzero(turns(parent))
    entries = lengths_of(first, len(parent))
    parent = parent[first]
    inside = groups.group[parent] >= floor
    parent, first, entries = parent[inside], first[inside], entries[inside]
    old = groups.group[parent]
    rank, order, new = old, np.arange(len(parent)), turns(old)
    for k in range(int(entries.max(initial=0))):
        has = entries > k
        next_child, next_count = np.full(len(parent), -1, np.int64), np.zeros(len(parent), np.int64)
        next_child[has], next_count[has] = child[first[has] + k], counts[first[has] + k]
        order = np.lexsort((next_count, next_child, rank))
        new = turns(rank[order], next_child[order], next_count[order])
        rank = np.empty(len(parent), np.int64)
        rank[order] = np.cumsum(new)
    return parent[order], old[order], new


def lyndon_groups(symbols: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Each suffix's group (the first slot of the suffix array that the group takes), the length of its Lyndon prefix, and the
    number of slots of ends of strings."""
    n = len(symbols)
    groups = _Groups(symbols)
    floor = int((symbols < least).sum())
    smaller, length, state = np.arange(-1, n - 1), np.ones(n, np.int64), np.zeros(n, np.int8)
    top, portion = n, _PORTION
    while top > floor:
        low = int(groups.group[groups.at[max(floor, top - portion)]])
        chosen = groups.at[low:top]
        group = groups.group[chosen]
        state[chosen] = _CHOSEN
        active, cut = np.arange(len(chosen)), -1
        while len(active):
            suffix = chosen[active]
            to = smaller[suffix]
            kind, above = state[to], groups.group[to] >= group[active]
            lower = (kind == _CHOSEN) & ~above
            if lower.any():  # continued inside the portion: its group is not final yet
                cut = max(cut, int(groups.group[to[lower]].max()))
            on = (kind == _DONE) | ((kind == _CHOSEN) & above)
            active = active[on]
            smaller[suffix[on]] = smaller[to[on]]
        if cut >= 0:
            begin = cut + int(groups.size[cut])
            back = chosen[: begin - low]
            state[back], smaller[back] = _WAITING, back - 1
            chosen, group, low = chosen[begin - low :], group[begin - low :], begin
            portion = max(256, 2 * (top - low))
        else:
            portion *= 2
        state[chosen], top = _DONE, low
        parent = smaller[chosen]
        order = np.lexsort((chosen, parent))
        chosen, parent, group = chosen[order], parent[order], group[order]
        begins = np.flatnonzero(turns(parent))
        length[parent[begins]] += np.add.reduceat(length[chosen], begins)
        moved, old, new = _continued(parent, group, groups, floor)
        if len(moved):
            groups.split(moved, old, new, state)
    return groups.group, length, floor


def suffix_order(group: np.ndarray, length: np.ndarray, floor: int) -> np.ndarray:
    """The suffix array from the groups: each filled stretch of it gives the places of the suffixes whose Lyndon prefixes end
    there, which take the next free slots of their groups."""
    n = len(group)
    ends = np.arange(n) + length
    sorted_in = np.flatnonzero(group >= floor)
    sorted_in = sorted_in[np.argsort(ends[sorted_in], kind="stable")]
    begins = np.searchsorted(ends[sorted_in], np.arange(n + 1))
    order, free = np.full(n, -1, np.int64), np.arange(n)
    order[:floor] = np.flatnonzero(group < floor)
    at, portion = 0, _PORTION
    while at < n:
        part = order[at : at + portion]
        empty = part < 0
        stop = int(empty.argmax()) if empty.any() else len(part)
        portion, at, part = max(_PORTION, 2 * stop), at + stop, part[:stop]
        first, count = begins[part], begins[part + 1] - begins[part]
        total = int(count.sum())
        if not total:
            continue
        found = sorted_in[np.repeat(first - np.cumsum(count) + count, count) + np.arange(total)]
        into = group[found]
        by_group = np.argsort(into, kind="stable")
        into = into[by_group]
        starts = np.flatnonzero(turns(into))
        counts = lengths_of(starts, total)
        groups = into[starts]
        order[np.repeat(free[groups] - starts, counts) + np.arange(total)] = found[by_group]
        free[groups] += counts
    return order


def suffix_array(symbols: np.ndarray, least: int = 1) -> np.ndarray:
    """Starts of all suffixes in ascending order, the ends of strings first."""
    return suffix_order(*lyndon_groups(symbols, least))
