"""Suffix arrays in linear time by grouping suffixes on their Lyndon prefixes."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence


def suffix_array(symbols: Sequence[int]) -> list[int]:
    """Start of each suffix in ascending order; a suffix stands before those that continue it.

    At first suffixes that begin with the same symbol are a group.  Groups are
    taken in descending order.  Each member of the group points to the nearest
    suffix before it that is in a lower group; a suffix that k members point
    to is a Lyndon prefix followed by k times the group's, so those of equal k
    leave their group together for a new one right above it.  In the end a
    group holds the suffixes of one Lyndon prefix, and the groups are in
    order.  A suffix's rank in its group is that of what follows its Lyndon
    prefix, which is smaller; so going through the array from its start, each
    suffix puts those that it follows at their groups' next places.
    """
    n = len(symbols)
    if not n:
        return []
    end = n  # the empty suffix, lower than all
    members: list[list[int]] = []
    length: list[int] = []
    below: list[int] = []
    above: list[int] = []
    group = [0] * (n + 1)
    first: dict[int, list[int]] = defaultdict(list)
    for i, s in enumerate(symbols):
        first[s].append(i)
    for g, starts in enumerate([[end], *(first[s] for s in sorted(first))]):
        members.append(starts)
        length.append(1)
        below.append(g - 1)
        above.append(g + 1)
        for i in starts:
            group[i] = g
    above[-1] = -1

    taken = [False] * (n + 1)
    lower = [-1] * (n + 1)  # the nearest suffix before it in a lower group
    g = len(members) - 1
    while g >= 0:
        own = sorted(i for i in members[g] if group[i] == g)
        members[g] = own
        pointed: dict[int, int] = defaultdict(int)
        for i in own:
            taken[i] = True
            p = i - 1
            while p >= 0 and taken[p]:
                p = lower[p]
            lower[i] = p
            if p >= 0:
                pointed[p] += 1
        by_count: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for p, k in pointed.items():
            by_count[k][group[p]].append(p)
        for k in sorted(by_count, reverse=True):
            for old, moved in by_count[k].items():
                new = len(members)
                members.append(moved)
                length.append(length[old] + k * length[g])
                below.append(old)
                above.append(above[old])
                if above[old] >= 0:
                    below[above[old]] = new
                above[old] = new
                for p in moved:
                    group[p] = new
        g = below[g]

    place = [0] * len(members)
    at, g = 0, 0
    while g >= 0:
        place[g] = at
        at += sum(1 for i in members[g] if group[i] == g)
        g = above[g]
    followers: list[list[int]] = [[] for _ in range(n + 2)]
    for i in range(n):
        followers[i + length[group[i]]].append(i)
    array = [end] * (n + 1)
    for k in range(n + 1):
        for i in followers[array[k]]:
            array[place[group[i]]] = i
            place[group[i]] += 1
    return array[1:]
