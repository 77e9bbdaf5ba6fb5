"""Suffix arrays by linear grouping construction.

Phase one sorts suffixes into groups by the Lyndon word that they start with: groups are taken in descending order, the
previous-smaller pointer of every member is found by following pointers that are known already, and the suffixes
pointed at move into new groups just above their old ones, those with more pointers higher. Phase two walks the
array as it fills: the suffix before each entry, and the chain of its previous-smaller pointers, take the next places
of their groups. Nothing is renamed or sorted again.
"""

from __future__ import annotations

from collections.abc import Sequence


def group_suffixes(text: Sequence[int]) -> tuple[list[int], list[int]]:
    """Group (its first place in the suffix array) and previous-smaller pointer (-1: none) of every suffix."""
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    place, group, size = [0] * n, [0] * n, [0] * n
    start = 0
    for at, i in enumerate(order):
        if text[i] != text[order[start]]:
            start = at
        place[i], group[i] = at, start
        size[start] += 1
    smaller = [-1] * n
    top = n - 1
    while top >= 0:
        own = group[order[top]]
        if own == top:
            i = order[top]
            j = i - 1
            while j >= 0 and group[j] > own:
                j = smaller[j]
            smaller[i] = j
            if j >= 0 and size[group[j]] > 1:
                old = group[j]
                end = old + size[old] - 1
                other, at = order[end], place[j]
                order[at], place[other] = other, at
                order[end], place[j] = j, end
                size[old] -= 1
                group[j], size[end] = end, 1
        else:
            pointers: dict[int, int] = {}
            for i in sorted(order[own : top + 1]):
                j = i - 1
                while j >= 0 and group[j] > own:
                    j = smaller[j]
                if j >= 0 and group[j] == own:  # an earlier member: its pointer is known
                    j = smaller[j]
                smaller[i] = j
                if j >= 0:
                    pointers[j] = pointers.get(j, 0) + 1
            moves: dict[tuple[int, int], list[int]] = {}
            for j, hits in pointers.items():
                moves.setdefault((-hits, group[j]), []).append(j)
            for _, old in sorted(moves) if len(moves) > 1 else moves:
                moved = moves[_, old]
                if len(moved) == size[old]:
                    continue
                end = old + size[old]
                for j in moved:
                    end -= 1
                    other, at = order[end], place[j]
                    order[at], place[other] = other, at
                    order[end], place[j] = j, end
                for j in moved:
                    group[j] = end
                size[old] -= len(moved)
                size[end] = len(moved)
        top = own - 1
    return group, smaller


def suffix_array(text: Sequence[int]) -> list[int]:
    """Start positions of all suffixes in ascending order. The last symbol must be smaller than all others."""
    n = len(text)
    if not n:
        return []
    group, smaller = group_suffixes(text)
    free = list(range(n))
    out = [-1] * n
    placed = [False] * n
    out[0], placed[n - 1] = n - 1, True
    for at in range(n):
        i = out[at] - 1
        while i >= 0 and not placed[i]:
            start = group[i]
            out[free[start]], placed[i] = i, True
            free[start] += 1
            i = smaller[i]
    return out
