"""Suffix array by grouping: Lyndon-prefix groups in descending order, then one pass that emits the order."""

from __future__ import annotations


def suffix_array(text: list[int]) -> list[int]:
    """Suffix array of ``text``, in linear time without renaming or recursion; any integers, a shorter suffix first.

    First phase: suffixes are grouped by their first symbol. Groups are taken from the highest down. Every member points to
    the nearest suffix before it in a lower group; such a suffix, followed by as many copies of the group's word as it
    has pointers, moves into a new group right behind its own, more copies further up. In the end suffixes share a
    group when they share their longest Lyndon prefix. Second phase: from the least suffix on, each placed suffix places the one
    before it and, along the pointers, all that are not placed yet, each at the next free place of its group.
    """
    n = len(text) + 1  # the empty suffix is the least
    order = [n - 1, *sorted(range(n - 1), key=text.__getitem__)]
    place, start, size = [0] * n, [0] * n, [0] * n
    head = 0
    for i, s in enumerate(order):
        if i < 2 or text[s] != text[order[head]]:
            head = i
        place[s], start[s] = i, head
        size[head] += 1
    before = [-1] * n
    high = n - 1
    while high >= 0:
        low = start[order[high]]
        pointers: dict[int, int] = {}
        for s in sorted(order[low:high + 1]):
            p = s - 1
            while p >= 0 and start[p] >= low:
                p = before[p]
            before[s] = p
            if p >= 0:
                pointers[p] = pointers.get(p, 0) + 1
        if pointers:
            by_count: dict[int, list[int]] = {}
            for p, c in pointers.items():
                by_count.setdefault(c, []).append(p)
            for c in sorted(by_count, reverse=True):
                moved: dict[int, list[int]] = {}
                for p in by_count[c]:
                    moved.setdefault(start[p], []).append(p)
                for g, members in moved.items():
                    if len(members) == size[g]:
                        continue  # the whole group moves: it stays where it is
                    end = g + size[g]
                    for p in members:
                        end -= 1
                        other, at = order[end], place[p]
                        order[at], order[end] = other, p
                        place[other], place[p] = at, end
                    size[g] -= len(members)
                    size[end] = len(members)
                    for p in members:
                        start[p] = end
        high = low - 1
    out, free, placed = [0] * n, {}, [False] * n
    out[0], placed[n - 1] = n - 1, True
    for i in range(n):
        p = out[i] - 1
        while p >= 0 and not placed[p]:
            g = start[p]
            at = free.get(g, g)
            out[at], free[g], placed[p] = p, at + 1, True
            p = before[p]
    return out[1:]
