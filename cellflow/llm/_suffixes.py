"""A suffix array by linear grouping."""

from __future__ import annotations

from collections import Counter


def suffix_array(text: list[int]) -> list[int]:
    """Starts of the suffixes of ``text`` in order; its last symbol must be the only one of the smallest.

    First suffixes are grouped by their Lyndon prefixes: groups, at first those
    of equal first symbols, are taken in descending order; each finds for its
    suffixes the previous suffix of a smaller group, and moves those it finds
    into new groups behind their own, the more often found the later.  Then
    groups are put in order from the smallest suffix on, by following the
    same pointers; nothing is renamed or sorted again.
    """
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    place, group, size = [0] * n, [0] * n, [0] * (n + 1)
    start = 0
    for k, i in enumerate(order):
        if k and text[i] != text[order[k - 1]]:
            start = k
        place[i], group[i] = k, start
        size[start] += 1
    smaller = [-1] * n
    end = n
    while end > 0:
        start = group[order[end - 1]]
        found = []
        for i in sorted(order[start:end]):
            p = i - 1
            while p >= 0 and group[p] >= start:
                p = smaller[p]
            smaller[i] = p
            if p >= 0:
                found.append(p)
        if len(found) == 1:
            moves = {(1, group[found[0]]): found}
        else:
            moves = {}
            for p, times in Counter(found).items():
                moves.setdefault((times, group[p]), []).append(p)
        for (_, own), members in sorted(moves.items(), reverse=True) if len(moves) > 1 else moves.items():
            if len(members) == size[own]:
                continue
            last = own + size[own]
            for p in members:
                last -= 1
                at, other = place[p], order[last]
                order[at], order[last] = other, p
                place[other], place[p] = at, last
            size[own] -= len(members)
            size[last] = len(members)
            for p in members:
                group[p] = last
        end = start
    out, free, placed = [-1] * n, list(range(n + 1)), [False] * n
    out[0], placed[n - 1] = n - 1, True
    for k in range(n):
        i = out[k] - 1
        while i >= 0 and not placed[i]:
            own = group[i]
            out[free[own]] = i
            free[own] += 1
            placed[i] = True
            i = smaller[i]
    return out


def equal_windows(texts: list[bytes], width: int) -> list[list[tuple[int, int]]]:
    """Runs of ``(text, start)`` whose next ``width`` bytes are equal, two or more each, from one suffix array of all texts."""
    symbols, at, start = [], [], 0
    for k, t in enumerate(texts):
        symbols += [b + 2 for b in t]
        symbols.append(1)
        at += [(k, i) if i + width <= len(t) else None for i in range(len(t))]
        at.append(None)
        start += len(t) + 1
    symbols.append(0)
    at.append(None)
    runs: list[list[tuple[int, int]]] = []
    last, run = b"", []
    for i in suffix_array(symbols):
        if at[i] is not None:
            k, j = at[i]
            window = texts[k][j : j + width]
            if window != last:
                if len(run) > 1:
                    runs.append(run)
                last, run = window, []
            run.append((k, j))
    if len(run) > 1:
        runs.append(run)
    return runs
