"""Linear suffix sorting by grouping.

Phase one sorts suffixes into groups by their Lyndon prefixes: groups are taken in descending order, and each of a
group's suffixes extends the Lyndon prefix of the suffix its previous-smaller pointer names, which moves that one
to a new group behind those that were not extended. Phase two emits the order inside groups from left to right: a
suffix that is emitted brings up the one before it and those that one's pointers lead to. Nothing is renamed and
no smaller problem is sorted.
"""

from __future__ import annotations

from collections.abc import Sequence


def suffix_order(text: Sequence[int], alphabet: int = 256) -> list[int]:
    """Starts of all suffixes of ``text`` (bytes, or numbers below ``alphabet``) in lexicographic order (a proper prefix comes first)."""
    n = len(text)
    if not n:
        return []
    at_start, order, place, size = [0] * n, [0] * n, [0] * n, [0] * n
    counts = [0] * alphabet
    for c in text:
        counts[c] += 1
    first, total = [0] * alphabet, 0
    for c in range(alphabet):
        first[c] = total
        if counts[c]:
            size[total] = counts[c]
        total += counts[c]
    fill = first[:]
    for i, c in enumerate(text):
        k = fill[c]
        fill[c] = k + 1
        order[k], place[i], at_start[i] = i, k, first[c]

    before = [-1] * n  # previous-smaller pointers
    end = n - 1
    while end >= 0:
        low = at_start[order[end]]
        members = order[low : end + 1]
        if end > low:
            members.sort()
        extended: dict[int, int] = {}
        for i in members:
            p = i - 1
            while p >= 0 and at_start[p] >= low:
                p = before[p]
            before[i] = p
            if p >= 0:
                extended[p] = extended.get(p, 0) + 1
        end = low - 1
        if not extended:
            continue
        most = max(extended.values())
        if most == 1:
            levels = [list(extended)]
        else:
            by: dict[int, list[int]] = {}
            for p, k in extended.items():
                by.setdefault(k, []).append(p)
            levels = [by[k] for k in sorted(by, reverse=True)]
        for level in levels:
            touched: dict[int, int] = {}
            for p in level:  # to the end of its group
                g = at_start[p]
                moved = touched.get(g, 0) + 1
                touched[g] = moved
                to = g + size[g] - moved
                q, k = order[to], place[p]
                order[to], order[k] = p, q
                place[p], place[q] = to, k
            for g, moved in touched.items():
                left = size[g] - moved
                if left:  # else the whole group was extended and stays where it is
                    size[g] = left
                    new = g + left
                    size[new] = moved
                    for k in range(new, new + moved):
                        at_start[order[k]] = new

    done = bytearray(n)
    out = [0] * n
    nxt = at_start  # from here on: the next free place of a group, kept at the group's first index
    free: dict[int, int] = {}
    i = -1
    s = n  # the empty suffix comes first
    while True:
        j = s - 1
        while j >= 0 and not done[j]:
            g = nxt[j]
            k = free.get(g, g)
            free[g] = k + 1
            out[k] = j
            done[j] = 1
            j = before[j]
        i += 1
        if i >= n:
            return out
        s = out[i]
