"""Bin completion by branch and bound, over how many pieces there are of each length.

A state is a histogram, so its size is bounded by the capacity however many pieces there are, and a step fills as many
bins alike as the histogram allows. Each step takes the largest length left and one undominated filling of the room
beside it. Best fit gives the first incumbent; a branch ends where its bins and the waste bound of what is left reach
the incumbent's number.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np

#: Bins alike: how many, and the copies of each length in one of them.
Step = tuple[int, dict[int, int]]


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs. For each k, lengths over ``capacity - k`` have no room for any of k or more, lengths over one half stand alone, and what those leave free counts towards the lengths from k to one half."""
    lengths = np.arange(len(counts), dtype=np.int64)
    n, total = np.concatenate(([0], np.cumsum(counts))), np.concatenate(([0], np.cumsum(counts * lengths)))
    half = capacity // 2
    k = np.arange(half + 1)
    alone, pairs = n[-1] - n[capacity - k + 1], n[capacity - k + 1] - n[half + 1]
    free = pairs * capacity - (total[capacity - k + 1] - total[half + 1])
    small = total[half + 1] - total[k]
    return int((alone + pairs + np.maximum(0, -((free - small) // capacity))).max())


def best_fit(counts: np.ndarray, capacity: int) -> list[Step]:
    """Best fit by descending length: each piece goes to the fullest bin that has room, a new one if none has."""
    rooms: list[int] = []
    groups: dict[int, list[Step]] = {}
    closed: list[Step] = []

    def keep(times: int, content: dict[int, int], room: int) -> None:
        if not room:
            closed.append((times, content))
            return
        if room not in groups:
            rooms.insert(bisect_left(rooms, room), room)
        groups.setdefault(room, []).append((times, content))

    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                room, times, content = capacity, left, {}
            else:
                room = rooms[at]
                times, content = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
            copies = room // length
            full = min(times, left // copies)
            if full:
                keep(full, content | {length: copies}, room - copies * length)
                left, times = left - full * copies, times - full
            if left and times and left < copies:
                keep(1, content | {length: left}, room - left * length)
                left, times = 0, times - 1
            if times and content:
                keep(times, content, room)
    return closed + [x for group in groups.values() for x in group]


def _sums(counts: np.ndarray, lengths: list[int], room: int) -> list[int]:
    """Bit sets: the sums up to ``room`` that the first i lengths make, none taken more often than it is there."""
    mask, now = (1 << (room + 1)) - 1, 1
    out = [now]
    for length in lengths:
        copies, take = min(int(counts[length]), room // length), 1
        while copies and now != mask:
            take = min(take, copies)
            now |= (now << (length * take)) & mask
            copies, take = copies - take, take * 2
        out.append(now)
    return out


def _dominated(filling: list[tuple[int, int]], slack: int, counts: np.ndarray, lengths: list[int]) -> bool:
    """Whether a length left out could stand for one of the filling that is shorter, or for two of it, within the slack."""
    used = dict(filling)
    spare = lambda x: counts[x] > used.get(x, 0)
    sums = [(x, x + 1) for x in used] + [(x + y, x + y) for x in used for y in used if x < y or x == y and used[x] > 1]
    return any(spare(x) for total, least in sums for x in lengths[bisect_left(lengths, least) : bisect_right(lengths, total + slack)])


def fillings(counts: np.ndarray, room: int, width: int) -> Iterator[list[tuple[int, int]]]:
    """Undominated fillings of ``room``, fullest first, of long pieces before short ones; at most ``width``, and those that a length of theirs or two could be exchanged in for a longer one left out are passed over."""
    lengths = np.flatnonzero(counts[: room + 1]).tolist()
    if not lengths or lengths[-1] == room:
        yield [(room, 1)] if lengths else []
        return
    sums = _sums(counts, lengths, room)

    def exact(total: int, within: int) -> Iterator[list[tuple[int, int]]]:
        if not total:
            yield []
            return
        for j in range(bisect_right(lengths, total, 0, within) - 1, -1, -1):
            if not sums[j + 1] >> total & 1:
                return
            length = lengths[j]
            for copies in range(min(int(counts[length]), total // length), 0, -1):
                if sums[j] >> (total - copies * length) & 1:
                    for rest in exact(total - copies * length, j):
                        yield [(length, copies), *rest]

    given = tried = 0
    for total in range(room, lengths[-1] - 1, -1):  # what is no fuller than one piece alone is dominated by it
        if sums[-1] >> total & 1:
            for filling in exact(total, len(lengths)):
                tried += 1
                if not given or not _dominated(filling, room - total, counts, lengths):
                    given += 1
                    yield filling
                if given == width or tried == 8 * width:
                    return


def complete(counts: np.ndarray, capacity: int, most_nodes: int = 4000, width: int = 8) -> list[Step]:
    """Bins for all pieces, ``counts[length]`` of each length from 1 to ``capacity``, as few as the search finds.

    It ends as soon as a packing needs no more bins than the lower bound; else all branches of ``width`` fillings a
    state are tried, ``most_nodes`` states at most. The packing is whole in any case: what the two parameters limit is
    how long a better one is looked for.
    """
    counts = np.asarray(counts, dtype=np.int64)
    best = best_fit(counts, capacity)
    fewest, least = sum(k for k, _ in best), lower_bound(counts, capacity)

    def branches(now: np.ndarray) -> Iterator[Step]:
        largest = int(np.flatnonzero(now)[-1])
        now[largest] -= 1
        found = list(fillings(now, capacity - largest, width))
        now[largest] += 1
        single = []
        for filling in found:
            content = {largest: 1}
            for length, copies in filling:
                content[length] = content.get(length, 0) + copies
            times = min(int(now[x]) // c for x, c in content.items())
            yield times, content
            if times > 1:
                single.append((1, content))
        yield from single

    if fewest == least:
        return best
    path: list[Step] = []
    frames = [(counts, 0, branches(counts.copy()))]
    nodes = 0
    while frames and nodes < most_nodes and fewest > least:
        now, used, options = frames[-1]
        step = next(options, None)
        if step is None:
            frames.pop()
            path = path[:-1]
            continue
        nodes += 1
        times, content = step
        rest, used = now.copy(), used + times
        for length, copies in content.items():
            rest[length] -= times * copies
        if not rest.any():
            if used < fewest:
                fewest, best = used, [*path, step]
        elif used + lower_bound(rest, capacity) < fewest:
            path = [*path, step]
            frames.append((rest, used, branches(rest.copy())))
    return best
