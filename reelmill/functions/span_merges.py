"""Shortest-first merges over a stretch of neighbouring spans, as far as what lies beyond the stretch cannot change them."""

from __future__ import annotations

import heapq

import numpy as np


def merge_shortest_first(
    start: np.ndarray,
    end: np.ndarray,
    may: np.ndarray | None = None,
    most: int | None = None,
    open_left: bool = False,
    open_right: bool = False,
) -> tuple[np.ndarray, np.ndarray]:
    """The spans after merging, again and again, the first shortest one into its shorter neighbour (left on a tie).

    Without ``may``, every span takes part, merged ones too, until ``most`` merges are done. With it, only spans that it marks
    begin merges, and a merged one only if both its halves are marked and it is still of no length: the merges up to some length.

    An open side has neighbours that aren't seen. The span at it is unsure from the start; a span whose turn comes while it or a
    neighbour is unsure is left, and it makes both its neighbours unsure from then on, since it may go either way. All merges that
    are done are those of the whole sequence, for they happen in the order of the lengths and between spans known to be as they are there.
    """
    begin, finish = start.tolist(), end.tolist()
    n = len(begin)
    level = may is not None
    marked = may.tolist() if level else [True] * n
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    unsure, stamp = [False] * n, [0] * n
    if n and open_left:
        unsure[0] = True
    if n and open_right:
        unsure[-1] = True
    queue = [(finish[i] - begin[i], i, 0) for i in range(n) if marked[i]]
    heapq.heapify(queue)
    gone, left_over = [False] * n, n - 1 if most is None else most
    while queue and left_over > 0:
        _, i, seen = heapq.heappop(queue)
        if gone[i] or stamp[i] != seen:
            continue
        near = [j for j in (before[i], after[i]) if 0 <= j < n]
        if unsure[i] or any(unsure[j] for j in near):
            for j in (i, *near):
                unsure[j] = True
            continue
        if not near:
            break
        left, right = before[i], after[i]
        to_left = left >= 0 and (right >= n or finish[left] - begin[left] <= finish[right] - begin[right])
        a, b = (left, i) if to_left else (i, right)
        finish[a], gone[b], after[a] = finish[b], True, after[b]
        if after[b] < n:
            before[after[b]] = a
        stamp[a] += 1
        left_over -= 1
        length = finish[a] - begin[a]
        marked[a] = marked[a] and marked[b] and (length <= 0 or not level)
        if marked[a]:
            heapq.heappush(queue, (length, a, stamp[a]))
    kept = ~np.array(gone, bool)
    return np.array(begin)[kept], np.array(finish)[kept]
