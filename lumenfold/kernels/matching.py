"""Row matchings of a square sparse matrix in column form: ``ptr``, ``row``, ``val``."""

from __future__ import annotations

import heapq
import math

import numpy as np


def _complete(match: np.ndarray) -> bool:
    """Give unmatched columns the unused rows in order; True if there was nothing to do."""
    free = np.flatnonzero(match < 0)
    if not len(free):
        return True
    unused = np.ones(len(match), bool)
    unused[match[match >= 0]] = False
    match[free] = np.flatnonzero(unused)
    return False


#: A diagonal entry of at least this share of its column's largest stays where it is.
STAYS = 0.1


def transversal(n: int, ptr: np.ndarray, row: np.ndarray, val: np.ndarray) -> tuple[np.ndarray, bool]:
    """Row matched to each column, large entries first (equal ones by row), and whether the matching is perfect.

    A diagonal entry of at least STAYS of its column's largest goes before all others: moving rows for little more size makes a symmetric
    pattern unsymmetric, and its factors fuller. A breadth-first search for a free row from each column left over by the greedy pass.
    """
    col = np.repeat(np.arange(n), np.diff(ptr))
    size = np.abs(val)
    most = np.zeros(n, size.dtype)
    np.maximum.at(most, col, size)
    stays = (row == col) & (size > 0) & (size >= STAYS * most[col])
    size = np.where(stays, np.inf, size)
    order = np.lexsort((row, -size, col))
    order = order[size[order] > 0]
    top = order[np.concatenate([[True], np.diff(col[order]) != 0])] if len(order) else order
    if len(top) == n and len(np.unique(row[top])) == n:
        return row[top].astype(np.int64), True  # every column's largest entry in a row of its own
    choices = []
    for j in range(n):
        r, v = row[ptr[j] : ptr[j + 1]], size[ptr[j] : ptr[j + 1]]
        r, v = r[v > 0], v[v > 0]
        choices.append(r[np.lexsort((r, -v))].tolist())
    match, owner = np.full(n, -1), np.full(n, -1)
    for j in range(n):
        for r in choices[j]:
            if owner[r] < 0:
                match[j], owner[r] = r, j
                break
    for j in np.flatnonzero(match < 0).tolist():
        via: dict[int, int] = {}
        queue, end = [j], -1
        while queue and end < 0:
            later = []
            for c in queue:
                for r in choices[c]:
                    if r not in via:
                        via[r] = c
                        if owner[r] < 0:
                            end = r
                            break
                        later.append(int(owner[r]))
                if end >= 0:
                    break
            queue = later
        while end >= 0:
            c = via[end]
            owner[end], match[c], end = c, end, match[c]
            if c == j:
                break
    perfect = _complete(match)
    return match, perfect


def max_product(n: int, ptr: np.ndarray, row: np.ndarray, val: np.ndarray) -> tuple[np.ndarray, bool, np.ndarray, np.ndarray]:
    """The matching of greatest product of magnitudes, and scales by which matched entries become 1 and no other exceeds 1.

    Successive shortest paths over costs ln(column maximum) - ln(magnitude), kept non-negative by potentials.
    """
    # Candidates and costs stay in arrays: as lists of numbers they take several times the matrix.
    size = np.abs(val)
    some = size > 0
    start_of = np.concatenate([[0], np.cumsum(some)])[ptr].tolist()
    cand, cost, top = row[some], size[some].astype(float), np.ones(n)
    for j in range(n):
        a, b = start_of[j], start_of[j + 1]
        if a < b:
            top[j] = cost[a:b].max()
            cost[a:b] = math.log(top[j]) - np.log(cost[a:b])
    u, w = np.zeros(n), np.zeros(n)  # cost(i, j) - u[i] - w[j] >= 0, with equality on the matching
    match, owner = np.full(n, -1), np.full(n, -1)
    for start in range(n):
        dist: dict[int, float] = {}
        via: dict[int, int] = {}
        done: list[int] = []
        settled: set[int] = set()
        heap: list[tuple[float, int]] = []
        col, base, end = start, 0.0, -1
        while True:
            a, b = start_of[col], start_of[col + 1]
            for r, c in zip(cand[a:b].tolist(), cost[a:b].tolist(), strict=True):
                d = base + c - u[r] - w[col]
                if r not in settled and d < dist.get(r, math.inf):
                    dist[r], via[r] = d, col
                    heapq.heappush(heap, (d, r))
            while heap and (heap[0][1] in settled or heap[0][0] > dist[heap[0][1]]):
                heapq.heappop(heap)
            if not heap:
                break
            base, r = heapq.heappop(heap)
            settled.add(r)
            done.append(r)
            if owner[r] < 0:
                end = r
                break
            col = int(owner[r])
        if end < 0:
            continue
        w[start] += base
        for r in done[:-1]:
            w[owner[r]] += base - dist[r]
            u[r] -= base - dist[r]
        while True:
            c = via[end]
            owner[end], match[c], end = c, end, match[c]
            if c == start:
                break
    row_scale, col_scale = np.exp(u), np.exp(w) / top
    col_scale[match < 0] = 1.0
    perfect = _complete(match)
    return match, perfect, row_scale, col_scale


def parity(perm: np.ndarray) -> int:
    """1 or -1: the sign of a permutation, by its cycles."""
    seen, sign = np.zeros(len(perm), bool), 1
    for i in range(len(perm)):
        if not seen[i]:
            length, j = 0, i
            while not seen[j]:
                seen[j], j, length = True, perm[j], length + 1
            sign = -sign if length % 2 == 0 else sign
    return sign
