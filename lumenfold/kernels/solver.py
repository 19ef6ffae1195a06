"""Analysis, factorization and solution of one sparse system in NumPy: a multifrontal LU with static and in-block pivoting.

Supernodes of equal width and (about) equal height on one level of the elimination tree are eliminated together, as stacks of dense fronts.
"""

from __future__ import annotations

import heapq
import json
import math
from dataclasses import asdict, dataclass

import numpy as np

from lumenfold.kernels import matching as mt
from lumenfold.kernels import symbolic as sy
from lumenfold.plans.options import SolveOptions


def assemble(n: int, row: np.ndarray, col: np.ndarray, val: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Duplicates summed, entries in column order; stored zeros stay."""
    if len(row) and (row.min() < 0 or col.min() < 0 or row.max() >= n or col.max() >= n):
        raise ValueError("an entry lies outside the matrix")
    code = col * n + row
    order = np.argsort(code, kind="stable")
    code = code[order]
    new = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else order
    out = np.add.reduceat(val[order], new) if len(new) else val
    return code[new] % max(n, 1), code[new] // max(n, 1), out


def ruiz(n: int, row: np.ndarray, col: np.ndarray, mag: np.ndarray, dr: np.ndarray, dc: np.ndarray, sweeps: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Scales that bring row and column maxima near 1; zero rows and columns keep theirs."""
    for _ in range(sweeps):
        now = mag * dr[row] * dc[col]
        rm, cm = np.zeros(n), np.zeros(n)
        np.maximum.at(rm, row, now)
        np.maximum.at(cm, col, now)
        far = np.abs(1 - np.concatenate([rm[rm > 0], cm[cm > 0]]))
        if not len(far) or far.max() < 0.1:
            break
        dr = np.where(rm > 0, dr / np.sqrt(np.where(rm > 0, rm, 1)), dr)
        dc = np.where(cm > 0, dc / np.sqrt(np.where(cm > 0, cm, 1)), dc)
    return dr, dc


@dataclass
class Analysis:
    """What depends on the pattern (and on the values that the matching saw)."""

    n: int
    options: SolveOptions
    match: np.ndarray
    perfect: bool
    row_to: np.ndarray  # original row -> internal
    col_to: np.ndarray  # original column -> internal
    seed_row: np.ndarray
    seed_col: np.ndarray
    structure: sy.Structure
    ordering: str


def order_pattern(n: int, row: np.ndarray, col: np.ndarray, adj: list[np.ndarray], kind: str) -> tuple[np.ndarray, str]:
    """orig -> internal. ``auto`` scores candidates by their fill, read in the direction in which they are used."""
    if kind == "natural":
        return np.arange(n), kind
    if kind == "min_degree":
        return sy.min_degree(adj), kind
    if kind == "dissection":
        return sy.dissection(adj), kind
    if kind == "column_degree":
        return sy.column_degree(n, row, col), kind
    tries = [("min_degree", sy.min_degree(adj))] if n <= 20_000 else []
    tries += [(f"dissection:{s}", sy.dissection(adj, seed=s)) for s in range(3 if n <= 5000 else 2 if n <= 10_000 else 1)]
    best = min(tries, key=lambda t: sy.fill_of(adj, t[1]))
    return best[1], best[0]


def analyze(n: int, row: np.ndarray, col: np.ndarray, val: np.ndarray, o: SolveOptions) -> Analysis:
    """Matching, ordering, tree, supernodes. Refactoring with new values keeps this matching and its scales."""
    row, col, val = assemble(n, row, col, val)
    ptr = np.searchsorted(col, np.arange(n + 1))
    sr, sc, perfect, match = np.ones(n), np.ones(n), True, np.arange(n)
    if o.matching == "transversal":
        match, perfect = mt.transversal(n, ptr, row, val)
    elif o.matching == "mc64":
        match, perfect, sr, sc = mt.max_product(n, ptr, row, val)
    place = np.empty(n, np.int64)
    place[match] = np.arange(n)  # matched row -> column position
    moved = place[row]
    adj = sy.neighbours(n, moved, col)
    order, name = order_pattern(n, moved, col, adj, o.ordering)
    adj = sy.relabel(adj, order)
    parent = sy.elimination_tree(adj)
    post = sy.postorder(parent)
    order = post[order]
    structure = sy.analyze(sy.relabel(adj, post), o.relaxed_width, o.max_zero_rows, o.fill_fraction, o.max_block, sy.moved_tree(parent, post))
    return Analysis(n, o, match, perfect, order[place], order, sr, sc, structure, name)


#: Width of a panel of the dense factorization, scalars in a stack of fronts, of right-hand sides multiplied at once, and sums or products of entries held at once.
PANEL, STACK, COLUMNS, PAIRS = 64, 1 << 20, 1 << 22, 1 << 19


def _swap(a: np.ndarray, k: int, other: np.ndarray, axis: int) -> None:
    """Exchange rows (axis 1) or columns (axis 2) k and ``other`` of every matrix of a stack."""
    b = np.flatnonzero(other != k)
    if len(b):
        i, j = ((b, k), (b, other[b])) if axis == 1 else ((b, slice(None), k), (b, slice(None), other[b]))
        a[i], a[j] = a[j].copy(), a[i].copy()


def dense_lu(a: np.ndarray, pivoting: str, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, np.ndarray]:
    """LU of a stack of square blocks in place: rows and columns as exchanged, pivots replaced, and which blocks had a pivot of exactly zero.

    Panels of PANEL columns, unless columns are exchanged too.
    """
    count, w = a.shape[:2]
    p, q = (np.tile(np.arange(w), (count, 1)) for _ in range(2))
    bumped, zero, every = 0, np.zeros(count, bool), np.arange(count)
    width = w if pivoting == "complete" else PANEL
    for start in range(0, w, width):
        stop = min(w, start + width)
        for k in range(start, stop):
            if pivoting == "partial":
                to = k + np.argmax(np.abs(a[:, k:, k]), 1)
                _swap(a, k, to, 1)
                p[every, k], p[every, to] = p[every, to], p[every, k]
            elif pivoting == "complete":
                i, j = np.divmod(np.argmax(np.abs(a[:, k:, k:]).reshape(count, -1), 1), w - k)
                for m, to, axis in ((p, k + i, 1), (q, k + j, 2)):
                    _swap(a, k, to, axis)
                    m[every, k], m[every, to] = m[every, to], m[every, k]
            pivot = a[:, k, k]
            size = np.abs(pivot)
            if len(small := np.flatnonzero(size < least)):
                a[small, k, k] = least * np.where(size[small] > 0, pivot[small] / np.where(size[small] > 0, size[small], 1), 1)
                bumped += len(small)
            none = a[:, k, k] == 0
            zero |= none
            a[:, k + 1 :, k] /= np.where(none, 1, a[:, k, k])[:, None]
            a[:, k + 1 :, k + 1 : stop] -= a[:, k + 1 :, k, None] * a[:, k, None, k + 1 : stop]
        if stop < w:
            one = np.tril(a[:, start:stop, start:stop], -1) + np.eye(stop - start, dtype=a.dtype)
            a[:, start:stop, stop:] = np.linalg.solve(one, a[:, start:stop, stop:])
            a[:, stop:, stop:] -= a[:, stop:, start:stop] @ a[:, start:stop, stop:]
    return p, q, a, bumped, zero


class Fronts:
    """The elimination tree of supernodes: parents, levels, and where rows lie in each front."""

    def __init__(self, n: int, s: sy.Structure):
        self.n, self.first, self.last, self.width, self.height = n, s.first, s.last, s.widths, s.below
        self.start = np.concatenate([[0], np.cumsum(self.height)]).astype(np.int64)
        self.rows = np.concatenate(s.rows).astype(np.int64) if len(s.rows) else np.zeros(0, np.int64)
        self.of = s.of()
        count = len(self.first)
        self.key = np.repeat(np.arange(count), self.height) * max(n, 1) + self.rows
        has = self.height > 0
        self.parent = np.full(count, -1)
        self.parent[has] = self.of[self.rows[self.start[:-1][has]]]
        level = [0] * count
        for k, up in enumerate(self.parent.tolist()):
            if up >= 0 and level[up] <= level[k]:
                level[up] = level[k] + 1
        self.level = np.array(level, np.int64)

    def place(self, node: np.ndarray, index: np.ndarray) -> np.ndarray:
        """Position of an internal index in the front of a supernode."""
        below = np.searchsorted(self.key, node * self.n + index) - self.start[node] + self.width[node]
        return np.where(index <= self.last[node], index - self.first[node], below)

    def work(self) -> np.ndarray:
        w, m = self.width.astype(float), (self.width + self.height).astype(float)
        return w * m * m

    def jobs(self, count: int) -> np.ndarray:
        """A job for each supernode: whole subtrees, dealt out by work; -1 for the cap above them."""
        total = self.work()
        kids: list[list[int]] = [[] for _ in range(len(total) + 1)]
        for k, up in enumerate(self.parent.tolist()):
            if up >= 0:
                total[up] += total[k]
            kids[up].append(k)
        heavy, trees = [(-total[k], k) for k in kids[-1]], []
        heapq.heapify(heavy)
        goal = self.work().sum() / (2 * count)
        while heavy:
            size, k = heapq.heappop(heavy)
            if -size <= goal:
                trees.append((size, k))
            else:
                for c in kids[k]:
                    heapq.heappush(heavy, (-total[c], c))
        job, load = np.full(len(total), -1), [(0.0, j) for j in range(count)]
        for size, k in sorted(trees):
            have, j = heapq.heappop(load)
            heapq.heappush(load, (have - size, j))
            job[k] = j
        for k in range(len(total) - 1, -1, -1):
            if job[k] < 0 and self.parent[k] >= 0:
                job[k] = job[self.parent[k]]
        return job


def _padded(height: np.ndarray) -> np.ndarray:
    """Heights up to 256 rounded up by at most a quarter, so that more fronts stack."""
    step = 1 << np.maximum(0, np.floor(np.log2(np.maximum(height, 1))).astype(np.int64) - 2)
    return np.where(height <= 256, -(-height // step) * step, height)


@dataclass
class Stack:
    """Factors of some supernodes of one level: (count, width, ...) arrays. ``rows`` beyond a front's own are n."""

    level: int
    first: np.ndarray
    rows: np.ndarray
    p: np.ndarray
    q: np.ndarray
    lu: np.ndarray
    l_inv: np.ndarray
    u_inv: np.ndarray
    low: np.ndarray
    up: np.ndarray

    @property
    def own(self) -> np.ndarray:
        return self.first[:, None] + np.arange(self.lu.shape[1])


ARRAYS = ("first", "rows", "p", "q", "lu", "l_inv", "u_inv", "low", "up")


class Assembly:
    """The chosen supernodes in stacks of equal width and (about) equal height on one level, and the updates that wait for their fronts.

    ``ir``, ``ic``, ``val``: entries that these supernodes own. An update is a supernode and a block on its rows below.
    """

    def __init__(self, fronts: Fronts, chosen: np.ndarray, ir: np.ndarray, ic: np.ndarray, val: np.ndarray):
        f, count = fronts, len(fronts.first)
        pad = _padded(f.height[chosen])
        order = np.lexsort((chosen, pad, f.width[chosen], f.level[chosen]))
        chosen, pad = chosen[order], pad[order]
        level, width = f.level[chosen], f.width[chosen]
        room = np.maximum(1, STACK // np.maximum(1, (width + pad) ** 2))
        bounds, at = [0], 0
        while at < len(chosen):
            near = slice(at, at + int(room[at]))
            other = np.flatnonzero((level[near] != level[at]) | (width[near] != width[at]) | (pad[near] != pad[at]))
            at = at + int(other[0]) if len(other) else min(at + int(room[at]), len(chosen))
            bounds.append(at)
        stack_of, slot = np.full(count, -1), np.zeros(count, np.int64)
        for g, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
            stack_of[chosen[a:b]] = g
            slot[chosen[a:b]] = np.arange(b - a)
        self.f, self.chosen, self.pad, self.level, self.width, self.bounds, self.stack_of, self.slot = f, chosen, pad, level, width, bounds, stack_of, slot
        owner = f.of[np.minimum(ir, ic)] if len(ir) else ir
        self.ir, self.ic, self.val, self.owner = ir, ic, val, owner
        self.by = np.argsort(stack_of[owner], kind="stable") if len(ir) else ir
        self.cut = np.searchsorted(stack_of[owner][self.by], np.arange(len(bounds))) if len(ir) else np.zeros(len(bounds), np.int64)
        self.waiting: dict[int, list] = {}
        self.begun: dict[int, np.ndarray] = {}
        self.held = [0] * len(bounds)  # scalars that wait for each stack

    def __iter__(self):
        """Of each stack, children first: its number, supernodes, width and padded height."""
        for g, (a, b) in enumerate(zip(self.bounds, self.bounds[1:], strict=False)):
            yield g, self.chosen[a:b], int(self.width[a]), int(self.pad[a])

    def fronts_of(self, g: int) -> np.ndarray:
        """The fronts of a stack: its entries, and all updates that have come."""
        a, b = self.bounds[g], self.bounds[g + 1]
        m = int(self.width[a] + self.pad[a])
        front = self.begun.pop(g, None)
        if front is None:
            front = np.zeros((b - a, m, m), self.val.dtype)
            e = self.by[self.cut[g] : self.cut[g + 1]]
            owner = self.owner[e]
            np.add.at(front.reshape(-1), (self.slot[owner] * m + self.f.place(owner, self.ir[e])) * m + self.f.place(owner, self.ic[e]), self.val[e])
        flat = front.reshape(-1)
        for updates, where, place, heights in self.waiting.pop(g, ()):
            if len(updates) == 1:
                h = int(heights[0])
                front[where[0]][np.ix_(place[0, :h], place[0, :h])] += updates[0, :h, :h]
                continue
            step = max(1, PAIRS // max(1, place.shape[1] ** 2))
            for c in range(0, len(updates), step):
                part = slice(c, c + step)
                line = where[part, None] * m + place[part]
                np.add.at(flat, (line[:, :, None] * m + place[part][:, None, :]).ravel(), updates[part].ravel())
        return front

    def send(self, nodes: np.ndarray, updates: np.ndarray) -> None:
        """Give the updates of these supernodes (one stack) to the stacks of their parents. Where they outgrow the fronts they wait for, those are begun."""
        f = self.f
        up = f.parent[nodes]
        to = self.stack_of[up]
        high = updates.shape[1]
        j = np.minimum(np.arange(high), np.maximum(f.height[nodes][:, None] - 1, 0))
        place = f.place(np.repeat(up, high), f.rows[(f.start[nodes][:, None] + j).ravel()]).reshape(len(nodes), high)
        for g in np.unique(to).tolist():
            sel = np.flatnonzero(to == g)
            self.waiting.setdefault(g, []).append((updates if len(sel) == len(to) else updates[sel], self.slot[up[sel]], place[sel], f.height[nodes[sel]]))
            self.held[g] += len(sel) * high * high
            a, b = self.bounds[g], self.bounds[g + 1]
            if self.held[g] > (b - a) * int(self.width[a] + self.pad[a]) ** 2:
                self.begun[g], self.held[g] = self.fronts_of(g), 0

    def below(self, nodes: np.ndarray, high: int) -> np.ndarray:
        """Rows below each of these fronts; beyond a front's own they are n."""
        f, j = self.f, np.arange(high)
        own = j < f.height[nodes][:, None]
        return np.where(own, f.rows[np.minimum(f.start[nodes][:, None] + j, max(len(f.rows) - 1, 0))], f.n) if high else np.zeros((len(nodes), 0), np.int64)


def eliminate(fronts: Fronts, chosen: np.ndarray, ir: np.ndarray, ic: np.ndarray, val: np.ndarray, incoming: list[tuple[int, np.ndarray]], pivoting: str, least: float):
    """Eliminate the chosen supernodes (whole subtrees, or all that is left above them): stacks, updates that leave, pivots replaced, message.

    ``ir``, ``ic``, ``val``: the scaled entries that these supernodes own. ``incoming``: updates of supernodes eliminated elsewhere. An update
    is a supernode and its Schur block.
    """
    f, plan = fronts, Assembly(fronts, chosen, ir, ic, val)
    for node, block in incoming:
        plan.send(np.array([node]), block[None])
    stacks, leaving, bumped = [], [], 0
    for g, nodes, w, high in plan:
        front = plan.fronts_of(g)
        p, q, lu, more, zero = dense_lu(front[:, :w, :w].copy(), pivoting, least)
        bumped += more
        if zero.any():
            return [], [], bumped, "a pivot is exactly zero: the matrix is singular"
        one = np.tril(lu, -1) + np.eye(w, dtype=lu.dtype)
        try:
            l_inv, u_inv = np.linalg.inv(one), np.linalg.inv(np.triu(lu))
        except np.linalg.LinAlgError:
            return [], [], bumped, "a diagonal block is singular to working precision"
        low = np.take_along_axis(front[:, w:, :w], q[:, None, :], 2) @ u_inv
        up = l_inv @ np.take_along_axis(front[:, :w, w:], p[:, :, None], 1)
        stacks.append(Stack(int(f.level[nodes[0]]), f.first[nodes], plan.below(nodes, high), p, q, lu, l_inv, u_inv, low, up))
        if high:
            update = low @ up
            np.subtract(front[:, w:, w:], update, out=update)
            del front
            stay = plan.stack_of[f.parent[nodes]] >= 0
            if stay.any():
                plan.send(nodes[stay], update[stay] if not stay.all() else update)
            leaving += [(int(k), update[i, : f.height[k], : f.height[k]]) for i, k in enumerate(nodes) if f.parent[k] >= 0 and not stay[i]]
    return stacks, leaving, bumped, ""


def merged(f: Fronts, leaving: list[tuple[int, np.ndarray]], kind: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Updates that leave, as entries of the matrix above them, each place once: many small subtrees send as much as one."""
    n, found = max(f.n, 1), [(np.zeros(0, np.int64), np.zeros(0, kind))]

    def sums() -> tuple[np.ndarray, np.ndarray]:
        key, val = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else order
        return key[new], np.add.reduceat(val[order], new) if len(new) else val

    waiting = 0
    for k, block in leaving:
        rows = f.rows[f.start[k] : f.start[k + 1]]
        found.append(((rows[:, None] * n + rows).ravel(), block.ravel()))
        waiting += block.size
        if waiting > max(PAIRS, len(found[0][0])):
            found, waiting = [sums()], 0
    key, val = sums()
    return key // n, key % n, val


def _subtract(y: np.ndarray, rows: np.ndarray, by: np.ndarray) -> None:
    flat = rows.ravel()
    by = by.reshape(len(flat), y.shape[1])
    for k in range(y.shape[1]):
        np.subtract.at(y[:, k], flat, by[:, k])


class Factor:
    """Factors by stacks of supernodes, the matrix they belong to and its scales."""

    def __init__(self, a: Analysis, row: np.ndarray, col: np.ndarray, val: np.ndarray, dr: np.ndarray, dc: np.ndarray):
        self.a, self.row, self.col, self.val, self.dr, self.dc = a, row, col, val, dr, dc
        self.stacks: list[Stack] = []
        self.replaced, self.ok, self.message, self.threshold = 0, False, "", 0.0
        self.iterations, self.residual = 0, math.nan
        self._sorted: dict[bool, tuple] = {}

    # Determinant of the factored matrix: that of the perturbed one if pivots were replaced.
    def diagonal(self) -> np.ndarray:
        """Pivots by internal column."""
        out = np.ones(self.a.n, self.val.dtype)
        for s in self.stacks:
            out[s.own] = np.diagonal(s.lu, axis1=1, axis2=2)
        return out

    def log_abs_det(self) -> float:
        with np.errstate(divide="ignore"):
            return float(np.log(np.abs(self.diagonal())).sum() - np.log(self.dr).sum() - np.log(self.dc).sum())

    def det_sign(self):
        d = self.diagonal()
        if np.any(d == 0):
            return 0.0
        sign = mt.parity(self.a.match)
        for s in self.stacks:
            for m in (s.p, s.q):
                for x in m[(m != np.arange(m.shape[1])).any(1)]:
                    sign *= mt.parity(x)
        unit = np.prod(d / np.abs(d)) * sign
        return complex(unit) if np.iscomplexobj(d) else float(unit)

    def determinant(self):
        return self.det_sign() * np.exp(self.log_abs_det())

    def lower(self, y: np.ndarray, trans: str = "N") -> np.ndarray:
        """The sweep with L (or the transposed U) in internal numbering, in place of a copy."""
        y = np.concatenate([y, np.zeros((1, y.shape[1]), y.dtype)])
        for s in sorted(self.stacks, key=lambda s: s.level):
            own = s.own
            if trans == "N":
                x = s.l_inv @ y[np.take_along_axis(own, s.p, 1)]
                by = s.low @ x
            else:
                x = _as(trans)(s.u_inv) @ y[np.take_along_axis(own, s.q, 1)]
                by = _as(trans)(s.up) @ x
            y[own] = x
            _subtract(y, s.rows, by)
        return y[:-1]

    def upper(self, y: np.ndarray, trans: str = "N") -> np.ndarray:
        """The sweep with U (or the transposed L)."""
        y = np.concatenate([y, np.zeros((1, y.shape[1]), y.dtype)])
        for s in sorted(self.stacks, key=lambda s: -s.level):
            below = y[s.rows]  # rows beyond a front's own read the zero at the end
            if trans == "N":
                y[np.take_along_axis(s.own, s.q, 1)] = s.u_inv @ (y[s.own] - s.up @ below)
            else:
                y[np.take_along_axis(s.own, s.p, 1)] = _as(trans)(s.l_inv) @ (y[s.own] - _as(trans)(s.low) @ below)
        return y[:-1]

    def pivoted(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each internal row and column, its place after the exchanges inside blocks."""
        r, c = np.arange(self.a.n), np.arange(self.a.n)
        for s in self.stacks:
            for out, m in ((r, s.p), (c, s.q)):
                out[np.take_along_axis(s.own, m, 1)] = s.own
        return r, c

    def triangle(self, which: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entries of L (unit diagonal included) or U in pivoted numbering: L U is the scaled, permuted matrix, if no pivot was replaced."""
        r, c = self.pivoted()
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.val.dtype))]
        for s in self.stacks:
            w, own = s.lu.shape[1], s.own
            i, j = np.tril_indices(w, -1) if which == "lower" else np.triu_indices(w)
            out.append((own[:, i].ravel(), own[:, j].ravel(), s.lu[:, i, j].ravel()))
            if which == "lower":
                out.append((own.ravel(), own.ravel(), np.ones(own.size, self.val.dtype)))
            b, x = np.nonzero(s.rows < self.a.n)
            index = np.repeat((r if which == "lower" else c)[s.rows[b, x]], w)
            mine = own[b].ravel()
            out.append((index, mine, s.low[b, x].ravel()) if which == "lower" else (mine, index, s.up[b, :, x].ravel()))
        return tuple(np.concatenate(z) for z in zip(*out, strict=True))

    def product(self):
        """Entries of L times U in pivoted numbering, a stack of supernodes at a time.

        Elimination undone: a supernode's columns of L times its rows of U are a dense block on its front; what falls on the rows below goes to the
        parent's front, and what is left when all has come are the product's entries.
        """
        n, (r, c) = self.a.n, self.pivoted()
        r, c = np.append(r, n), np.append(c, n)
        fronts = Fronts(n, self.a.structure)
        at = np.full(n, -1)  # of each supernode's first index, its stack and its place there
        slot = np.zeros(n, np.int64)
        for k, s in enumerate(self.stacks):
            at[s.first], slot[s.first] = k, np.arange(len(s.first))
        none = np.zeros(0, np.int64)
        plan = Assembly(fronts, np.arange(len(fronts.first)), none, none, np.zeros(0, self.val.dtype))
        for g, nodes, w, high in plan:
            front, first = plan.fronts_of(g), fronts.first[nodes]
            for k in np.unique(at[first]).tolist():
                s, mine = self.stacks[k], np.flatnonzero(at[first] == k)
                of = slot[first[mine]]
                low, up = np.tril(s.lu[of], -1) + np.eye(w, dtype=s.lu.dtype), np.triu(s.lu[of])
                # Own rows and columns as they were before the exchanges inside the block.
                low = np.take_along_axis(low, np.argsort(s.p[of], 1)[:, :, None], 1)
                up = np.take_along_axis(up, np.argsort(s.q[of], 1)[:, None, :], 2)
                front[mine if len(mine) < len(nodes) else slice(None)] += np.concatenate([low, s.low[of]], 1) @ np.concatenate([up, s.up[of]], 2)
            index = np.concatenate([first[:, None] + np.arange(w), plan.below(nodes, high)], 1)
            for done, row, col in ((front[:, :w], index[:, :w], index), (front[:, w:, :w], index[:, w:], index[:, :w])):
                b, i, j = np.nonzero(done)
                keep = (row[b, i] < n) & (col[b, j] < n)
                yield r[row[b, i][keep]], c[col[b, j][keep]], done[b, i, j][keep]
            if high:
                stay = fronts.parent[nodes] >= 0
                if stay.any():
                    plan.send(nodes[stay], front[stay, w:, w:] if not stay.all() else front[:, w:, w:].copy())

    def direct(self, b: np.ndarray, trans: str = "N") -> np.ndarray:
        """The factored solution, without refinement: N, T (transposed) or H (adjoint)."""
        into, scale, out, last = (self.a.row_to, self.dr, self.a.col_to, self.dc) if trans == "N" else (self.a.col_to, self.dc, self.a.row_to, self.dr)
        y = np.empty(b.shape, np.result_type(b, self.val))
        y[into] = b * scale[:, None]
        y = self.upper(self.lower(y, trans), trans)
        return y[out] * last[:, None]

    def multiply(self, x: np.ndarray, trans: str = "N") -> np.ndarray:
        key = trans == "N"
        if key not in self._sorted:
            row, col = (self.row, self.col) if key else (self.col, self.row)
            order = np.argsort(row, kind="stable")
            starts = np.flatnonzero(np.diff(row[order], prepend=-1))
            self._sorted[key] = order, row[order][starts], col[order], starts
        order, rows, col, starts = self._sorted[key]
        val = self.val.conj() if trans == "H" else self.val
        out = np.zeros(x.shape, np.result_type(x, val))
        step = max(1, COLUMNS // max(1, len(order)))  # columns at a time, as each takes an array of the matrix's entries
        for k in range(0, x.shape[1] if len(order) else 0, step):
            out[rows, k : k + step] = np.add.reduceat(val[order, None] * x[col, k : k + step], starts, axis=0)
        return out

    def solve(self, b: np.ndarray, trans: str = "N") -> np.ndarray:
        """Solve, refine as the options say, and record the residual on the original matrix and the status."""
        o, self.iterations = self.a.options, 0
        x = self.direct(b, trans)
        if o.refinement != "none" and o.max_refinements and (self.replaced or not o.refine_only_if_perturbed):
            x = (self._stationary if o.refinement == "stationary" else self._bicgstab)(x, b, trans)
        r, size = np.linalg.norm(b - self.multiply(x, trans)), np.linalg.norm(b)
        self.residual = float(r / size if size else r)
        good = np.isfinite(x).all() and self.residual <= o.failure_threshold
        self.ok, self.message = bool(good), "" if good else f"the solution leaves a residual of {self.residual:.3g}"
        return x

    def _stationary(self, x: np.ndarray, b: np.ndarray, trans: str) -> np.ndarray:
        o, size = self.a.options, np.linalg.norm(b)
        r = b - self.multiply(x, trans)
        best = np.linalg.norm(r)
        for _ in range(o.max_refinements):
            if not np.isfinite(best) or best <= o.refine_tolerance * size:
                break
            y = x + self.direct(r, trans)
            s = b - self.multiply(y, trans)
            self.iterations += 1
            if not np.linalg.norm(s) < best:
                break
            x, r, best = y, s, np.linalg.norm(s)
        return x

    def _bicgstab(self, x: np.ndarray, b: np.ndarray, trans: str) -> np.ndarray:
        """Preconditioned BiCGStab from the direct solution, all columns at once, each with its own scalars; a column's best iterate is returned."""
        o, k = self.a.options, b.shape[1]
        dot = lambda u, v: np.einsum("ij,ij->j", u.conj(), v)
        size = lambda u: np.linalg.norm(u, axis=0)
        goal = o.refine_tolerance * size(b)
        best, z = x.copy(), x.copy()
        r = b - self.multiply(z, trans)
        low = size(r)
        live = np.flatnonzero(np.isfinite(low) & (low > goal))
        shadow, v, p = r.copy(), np.zeros_like(r), np.zeros_like(r)
        rho, alpha, omega = (np.ones(k, r.dtype) for _ in range(3))
        for _ in range(o.max_refinements):
            new = dot(shadow[:, live], r[:, live])
            live, new = live[ok := (new != 0) & (omega[live] != 0)], new[ok]
            if not len(live):
                break
            p[:, live] = r[:, live] + (new / rho[live]) * (alpha[live] / omega[live]) * (p[:, live] - omega[live] * v[:, live])
            rho[live] = new
            ph = self.direct(p[:, live], trans)
            v[:, live] = self.multiply(ph, trans)
            den = dot(shadow[:, live], v[:, live])
            ph, live, den = ph[:, ok := den != 0], live[ok], den[ok]
            if not len(live):
                break
            alpha[live] = rho[live] / den
            s = r[:, live] - alpha[live] * v[:, live]
            sh = self.direct(s, trans)
            t = self.multiply(sh, trans)
            tt = dot(t, t)
            omega[live] = np.where(tt != 0, dot(t, s) / np.where(tt != 0, tt, 1), 0)
            z[:, live] += alpha[live] * ph + omega[live] * sh
            r[:, live] = b[:, live] - self.multiply(z[:, live], trans)
            self.iterations += len(live)
            now = size(r[:, live])
            better = np.isfinite(now) & (now < low[live])
            best[:, live[better]], low[live[better]] = z[:, live[better]], now[better]
            live = live[np.isfinite(now) & (low[live] > goal[live])]
            if not len(live):
                break
        return best


def _as(trans: str):
    return (lambda m: np.swapaxes(m, -1, -2).conj()) if trans == "H" else (lambda m: np.swapaxes(m, -1, -2))


def prepare(a: Analysis, row: np.ndarray, col: np.ndarray, val: np.ndarray) -> tuple[Factor, np.ndarray]:
    """A factor without its stacks, and the scaled values: what comes before elimination. ``message`` is set if the fill guard refuses."""
    o = a.options
    row, col, val = assemble(a.n, row, col, val)
    dr, dc = a.seed_row, a.seed_col
    if o.equilibrate:
        dr, dc = ruiz(a.n, row, col, np.abs(val).astype(float), dr, dc)
    out = Factor(a, row, col, val, dr, dc)
    if o.max_factor_nonzeros and a.structure.predicted() > o.max_factor_nonzeros:
        out.message = f"the factors would hold {a.structure.predicted()} scalars, more than the limit of {o.max_factor_nonzeros}"
    scaled = (val * dr[row] * dc[col]).astype(val.dtype)
    top = float(np.abs(scaled).max()) if len(scaled) else 0.0
    out.threshold = o.pivot_threshold if o.pivot_threshold is not None else math.sqrt(np.finfo(val.dtype).eps) * top
    return out, scaled


def factorize(a: Analysis, row: np.ndarray, col: np.ndarray, val: np.ndarray) -> Factor:
    """Multifrontal elimination, level by level of the tree of supernodes, all in this task."""
    out, scaled = prepare(a, row, col, val)
    if out.message:
        return out
    fronts = Fronts(a.n, a.structure)
    every = np.arange(len(fronts.first))
    out.stacks, _, out.replaced, out.message = eliminate(fronts, every, a.row_to[out.row], a.col_to[out.col], scaled, [], a.options.pivoting, out.threshold)
    out.ok = not out.message
    return out


# Arrays that a table holds.
def pack_stacks(stacks: list[Stack]) -> dict[str, np.ndarray]:
    out = {"shape": np.array([(s.level, *s.low.shape[:2], s.lu.shape[1]) for s in stacks], np.int64).reshape(-1, 4)}
    for name in ARRAYS:
        parts = [getattr(s, name).ravel() for s in stacks]
        out[name] = np.concatenate(parts) if parts else np.zeros(0)
    return out


def unpack_stacks(held: dict[str, np.ndarray]) -> list[Stack]:
    out, at = [], dict.fromkeys(ARRAYS, 0)
    for level, count, high, w in held["shape"].reshape(-1, 4).tolist():
        shapes = {"first": (count,), "rows": (count, high), "p": (count, w), "q": (count, w), "lu": (count, w, w), "l_inv": (count, w, w), "u_inv": (count, w, w), "low": (count, high, w), "up": (count, w, high)}
        got = {}
        for name, shape in shapes.items():
            size = math.prod(shape)
            got[name] = held[name][at[name] : at[name] + size].reshape(shape)
            at[name] += size
        out.append(Stack(level, **got))
    return out


def pack_analysis(a: Analysis) -> dict[str, np.ndarray]:
    s = a.structure
    rows = np.concatenate(s.rows).astype(np.int64) if s.rows else np.zeros(0, np.int64)
    note = json.dumps({"n": a.n, "perfect": bool(a.perfect), "ordering": a.ordering, "options": asdict(a.options)})
    return {
        "note": np.frombuffer(note.encode(), np.uint8), "match": a.match, "row_to": a.row_to, "col_to": a.col_to, "seed_row": a.seed_row, "seed_col": a.seed_col,
        "parent": s.parent, "first": s.first, "last": s.last, "below": s.below, "rows": rows, "level": s.level, "counts": s.counts,
    }


def unpack_analysis(held: dict[str, np.ndarray]) -> Analysis:
    note = json.loads(held["note"].tobytes())
    rows = np.split(held["rows"], np.cumsum(held["below"])[:-1]) if len(held["below"]) else []
    structure = sy.Structure(held["parent"], held["first"], held["last"], rows, held["level"], held["counts"])
    return Analysis(note["n"], SolveOptions(**note["options"]), held["match"], note["perfect"], held["row_to"], held["col_to"], held["seed_row"], held["seed_col"], structure, note["ordering"])
