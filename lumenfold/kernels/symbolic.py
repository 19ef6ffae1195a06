"""Orderings, elimination tree, supernodes and levels of a symmetric pattern given as neighbour lists."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values: sorting is faster here than hashing."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def neighbours(n: int, row: np.ndarray, col: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct neighbours of each node in the pattern's union with its transpose, without the diagonal."""
    off = row != col
    code = np.concatenate([row[off] * n + col[off], col[off] * n + row[off]])
    code.sort()
    if len(code):
        code = code[np.concatenate([[True], code[1:] != code[:-1]])]
    return np.split(code % n, np.searchsorted(code, np.arange(1, n) * n)) if n else []


def _expand(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indices start[i] .. start[i] + size[i] - 1, one run after another."""
    total = int(size.sum())
    return np.arange(total) + np.repeat(start - np.cumsum(size) + size, size)


class _Quotient:
    """Quotient graph as arrays: edges among variables that no element covers, and members of elements (named by their pivot)."""

    def __init__(self, n: int, src: np.ndarray, dst: np.ndarray):
        self.n, self.src, self.dst = n, src, dst
        self.element, self.member = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.alive, self.exact = np.ones(n, bool), np.ones(n, bool)
        self.degree = np.bincount(src, minlength=n)
        self.left = n

    def bound(self) -> None:
        """For variables whose neighbourhood changed, a lower bound of the degree: own edges and the largest element."""
        self.size = np.bincount(self.element, minlength=self.n)
        self.own = np.bincount(self.src, minlength=self.n)
        self.largest = np.zeros(self.n, np.int64)
        np.maximum.at(self.largest, self.member, self.size[self.element] - 1)
        low = self.own + self.largest
        self.degree = np.where(self.exact, self.degree, low)

    def measure(self, some: np.ndarray) -> None:
        """Degrees, bounded from above: own edges, the largest element, and of every other element what lies outside the largest."""
        n = self.n
        mark = np.zeros(n, bool)
        mark[some] = True
        m = mark[self.member]
        element, member = self.element[m], self.member[m]
        order = np.lexsort((element, self.size[element], member))
        base = np.full(n, -1)
        base[member[order]] = element[order]  # the last of each is its largest
        inside = np.zeros(n, bool)
        inside[base[some][base[some] >= 0]] = True
        # Members that an element shares with a base: pairs of the elements of each member of a base.
        by = np.argsort(self.member, kind="stable")
        start = np.concatenate([[0], np.cumsum(np.bincount(self.member, minlength=n))])
        held = inside[self.element]
        b, v = self.element[held], self.member[held]
        many = start[v + 1] - start[v]
        pair = np.sort(np.repeat(b, many) * n + self.element[by][_expand(start[v], many)])
        new = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else pair
        pair, shared = pair[new], np.diff(np.append(new, len(pair)))
        rest = element != base[member]
        element, member = element[rest], member[rest]
        key = base[member] * n + element
        outside = self.size[element] - shared[np.searchsorted(pair, key)] if len(key) else key
        more = np.bincount(member, outside, n).astype(np.int64)
        self.degree[some] = np.minimum(self.own + self.largest + more, self.left - 1)[some]
        self.exact[some] = True

    def independent(self, some: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """A maximal set of variables, by rank, no two of which are joined."""
        n, none = self.n, np.iinfo(np.int64).max
        key = np.full(n, none)
        key[some[np.lexsort((rank[some], self.degree[some]))]] = np.arange(len(some))
        out = []
        near = (key[self.src] < none) & (key[self.dst] < none)
        src, dst = self.src[near], self.dst[near]
        inside = key[self.member] < none
        element, member = self.element[inside], self.member[inside]
        while True:
            now = some[key[some] < none]
            if not len(now):
                return np.concatenate(out)
            best, least = np.full(n, none), np.full(n, none)
            np.minimum.at(best, src, key[dst])
            np.minimum.at(least, element, key[member])
            np.minimum.at(best, member, least[element])
            won = now[key[now] <= best[now]]
            out.append(won)
            hit = np.zeros(n, bool)
            hit[won] = True
            touched = np.zeros(n, bool)
            touched[element[hit[member]]] = True
            key[won] = none
            key[dst[hit[src]]] = none
            key[member[touched[element]]] = none

    def eliminate(self, pivots: np.ndarray) -> None:
        """Each of these variables, no two joined, becomes an element; the elements it touched are absorbed."""
        n = self.n
        hit = np.zeros(n, bool)
        hit[pivots] = True
        into = np.full(n, -1)
        own = hit[self.member]
        into[self.element[own]] = self.member[own]
        gone = into[self.element] >= 0
        edge = hit[self.src]
        name = np.concatenate([self.src[edge], into[self.element[gone]]])
        who = np.concatenate([self.dst[edge], self.member[gone]])
        pair = distinct((name * n + who)[~hit[who]])
        self.element = np.concatenate([self.element[~gone], pair // n])
        self.member = np.concatenate([self.member[~gone], pair % n])
        keep = ~(hit[self.src] | hit[self.dst])
        self.src, self.dst = self.src[keep], self.dst[keep]
        self.alive[pivots] = False
        self.left -= len(pivots)
        self.exact[pair % n] = False
        # Edges inside a new element are covered by it.
        new = np.zeros(n, bool)
        new[pair % n] = True
        both = np.flatnonzero(new[self.src] & new[self.dst])
        if len(both):
            order = np.argsort(pair % n, kind="stable")
            many = np.bincount(pair % n, minlength=n)
            start = np.concatenate([[0], np.cumsum(many)])[:-1]
            u = self.src[both]
            at = _expand(start[u], many[u])
            key = (pair // n)[order][at] * n + np.repeat(self.dst[both], many[u])
            place = np.minimum(np.searchsorted(pair, key), len(pair) - 1)
            covered = np.zeros(len(self.src), bool)
            covered[np.repeat(both, many[u])[pair[place] == key]] = True
            self.src, self.dst = self.src[~covered], self.dst[~covered]

    def drop(self, gone: np.ndarray) -> None:
        """Variables whose neighbours form one element already: they go without a trace but in it."""
        hit = np.zeros(self.n, bool)
        hit[gone] = True
        home = np.full(self.n, -1)
        own = hit[self.member]
        full = own & (self.size[self.element] - 1 == self.degree[self.member])
        home[self.member[full]] = self.element[full]
        held = np.zeros(self.n, bool)
        held[self.element[own & (home[self.member] != self.element)]] = True
        homes = np.zeros(self.n, bool)
        homes[home[gone]] = True
        touched = self.member[homes[self.element]]
        keep = ~own & ~(held & ~homes)[self.element]
        self.element, self.member = self.element[keep], self.member[keep]
        self.alive[gone] = False
        self.left -= len(gone)
        self.exact[touched] = False


def min_degree(adj: list[np.ndarray], spread: float = 0.125) -> np.ndarray:
    """orig -> internal by approximate minimum external degree on the quotient graph, many variables a round.

    A round takes a maximal set of variables, no two joined, of degree at most (1 + ``spread``) times the least. Only variables
    whose lower bound is that small are measured. A variable whose neighbours are one element goes at once, as it adds no fill.
    """
    n = len(adj)
    order = np.full(n, -1)
    if not n:
        return order
    src = np.repeat(np.arange(n), [len(a) for a in adj])
    dst = np.concatenate(adj).astype(np.int64)
    rank = np.random.default_rng(1).permutation(n)
    q, done = _Quotient(n, src, dst), 0

    def place(some: np.ndarray) -> None:
        nonlocal done
        order[some] = done + np.arange(len(some))
        done += len(some)

    while done < n:
        q.bound()
        while True:
            live = np.flatnonzero(q.alive)
            least = q.degree[live].min()
            limit = least + int(spread * least)
            unsure = live[~q.exact[live] & (q.degree[live] <= limit)]
            if not len(unsure):
                break
            q.measure(unsure)
            plain = unsure[(q.own[unsure] == 0) & (q.degree[unsure] == q.largest[unsure]) & (q.largest[unsure] > 0)]
            if len(plain):
                place(plain[np.lexsort((rank[plain], q.degree[plain]))])
                q.drop(plain)
                if done == n:
                    return order
                q.bound()
        live = np.flatnonzero(q.alive)
        if least >= q.left - 1:
            place(live)
            break
        chosen = q.independent(live[q.exact[live] & (q.degree[live] <= limit)], rank)
        place(chosen[np.lexsort((rank[chosen], q.degree[chosen]))])
        q.eliminate(chosen)
    return order


def _frontiers(ptr: np.ndarray, dst: np.ndarray, part: np.ndarray, root: int, mark: int) -> list[np.ndarray]:
    """Levels of a breadth-first search from ``root`` inside the part ``mark``; it leaves the part's marks negated."""
    out, now = [], np.array([root])
    part[now] = -mark
    while len(now):
        out.append(now)
        nxt = dst[_expand(ptr[now], ptr[now + 1] - ptr[now])]
        now = distinct(nxt[part[nxt] == mark])
        part[now] = -mark
    return out


def dissection(adj: list[np.ndarray], leaf: int = 64, seed: int = 0) -> np.ndarray:
    """orig -> internal by nested dissection: the middle level of a breadth-first search from a far node separates each part.

    Parts of at most ``leaf`` nodes are ordered together by minimum degree; they come first, separators after them, the first cut last.
    """
    n = len(adj)
    order, rng = np.full(n, -1), np.random.default_rng(seed)
    if not n:
        return order
    ptr = np.concatenate([[0], np.cumsum([len(a) for a in adj])])
    dst = np.concatenate(adj).astype(np.int64)
    stack, top = [np.arange(n)], n
    part, inside = np.zeros(n, np.int64), np.zeros(n, bool)
    label = 0
    while stack:
        nodes = stack.pop()
        if len(nodes) <= leaf:
            inside[nodes] = True
            continue
        label += 1
        part[nodes] = label
        found = _frontiers(ptr, dst, part, int(nodes[rng.integers(len(nodes))]) if seed else int(nodes[0]), label)
        one = np.concatenate(found)
        if len(one) < len(nodes):
            stack += [one, nodes[part[nodes] == label]]
            continue
        part[nodes] = label
        found = _frontiers(ptr, dst, part, int(found[-1][0]), label)
        mid = int(np.searchsorted(2 * np.cumsum([len(x) for x in found]), len(nodes)))
        cut = found[mid]
        order[cut] = np.arange(top - len(cut), top)
        top -= len(cut)
        part[nodes] = 0
        part[cut] = -1
        stack += [np.concatenate(side) for side in (found[:mid], found[mid + 1 :]) if side]
    rest = np.flatnonzero(inside)
    number = np.full(n, -1)
    number[rest] = np.arange(len(rest))
    src = np.repeat(np.arange(n), np.diff(ptr))
    keep = inside[src] & inside[dst]
    # Leaves are parted by separators, so edges among leaf nodes stay inside their leaf.
    row, col = number[src[keep]], number[dst[keep]]
    cut = np.searchsorted(row, np.arange(1, len(rest)))
    if len(rest):
        order[rest] = min_degree(np.split(col, cut))
    return order


def column_degree(n: int, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """orig -> internal by minimum degree on the pattern of AᵀA."""
    by_row: dict[int, list[int]] = {}
    for r, c in zip(row.tolist(), col.tolist(), strict=True):
        by_row.setdefault(r, []).append(c)
    pairs = [np.array([(a, b) for a in cs for b in cs]).reshape(-1, 2) for cs in by_row.values()]
    p = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)
    return min_degree(neighbours(n, p[:, 0], p[:, 1]))


def relabel(adj: list[np.ndarray], order: np.ndarray) -> list[np.ndarray]:
    out: list[np.ndarray] = [None] * len(adj)
    for v, a in enumerate(adj):
        out[order[v]] = np.sort(order[a])
    return out


def elimination_tree(adj: list[np.ndarray]) -> np.ndarray:
    """Parent of each column, -1 for a root."""
    n = len(adj)
    parent, ancestor = np.full(n, -1), list(range(n))
    for i in range(n):
        for k in adj[i].tolist():
            while k < i:
                nxt, ancestor[k] = ancestor[k], i
                if nxt == k:
                    parent[k] = i
                    break
                k = nxt
                if k >= i:
                    break
    return parent


def postorder(parent: np.ndarray) -> np.ndarray:
    """node -> position, children in ascending order before their parent."""
    n = len(parent)
    kids: list[list[int]] = [[] for _ in range(n + 1)]
    for v in range(n - 1, -1, -1):
        kids[parent[v]].append(v)  # popped in ascending order; -1 collects the roots
    out, at, stack = np.full(n, -1), 0, [-1]
    while stack:
        v = stack[-1]
        if kids[v]:
            stack.append(kids[v].pop())
        else:
            stack.pop()
            if v >= 0:
                out[v], at = at, at + 1
    return out


@dataclass
class Structure:
    """Supernodes ``[first, last]`` with their rows below, in internal numbering."""

    parent: np.ndarray
    first: np.ndarray
    last: np.ndarray
    rows: list[np.ndarray]
    level: np.ndarray
    counts: np.ndarray

    @property
    def widths(self) -> np.ndarray:
        return self.last - self.first + 1

    @property
    def below(self) -> np.ndarray:
        return np.array([len(r) for r in self.rows], np.int64)

    def factor_nonzeros(self) -> int:
        """Of L with its diagonal; U has as many."""
        w, r = self.widths, self.below
        return int((w * (w + 1) // 2 + r * w).sum())

    def predicted(self) -> int:
        w, r = self.widths, self.below
        return int(((w + r) * w + w * r).sum())

    def of(self) -> np.ndarray:
        """Supernode of each column."""
        return np.repeat(np.arange(len(self.first)), self.widths)

    def blocks(self) -> list[tuple[int, int, int, int, int, int]]:
        """Row blocks: supernode, block, first row, last row, the supernode faced, offset in the panel."""
        of, out = self.of(), []
        for s, r in enumerate(self.rows):
            if len(r):
                cut = np.flatnonzero((np.diff(r) != 1) | (np.diff(of[r]) != 0)) + 1
                for b, (x, y) in enumerate(zip(np.append(0, cut), np.append(cut, len(r)), strict=True)):
                    out.append((s, b, int(r[x]), int(r[y - 1]), int(of[r[x]]), int(self.widths[s] + x)))
        return out

    def sources(self) -> list[tuple[int, int, int]]:
        """Update sources: target supernode, source supernode, its first block that faces the target."""
        out: dict[tuple[int, int], int] = {}
        for s, b, _, _, t, _ in self.blocks():
            out.setdefault((t, s), b)
        return [(t, s, b) for (t, s), b in sorted(out.items())]


def analyze(adj: list[np.ndarray], relaxed: int = 4, most_zero: int = 4, fraction: float = 0.3, most_wide: int = 128, parent: np.ndarray | None = None) -> Structure:
    """Column structures and supernodes of a postordered pattern.

    Neighbouring columns of a chain merge if that adds no rows (and the first is the only child), if the supernode is
    narrower than ``relaxed``, or if the rows added are at most ``most_zero`` or ``fraction`` of those it has.
    """
    n = len(adj)
    parent = elimination_tree(adj) if parent is None else parent
    kids = np.bincount(parent[parent >= 0], minlength=n) if n else np.zeros(0, np.int64)
    pending: list[list[np.ndarray]] = [[] for _ in range(n)]
    counts = np.zeros(n, np.int64)
    first, rows = [], []
    for j in range(n):
        own = adj[j][adj[j] > j]
        below = distinct(np.concatenate([own, *pending[j]])) if pending[j] else own
        pending[j] = []
        counts[j] = len(below)
        if parent[j] >= 0:
            pending[parent[j]].append(below[below != parent[j]])
        merge = False
        if first and parent[j - 1] == j:
            width, have = j - first[-1], len(rows[-1]) - 1
            extra = len(below) - have
            merge = (extra == 0 and kids[j] == 1) or width < relaxed or extra <= most_zero or extra <= fraction * have
            merge = merge and not (most_wide and width >= most_wide)
        if merge:
            rows[-1] = below
        else:
            first.append(j)
            rows.append(below)
    first = np.array(first, np.int64)
    last = np.append(first[1:], n) - 1 if n else first
    out = Structure(parent, first, last, rows, np.zeros(len(first), np.int64), counts)
    of = out.of()
    for s, r in enumerate(rows):
        if len(r):
            to = of[r]
            np.maximum.at(out.level, to, out.level[s] + 1)
    return out


def moved_tree(parent: np.ndarray, to: np.ndarray) -> np.ndarray:
    """The tree of a pattern whose nodes move."""
    out = np.full(len(parent), -1)
    out[to] = np.where(parent >= 0, to[parent], -1)
    return out


def fill_of(adj: list[np.ndarray], order: np.ndarray) -> int:
    """Entries of L (with diagonal) under an ordering, without merging columns."""
    moved = relabel(adj, order)
    parent = elimination_tree(moved)
    post = postorder(parent)
    found = analyze(relabel(moved, post), 0, -1, -1.0, 1, moved_tree(parent, post))
    return int(found.counts.sum() + len(adj))
