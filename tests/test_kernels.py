import itertools
import tracemalloc

import numpy as np
import pytest

from lumenfold.kernels import matching as mt
from lumenfold.kernels import solver as sv
from lumenfold.kernels import symbolic as sy
from lumenfold.plans.options import DYNAMIC, LEVELLED, SolveOptions

CHOICES = [LEVELLED, DYNAMIC, LEVELLED.but(matching="mc64", ordering="auto"), DYNAMIC.but(matching="mc64", refinement="stationary", ordering="column_degree"), LEVELLED.but(ordering="dissection", pivoting="none")]


def grid(g):
    i = np.arange(g * g)
    x, y = i % g, i // g
    row, col = [i], [i]
    for d, ok in ((1, x < g - 1), (-1, x > 0), (g, y < g - 1), (-g, y > 0)):
        row.append(i[ok])
        col.append(i[ok] + d)
    row, col = np.concatenate(row), np.concatenate(col)
    return g * g, row, col, np.where(row == col, 4.0, -1.0)


def draw(rng, n, kind=float):
    a = np.where(rng.random((n, n)) < 0.2, rng.normal(size=(n, n)), 0) * 10.0 ** rng.integers(-3, 4, (n, 1))
    a[np.arange(n), rng.permutation(n)] += rng.normal(size=n)
    return a + 1j * np.where(a != 0, rng.normal(size=(n, n)), 0) if kind is complex else a


@pytest.mark.parametrize("options", CHOICES)
@pytest.mark.parametrize("kind", [float, complex])
def test_solves_and_determinants_match_dense(options, kind):
    rng = np.random.default_rng(5)
    for _ in range(25):
        n = int(rng.integers(1, 35))
        a = draw(rng, n, kind)
        row, col = np.nonzero(a)
        f = sv.factorize(sv.analyze(n, row, col, a[row, col], options), row, col, a[row, col])
        assert f.ok, f.message
        x = rng.normal(size=(n, 2))
        for trans, op in (("N", a), ("T", a.T), ("H", a.conj().T)):
            y = f.solve(op @ x, trans)
            assert f.ok and np.abs(y - x).max() < 1e-6 * max(1, np.linalg.cond(a) * 1e-8)
        if not f.replaced:
            sign, log = np.linalg.slogdet(a)
            assert abs(log - f.log_abs_det()) < 1e-8 * max(1, abs(log)) + 1e-8 and abs(sign - f.det_sign()) < 1e-8


def test_max_product_is_optimal_and_scales():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(1, 6))
        a = rng.normal(size=(n, n)) * 10.0 ** rng.integers(-6, 7, (n, n))
        row, col = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(n)))
        match, perfect, dr, dc = mt.max_product(n, np.arange(n + 1) * n, row, a[row, col])
        assert perfect
        logs = np.log(np.abs(a))
        best = max(sum(logs[p[j], j] for j in range(n)) for p in itertools.permutations(range(n)))
        assert abs(logs[match, np.arange(n)].sum() - best) < 1e-8
        scaled = np.abs(a) * dr[:, None] * dc
        assert scaled.max() < 1 + 1e-9 and np.allclose(scaled[match, np.arange(n)], 1)


def test_transversal_is_a_permutation_and_reports_singular_patterns():
    n, row, col, val = grid(6)
    keep = col != 17
    ptr = np.searchsorted(np.sort(col[keep]), np.arange(n + 1))
    order = np.lexsort((row[keep], col[keep]))
    match, perfect = mt.transversal(n, ptr, row[keep][order], val[keep][order])
    assert not perfect and sorted(match) == list(range(n))


def test_fill_pins_the_direction_of_orderings():
    n, row, col, val = grid(30)
    base = sv.analyze(n, row, col, val, LEVELLED.but(ordering="natural")).structure.factor_nonzeros()
    for kind in ("min_degree", "dissection", "auto"):
        assert sv.analyze(n, row, col, val, LEVELLED.but(ordering=kind)).structure.factor_nonzeros() < 0.5 * base


def test_column_counts_match_elimination():
    rng = np.random.default_rng(2)
    for _ in range(20):
        n = int(rng.integers(1, 30))
        row, col = rng.integers(0, n, (2, 2 * n))
        adj = sy.neighbours(n, row, col)
        adj = sy.relabel(adj, sy.postorder(sy.elimination_tree(adj)))
        full = np.zeros((n, n), bool)
        for i, a in enumerate(adj):
            full[i, a] = True
        for k in range(n):
            later = np.flatnonzero(full[k] & (np.arange(n) > k))
            full[np.ix_(later, later)] = True
        found = sy.analyze(adj, 0, -1, -1.0, 1)
        assert found.counts.tolist() == [int((full[k] & (np.arange(n) > k)).sum()) for k in range(n)]


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_tiny(n):
    i = np.arange(n)
    row, col = np.concatenate([i, i[1:], i[:-1]]), np.concatenate([i, i[:-1], i[1:]])
    val = np.concatenate([3.0 + i, np.full(max(n - 1, 0), -1.0), np.full(max(n - 1, 0), -0.5)])
    f = sv.factorize(sv.analyze(n, row, col, val, LEVELLED), row, col, val)
    x = np.ones((n, 1))
    assert np.allclose(f.solve(f.multiply(x)), x)


def test_failures_are_reported():
    n, row, col, val = grid(8)
    a = sv.analyze(n, row, col, val, LEVELLED.but(max_factor_nonzeros=50))
    assert not sv.factorize(a, row, col, val).ok
    keep = (row != 9) & (col != 9)
    f = sv.factorize(sv.analyze(n, row[keep], col[keep], val[keep], LEVELLED), row[keep], col[keep], val[keep])
    if f.ok:
        f.solve(np.ones((n, 1)))
    assert not f.ok and f.message
    with pytest.raises(ValueError):
        SolveOptions(matching="other")
    with pytest.raises(ValueError):
        sv.assemble(2, np.array([2]), np.array([0]), np.array([1.0]))


def test_transversal_leaves_a_good_diagonal():
    """Two hubs whose rows hold somewhat larger entries than the leaves' own diagonal: exchanging them would fill the factors."""
    n = 40
    leaf, hub = np.arange(2, n), np.arange(2, n) % 2
    row = np.concatenate([np.arange(n), hub, leaf])
    col = np.concatenate([np.arange(n), leaf, hub])
    val = np.concatenate([[900.0, 900.0], np.full(n - 2, 30.0), np.full(n - 2, 50.0), np.ones(n - 2)])
    row, col, val = sv.assemble(n, row, col, val)
    match, perfect = mt.transversal(n, np.searchsorted(col, np.arange(n + 1)), row, val)
    assert perfect and (match == np.arange(n)).all()


@pytest.mark.parametrize("kind", [float, complex])
def test_product_in_pieces(monkeypatch, kind):
    monkeypatch.setattr(sv, "PAIRS", 50)
    n, row, col, val = grid(6)
    f = sv.factorize(sv.analyze(n, row, col, val.astype(kind), LEVELLED.but(dtype="complex128" if kind is complex else "float64")), row, col, val * (1 + 1j if kind is complex else 1))
    low, up, got = (np.zeros((n, n), kind) for _ in range(3))
    for out, part in ((low, f.triangle("lower")), (up, f.triangle("upper"))):
        out[part[0], part[1]] = part[2]
    pieces = list(f.product())
    for i, j, v in pieces:
        got[i, j] += v
    assert len(pieces) > 5 and np.allclose(got, low @ up)


def test_product_goes_by_fronts(monkeypatch):
    """No list of all products of an entry of L and one of U is made, of which a dense end has a third of its size cubed."""
    n = 60
    row, col = np.indices((n, n)).reshape(2, -1)
    val = np.where(row == col, 100.0, 1.0 + row % 7)
    f = sv.factorize(sv.analyze(n, row, col, val, DYNAMIC.but(max_block=16)), row, col, val)
    monkeypatch.setattr(sv.sy, "_expand", lambda *_: pytest.fail("products of entries are listed"))
    got = np.zeros((n, n))
    for i, j, v in f.product():
        got[i, j] += v
    (r, c), want = f.pivoted(), np.zeros((n, n))
    want[np.ix_(r[f.a.row_to], c[f.a.col_to])] = val.reshape(n, n) * f.dr[:, None] * f.dc
    assert np.allclose(got, want)


def star(leaves, hub, picks, rnd):
    """Leaves that each join some of a few hub nodes: every leaf's update goes to the one front of the hub."""
    leaf = np.repeat(np.arange(leaves), picks)
    to = leaves + np.concatenate([rnd.choice(hub, picks, replace=False) for _ in range(leaves)])
    n, val = leaves + hub, rnd.random(len(leaf)) + 0.5
    row, col = np.concatenate([leaf, to]), np.concatenate([to, leaf])
    val = np.concatenate([val, val * 0.7])
    diag = 1 + np.bincount(row, val, n)
    return n, np.concatenate([row, np.arange(n)]), np.concatenate([col, np.arange(n)]), np.concatenate([val, diag])


def peak_of(f):
    tracemalloc.start()
    try:
        return f(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_updates_do_not_pile_up_before_a_front():
    n, row, col, val = star(6000, 200, 30, np.random.default_rng(2))
    an = sv.analyze(n, row, col, val, DYNAMIC)
    f, peak = peak_of(lambda: sv.factorize(an, row, col, val))
    kept = sum(getattr(s, a).nbytes for s in f.stacks for a in sv.ARRAYS)
    updates = int((an.structure.below**2).sum()) * 8
    assert updates > 40e6 and peak < kept + 9 * len(row) * 8 + 0.8 * updates
    x = 1 + 0.25 * (np.arange(n) % 5)
    assert abs(f.solve(np.bincount(row, val * x[col], n)[:, None])[:, 0] - x).max() < 1e-10


def test_greatest_product_holds_costs_as_arrays():
    n, *entries = star(6000, 200, 30, np.random.default_rng(2))
    row, col, val = sv.assemble(n, *entries)
    (match, perfect, *_), peak = peak_of(lambda: mt.max_product(n, np.searchsorted(col, np.arange(n + 1)), row, val))
    assert perfect and (match == np.arange(n)).all() and peak < 5 * (row.nbytes + val.nbytes) / 2
