"""Kept analyses and factors: how often they are made, and that splitting changes nothing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.kernels import solver as sv
from lumenfold.operators import pattern as pt
from lumenfold.operators.factored import Solver
from lumenfold.plans.options import DYNAMIC, LEVELLED
from lumenfold.sources import generate as gen
from lumenfold.streaming.rhs import solve_stream


def test_factored_once_solved_often(spark, tmp_path):
    a, x = gen.laplacian2d(spark, 9, 9), gen.ramp(spark, 81)
    s = Solver(spark).compute(a)
    for k in range(3):
        b = pt.multiply(a, x).withColumn("val", F.col("val") * (k + 1))
        assert all(abs(r.val - (k + 1) * (1 + 0.25 * (r.idx % 5))) < 1e-9 for r in s.solve(b).collect())
    assert (s.factorizations.value, s.solved.value) == (1, 3)
    for k in range(2):
        pt.multiply(a, x).withColumn("val", F.col("val") * (k + 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "b"))
    got = []
    stream = spark.readStream.schema("idx long, rhs_id int, val double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "b"))
    solve_stream(a, stream, lambda df, _: got.extend(df.collect()), solver=s).awaitTermination(120)
    assert len(got) == 162 and (s.factorizations.value, s.solved.value) == (1, 5)
    s.drop()


@pytest.mark.parametrize("options", [LEVELLED, DYNAMIC.but(matching="mc64", ordering="dissection", pivot_threshold=0.5)])
def test_jobs_change_nothing(spark, options):
    """The same factors however the tree is cut, replaced pivots and failures included."""
    a = gen.random_unsymmetric_pattern(spark, 150, 0.02, 5)
    b = gen.ramp(spark, 150)
    found = []
    for jobs in (1, 3, 7):
        s = Solver(spark, options, jobs=jobs, n=150).compute(a)
        found.append(sorted((r.idx, r.val) for r in s.solve(b).collect()))
        assert [r.status for r in s.status().collect()] == ["success"]
    assert np.allclose(found[0], found[1], rtol=1e-12) and np.allclose(found[0], found[2], rtol=1e-12)
    broken = a.where("row <> 70 AND col <> 70")
    s = Solver(spark, options, jobs=3, n=150).compute(broken)
    s.solve(b)
    assert [r.status for r in s.status().collect()] == ["numerical_issue"]


def test_triangles_multiply_back():
    rng = np.random.default_rng(4)
    for options in (LEVELLED, DYNAMIC.but(matching="mc64", ordering="dissection")):
        n = 40
        a = np.where(rng.random((n, n)) < 0.15, rng.normal(size=(n, n)), 0) + np.diag(rng.normal(size=n) * 3)
        row, col = np.nonzero(a)
        f = sv.factorize(sv.analyze(n, row, col, a[row, col], options), row, col, a[row, col])
        assert f.ok and not f.replaced
        low, up = np.zeros((n, n)), np.zeros((n, n))
        for out, which in ((low, "lower"), (up, "upper")):
            i, j, v = f.triangle(which)
            out[i, j] = v
        assert np.allclose(low, np.tril(low)) and np.allclose(up, np.triu(up)) and np.allclose(np.diag(low), 1)
        r, c = f.pivoted()
        want = np.zeros((n, n))
        want[np.ix_(r[f.a.row_to], c[f.a.col_to])] = a * f.dr[:, None] * f.dc
        assert np.allclose(low @ up, want)


def test_blocked_dense_factorization():
    rng = np.random.default_rng(9)
    a = rng.normal(size=(2, 150, 150))
    p, q, lu, bumped, zero = sv.dense_lu(a.copy(), "partial", 0.0)
    for k in range(2):
        assert np.allclose((np.tril(lu[k], -1) + np.eye(150)) @ np.triu(lu[k]), a[k][p[k]][:, q[k]])
    assert not bumped and not zero.any()


def test_updates_of_many_leaves_are_merged():
    """40 leaves that share 5 rows: their updates leave as 25 entries, the sum of all."""
    n, leaves = 45, np.arange(40)
    far = np.arange(40, 45)
    row = np.concatenate([np.arange(n), np.repeat(leaves, 5), np.tile(far, 40)])
    col = np.concatenate([np.arange(n), np.tile(far, 40), np.repeat(leaves, 5)])
    val = np.concatenate([np.full(n, 100.0), np.arange(1.0, 201), np.ones(200)])
    an = sv.analyze(n, row, col, val, LEVELLED.but(ordering="natural", matching="none", relaxed_width=0, equilibrate=False, pivoting="none"))
    f, scaled = sv.prepare(an, row, col, val)
    fronts = sv.Fronts(n, an.structure)
    ir, ic = an.row_to[f.row], an.col_to[f.col]
    low = np.flatnonzero(fronts.last < 40)
    mine = np.isin(fronts.of[np.minimum(ir, ic)], low)
    _, leaving, _, _ = sv.eliminate(fronts, low, ir[mine], ic[mine], scaled[mine], [], "none", 0.0)
    i, j, v = sv.merged(fronts, leaving, scaled.dtype)
    want = np.zeros((n, n))
    for k, block in leaving:
        r = fronts.rows[fronts.start[k] : fronts.start[k + 1]]
        want[np.ix_(r, r)] += block
    got = np.zeros((n, n))
    got[i, j] = v
    assert len(leaving) > 30 and len(i) == 25 and np.allclose(got, want)
