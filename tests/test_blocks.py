"""Blocks of a system are found, and solved apart."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.operators import blocks as bl
from lumenfold.operators import factored as fd
from lumenfold.operators import pattern as pt
from lumenfold.operators import solve as so
from lumenfold.operators.factored import Solver
from lumenfold.sources import generate as gen


def copies(spark, k=3, side=5):
    """k grids, their indices interleaved."""
    a = gen.laplacian2d(spark, side, side).crossJoin(spark.range(k).withColumnRenamed("id", "c"))
    return a.select((F.col("row") * k + F.col("c")).alias("row"), (F.col("col") * k + F.col("c")).alias("col"), (F.col("val") * (1 + F.col("c"))).alias("val"))


@pytest.mark.parametrize("links", [bl.LINKS, 4])
def test_components(spark, monkeypatch, links):
    """Chains, a diagonal entry alone and two systems; in one task and in rounds."""
    monkeypatch.setattr(bl, "LINKS", links)
    edges = [(0, i, i + 1) for i in range(20) if i != 9] + [(0, 30, 30), (1, 5, 2), (1, 2, 2)]
    a = spark.createDataFrame(edges, "system_id long, row long, col long").repartition(5)
    got = {(r.system_id, r.idx): r.block for r in bl.components(a).collect()}
    want = {(0, i): 0 if i < 10 else 10 for i in range(21)} | {(0, 30): 30, (1, 5): 2, (1, 2): 2}
    assert got == want


def test_blocks_are_tasks_of_their_own(spark):
    a, table = bl.split(so.complex_parts(so.keyed(copies(spark))).select("system_id", "row", "col", "re", "im"), 75)
    assert sorted(r["count"] for r in table.groupBy("block").count().collect()) == [25, 25, 25]
    assert a.groupBy("system_id", "block").count().count() == 3 and a.count() == copies(spark).count()


@pytest.mark.parametrize("trans", ["N", "T"])
def test_split_solution(spark, trans):
    """The known solution; a right-hand side with entries in one block only is zero in the others; an index without entries keeps the system whole."""
    a, x = copies(spark), gen.ramp(spark, 75, 2)
    b = pt.multiply(a, x, transpose=trans == "T")
    got = so.solve(a, b, split=True, n=75, trans=trans).collect()
    assert len(got) == 150 and all(abs(r.val - 1 - 0.25 * (r.idx % 5) - r.rhs_id) < 1e-9 for r in got)
    one = b.where("rhs_id = 0 AND idx % 3 = 0")
    got = {r.idx: r.val for r in so.solve(a, one, split=True, n=75, trans=trans).collect()}
    assert len(got) == 75 and all(abs(v - (1 + 0.25 * (i % 5) if i % 3 == 0 else 0)) < 1e-9 for i, v in got.items())
    plain, split = (sorted((r.idx, r.val) for r in so.solve(a, one, n=80, trans=trans, split=s).collect()) for s in (False, True))
    assert np.array_equal(plain, split, equal_nan=True)


def test_kept_factors_by_blocks(spark):
    """Factors of blocks solve, multiply back in the whole numbering, take new values, and tell how it went."""
    a, x = copies(spark), gen.ramp(spark, 75, 2)
    for jobs in (1, 3):
        s = Solver(spark, jobs=jobs, split=True).compute(a)
        assert s.factorizations.value == 3
        for trans in "NT":
            got = s.solve(pt.multiply(a, x, transpose=trans == "T"), trans).collect()
            assert len(got) == 150 and all(abs(r.val - 1 - 0.25 * (r.idx % 5) - r.rhs_id) < 1e-9 for r in got)
        assert [r.status for r in s.status().collect()] == ["success"]
        dense = {}
        for name, part in (("l", s.lower()), ("u", s.upper()), ("lu", s.product()), ("a", a)):
            dense[name] = np.zeros((75, 75))
            for r in part.collect():
                dense[name][r.row, r.col] += r.val
        p, scale = s.permutation().collect(), s.scales().collect()
        row, col, dr, dc = (np.zeros(75) for _ in range(4))
        for r in p:
            row[r.orig], col[r.orig] = r.row, r.col
        for r in scale:
            dr[r.idx], dc[r.idx] = r.row_scale, r.col_scale
        assert np.array_equal(dense["l"], np.tril(dense["l"])) and np.array_equal(dense["u"], np.triu(dense["u"]))
        assert np.allclose(dense["l"] @ dense["u"], dense["lu"], atol=1e-12)
        back = dense["lu"][np.ix_(row.astype(int), col.astype(int))] / dr[:, None] / dc
        assert np.allclose(back, dense["a"])
        twice = a.withColumn("val", 2 * F.col("val"))
        got = s.factorize(twice).solve(pt.multiply(a, x)).collect()
        assert all(abs(2 * r.val - 1 - 0.25 * (r.idx % 5) - r.rhs_id) < 1e-9 for r in got)
        s.drop()


def test_product_by_blocks_and_lanes(spark):
    a, x = copies(spark), gen.ramp(spark, 75, 5)
    got = {(r.idx, r.rhs_id): r.re for r in Solver(spark, split=True).compute(a).multiply(x, 3).collect()}
    want = {(r.idx, r.rhs_id): r.val for r in pt.multiply(a, x).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_compute_is_one_pass(spark):
    """Analysis and factor of a block come from one task: one table is written, and right-hand sides have as many lanes as tasks are free."""
    a = copies(spark)
    s = Solver(spark, split=True).compute(a)
    assert s.made == 1 and s.factorizations.value == 3
    assert [s._lanes(k) for k in (1, 120)] == [1, 2] and s.tasks >= 3 * bl.SHARE


def test_right_hand_sides_some_at_a_time(spark, monkeypatch):
    """Solved two at a time, with the blocks that the product gave them: the same solutions, and one norm for each block."""
    monkeypatch.setattr(fd, "ONCE", 50)
    a, x = copies(spark), gen.ramp(spark, 75, 5)
    s = Solver(spark, split=True).compute(a)
    b = s.multiply(x, 3)
    assert "block" in b.columns
    got = s.solve(b).collect()
    assert len(got) == 375 and all(abs(r.val - 1 - 0.25 * (r.idx % 5) - r.rhs_id) < 1e-9 for r in got)
    assert s.norms.count() == 3 and [r.status for r in s.status().collect()] == ["success"] and s.solved.value == 15
