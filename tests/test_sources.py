import pytest
from pyspark.sql import functions as F

from lumenfold.operators import solve as so
from lumenfold.sources import generate as gen
from lumenfold.sources import matrixmarket as mm

CASES = {
    "general": ("coordinate real general\n% note\n3 3 2\n1 1 2.5\n3 2 -1", {(0, 0): 2.5, (2, 1): -1}),
    "symmetric": ("coordinate real symmetric\n2 2 2\n1 1 4\n2 1 3", {(0, 0): 4, (1, 0): 3, (0, 1): 3}),
    "skew": ("coordinate real skew-symmetric\n2 2 1\n2 1 3", {(1, 0): 3, (0, 1): -3}),
    "pattern": ("coordinate pattern symmetric\n2 2 1\n2 1", {(1, 0): 1, (0, 1): 1}),
    "array": ("array real general\n3 2\n1\n0\n2\n3\n4\n5", {(0, 0): 1, (2, 0): 2, (0, 1): 3, (1, 1): 4, (2, 1): 5}),
    "tolerant": ("  COORDINATE   Real General\n\n% x\n1 1 1\r\n\n1 1 7\r", {(0, 0): 7}),
}


@pytest.mark.parametrize("name", CASES)
def test_matrixmarket(spark, tmp_path, name):
    text, want = CASES[name]
    (p := tmp_path / "a.mtx").write_text("%%MatrixMarket matrix " + text.lstrip())
    assert {(r.row, r.col): r.val for r in mm.read_matrix(spark, str(p)).collect()} == want


def test_hermitian():
    lines = iter("%%MatrixMarket matrix coordinate complex hermitian\n2 2 2\n1 1 1 0\n2 1 3 4".split("\n"))
    assert list(mm.entries(lines, True)) == [(0, 0, 1.0, 0.0), (1, 0, 3.0, 4.0), (0, 1, 3.0, -4.0)]


@pytest.mark.parametrize("text", ["1 1 1", "%%MatrixMarket matrix coordinate real odd\n1 1 1\n1 1 1", "%%MatrixMarket matrix coordinate real general\n2 2 2\n1 1 1", "%%MatrixMarket matrix coordinate real general\n2 2 1\n3 1 1", "%%MatrixMarket matrix coordinate complex general\n1 1 1\n1 1 1 1"])
def test_malformed(text):
    with pytest.raises(ValueError):
        list(mm.entries(iter(text.split("\n")), False))


def test_baseline_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", "s", 1, 2, 3, 3, 1, 1e-16, 2.0), ("b", "s", 1, 2, 3, 3, 1, 1e-16, 2.0)], mm.BASELINE)
    new = spark.createDataFrame([("b", "s", 9, 2, 3, 3, 1, 1e-16, 2.0), ("c", "s", 1, 2, 3, 3, 1, 1e-16, 2.0)], mm.BASELINE)
    mm.write_baseline(mm.merge_baseline(rows, new), str(tmp_path / "base"))
    assert {(r.matrix, r.n) for r in mm.read_baseline(spark, str(tmp_path / "base")).collect()} == {("a", 1), ("b", 9), ("c", 1)}


def test_manifest(spark, tmp_path):
    (p := tmp_path / "m").write_text("# note\nHB one small 10 20 0.5 false odd kind of\n\nHB two large 10 20 1.0 true x\n")
    assert [r.kind for r in mm.read_manifest(spark, str(p)).orderBy("name").collect()] == ["odd kind of", "x"]


def test_nulls_are_refused_and_partitioning_changes_nothing(spark):
    a = gen.laplacian2d(spark, 4, 4)
    with pytest.raises(Exception, match="null in"):
        so.solve(a.withColumn("val", F.when(F.col("row") > 3, F.col("val"))), gen.ramp(spark, 16)).collect()
    r = gen.random_unsymmetric_pattern(spark, 60, 0.1, 1)
    assert sorted(r.repartition(7).collect()) == sorted(r.collect())


def test_stream(spark, tmp_path):
    from lumenfold.streaming.rhs import solve_stream

    gen.ramp(spark, 16).write.parquet(str(tmp_path / "in"))
    got = []
    stream = spark.readStream.schema("idx long, rhs_id int, val double").parquet(str(tmp_path / "in"))
    solve_stream(gen.laplacian2d(spark, 4, 4), stream, lambda df, _: got.extend(df.collect())).awaitTermination(120)
    assert len(got) == 16


def test_ranges_of_a_large_file(spark, tmp_path):
    """However a file is cut into ranges, its entries are the same; a file of several ranges that ends early is refused."""
    rows = [f"{1 + i % 50} {1 + i * 7 % 50} {i / 4}" for i in range(500)]
    text = "%%MatrixMarket matrix coordinate real symmetric\n% note\n\n50 50 500\n" + "\n".join(rows) + "\n"
    (p := tmp_path / "a.mtx").write_text(text)
    want = sorted(mm.read_matrix(spark, str(p)).collect())
    for size in (37, 400, 5000):
        assert sorted(mm.read_matrix(spark, str(p), range_bytes=size).collect()) == want
    p.write_text(text.replace("50 50 500", "50 50 501"))
    with pytest.raises(ValueError, match="early"):
        mm.read_matrix(spark, str(p), range_bytes=400)


def test_malformed_systems_are_reported_alone(spark):
    a = gen.laplacian2d(spark, 4, 4).join(spark.range(2).withColumnRenamed("id", "system_id")).union(spark.sql("SELECT 99L, 0L, 1.0D, 1L"))
    r = {x.system_id: x for x in so.report(so.run(a, None, so.SolveOptions(), n=16, on_error="report")).collect()}
    assert r[0].status == "success" and r[1].status == "error" and "outside" in r[1].message
