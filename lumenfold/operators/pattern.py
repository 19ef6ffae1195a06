"""Pattern, scaling and product operators on COO tables ``row, col, val``; all built-in expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenfold.functions.structs import rows as rows_of


def assemble(a: DataFrame) -> DataFrame:
    """Duplicates summed; stored zeros stay."""
    return a.groupBy("row", "col").agg(F.sum("val").alias("val"))


def edges(a: DataFrame) -> DataFrame:
    """``src, dst``: the pattern's union with its transpose, without the diagonal."""
    both = rows_of("src dst", ("row", "col"), ("col", "row"))
    return a.where("row <> col").select(F.explode(both).alias("e")).select("e.src", "e.dst").distinct()


def mirror_missing(a: DataFrame) -> DataFrame:
    """Off-diagonal entries whose mirror is not in the pattern."""
    off = a.where("row <> col").select("row", "col").distinct()
    return off.join(off.select(F.col("col").alias("row"), F.col("row").alias("col")), ["row", "col"], "left_anti")


def pattern_symmetry(a: DataFrame) -> DataFrame:
    """``symmetry, symmetric``: mirrored share of the off-diagonal entries; 1 without any. One grouping by unordered pair."""
    off = a.where("row <> col").groupBy(F.least("row", "col").alias("i"), F.greatest("row", "col").alias("j")).agg(F.max((F.col("row") < F.col("col")).cast("int")).alias("u"), F.max((F.col("row") > F.col("col")).cast("int")).alias("l"))
    m, both = F.coalesce(F.sum(F.col("u") + F.col("l")), F.lit(0)), F.coalesce(F.sum(F.when(F.col("u") + F.col("l") == 2, 2).otherwise(0)), F.lit(0))
    return off.agg(m.alias("m"), both.alias("b")).select(F.when(F.col("m") == 0, 1.0).otherwise(F.col("b") / F.col("m")).alias("symmetry"), (F.col("m") == F.col("b")).alias("symmetric"))


def pad(a: DataFrame) -> DataFrame:
    """Explicit zeros at missing mirrors."""
    both = rows_of("row col val", ("row", "col", "val"), ("col", "row", F.lit(0.0)))
    return assemble(a.select(F.explode(both).alias("e")).select("e.row", "e.col", "e.val"))


def relabel(a: DataFrame, perm: DataFrame) -> DataFrame:
    """Both indices through ``orig -> internal``."""
    r, c = perm.select(F.col("orig").alias("row"), F.col("internal").alias("r")), perm.select(F.col("orig").alias("col"), F.col("internal").alias("c"))
    return a.join(r, "row").join(c, "col").select(F.col("r").alias("row"), F.col("c").alias("col"), "val")


def permute_rows(a: DataFrame, match: DataFrame) -> DataFrame:
    """Row matching applied: row r moves to the column it is matched to (``row, col``)."""
    return a.join(match.select("row", F.col("col").alias("to")), "row").select(F.col("to").alias("row"), "col", "val")


def stats(a: DataFrame, n: int) -> DataFrame:
    rows = a.groupBy("row").agg(F.count(F.lit(1)).alias("k"))
    return rows.agg(F.coalesce(F.sum("k"), F.lit(0)).cast("long").alias("nnz"), F.coalesce(F.max("k"), F.lit(0)).cast("long").alias("most_in_row")).withColumn("n", F.lit(n).cast("long")).withColumn("density", F.col("nnz") / float(max(1, n) ** 2))


def norms(a: DataFrame) -> DataFrame:
    """``axis, idx, norm``: largest magnitude of every row and column, in one pass."""
    both = rows_of("axis idx", (F.lit("row"), "row"), (F.lit("col"), "col"))
    return a.select(F.explode(both).alias("k"), F.abs("val").alias("m")).groupBy("k.axis", "k.idx").agg(F.max("m").alias("norm"))


def scale(a: DataFrame, scales: DataFrame) -> DataFrame:
    """``row, col, val`` times its row's and column's scale (``axis, idx, scale``)."""
    r = scales.where("axis = 'row'").select(F.col("idx").alias("row"), F.col("scale").alias("r"))
    c = scales.where("axis = 'col'").select(F.col("idx").alias("col"), F.col("scale").alias("c"))
    return a.join(r, "row").join(c, "col").select("row", "col", (F.col("val") * F.col("r") * F.col("c")).alias("val"))


def ruiz(a: DataFrame, sweeps: int = 5, seed: DataFrame | None = None) -> DataFrame:
    """``axis, idx, scale`` after at most ``sweeps`` simultaneous row and column sweeps; stops once all norms are within 0.1 of 1.

    ``seed`` gives initial scales. Zero rows and columns keep theirs. The matrix is written once; each sweep is one grouping and one written table.
    """
    from lumenfold.plans.shared import checkpoint

    a = checkpoint(a.select("row", "col", "val"))
    found = checkpoint(seed if seed is not None else norms(a).select("axis", "idx", F.lit(1.0).alias("scale")))
    for _ in range(sweeps):
        now = norms(scale(a, found)).where("norm > 0")
        new = checkpoint(found.join(now, ["axis", "idx"], "left").select("axis", "idx", "norm", "scale"))
        far = new.agg(F.max(F.abs(1 - F.col("norm")))).first()[0]
        if far is None or far < 0.1:
            break
        found = new.select("axis", "idx", F.when(F.col("norm").isNotNull(), F.col("scale") / F.sqrt("norm")).otherwise(F.col("scale")).alias("scale"))
    return found


def pivot_threshold(a: DataFrame, scales: DataFrame) -> DataFrame:
    """sqrt(eps) times the largest scaled magnitude."""
    return scale(a, scales).agg((F.max(F.abs("val")) * F.lit(2.220446049250313e-16**0.5)).alias("threshold"))


def multiply(a: DataFrame, x: DataFrame, transpose: bool = False) -> DataFrame:
    """``idx, rhs_id, val`` = A x (or its transpose times x) for every right-hand side."""
    row, col = ("col", "row") if transpose else ("row", "col")
    keys = ["system_id"] if "system_id" in a.columns and "system_id" in x.columns else []
    m = a.select(*keys, F.col(row).alias("__to"), F.col(col).alias("idx"), F.col("val").alias("__a"))
    return m.join(x, [*keys, "idx"]).groupBy(*keys, F.col("__to").alias("idx"), "rhs_id").agg(F.sum(F.col("__a") * F.col("val")).alias("val"))


def residual(a: DataFrame, x: DataFrame, b: DataFrame, threshold: float = 1e-6) -> DataFrame:
    """``residual, status``: ||b - A x|| over all right-hand sides, relative to ||b|| (absolute if b = 0); non-finite or large is a numerical issue."""
    ax = multiply(a, x).select("idx", "rhs_id", F.col("val").alias("ax"))
    r = b.join(ax, ["idx", "rhs_id"], "full_outer").select(F.coalesce("val", F.lit(0.0)).alias("b"), (F.coalesce("val", F.lit(0.0)) - F.coalesce("ax", F.lit(0.0))).alias("r"))
    s = r.agg(F.sqrt(F.coalesce(F.sum(F.col("r") * F.col("r")), F.lit(0.0))).alias("r"), F.sqrt(F.coalesce(F.sum(F.col("b") * F.col("b")), F.lit(0.0))).alias("b"))
    out = s.select(F.when(F.col("b") > 0, F.col("r") / F.col("b")).otherwise(F.col("r")).alias("residual"))
    bad = F.isnan("residual") | (F.col("residual") == float("inf")) | (F.col("residual") > threshold)
    return out.withColumn("status", F.when(bad, "numerical_issue").otherwise("success"))


def candidates(a: DataFrame) -> DataFrame:
    """Matching candidates of each column: non-zero entries by falling magnitude, then row."""
    w = W.partitionBy("col").orderBy(F.desc(F.abs("val")), "row")
    return a.where("val <> 0").select("row", "col", "val", F.row_number().over(w).alias("rank"))


def costs(a: DataFrame) -> DataFrame:
    """ln(column maximum) - ln(magnitude) of the non-zero entries."""
    w = W.partitionBy("col")
    return a.where("val <> 0").select("row", "col", (F.ln(F.max(F.abs("val")).over(w)) - F.ln(F.abs("val"))).alias("cost"))
