"""Test systems and right-hand sides from ``spark.range``; all hash-based, so partitioning cannot change them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions.structs import rows as rows_of

COO = ["row", "col", "val"]


def _stencil(spark: SparkSession, sizes: list[int], steps: list[tuple[int, ...]], diag: float) -> DataFrame:
    """Every grid point (the first size varies fastest) with its diagonal and -1 to each neighbour inside the grid."""
    total = 1
    for s in sizes:
        total *= s
    place, at, stride = [], F.col("id"), 1
    for s in sizes:
        place.append((F.floor(at / stride) % s).cast("long"))
        stride *= s
    entries = [F.struct(F.col("id").alias("col"), F.lit(float(diag)).alias("val"), F.lit(True).alias("inside"))]
    for step in steps:
        move, stride, inside = F.lit(0).cast("long"), 1, F.lit(True)
        for d, s, p in zip(step, sizes, place, strict=True):
            move = move + d * stride
            stride *= s
            inside = inside & (p + d >= 0) & (p + d < s)
        entries.append(F.struct((F.col("id") + move).alias("col"), F.lit(-1.0).alias("val"), inside.alias("inside")))
    return spark.range(total).select(F.col("id").alias("row"), F.explode(F.array(*entries)).alias("e")).where("e.inside").select("row", "e.col", "e.val")


def laplacian2d(spark: SparkSession, gx: int, gy: int) -> DataFrame:
    return _stencil(spark, [gx, gy], [(1, 0), (-1, 0), (0, 1), (0, -1)], 4)


def laplacian3d(spark: SparkSession, gx: int, gy: int, gz: int) -> DataFrame:
    return _stencil(spark, [gx, gy, gz], [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)], 6)


def upwind2d(spark: SparkSession, gx: int, gy: int) -> DataFrame:
    """Diagonal 4 and -1 to west and south; point i, j is i * gy + j."""
    return _stencil(spark, [gy, gx], [(-1, 0), (0, -1)], 4)


def uniform(seed: int, *cols: Column) -> Column:
    """A number in [0, 1) that depends only on the arguments: 48 bits of a digest, so that any engine finds the same."""
    digest = F.md5(F.concat_ws(",", F.lit(str(seed)), *[c.cast("string") for c in cols]).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") / float(1 << 48)


def _pairs(spark: SparkSession, n: int, p: float, seed: int) -> DataFrame:
    """Pairs i < j, each with probability p: a row skips from one pair to the next by geometric steps, so only pairs that exist are made.

    A row draws the steps that it needs on average, 12 standard deviations and 20 more.
    """
    i = F.col("id")
    if p <= 0:
        return spark.range(0).select(i.alias("i"), i.alias("j"))
    mean = (n - i) * min(p, 1.0)
    steps = F.sequence(F.lit(1), F.ceil(mean + 12 * F.sqrt(mean) + 20).cast("int"))
    drawn = spark.range(n).select(i.alias("i"), F.explode(steps).alias("k"))
    skip = F.lit(1.0) if p >= 1 else 1 + F.floor(F.ln(1 - uniform(seed, F.col("i"), F.col("k"))) / math.log(1 - p))
    place = drawn.withColumn("skip", skip).selectExpr("i", "i + CAST(sum(skip) OVER (PARTITION BY i ORDER BY k) AS LONG) AS j")
    return place.where(F.col("j") < n)


def _with_diagonal(spark: SparkSession, off: DataFrame, n: int, seed: int) -> DataFrame:
    return off.union(spark.range(n).select(F.col("id"), F.col("id"), n + uniform(seed + 9, F.col("id"))))


def random_symmetric_pattern(spark: SparkSession, n: int, p: float, seed: int) -> DataFrame:
    pair = _pairs(spark, n, p, seed)
    value = lambda a, b: 2 * uniform(seed + 1, F.col(a), F.col(b)) - 1
    off = pair.select(F.col("i").alias("row"), F.col("j").alias("col"), value("i", "j").alias("val")).union(pair.select("j", "i", value("j", "i")))
    return _with_diagonal(spark, off, n, seed)


def random_unsymmetric_pattern(spark: SparkSession, n: int, p: float, seed: int) -> DataFrame:
    pair = _pairs(spark, n, p, seed).withColumn("up", uniform(seed + 2, F.col("i"), F.col("j")) < 0.5)
    off = pair.select(F.when(F.col("up"), F.col("i")).otherwise(F.col("j")).alias("row"), F.when(F.col("up"), F.col("j")).otherwise(F.col("i")).alias("col"), (2 * uniform(seed + 1, F.col("i"), F.col("j")) - 1).alias("val"))
    return _with_diagonal(spark, off, n, seed)


def weak_diagonal(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """Tiny diagonal, strong neighbours, every third row coupled five further on; duplicates are summed."""
    i = F.col("id")
    u = lambda k: 2 * uniform(seed + k, i) - 1
    near = i + 1 < n
    parts = rows_of("row col val use", (i, i, 1e-3 * u(0), F.lit(True)), (i, i + 1, 2 + u(1), near), (i + 1, i, 2 + u(2), near), (i, (i + 5) % n, 1.5 + u(3), i % 3 == 0))
    return spark.range(n).select(F.explode(parts).alias("e")).where("e.use").groupBy("e.row", "e.col").agg(F.sum("e.val").alias("val"))


def ramp(spark: SparkSession, n: int, rhs: int = 1) -> DataFrame:
    """x(i) = 1 + (i mod 5) / 4, the same for each right-hand side but for its number added."""
    return spark.range(n).select(F.col("id").alias("idx"), F.explode(F.sequence(F.lit(0), F.lit(rhs - 1))).alias("rhs_id")).withColumn("val", 1 + 0.25 * (F.col("idx") % 5) + F.col("rhs_id"))


def sine(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("idx"), F.lit(0).alias("rhs_id"), (1 + 0.5 * F.sin(F.col("id").cast("double"))).alias("val"))


def seeded(spark: SparkSession, n: int, seed: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("idx"), F.lit(0).alias("rhs_id"), (2 * uniform(seed, F.col("id")) - 1).alias("val"))
