"""Registries and manifests of test matrices: tiers, availability, verification, proposals; and verdicts on solvers run over them."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenfold.functions.compare import symmetry_band

#: Sizes of matrices, ascending, in registries and in manifests.
REGISTRY_TIERS, MANIFEST_TIERS = ("small", "large", "huge"), ("quick", "standard", "large")
#: The setting that moves a registry's folder.
FOLDER_SETTING = "spark.lumenfold.testdata"


def _rank(tier: Column, tiers: Sequence[str]) -> Column:
    return F.array_position(F.array(*[F.lit(t) for t in tiers]), tier)


def at_most(table: DataFrame, tier: str, tiers: Sequence[str]) -> DataFrame:
    """Rows of a tier or a smaller one; rows of an unknown tier are left out."""
    if tier not in tiers:
        raise ValueError(f"tier must be one of {tuple(tiers)}")
    return table.where(_rank(F.col("tier"), tiers).between(1, tiers.index(tier) + 1))


def registry(spark: SparkSession, rows: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """``label, relative, tier, note`` of a curated list held by the driver."""
    return spark.createDataFrame(list(rows), "label string, relative string, tier string, note string")


def registry_paths(table: DataFrame, tier: str, folder: str) -> DataFrame:
    """``label, path`` of the matrices up to a tier; the session's FOLDER_SETTING, if set, names the folder instead."""
    root = table.sparkSession.conf.get(FOLDER_SETTING, folder).rstrip("/")
    return at_most(table, tier, REGISTRY_TIERS).select("label", F.concat(F.lit(root + "/"), "relative").alias("path"))


def with_availability(manifest: DataFrame, folder: str) -> DataFrame:
    """``available``: whether ``folder/group/name.mtx`` (a file, or a folder of its parts) is there; one listing of the folder by the file system that holds it."""
    spark = manifest.sparkSession
    jvm, found = spark.sparkContext._jvm, set()
    root = jvm.org.apache.hadoop.fs.Path(folder)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(root):
        listing = files.listFiles(root, True)
        while listing.hasNext():
            path = listing.next().getPath()
            if not path.getName().endswith(".mtx"):
                path = path.getParent()  # a file in parts is a folder
            if path.getName().endswith(".mtx"):
                found.add((path.getParent().getName(), os.path.splitext(path.getName())[0]))
    here = spark.createDataFrame(sorted(found), "grp string, name string").withColumn("available", F.lit(True))
    return manifest.join(here, ["grp", "name"], "left").withColumn("available", F.coalesce("available", F.lit(False)))


def verify(manifest: DataFrame, index: DataFrame, close: float = 0.01) -> DataFrame:
    """``grp, name, problem``: manifest rows that the index does not have, or whose size, entries or symmetry (beyond ``close``) differ."""
    i = index.select("grp", "name", F.col("n").alias("i_n"), F.col("nnz").alias("i_nnz"), F.col("psym").alias("i_psym"))
    both = manifest.join(i, ["grp", "name"], "left")
    problem = (
        F.when(F.col("i_n").isNull(), "unknown").when(F.col("n") != F.col("i_n"), "n").when(F.col("nnz") != F.col("i_nnz"), "nnz").when(F.abs(F.col("psym") - F.col("i_psym")) > close, "psym")
    )
    return both.select("grp", "name", problem.alias("problem")).where("problem IS NOT NULL")


def propose(index: DataFrame, manifest: DataFrame, count: int, least: int = 1000, most: int = 60_000) -> DataFrame:
    """The ``count`` matrices to add: real, square, of fitting size, with three entries a row, not in the manifest; the one of fewest entries for each symmetry band and kind, fewest entries first."""
    fits = F.col("real") & ~F.col("binary") & (F.col("n") == F.col("cols")) & F.col("n").between(least, most) & (F.col("nnz") >= 3 * F.col("n"))
    new = index.where(fits).join(manifest.select("grp", "name"), ["grp", "name"], "left_anti").withColumn("band", symmetry_band(F.col("psym")))
    by = W.partitionBy("band", "kind").orderBy("nnz", "grp", "name")
    first = new.withColumn("__r", F.row_number().over(by)).where("__r = 1").drop("__r")
    return first.orderBy("nnz", "grp", "name").limit(count).select("grp", "name", "n", "nnz", "psym", "band", "kind")


def spread(manifest: DataFrame) -> DataFrame:
    """``band, tier, n, entries``: matrices and their entries by symmetry band and tier."""
    return manifest.groupBy(symmetry_band(F.col("psym")).alias("band"), "tier").agg(F.count(F.lit(1)).alias("n"), F.sum("nnz").alias("entries"))


def judged(reports: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """``matrix, solver, outcome, honest`` from reports ``matrix, solver, status, message, factorized, residual, measured``.

    Solved: claimed, and the measured residual agrees (else not honest). Flagged: factored, but the solver itself calls its answer bad (honest only if it
    is). Declined: refused to factor (honest only with a reason). Error: anything else, never honest.
    """
    good = F.col("measured").isNotNull() & ~F.isnan("measured") & (F.col("measured") < tolerance)
    outcome = F.when(F.col("status") == "error", "error").when(F.col("status") == "success", "solved").when(F.col("factorized"), "flagged").when(F.col("status") == "numerical_issue", "declined").otherwise("error")
    honest = F.when(F.col("outcome") == "solved", good).when(F.col("outcome") == "flagged", ~good).when(F.col("outcome") == "declined", F.length("message") > 0).otherwise(F.lit(False))
    return reports.withColumn("outcome", outcome).select("matrix", "solver", "outcome", F.coalesce(honest, F.lit(False)).alias("honest"))


def agreement(reports: DataFrame) -> DataFrame:
    """``matrix, feasible, fill``: whether all solvers agree that a matrix can be factored, and, where they did, on its fill."""
    done = F.col("factorized")
    return reports.groupBy("matrix").agg((F.min(done.cast("int")) == F.max(done.cast("int"))).alias("feasible"), F.coalesce(F.min(F.when(done, F.col("nnz_l"))) == F.max(F.when(done, F.col("nnz_l"))), F.lit(True)).alias("fill"))


def phase_shares(times: DataFrame) -> DataFrame:
    """``threads, phase, ms, share, speedup``: the best time of each phase, its share of all phases, and its gain over the fewest threads (``phase, threads, ms``)."""
    best = times.groupBy("threads", "phase").agg(F.min("ms").alias("ms"))
    first = F.first("ms").over(W.partitionBy("phase").orderBy("threads"))
    return best.select("threads", "phase", "ms", (F.col("ms") / F.sum("ms").over(W.partitionBy("threads"))).alias("share"), (first / F.col("ms")).alias("speedup"))
