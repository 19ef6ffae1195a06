"""Comparing runs: baselines, outcomes, symmetry bands and timings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def against_baseline(old: DataFrame, new: DataFrame, fill: float = 0.05, worse: float = 10, least: float = 1e-6, slower: float = 3) -> DataFrame:
    """Verdict on each new row: declined before or now but not both, fill off by over 5%, residual over ten times (and over 1e-6), or time over three times."""
    o = old.select("matrix", "solver", *[F.col(c).alias(f"o_{c}") for c in ("nnz_l", "resid", "time_ms")])
    j = new.join(o, ["matrix", "solver"], "left")
    verdict = (
        F.when(F.col("o_nnz_l").isNull(), "new").when((F.col("o_nnz_l") < 0) != (F.col("nnz_l") < 0), "flipped").when(F.abs(F.col("nnz_l") - F.col("o_nnz_l")) > fill * F.col("o_nnz_l"), "fill")
        .when(F.col("resid") > F.greatest(F.lit(least), worse * F.col("o_resid")), "residual").when(F.col("time_ms") > slower * F.col("o_time_ms"), "time").otherwise("same")
    )
    return j.select("matrix", "solver", verdict.alias("verdict"))


def symmetry_band(psym: Column) -> Column:
    return F.when(psym >= 0.999, "sym").when(psym >= 0.5, "partial").otherwise("unsym")


def band_counts(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy(symmetry_band(F.col("psym")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


def outcomes(reports: DataFrame) -> DataFrame:
    """Solved, flagged (a residual too large or a singular factor) or declined (the guard)."""
    kind = F.when(F.col("status") == "success", "solved").when(F.col("message").contains("more than the limit"), "declined").otherwise("flagged")
    return reports.groupBy(kind.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def best_of(times: DataFrame) -> DataFrame:
    """Fastest configuration of each phase after the warm-up run 0 (``config, phase, run, ms``)."""
    return times.where("run > 0").groupBy("phase").agg(F.min_by("config", "ms").alias("config"), F.min("ms").alias("best_ms"))


def thread_table(times: DataFrame) -> DataFrame:
    """Phases by threads (``phase, threads, ms``)."""
    return times.groupBy("phase").pivot("threads").agg(F.min("ms"))
