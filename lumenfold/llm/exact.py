"""Exact deduplication by skew-safe combining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.rows import pick, row_key

#: Characters that do not count: ``[\x20\x09-\x0D]``.
BLANK = " \t\n\x0b\x0c\r"


def normalized(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANK, "")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """Find the row that stays of every group of equal texts.

    Texts are equal when identical once blanks are deleted; null counts as empty. The row with the
    most code points stays, then the smallest id (a null id loses ties). Three combining stages, each grouping by
    the full content next to its digest: within a task (map-side aggregation), by salted digest (a
    group of a third of all rows reaches each salt as one row a task), then over the salts' winners.
    Returns ``id, keep_id, group_size, kept, text_sha256``, one row per input row. Rows that repeat
    both id and text share one verdict. Ids may be of any type that sorts. An empty table gives no rows; other columns are not read.
    """
    norm = normalized(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm"), F.char_length(F.coalesce(F.col(text_col), F.lit(""))).alias("size"))
    keyed = rows.select("doc_id", "size", "norm", F.sha2("norm", 256).alias("digest"), F.xxhash64("norm").alias("second"))
    local = keyed.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts))).groupBy("digest", "second", "norm", "salt")
    best = F.min(F.struct((-F.col("size")).alias("less"), F.col("doc_id").isNull().alias("none"), "doc_id"))
    salted = local.agg(best.alias("best"), F.count(F.lit(1)).alias("n"))
    winners = salted.groupBy("digest", "second", "norm").agg(F.min("best").alias("best"), F.sum("n").alias("group_size"))
    kept = winners.select("digest", "second", F.col("best.doc_id").alias("keep_id"), "group_size")
    out = keyed.select("doc_id", "digest", "second").join(kept, ["digest", "second"])
    return out.select(
        F.col("doc_id").alias(id_col), "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256")
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of every group of equal texts, with all its columns: that of ``exact_dedup``.

    Of rows that repeat its id too, the one with the most code points stays, once.
    """
    stay = exact_dedup(docs, id_col, text_col).where("kept").select(row_key(F.col("text_sha256"), F.col(id_col)).alias("__stay")).distinct()
    key = row_key(F.sha2(normalized(F.col(text_col)), 256), F.col(id_col))
    return pick(docs, key, stay, F.char_length(F.coalesce(F.col(text_col), F.lit(""))))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS size, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), r AS (
  SELECT doc_id, sha256(norm) AS text_sha256,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY size DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r
"""
