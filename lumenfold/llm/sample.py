"""Labelled documents for fitting a classifier: all, or a bounded sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_col: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def known(labels: DataFrame, id_col: str, label_col: str, fit: Column) -> DataFrame:
    """``__id, label`` of every labelled id for which ``fit`` holds. An id labelled both ways says nothing and is left out; one labelled alike more than once counts once."""
    some = labels.where(fit & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("label"))
    return some.groupBy("__id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other")


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, fit: Column, most: int) -> DataFrame:
    """``id, text, label`` of at most ``most`` labelled documents for which ``fit`` (on the labels' id) holds: those of least hash, so any run draws the same."""
    few = known(labels, id_col, label_col, fit).orderBy(F.xxhash64(F.lit(5), "__id"), "__id").limit(most)
    # At most `most` ids and labels: a few hundred kB.
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(few), F.col("id") == F.col("__id")).select("id", "text", "label")
