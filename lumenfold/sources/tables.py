"""Systems built from ordinary tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenfold.functions.structs import rows as rows_of


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def supplier_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bipartite supplier-part matrix: parts first, then suppliers; a row's diagonal is 1 + its absolute sum."""
    li = read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity", "l_discount")
    parts = read(spark, sf_dir, "part").count()
    pair = li.groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"), F.sum(1 + F.col("l_discount")).alias("d"))
    both = rows_of("row col val", (F.col("l_suppkey") + parts, "l_partkey", "q"), ("l_partkey", F.col("l_suppkey") + parts, "d"))
    off = pair.select(F.explode(both).alias("e")).select("e.row", "e.col", "e.val")
    n = parts + read(spark, sf_dir, "supplier").count()
    rows = spark.range(n).withColumnRenamed("id", "row")
    diag = rows.join(off.groupBy("row").agg(F.sum(F.abs("val")).alias("s")), "row", "left").select("row", F.col("row").alias("col"), (1 + F.coalesce("s", F.lit(0.0))).alias("val"))
    return off.union(diag)


def event_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each user, I - 0.85 transposed transition probabilities between event types (numbered by name)."""
    ev = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    kinds = ev.select("event_type").distinct().withColumn("k", F.row_number().over(W.orderBy("event_type")).cast("long") - 1)
    step = ev.withColumn("to", F.lead("event_type").over(w)).where("to IS NOT NULL").groupBy("user_id", "event_type", "to").count()
    total = W.partitionBy("user_id", "event_type")
    p = step.withColumn("p", F.col("count") / F.sum("count").over(total))
    a, b = kinds.select(F.col("event_type"), F.col("k").alias("i")), kinds.select(F.col("event_type").alias("to"), F.col("k").alias("j"))
    off = p.join(a, "event_type").join(b, "to").select(F.col("user_id").alias("system_id"), F.col("j").alias("row"), F.col("i").alias("col"), (-0.85 * F.col("p")).alias("val"))
    count = kinds.count()
    eye = ev.select("user_id").distinct().select(F.col("user_id").alias("system_id"), F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("row")).select("system_id", F.col("row").cast("long").alias("row"), F.col("row").cast("long").alias("col"), F.lit(1.0).alias("val"))
    return off.union(eye)


def ridge(spark: SparkSession, sf_dir: str, penalty: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Normal equations of the embeddings: EᵀE + penalty I, and Eᵀ of each label's indicator."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "v"))
    e = e.select("vec_id", "label", F.col("i").cast("long").alias("i"), F.col("v").cast("double").alias("v"))
    # Products inside each row: an array pair, so no join of the table with itself.
    rows = read(spark, sf_dir, "embeddings").select(F.col("embedding").alias("x")).select("x", F.posexplode("x").alias("i", "v")).select("i", "v", F.posexplode("x").alias("j", "u"))
    gram = rows.groupBy(F.col("i").cast("long").alias("row"), F.col("j").cast("long").alias("col")).agg(F.sum(F.col("v").cast("double") * F.col("u").cast("double")).alias("val"))
    gram = gram.select("row", "col", (F.col("val") + F.when(F.col("row") == F.col("col"), penalty).otherwise(0.0)).alias("val"))
    rhs = e.groupBy(F.col("i").alias("idx"), F.col("label").cast("int").alias("rhs_id")).agg(F.sum("v").alias("val"))
    return gram, rhs
