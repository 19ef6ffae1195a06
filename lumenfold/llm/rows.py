"""Whole rows chosen by a key of their own, so that repeated and null ids neither multiply nor mix rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.store import Tables


def row_key(digest: Column, id_value: Column) -> Column:
    """A text key of digest and id; a null id has a key of its own."""
    return F.concat_ws(" ", digest.cast("string"), id_value.cast("string"))


def pick(docs: DataFrame, key: Column, stay: DataFrame, rank: Column) -> DataFrame:
    """One row of ``docs``, with all its columns, for each key that ``stay`` holds as its only column ``__stay`` (without repeats).

    Of rows with equal keys the one of highest rank is picked, then by a hash of the columns (maps aside). Join and choice share one shuffle.
    """
    hashed = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind]
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), key.alias("__key"), F.struct(rank.alias("rank"), F.xxhash64(*hashed).alias("tie")).alias("__rank"))
    found = row.join(stay, F.col("__key") == F.col("__stay")).groupBy("__key").agg(F.max_by("__row", "__rank").alias("__row"))
    return found.select("__row.*")


def positions(df: DataFrame, by: list[Column], tables: Tables) -> DataFrame:
    """``df`` with ``position``: each row's place in the order of ``by``, from 0, without one task holding all rows."""
    ranged = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id())
    placed = tables.keep(ranged.withColumn("__range", F.shiftright("__at", 33)).withColumn("__at", F.col("__at").bitwiseAND((1 << 33) - 1)))
    before, starts = 0, []
    for r in sorted(placed.groupBy("__range").count().collect()):  # one row a partition
        starts.append((r["__range"], before))
        before += r["count"]
    first = df.sparkSession.createDataFrame(starts, "__range long, __start long")
    return placed.join(F.broadcast(first), "__range").withColumn("position", F.col("__start") + F.col("__at")).drop("__range", "__start", "__at")


def join_spread(rows: DataFrame, table: DataFrame, key: str, hot: Column) -> DataFrame:
    """``rows`` with the columns of ``table``, which holds every value of the binary column ``key`` once.

    ``hot`` is true for at most some 10,000 rows of ``table``: those are broadcast, so that rows of one hot key stay where they are; all others
    meet by shuffle.
    """
    names = [c for c in table.columns if c != key]
    known = table.select(F.col(key).alias("__key"), F.struct(*names).alias("__value"), hot.alias("__hot"))
    few = F.broadcast(known.where("__hot").select(F.col("__key").alias("__few"), F.col("__value").alias("__found")))
    seen = rows.join(few, F.col(key) == F.col("__few"), "left").drop("__few")
    # Settled rows go by a key of their own that matches nothing.
    own = F.concat(F.lit("-"), F.xxhash64(*rows.columns).cast("string")).cast("binary")
    seen = seen.withColumn("__own", F.when(F.col("__found").isNull(), F.col(key)).otherwise(own))
    out = seen.join(known.where("NOT __hot").drop("__hot"), F.col("__own") == F.col("__key"), "left")
    return out.withColumn("__value", F.coalesce("__found", "__value")).select(*rows.columns, *[F.col("__value").getField(c).alias(c) for c in names])
