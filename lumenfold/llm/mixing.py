"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source's documents lie in blocks (equal parts of a hash line). A pass over a source draws its blocks in an order of its
own; passes go on until the target is met. The quota of drawn blocks of every source is split among the shards by the tree, and
each shard draws its part of that order, so shards hold disjoint draws. Inside a shard rows are shuffled by hash.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.rows import positions
from lumenfold.llm.store import Tables

WORD = r"[^\x20\x09-\x0D]+"
#: No document is taken more than so many times.
EPOCHS = 3
#: Bits of a place on the hash line. All words together form about MOST_BLOCKS blocks at most, so a place times a number of blocks fits 63 bits.
LINE_BITS, MOST_BLOCKS = 44, 1 << 16
#: Sources that one task splits among the shards.
GROUP = 4096
#: Rows up to which a table of sources or blocks is broadcast (some 20 MB); beyond, it is joined by shuffle, each source dealt over SALTS.
FEW, SALTS = 200_000, 16
#: A total so near its target, as a share of it, is kept with whole documents.
NEAR = 0.5


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def default_weights(position: Column, source: Column) -> Column:
    """1, 2, 3, repeating, over the sources by code point, null last."""
    return (position % 3 + 1).cast("double")


def split(counts: np.ndarray, room: np.ndarray, seed: list[int]) -> np.ndarray:
    """Deal ``counts`` blocks of each source into shards of ``room`` blocks: sources x shards, every sum exact.

    The tree halves the shards; what the left half gets of a node's blocks is one multivariate hypergeometric draw, seeded by the node.
    """
    out = np.zeros((len(counts), len(room)), np.int64)
    stack = [(0, len(room), counts.astype(np.int64))]
    while stack:
        low, high, held = stack.pop()
        if high - low == 1:
            out[:, low] = held
            continue
        mid = (low + high) // 2
        draw = np.random.default_rng([*seed, low, high])
        left = draw.multivariate_hypergeometric(held, int(room[low:mid].sum()), method="marginals")
        stack += [(low, mid, left), (mid, high, held - left)]
    return out


def _spot(row_key: Column, seed: int) -> Column:
    """A row's place on the hash line: a random order."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), row_key), 64 - LINE_BITS)


def _sources(rows: DataFrame, weights: Callable, tables: Tables) -> DataFrame:
    """``source, source_size, target, epochs, part``: whole passes over each source, and the words still wanted after them."""
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = weights(F.col("position"), F.col("source"))
    known = tables.keep(positions(per, [F.col("source").isNull(), F.col("source")], tables).select("source", "source_size", weight.cast("double").alias("weight")))
    # The common level: every round fixes sources whose cap lies below their share and shares the rest again.
    total, level = known.agg(F.sum("source_size")).first()[0] or 0, 0.0
    while True:
        capped = EPOCHS * F.col("source_size") < F.lit(level) * F.col("weight")
        r = known.where("weight > 0").agg(F.sum(F.when(capped, EPOCHS * F.col("source_size"))).alias("fixed"), F.sum(F.when(~capped, F.col("weight"))).alias("free")).first()
        after = (total - (r.fixed or 0)) / r.free if r.free else level
        if after <= level:
            break
        level = after
    target = F.when(F.col("weight") > 0, F.least((EPOCHS * F.col("source_size")).cast("double"), F.lit(level) * F.col("weight"))).otherwise(0.0)
    take = F.least(F.floor(F.col("target") + 0.5), EPOCHS * F.col("source_size"))
    out = known.select("source", "source_size", target.alias("target")).withColumn("take", take)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("take") / F.col("source_size"))).otherwise(0)
    return tables.keep(out.withColumn("epochs", whole).select("source", "source_size", "target", "epochs", (F.col("take") - F.col("epochs") * F.col("source_size")).alias("part")))


def _join_sources(rows: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    known = sources.withColumnRenamed("source", "__source")
    same = F.col("source").eqNullSafe(F.col("__source"))
    if few:
        return rows.join(F.broadcast(known), same).drop("__source")
    salted = known.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(salted, same & (F.pmod(F.col("spot"), F.lit(SALTS)) == F.col("__salt"))).drop("__source", "__salt")


class Plan:
    """What the mix draws: a table of sources and one of the blocks drawn."""

    def __init__(self, rows: DataFrame, weights: Callable, seed: int, shards: int, block_words: int, tables: Tables):
        """``rows``: source, size, spot."""
        self.seed, self.shards = seed, shards
        sources = _sources(rows, weights, tables)
        total, self.n = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.count(F.lit(1))).first()
        self.words = max(1, block_words, -(-int(total) // MOST_BLOCKS))
        self.sources, self.few = sources, self.n <= FEW
        sized = self.placed(rows).where("size > 0").groupBy("source", "block").agg(F.sum("size").alias("words"), F.first("epochs").alias("epochs"), F.first("part").alias("part"))
        passes = F.when(F.col("part") > 0, F.col("epochs")).otherwise(F.col("epochs") - 1)
        each = tables.keep(sized).where("epochs > 0 OR part > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), passes)))
        # A pass draws the source's blocks in an order of its own; at most MOST_BLOCKS + 1 rows a window.
        each = each.withColumn("turn", F.xxhash64(F.lit(seed + 1), "source", "epoch", "block"))
        each = each.selectExpr("*", "sum(words) OVER (PARTITION BY source, epoch ORDER BY turn, block) - words AS before", "row_number() OVER (PARTITION BY source, epoch ORDER BY turn, block) AS number", "count(*) OVER (PARTITION BY source, epoch) AS n")
        drawn = tables.keep(each.where("epoch < epochs OR before < part").selectExpr("source", "block", "epoch", "epoch * n + number - 1 AS rank", "CASE WHEN epoch < epochs OR before + words <= part THEN NULL ELSE part - before END AS cut"))
        quotas = self._quotas(drawn, tables)
        if self.few:
            quotas = F.broadcast(quotas)
        dealt = drawn.join(quotas, F.col("source").eqNullSafe(F.col("__source")))
        shard = F.size(F.filter("upto", lambda x: x <= F.col("rank")))
        draw = F.struct("epoch", shard.alias("shard"), "cut")
        blocks = dealt.groupBy("source", "block").agg(F.sort_array(F.collect_list(draw)).alias("drawn"))  # at most EPOCHS
        self.blocks = tables.keep(blocks.withColumnsRenamed({"source": "__source", "block": "__block"}))
        # The rows of the table: at most one a block, MOST_BLOCKS and one a source.
        self.few_blocks = MOST_BLOCKS + self.n <= FEW

    def _quotas(self, drawn: DataFrame, tables: Tables) -> DataFrame:
        """``__source, upto``: the source's blocks in shards 0..j, for each j.

        Two trees of the same kind: groups of sources among the shards, then each group's sources in a task of its own. What a
        group's sources get, given what the group gets, is again multivariate hypergeometric.
        """
        groups, shards, seed = -(-self.n // GROUP) or 1, self.shards, self.seed
        counts = tables.keep(drawn.groupBy("source").count().withColumn("group", F.pmod(F.xxhash64("source"), F.lit(groups)).cast("long")))
        held = np.zeros(groups, np.int64)
        for r in counts.groupBy("group").agg(F.sum("count").alias("n")).collect():  # one row for GROUP sources
            held[r.group] = r.n
        everything = int(held.sum())
        room = np.array([everything * (j + 1) // shards - everything * j // shards for j in range(shards)], np.int64)
        rooms = split(held, room, [seed])
        table = counts.sparkSession.createDataFrame([(i, x.tolist()) for i, x in enumerate(rooms)], "group long, room array<long>")

        def deal(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.assign(none=pdf.source.isna()).sort_values(["none", "source"])
            got = split(pdf["count"].to_numpy(), np.array(pdf.room.iloc[0]), [seed, int(pdf.group.iloc[0]) + 1])
            return pd.DataFrame({"__source": pdf.source, "upto": list(np.cumsum(got, 1))})

        return counts.join(F.broadcast(table), "group").groupBy("group").applyInPandas(deal, "__source string, upto array<long>")

    def placed(self, rows: DataFrame) -> DataFrame:
        """``rows`` with their source's columns and their block: equal parts of the hash line, as many as the source's size asks for."""
        parts = F.ceil(F.greatest("source_size", F.lit(1)) / self.words).cast("long")
        return _join_sources(rows, self.sources, self.few).withColumn("block", F.shiftright(F.col("spot") * parts, LINE_BITS))

    def draw(self, rows: DataFrame, tie: list[str]) -> DataFrame:
        """``rows`` (source, size, spot and others) with source_size, target, epochs, rest and draws.

        Of a block that a source's target cuts, rows count in the order of ``spot`` and ``tie`` until it is met.
        """
        known = F.broadcast(self.blocks) if self.few_blocks else self.blocks
        both = self.placed(rows).drop("epochs", "part").join(known, F.col("source").eqNullSafe(F.col("__source")) & (F.col("block") == F.col("__block")), "left").drop("__source", "__block")
        cut = F.coalesce(F.aggregate("drawn", F.lit(None).cast("long"), lambda a, d: F.coalesce(d["cut"], a)), F.lit(-1))
        both = both.withColumn("cut", cut).withColumn("whole", F.coalesce(F.size(F.filter("drawn", lambda d: d["cut"].isNull())), F.lit(0)).cast("long"))
        plain = both.where("cut < 0").withColumn("rest", F.lit(0).cast("long"))
        order = ", ".join(f"`{c}`" for c in ["spot", *tie])
        # One block a source: about ``block_words`` words, or a MOST_BLOCKS-th of all.
        run = both.where("cut >= 0").selectExpr("*", f"sum(size) OVER (PARTITION BY source, block ORDER BY {order} ROWS UNBOUNDED PRECEDING) - size AS before")
        run = run.withColumn("rest", F.greatest(F.lit(0).cast("long"), F.least("size", F.col("cut") - F.col("before")))).drop("before")
        out = plain.unionByName(run)
        place = lambda d: F.shiftrightunsigned(F.xxhash64(F.lit(self.seed + 2), "spot", d["epoch"]), 2)
        words = lambda d: F.when(d["cut"].isNull(), F.col("size")).otherwise(F.col("rest"))
        draws = F.filter(F.transform("drawn", lambda d: F.struct(d["shard"].alias("shard"), d["epoch"].alias("epoch"), place(d).alias("place"), words(d).alias("words"))), lambda d: d["words"] > 0)
        none = F.array().cast("array<struct<shard:int,epoch:long,place:long,words:long>>")
        whole = F.when(F.col("size") > 0, F.col("whole")).otherwise(0).alias("epochs")
        return out.withColumn("draws", F.coalesce(draws, none)).withColumn("epochs", whole).withColumn("taken", F.col("epochs") * F.col("size") + F.col("rest")).drop("cut", "whole", "drawn", "block")


def _measured(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> list[Column]:
    # Rows that share an id, or have none, lie apart by their texts.
    digest = F.xxhash64(F.col(id_col), F.col(text_col))
    return [F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), _spot(digest, seed).alias("spot"), digest.alias("digest")]


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Callable = default_weights, seed: int = 17, shards: int = 64, block_words: int = 50_000
) -> DataFrame:
    """``id, source, size, source_size, target, taken, spot, epochs, rest, draws`` for every document.

    Targets are shares of all sizes by weight (``weights(position, source)``, columns), each at most EPOCHS times its source's size, the excess reshared. A
    source's blocks hold about ``block_words`` words (more, where all words would form over MOST_BLOCKS). Each pass draws them in
    an order of its own, until the rounded target is met exactly: the last block is cut, and in it one document. ``taken`` = ``epochs``
    (draws of the whole document) x size + ``rest``. ``draws`` holds a struct ``(shard, epoch, place, words)`` for each time a document is taken: its block's
    shard in that pass, by the splitting tree, and a place that orders the shard at random.

    Null text has size 0, is never taken and has no draws; a null source is a source, the last. Rows that share an id, or have
    none, are rows of their own; rows that also share the text are interchangeable. An empty table gives no rows; other columns are not read. A
    total of 0 gives targets of 0. Reruns give the same rows.
    """
    tables = Tables(docs.sparkSession, "mix")
    rows = tables.keep(docs.select(F.col(id_col).alias("id"), *_measured(docs, id_col, text_col, source_col, seed)))
    out = Plan(rows, weights, seed, shards, block_words, tables).draw(rows, ["digest", "id"])
    return out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "taken", "spot", "epochs", "rest", "draws")


def mixed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Callable = default_weights, seed: int = 17, shards: int = 64, block_words: int = 50_000, whole: bool = False
) -> DataFrame:
    """The mix itself: a row for each time a document is taken, with the columns of ``docs``.

    Each shard lies in one partition, shard after shard, its rows in the order of ``place``.

    The last draw of a source may take only the first words of one document; its text then ends there. With ``whole`` that document is taken or
    left whole, by which is nearer to the source's target, and cut only where both miss the target by more than NEAR of it.
    Documents of size 0 stay, once, in a shard by hash: they weigh nothing in any share. Texts move once, to their shards.
    """
    tables = Tables(docs.sparkSession, "mix")
    measured = _measured(docs, id_col, text_col, source_col, seed)
    rows = tables.keep(docs.select(*measured).drop("digest"))
    carried = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *measured)
    drawn = Plan(rows, weights, seed, shards, block_words, tables).draw(carried, ["digest"])
    hashed = F.xxhash64(F.lit(shards), "digest", "source")
    zero = F.lit(0).cast("long")
    none = F.array(F.struct(F.pmod(hashed, F.lit(shards)).cast("int").alias("shard"), zero.alias("epoch"), F.shiftrightunsigned(hashed, 2).alias("place"), zero.alias("words")))
    each = drawn.withColumn("draw", F.explode(F.when(F.col("size") == 0, none).otherwise(F.col("draws"))))
    words, over = F.col("draw.words"), F.col("size") - F.col("draw.words")
    if whole:
        near = F.least(words, over) <= F.col("target") * NEAR
        each = each.where((over == 0) | ~near | (words >= over))
        each = each.withColumn("draw", F.col("draw").withField("words", F.when(near & (words >= over), F.col("size")).otherwise(words)))
    text = F.col("row").getField(text_col)
    pieces = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    first = F.array_join(F.slice(pieces, F.lit(1), words.cast("int")), "")
    each = each.withColumn("new", F.when(over > 0, first).otherwise(text)).repartition(F.col("draw.shard")).sortWithinPartitions("draw.shard", "draw.place", "digest")

    def column(name: str) -> Column:
        if name == text_col:
            return F.col("new").alias(name)
        old = F.col("row").getField(name)
        return (F.when(over > 0, F.char_length("new").cast(docs.schema[name].dataType)).otherwise(old) if name == "n_chars" else old).alias(name)

    return each.select(*map(column, docs.columns))
