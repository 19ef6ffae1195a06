"""Independent blocks of a system: the connected components of its pattern. Each can be solved by a task of its own."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.plans.shared import checkpoint

#: Links between indices that one task may hold (16 bytes each), and neighbouring rows that lie together.
LINKS, CHUNK = 2_000_000, 1024
#: Partitions for each block, and for all.
SHARE, MOST = 4, 2048
LINK = "system_id long, u long, v long"
PRODUCT = pa.schema([("system_id", pa.int64()), ("idx", pa.int64()), ("rhs_id", pa.int64()), ("val", pa.float64()), ("im", pa.float64()), ("block", pa.int64())])


def roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ends of the edges, and of each the least end that it is joined with."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    up = np.arange(len(nodes))
    while len(a):
        low = np.minimum(up[a], up[b])
        np.minimum.at(up, up[a], low)
        np.minimum.at(up, up[b], low)
        while ((jump := up[up]) != up).any():
            up = jump
        apart = up[a] != up[b]
        a, b = a[apart], b[apart]
    return nodes, nodes[up]


def _forest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The edges ``system_id, u, v`` of a partition as stars: each end v with its root u, roots themselves included."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for pdf in parts:
        for system, rows in pdf.groupby("system_id"):
            have = held.setdefault(int(system), [])
            have.append((rows.u.to_numpy(), rows.v.to_numpy()))
            if sum(len(x) for x, _ in have[1:]) > max(LINKS // 4, len(have[0][0])):
                held[int(system)] = [roots(*(np.concatenate(x) for x in zip(*have, strict=True)))]
    for system, have in held.items():
        nodes, root = roots(*(np.concatenate(x) for x in zip(*have, strict=True)))
        yield pd.DataFrame({"system_id": system, "u": root, "v": nodes})


def components(a: DataFrame) -> DataFrame:
    """``system_id, idx, block`` for every index of the entries ``system_id, row, col``; the block is the least index of its component.

    Partitions send stars. Where there are more than LINKS of them, rounds in the executors hook each end to its least neighbour's parent;
    then one task joins what is left.
    """
    link = checkpoint(a.select("system_id", F.col("row").alias("u"), F.col("col").alias("v")).mapInPandas(_forest, LINK))
    own, link = link.where("u = v").select("system_id", "u", "v"), link.where("u <> v")
    many = own.count() > LINKS
    while many or link.count() > LINKS:
        parent = checkpoint(link.groupBy("system_id", "v").agg(F.min("u").alias("p")))
        up = parent.select("system_id", F.col("v").alias("u"), F.col("p").alias("pp"))
        joined = link.join(parent, ["system_id", "v"]).join(up, ["system_id", "u"], "left")
        other = joined.where("u <> p").select("system_id", F.least("u", "p").alias("u"), F.greatest("u", "p").alias("v"))
        mine = joined.where("u = p").select("system_id", F.coalesce("pp", "p").alias("u"), "v")
        moved = joined.where("u <> p OR pp IS NOT NULL").limit(1).count()
        link = checkpoint(other.union(mine).distinct())
        if not moved:  # stars already: every end with its root
            alone = own.join(link.select("system_id", "v"), ["system_id", "v"], "left_anti").distinct()
            found = link.union(alone.select("system_id", "u", "v"))
            break
    else:
        found = link.union(own).coalesce(1).mapInPandas(_forest, LINK)
    return found.select("system_id", F.col("v").alias("idx"), F.col("u").alias("block"))


def split(a: DataFrame, n: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The entries ``system_id, row, col, re, im`` with their ``block``, and the table ``system_id, idx, block``; both are written.

    A system in which an index below ``n`` has no entry is singular and stays whole: its block is -1.
    """
    a = checkpoint(a.repartition("system_id", F.floor(F.col("row") / CHUNK)))
    found = components(a)
    size = F.max("idx") + 1 if n is None else F.lit(n)
    whole = checkpoint(found).transform(lambda t: t.join(t.groupBy("system_id").agg((F.count(F.lit(1)) != size).alias("__gap")), "system_id"))
    table = checkpoint(whole.select("system_id", "idx", F.when(F.col("__gap"), -1).otherwise(F.col("block")).cast("long").alias("block")))
    return a.join(table.withColumnRenamed("idx", "row"), ["system_id", "row"]).select("system_id", "row", "col", "re", "im", "block"), table


def tasks(table: DataFrame) -> int:
    """Partitions for the blocks: some for each, so that few share one by chance, and not fewer than Spark's own number."""
    own = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(own, min(SHARE * table.select("system_id", "block").distinct().count(), MOST))


def sides(b: DataFrame, table: DataFrame) -> DataFrame:
    """Written right-hand sides ``system_id, idx, rhs_id, re, im`` with their ``block``, which they may have. Every block gets every right-hand side of its system: where one has no entry, a zero."""
    zero = table.select("system_id", "block").distinct().join(b.select("system_id", "rhs_id").distinct(), "system_id")
    zero = zero.select("system_id", F.greatest("block", F.lit(0)).alias("idx"), "rhs_id", F.lit(0.0).alias("re"), F.lit(0.0).alias("im"), "block")
    if "block" in b.columns:
        return b.select("system_id", "idx", "rhs_id", "re", "im", "block").union(zero)
    gap = table.where("block = -1").select("system_id", F.lit(-1).cast("long").alias("__gap")).distinct()
    known = b.join(table, ["system_id", "idx"], "left").join(gap, "system_id", "left")
    outside = F.raise_error(F.lit("a right-hand side lies outside its matrix")).cast("long")
    known = known.withColumn("block", F.coalesce("block", "__gap", outside)).drop("__gap")
    return known.select("system_id", "idx", "rhs_id", "re", "im", "block").union(zero)


def multiply(a: DataFrame, table: DataFrame, x: DataFrame, lanes: int = 1) -> DataFrame:
    """``system_id, idx, rhs_id, val, im, block`` = A x for the entries and the table of ``split``, in a task for each block and lane of right-hand sides.

    A join makes a row for each entry and right-hand side; here a task holds a block and its lane of x as arrays, and sends a right-hand side before it makes the next.
    """

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[tuple]] = [[], []]
        for batch in batches:
            col = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in batch.schema.names}
            for code in (0, 1):
                of = np.flatnonzero(col["what"] == code)
                if len(of):
                    system, block = int(col["system_id"][0]), int(col["block"][0])
                    im = col["im"][of]
                    parts[code].append((col["i"][of], col["j"][of], col["re"][of] + 1j * im if im.any() else col["re"][of]))
        if not parts[0] or not parts[1]:
            return
        row, col, val = (np.concatenate(z) for z in zip(*parts[0], strict=True))
        parts[0].clear()
        index = np.unique(np.concatenate([row, col]))
        row, col = np.searchsorted(index, row), np.searchsorted(index, col)
        ids = np.unique(np.concatenate([np.unique(rhs) for _, rhs, _ in parts[1]]))
        every = np.zeros((len(ids), len(index)), np.result_type(*{side.dtype for *_, side in parts[1]}))
        while parts[1]:
            at, rhs, side = parts[1].pop()
            inside = np.isin(at, index)
            np.add.at(every, (np.searchsorted(ids, rhs[inside]), np.searchsorted(index, at[inside])), side[inside])
        for name, dense in zip(ids, every, strict=True):
            term = val * dense[col]
            re = np.bincount(row, term.real, len(index))
            im = np.bincount(row, term.imag, len(index)) if np.iscomplexobj(term) else np.zeros(len(index))
            full = [np.full(len(index), v, np.int64) for v in (system, int(name), block)]
            yield pa.record_batch([full[0], index, full[1], re, im, full[2]], PRODUCT)

    keys = ["system_id", "block", "lane"]
    right = sides(checkpoint(x.select("system_id", "idx", "rhs_id", "re", "im")), table).withColumn("lane", F.pmod("rhs_id", F.lit(lanes)).cast("int"))
    left = a.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    both = left.select(*keys, F.lit(0).alias("what"), F.col("row").alias("i"), F.col("col").alias("j"), "re", "im").union(right.select(*keys, F.lit(1), "idx", "rhs_id", "re", "im"))
    return both.repartition(tasks(table), *keys).groupBy(*keys).applyInArrow(one, "system_id long, idx long, rhs_id long, val double, im double, block long")
