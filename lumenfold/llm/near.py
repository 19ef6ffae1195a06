"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles.

Every document is a weighted set of five-word shingles, weight = count x damped IDF. Improved
consistent weighted sampling (Ioffe, 2010) draws ``bands x rows`` samples of it, so that two
documents agree in a sample with the probability of their weighted Jaccard similarity. Documents that agree in
a whole band meet; the similarity of every link is then computed from both texts.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.graph import components
from lumenfold.llm.rows import join_spread, pick, row_key
from lumenfold.llm.store import Tables
from lumenfold.llm.textarrays import BASE, U, Words, mix, pieces, windows

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 14, 4
#: Counters of the document-frequency sketch: fixed, so 4 MB whatever the input. A counter holds at most the
#: shingle's share of documents plus the mean document's shingles / SLOTS.
SLOTS = 1 << 20
SLICE = 1 << 14
#: IDF lies between 1 and 1 + STRENGTH. Undamped, shared shingles of a group with a third of all documents would
#: weigh an eighth of a changed one, and true copies would fall below the threshold.
STRENGTH = 0.1
#: Members of a band that one task compares with as many others.
BLOCK = 512
#: Classes and texts with more than a HOT-th of all documents: at most HOT, so they can be broadcast.
HOT = 10_000


def _shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Document and name of each shingle; a document of fewer than ``size`` words is one shingle, an empty one none."""
    at, names = windows(words, size)
    short = np.flatnonzero((words.count > 0) & (words.count < size))
    more = np.zeros(len(short), U)
    with np.errstate(over="ignore"):
        for j in range(size - 1):
            has = words.count[short] > j
            more[has] = more[has] * BASE[1] + words.name[words.first[short[has]] + j]
        more = mix(more + U(1))
    doc = np.concatenate([words.doc[at], short])
    return doc, np.concatenate([names, more])


def _counted(doc: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, shingle) in order, and their counts."""
    if not len(doc):
        return doc, name, np.zeros(0, np.int64)
    order = np.lexsort((name, doc))
    doc, name = doc[order], name[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (name[1:] != name[:-1])])
    at = np.flatnonzero(new)
    return doc[at], name[at], np.diff(np.concatenate([at, [len(doc)]]))


def _gamma_quantiles(n: int) -> np.ndarray:
    """Quantiles of Gamma(2, 1) at (i + 1/2) / n, by bisection."""
    q, low, high = (np.arange(n) + 0.5) / n, np.zeros(n), np.full(n, 60.0)
    for _ in range(60):
        x = (low + high) / 2
        less = 1 - np.exp(-x) * (1 + x) < q
        low, high = np.where(less, x, low), np.where(less, high, x)
    return (low + high) / 2


class Sampler:
    """Draws the samples; every number follows from the shingle's name, so all tasks and reruns agree."""

    def __init__(self, count: int):
        self.shift = np.array([int(x) | 1 for x in np.random.default_rng(77).integers(0, 2**63, count, dtype=np.uint64)], U)
        self.r = _gamma_quantiles(1 << 16).astype(np.float32)
        self.c = np.log(_gamma_quantiles(1 << 20)).astype(np.float32)

    def draw(self, start: np.ndarray, doc: np.ndarray, name: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """One row of sample names for each document; ``start``: where each document's shingles begin."""
        log_w = np.log(weight).astype(np.float32)
        sizes = np.diff(np.concatenate([start, [len(name)]]))
        out = np.zeros((len(start), len(self.shift)), U)
        # Every pass reuses the same few buffers, which stay in the processor's cache.
        z, at = np.empty(len(name), U), np.empty(len(name), U)
        r, beta, t, a = (np.empty(len(name), np.float32) for _ in range(4))
        index = at.view(np.int64)
        with np.errstate(over="ignore"):
            for k, odd in enumerate(self.shift):
                np.multiply(name, odd, out=z)
                np.right_shift(z, U(32), out=at)
                z ^= at
                z *= BASE[0]
                np.right_shift(z, U(48), out=at)
                np.take(self.r, index, out=r, mode="clip")
                # beta, the fraction that t is rounded with, comes back in ln y = r (t - beta).
                np.right_shift(z, U(32), out=at)
                at &= U(0xFFFF)
                np.copyto(beta, index, casting="same_kind")
                beta *= np.float32(2.0**-16)
                np.divide(log_w, r, out=t)
                t += beta
                np.floor(t, out=t)
                np.subtract(t, beta, out=a)
                a += 1
                a *= r
                np.right_shift(z, U(12), out=at)
                at &= U(0xFFFFF)
                np.take(self.c, index, out=r, mode="clip")
                np.subtract(r, a, out=a)
                least = np.minimum.reduceat(a, start)
                hit = np.flatnonzero(a == np.repeat(least, sizes))
                if len(hit) > len(start):  # ties: the first
                    hit = hit[np.searchsorted(hit, start)]
                out[:, k] = mix(name[hit] ^ (t[hit].astype(np.int64).astype(U) * BASE[1]))
        return out


class Weights:
    """Weight of a shingle: its count times its damped inverse document frequency."""

    def __init__(self, sketch: np.ndarray, total: int):
        self.sketch, self.total = sketch, max(1, total)

    def of(self, name: np.ndarray, count: np.ndarray) -> np.ndarray:
        seen = np.clip(self.sketch[name & U(SLOTS - 1)], 1, self.total)
        return count * (1 + STRENGTH * np.log(self.total / seen) / math.log(self.total + 1))


def document_frequencies(texts: DataFrame, shingle: int) -> np.ndarray:
    """The sketch of document frequencies over all documents: 64 slices, summed in the executors."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for _, _, buf, off in pieces(batch.column(0)):
                doc, name, _ = _counted(*_shingles(Words(buf, off), shingle))
                sketch += np.bincount((name & U(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
        if sketch.any():
            yield pa.record_batch({"part": list(range(SLOTS // SLICE)), "counts": [sketch[i : i + SLICE].tobytes() for i in range(0, SLOTS, SLICE)]}, schema=pa.schema([("part", pa.int32()), ("counts", pa.binary())]))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[part] = sums.get(part, 0) + np.frombuffer(counts, np.int64)
        if sums:
            yield pa.record_batch({"part": list(sums), "counts": [x.tobytes() for x in sums.values()]}, schema=pa.schema([("part", pa.int32()), ("counts", pa.binary())]))

    kind = "part int, counts binary"
    parts = texts.mapInArrow(count, kind)
    # Adding up is associative: a first round shrinks what many tasks send before each slice meets in one.
    parts = parts.repartition(SLOTS // SLICE, "part", F.pmod(F.spark_partition_id(), F.lit(16))).mapInArrow(total, kind).repartition(SLOTS // SLICE, "part").mapInArrow(total, kind)
    sketch = np.zeros(SLOTS, np.int64)
    for row in parts.collect():
        sketch[row.part * SLICE : (row.part + 1) * SLICE] += np.frombuffer(row.counts, np.int64)
    return sketch


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """One row per document: ``id, class_id, class_size``.

    Classes are the connected components of documents whose weighted Jaccard similarity is at least
    ``threshold``; ``class_id`` is the least id in the class, ``class_size`` its number of documents. Words are taken as they
    stand. Texts with the same words are copies and form one node. A null text counts as empty, and
    all texts without words are copies of each other; a text of 1 to 4 words is a single shingle. A null id
    belongs to its text's class, and is that class's id only if no other id exists (null then). An empty table gives no rows.

    A band's members are first checked against their least member. Members of a band that are in
    different components afterwards are compared with all others of that band in blocks: by samples, then by texts, until
    one link to each component is found or no candidate is left; so no band is capped. A pair there whose samples agree four standard
    deviations less often than at the threshold (in fewer than 33 of 56) is not compared by texts, and so a class that a band offers may be missed.
    """
    member, node, least, total = _classes(docs, id_col, text_col, shingle, threshold, bands, rows)
    # A class or text of a third of all documents does not meet its verdict in one task: at most HOT of either have over a HOT-th of all.
    placed = join_spread(node.select("node", "root", F.col("size").alias("copies")), least, "root", F.col("class_size") * HOT > total)
    placed = placed.select("node", "copies", "class_id", "class_size")
    return join_spread(member, placed, "node", F.col("copies") * HOT > total).select(F.col("id").alias(id_col), "class_id", "class_size")


def _digest(text_col: str):
    """Tells rows that share an id, or have none, apart by their texts."""
    return F.xxhash64(F.col(text_col))


def _classes(docs: DataFrame, id_col: str, text_col: str, shingle: int, threshold: float, bands: int, rows: int) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """``id, node`` of every document, ``node, root, size`` of every text, ``root, class_id, class_size, first`` of every class (``first`` names its row of least id), and the number of documents."""
    spark = docs.sparkSession
    tables = Tables(spark, "near")
    texts = docs.select(F.col(text_col).alias("text"))
    total = docs.count()
    sketch = document_frequencies(texts, shingle)
    shared = spark.sparkContext.broadcast((sketch, total))
    count = bands * rows

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, sampler = Weights(*shared.value), Sampler(count)
        for batch in batches:
            text = batch.column(1)
            for a, b, buf, off in pieces(text, 1 << 17):
                raw = buf.tobytes()
                nodes = [hashlib.blake2b(b" ".join(raw[off[i] : off[i + 1]].split()), digest_size=16).digest() for i in range(b - a)]
                doc, name, n = _counted(*_shingles(Words(buf, off), shingle))
                samples: list[bytes | None] = [None] * (b - a)
                if len(doc):
                    start = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
                    got = sampler.draw(start, doc, name, weights.of(name, n))
                    for i, row in zip(doc[start].tolist(), got, strict=True):
                        samples[i] = row.tobytes()
                yield pa.record_batch([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(nodes, pa.binary()), pa.array(samples, pa.binary())], names=["id", "digest", "node", "samples"])

    id_type = docs.schema[id_col].dataType.simpleString()
    signed = tables.keep(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), _digest(text_col).alias("digest")).mapInArrow(sign, f"id {id_type}, digest long, node binary, samples binary"))
    nodes = tables.keep(signed.groupBy("node").agg(F.first("samples").alias("samples")))

    def bands_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(1).is_valid())
            if not batch.num_rows:
                continue
            got = np.frombuffer(b"".join(batch.column(1).to_pylist()), U).reshape(batch.num_rows, bands, rows)
            with np.errstate(over="ignore"):
                key = np.zeros((batch.num_rows, bands), U)
                for j in range(rows):
                    key = key * BASE[0] + got[:, :, j]
                key = mix(key + np.arange(bands, dtype=U) * BASE[1])
            yield pa.record_batch([pa.array(key.view(np.int64).ravel()), batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), bands)))], names=["band", "node"])

    band = nodes.select("node", "samples").mapInArrow(bands_of, "band long, node binary")
    lead = tables.keep(band.groupBy("band").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    met = tables.keep(band.join(lead, "band").select("band", "node", "lead", "n"))
    first = met.where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    check = lambda pairs: _verified(pairs, signed, docs, id_col, text_col, shared, shingle, threshold, tables)
    links = check(first)
    groups = tables.keep(components(links, tables))

    # What the leaders did not settle: bands with members of several components.
    placed = met.join(groups, met["node"] == groups["node"], "left").select("band", met["node"], F.coalesce("root", met["node"]).alias("root"))
    sizes = placed.groupBy("band", "root").count()
    mixed = tables.keep(sizes.groupBy("band").agg(F.count(F.lit(1)).alias("roots"), F.sum("count").alias("n"), F.max(F.struct("count", "root")).alias("most")).where("roots > 1"))
    if mixed.limit(1).count():
        open_ = placed.join(mixed.select("band", "n", F.col("most.root").alias("main"), F.col("most.count").alias("m")), "band")
        held = _texts(open_.select("node").distinct(), signed, docs, id_col, text_col, tables)
        few = (F.col("root") != F.col("main")).alias("few")
        t, q = F.greatest(F.ceil(F.col("n") / BLOCK), F.lit(1)), F.greatest(F.ceil((F.col("n") - F.col("m")) / BLOCK), F.lit(1))
        full = open_.join(nodes, "node").join(held, "node")
        one = full.select("band", "node", "root", "samples", "text", few, t.cast("long").alias("t"), q.cast("long").alias("q"), F.xxhash64("node").alias("h"))
        zero = F.lit(0).cast("long")
        rows_ = one.select("*", F.lit(False).alias("asks"), F.pmod("h", "t").alias("tb"), F.explode(F.sequence(zero, F.col("q") - 1)).alias("qb")).union(
            one.where("few").select("*", F.lit(True).alias("asks"), F.explode(F.sequence(zero, F.col("t") - 1)).alias("tb"), F.pmod("h", "q").alias("qb"))
        )
        least_like = count * threshold - 4 * math.sqrt(count * threshold * (1 - threshold))

        def compare(pdf: pd.DataFrame) -> pd.DataFrame:
            """Links between components of a band's block: candidates by falling agreement, up to the first true link to each component."""
            asks = pdf.asks.to_numpy()
            ask, rest = np.flatnonzero(asks), np.flatnonzero(~asks)
            out: list[tuple[bytes, bytes]] = []
            if not len(ask) or not len(rest):
                return pd.DataFrame(out, columns=["a", "b"])
            sample = np.frombuffer(b"".join(pdf.samples), U).reshape(len(pdf), count)
            node, root = pdf.node.to_numpy(), pd.factorize(pdf.root)[0]
            theirs, their_root = sample[rest], root[rest]
            maybe: list[tuple[int, np.ndarray]] = []
            for x in ask:
                like = np.count_nonzero(theirs == sample[x], axis=1)
                near_ = np.flatnonzero((like >= least_like) & (their_root != root[x]))
                if len(near_):
                    maybe.append((x, rest[near_[np.argsort(-like[near_], kind="stable")]]))
            if not maybe:
                return pd.DataFrame(out, columns=["a", "b"])
            # Only texts with a candidate are cut into shingles.
            used = np.unique(np.concatenate([[x for x, _ in maybe], *(y for _, y in maybe)]))
            place = np.zeros(len(pdf), np.int64)
            place[used] = np.arange(len(used))
            sets = _sets(pdf.text.iloc[used], Weights(*shared.value), shingle)
            for x, near_ in maybe:
                for r in np.unique(root[near_]):
                    hit = next((y for y in near_[root[near_] == r] if sets.similar(place[x], place[y], threshold - 1e-6) >= threshold - 1e-9), None)
                    if hit is not None:
                        out.append((min(node[x], node[hit]), max(node[x], node[hit])))
            return pd.DataFrame(out, columns=["a", "b"])

        second = rows_.select("band", "qb", "tb", "node", "root", "samples", "text", "asks").groupBy("band", "qb", "tb").applyInPandas(compare, "a binary, b binary")
        links = links.union(tables.keep(second.distinct()))
        groups = tables.keep(components(links, tables))
    tables.drop(met, lead, mixed, nodes)

    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest"))
    node = signed.groupBy("node").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("size"), first.alias("first"))
    node = tables.keep(node.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node")))
    least = tables.keep(node.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("size").alias("class_size"), F.min("first").alias("first")))
    return signed.select("id", "node"), node, least, total


class _sets:
    """Weighted shingle sets of some texts."""

    def __init__(self, texts: pd.Series, weights: Weights, shingle: int):
        doc, name, n = [], [], []
        for a, _, buf, off in pieces(pa.array(texts, pa.string())):
            d, k, c = _counted(*_shingles(Words(buf, off), shingle))
            doc.append(d + a)
            name.append(k)
            n.append(c)
        doc, self.name, n = np.concatenate(doc), np.concatenate(name), np.concatenate(n)
        self.weight = weights.of(self.name, n)
        self.bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
        self.total = np.add.reduceat(np.append(self.weight, 0), self.bounds[:-1]) * (np.diff(self.bounds) > 0)

    def of(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.bounds[i], self.bounds[i + 1])
        return self.name[part], self.weight[part]

    def similar(self, i: int, j: int, least: float = 0.0) -> float:
        """Weighted Jaccard similarity of two texts."""
        (a, wa), (b, wb) = self.of(i), self.of(j)
        # The totals alone bound the similarity; below the threshold the bound is as good an answer.
        low, high = sorted((self.total[i], self.total[j]))
        if low <= 0 or low < least * high:
            return low / high if low > 0 else 0.0
        at = np.minimum(np.searchsorted(a, b), len(a) - 1)
        same = a[at] == b
        both = np.minimum(wa[at[same]], wb[same]).sum()
        return both / (self.total[i] + self.total[j] - both)


def _texts(wanted: DataFrame, signed: DataFrame, docs: DataFrame, id_col: str, text_col: str, tables: Tables) -> DataFrame:
    """``node, text``: the text of a node is that of its document with the least id; equal words give equal shingles."""
    owner = signed.join(wanted, "node").groupBy("node").agg(F.min(F.struct("id", "digest")).alias("o")).select("node", "o.id", "o.digest")
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), _digest(text_col).alias("digest"))
    return tables.keep(text.join(owner, text["id"].eqNullSafe(owner["id"]) & (text["digest"] == owner["digest"])).select("node", "text").dropDuplicates(["node"]))


def _verified(pairs, signed, docs, id_col, text_col, shared, shingle, threshold, tables) -> DataFrame:
    """The pairs of nodes whose texts reach the threshold; a hot first node is dealt out in chunks of a few hundred partners."""
    pairs = tables.keep(pairs)
    load = tables.keep(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / 256).cast("long").alias("chunks")))
    dealt = tables.keep(pairs.join(load, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("chunks")).alias("chunk")))
    held = _texts(dealt.select(F.col("a").alias("node")).union(dealt.select("b")).distinct(), signed, docs, id_col, text_col, tables)
    left = dealt.select("a", "chunk").distinct().join(held, F.col("a") == F.col("node")).select("a", "chunk", F.lit(None).cast("binary").alias("b"), "text")
    right = dealt.join(held, F.col("b") == F.col("node")).select("a", "chunk", "b", "text")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = _sets(pdf.text, Weights(*shared.value), shingle)
        head = next(i for i, b in enumerate(pdf.b) if b is None)
        good = [i for i, b in enumerate(pdf.b) if b is not None and sets.similar(head, i, threshold - 1e-6) >= threshold - 1e-9]
        return pd.DataFrame({"a": [pdf.a[i] for i in good], "b": [pdf.b[i] for i in good]})

    out = tables.keep(left.union(right).groupBy("a", "chunk").applyInPandas(compare, "a binary, b binary"))
    tables.drop(held, load, dealt, pairs)
    return out


def drop_near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """One row of each class with all its columns: the one with the least id (a null id comes last).

    Of rows that share this id, the one of least hashed text stays, once; rows with one id in other classes do not stay with it.
    """
    _, _, least, _ = _classes(docs, id_col, text_col, shingle, threshold, bands, rows)
    stay = least.select(row_key(F.col("first.digest"), F.col("first.id")).alias("__stay")).distinct()
    return pick(docs, row_key(_digest(text_col), F.col(id_col)), stay, F.lit(0))
