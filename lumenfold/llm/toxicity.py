"""Toxicity: a factorization machine over hashed terms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.sample import labelled
from lumenfold.llm.store import Tables
from lumenfold.llm.textarrays import U, Words, pieces

#: Hashed term space, labelled documents fitted at most, the machine's factors, rows multiplied at once while fitting.
SPACE_BITS, MOST_FITTED, FACTORS, ROWS = 22, 20_000, 8, 2048
#: Every term in so many fitted documents, and of a z score beyond this, enters the machine.
SEEN, TELLS = 3, 4.5

#: Terms are runs of letters: ASCII letters, lower-cased, and bytes of other scripts.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BETWEEN = np.ones(256, bool)
BETWEEN[97:123] = BETWEEN[128:] = False


def terms(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, hashed term)."""
    words = Words(LOWER[buf], off, BETWEEN)
    code = np.unique((words.doc.astype(U) << U(SPACE_BITS)) | (words.name & U((1 << SPACE_BITS) - 1)))
    return (code >> U(SPACE_BITS)).astype(np.int64), (code & U((1 << SPACE_BITS) - 1)).astype(np.int64)


class Machine:
    """p = sigmoid(w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j), x_i = 1 if the term occurs."""

    def __init__(self, slots: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray):
        self.slots, self.w0, self.w, self.v = slots, w0, w, v

    def raw(self, doc: np.ndarray, slot: np.ndarray, n: int) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.slots, slot), max(0, len(self.slots) - 1))
        if not len(self.slots):
            return np.full(n, self.w0)
        hit = self.slots[at] == slot
        doc, at = doc[hit], at[hit]
        out = self.w0 + np.bincount(doc, self.w[at], n)
        for f in range(self.v.shape[1]):
            x = self.v[at, f]
            out += 0.5 * (np.bincount(doc, x, n) ** 2 - np.bincount(doc, x * x, n))
        return out


def fit(docs: list[np.ndarray], labels: np.ndarray, rounds: int = 250, rate: float = 0.03, decay: float = 1e-3) -> Machine:
    """Fit by logistic loss (Adam, full batches, fixed seed) on all terms that tell the classes apart (SEEN, TELLS)."""
    n, pos = len(labels), int(labels.sum())
    if not n or pos in (0, n):
        prior = (pos + 1) / (n + 2)
        return Machine(np.zeros(0, np.int64), float(np.log(prior / (1 - prior))), np.zeros(0), np.zeros((0, FACTORS)))
    all_terms = np.concatenate(docs).astype(np.int64)
    row = np.repeat(np.arange(n), [len(d) for d in docs])
    slots, inverse, seen = np.unique(all_terms, return_inverse=True, return_counts=True)
    with_pos = np.bincount(inverse, labels[row], len(slots))
    share = seen / n
    # The two-proportion z score, each count smoothed by one half.
    z = ((with_pos + 0.5) / (pos + 1) - (seen - with_pos + 0.5) / (n - pos + 1)) / np.sqrt(np.maximum(share * (1 - share), 1 / n) * (1 / pos + 1 / (n - pos)))
    strong = np.flatnonzero((seen >= SEEN) & (np.abs(z) > TELLS))
    x = np.zeros((n, len(strong)), bool)
    place = np.full(len(slots), -1)
    place[strong] = np.arange(len(strong))
    hit = place[inverse] >= 0
    x[row[hit], place[inverse[hit]]] = 1
    rng = np.random.default_rng(3)
    theta = [np.array([np.log(pos / (n - pos))], np.float32), np.zeros(len(strong), np.float32), rng.normal(0, 0.05, (len(strong), FACTORS)).astype(np.float32)]
    moment, second = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    for step in range(1, rounds + 1):
        w0, w, v = theta
        g0, gw, gv = np.zeros_like(w0), np.zeros_like(w), np.zeros_like(v)
        for a in range(0, n, ROWS):
            some = x[a : a + ROWS].astype(np.float32)
            xv = some @ v
            raw = w0 + some @ w + 0.5 * ((xv**2).sum(1) - (some @ (v**2)).sum(1))
            g = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[a : a + ROWS]).astype(np.float32) / n
            g0 += g.sum()
            gw += some.T @ g
            gv += some.T @ (g[:, None] * xv)
        grads = [g0, gw + decay * w / len(w), gv - gw[:, None] * v + decay * v / len(w)] if len(strong) else [g0, w, v]
        for t, gr, m, s in zip(theta, grads, moment, second, strict=True):
            m *= 0.9
            m += 0.1 * gr
            s *= 0.999
            s += 0.001 * gr**2
            t -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-9)
    return Machine(slots[strong], float(theta[0][0]), theta[1].astype(float), theta[2].astype(float))


def score_toxicity(docs: DataFrame, labels: DataFrame, fit_on: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = MOST_FITTED) -> DataFrame:
    """``id, score`` for every document, from its whole text.

    The machine is fitted on at most ``most`` labelled documents for which ``fit_on`` (on the labels' columns) holds. A null or
    empty text has no terms and scores as they weigh: w0. Without both labels the score is the smoothed share of label 1. Nulls
    among labels or their ids do not count; rows that repeat are scored each; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession

    def collect_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, off in pieces(batch.column(1)):
                doc, slot = terms(buf, off)
                cut = np.searchsorted(doc, np.arange(b - a + 1))
                yield pa.record_batch([batch.column(2).slice(a, b - a), pa.array([slot[cut[i] : cut[i + 1]].astype(np.int32).tobytes() for i in range(b - a)], pa.binary()), batch.column(0).slice(a, b - a).cast(pa.string())], names=["label", "terms", "id"])

    fitted = Tables(spark, "toxicity").keep(labelled(docs, labels, id_col, text_col, label_col, fit_on, most).mapInArrow(collect_terms, "label int, terms binary, id string"))
    n, pos = fitted.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()

    def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(x, np.int32) for x in batch.column(1).to_pylist()]
            slots, at = np.unique(np.concatenate([*found, np.zeros(0, np.int32)]), return_inverse=True)
            label = np.repeat(batch.column(0).to_numpy(), [len(x) for x in found])
            yield pa.record_batch([pa.array(slots), pa.array(np.bincount(at, minlength=len(slots))), pa.array(np.bincount(at, label, len(slots)).astype(np.int64))], names=["slot", "seen", "pos"])

    # Only telling terms, and of each text only those, reach the driver.
    counts = fitted.mapInArrow(count_terms, "slot int, seen long, pos long").groupBy("slot").agg(F.sum("seen").alias("seen"), F.sum("pos").alias("pos")).where(F.col("seen") >= SEEN)
    share = F.greatest(F.col("seen") / n * (1 - F.col("seen") / n), F.lit(1 / max(n, 1)))
    z = ((F.col("pos") + 0.5) / (pos + 1) - (F.col("seen") - F.col("pos") + 0.5) / (n - pos + 1)) / F.sqrt(share * (1 / max(pos, 1) + 1 / max(n - pos, 1)))
    strong = np.array(sorted(r.slot for r in counts.where(F.abs(z) > TELLS * 0.999).select("slot").collect()) if 0 < pos < n else [], np.int32)
    telling = spark.sparkContext.broadcast(strong)

    def keep_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = [x[np.isin(x, telling.value)].tobytes() for x in (np.frombuffer(t, np.int32) for t in batch.column(1).to_pylist())]
            yield pa.record_batch([batch.column(0), pa.array(some, pa.binary()), batch.column(2)], names=["label", "terms", "id"])

    rows = fitted.mapInArrow(keep_terms, "label int, terms binary, id string").collect()
    rows.sort(key=lambda r: (r.id, r.terms))
    model = fit([np.frombuffer(r.terms, np.int32).astype(np.int64) for r in rows], np.array([r.label for r in rows], np.float32))
    held = spark.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = held.value
        for batch in batches:
            for a, b, buf, off in pieces(batch.column(1)):
                raw = machine.raw(*terms(buf, off), b - a)
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(1 / (1 + np.exp(-np.clip(raw, -500, 500))))], names=["id", "score"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(score, f"id {kind}, score double")
    return out.withColumnRenamed("id", id_col)
