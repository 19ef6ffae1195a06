"""Document quality by Bradley-Terry pairwise ranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.sample import known
from lumenfold.llm.store import Tables
from lumenfold.llm.textarrays import U, Words, mix, pieces, windows

#: Bins of a feature; cells of a score's unit for counting pairs, and groups of cells for the second derivatives; rows held as bins at once.
BINS, CELLS, GROUPS, ROWS = 8, 128, 64, 4096
#: Rows of a task while fitting. Weights are whole multiples of 1 / FINE, so that sums are exact and their order says nothing.
TASK, FINE = 65_536, float(1 << 22)
#: Byte classes whose shares are features: letters, digits, blanks and each sign on its own.
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
N_FEATURES = len(SIGNS) + 14


def features(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of numbers for each document: shares of byte classes, and how long and how repetitive it is."""
    n = len(off) - 1
    size = np.maximum(np.diff(off), 1)
    kind = np.full(256, 0)
    kind[97:123], kind[65:91], kind[48:58], kind[128:192], kind[192:], kind[32], kind[10] = 1, 2, 3, 4, 5, 6, 7
    for i, c in enumerate(SIGNS):
        kind[ord(c)] = 8 + i
    width = 8 + len(SIGNS)
    of = np.repeat(np.arange(n), np.diff(off))
    shares = np.bincount(of * width + kind[buf], minlength=n * width).reshape(n, width)[:, 1:] / size[:, None]
    words = Words(buf, off)
    count = np.maximum(words.count, 1)

    def distinct(doc: np.ndarray, name: np.ndarray) -> np.ndarray:
        """Share of a document's items that repeat an earlier one."""
        if not len(doc):
            return np.zeros(n)
        order = np.lexsort((name, doc))
        d, k = doc[order], name[order]
        new = np.concatenate([[True], (d[1:] != d[:-1]) | (k[1:] != k[:-1])])
        return 1 - np.bincount(d[new], minlength=n) / np.maximum(np.bincount(d, minlength=n), 1)

    gap = np.zeros(256, bool)
    gap[10] = True
    lines = Words(buf, off, gap)
    at, tri = windows(words, 3)
    # The share of the commonest word tail (last byte, second last): marks glued to every word. A word of one byte has 0 before it, not what its neighbour in the batch ends with.
    before = np.where(words.end - words.start > 1, buf[np.maximum(words.end - 2, 0)], 0) if len(words.end) else np.zeros(0, U)
    tail = mix(buf[words.end - 1].astype(U) * U(257) + before.astype(U)) if len(words.end) else np.zeros(0, U)
    more = [
        np.log1p(words.count), np.diff(off) / count, distinct(words.doc, words.name), distinct(words.doc[at], tri), distinct(lines.doc, lines.name),
        np.log1p(words.count / np.maximum(lines.count, 1)), distinct(words.doc, tail),
    ]
    return np.concatenate([shares, np.stack(more, 1)], 1)


class Ranker:
    """Score of a document: a sum of one weight for each feature's bin; quality is sigmoid(score - threshold)."""

    def __init__(self, edges: list[np.ndarray], weights: list[np.ndarray], threshold: float):
        self.edges, self.weights, self.threshold = edges, weights, threshold

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for i, (e, w) in enumerate(zip(self.edges, self.weights, strict=True)):
            out += w[np.searchsorted(e, x[:, i], "right")]
        return out

    def cell(self, x: np.ndarray) -> np.ndarray:
        return np.floor(CELLS * self.raw(x)).astype(np.int64)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x) - self.threshold, -500, 500)))


#: Adds up f(labels, features) over all rows: arrays of so many whole numbers.
Total = Callable[[Callable[[np.ndarray, np.ndarray], np.ndarray], int], np.ndarray]


def quantiles(total: Total, n: int, width: int) -> list[np.ndarray]:
    """The distinct k/BINS quantiles of each feature: the values of these ranks, found exactly, 8 bits of their order at a time."""
    rank = np.tile(np.arange(1, BINS) * n // BINS, (width, 1))
    prefix = np.zeros((width, BINS - 1), np.uint32)
    for shift in (24, 16, 8, 0):

        def count(_, x: np.ndarray, shift=shift, prefix=prefix) -> np.ndarray:
            out = np.zeros((width, BINS - 1, 256))
            for i in range(width):
                bits = (x[:, i].astype(np.float32) + np.float32(0)).view(np.uint32)
                key = np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31))
                digit = key >> np.uint32(shift) & np.uint32(255)
                for k in range(BINS - 1):
                    if k and prefix[i, k] == prefix[i, k - 1]:
                        out[i, k] = out[i, k - 1]
                    else:
                        out[i, k] = np.bincount(digit if shift == 24 else digit[key >> np.uint32(shift + 8) == prefix[i, k]], minlength=256)
            return out.ravel()

        below = np.cumsum(total(count, prefix.size * 256).reshape(*prefix.shape, 256), 2)
        digit = (below <= rank[:, :, None]).sum(2)
        rank = rank - np.where(digit > 0, np.take_along_axis(below, np.maximum(digit - 1, 0)[:, :, None], 2)[:, :, 0], 0).astype(int)
        prefix = prefix << np.uint32(8) | digit.astype(np.uint32)
    value = np.where(prefix >> 31, prefix & np.uint32((1 << 31) - 1), ~prefix).view(np.float32)
    return [np.unique(v).astype(float) for v in value]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _against(count: np.ndarray, f: Callable) -> np.ndarray:
    """For each cell, the sum over all cells of their count times f(other cell's score - own score)."""
    m = len(count)
    return np.convolve(count, f(np.arange(m - 1, -m, -1) / CELLS))[m - 1 : 2 * m - 1]


def train(total: Total, width: int, rounds: int, decay: float) -> Ranker:
    """Bradley-Terry: P(good beats bad) = sigmoid(score difference), by Newton's method on all pairs of all rows; then the score that tells the labels apart best.

    A pair's scores are compared to 1 / CELLS: pairs of cells are counted, not pairs of rows. Each round is two passes: counts of scores, which give
    the loss of all pairs (a step that does not lower it is halved), and sums of the features by what their rows' pairs weigh.
    Without both labels there are no pairs: every score is the smoothed share of label 1.
    """
    size = total(lambda y, _: np.bincount(y, minlength=2), 2)
    n, (n_bad, n_good) = int(size.sum()), size
    if not n_bad or not n_good:
        prior = (n_good + 1) / (n + 2)
        return Ranker([], [], -float(np.log(prior / (1 - prior))))
    edges = quantiles(total, n, width)
    offset = np.concatenate([[0], np.cumsum([len(e) + 1 for e in edges])])
    d = int(offset[-1])

    def counted(w: np.ndarray) -> tuple[Ranker, int, np.ndarray, float]:
        """The ranker, its first cell, rows by label and cell, and the mean loss of a pair with the decay."""
        ranker = Ranker(edges, np.split(w, offset[1:-1]), 0.0)
        low, high = (int(np.floor(CELLS * sum(f(v) for v in ranker.weights))) + more for f, more in ((np.min, -1), (np.max, 2)))
        m = high - low
        count = total(lambda y, x: np.bincount(y * m + ranker.cell(x) - low, minlength=2 * m), 2 * m).reshape(2, m)
        loss = (count[1] @ _against(count[0], lambda t: np.logaddexp(0, t))) / (n_good * n_bad)
        return ranker, low, count, float(loss + decay / 2 * (w @ w))

    w = np.zeros(d)
    ranker, low, count, loss = counted(w)
    for _ in range(rounds):
        m = count.shape[1]
        wide = -(-m // GROUPS)
        group = np.arange(m) // wide
        some = np.stack([np.bincount(group, c, GROUPS) for c in count])
        mid = (np.arange(GROUPS) + 0.5) * wide / CELLS
        curve = _sigmoid(mid[:, None] - mid) * _sigmoid(mid - mid[:, None])
        # What a row's pairs weigh: first derivatives by cell, second ones by group of cells; of bad rows, then of good ones.
        first = np.rint(FINE * np.stack([_against(count[1], lambda t: _sigmoid(-t)) / n_good, _against(count[0], _sigmoid) / n_bad]))
        second = np.rint(FINE * np.stack([curve @ some[1] / n_good * (n / n_bad), curve @ some[0] / n_bad * (n / n_good)]))

        def sums(y: np.ndarray, x: np.ndarray, ranker=ranker, low=low, group=group, first=first, second=second) -> np.ndarray:
            one, cross, square = np.zeros((2, d)), np.zeros((2 * GROUPS, d)), np.zeros((d, d))
            for a in range(0, len(y), ROWS):
                label, some = y[a : a + ROWS], x[a : a + ROWS]
                cell = ranker.cell(some) - low
                at, rows = group[cell], np.arange(len(label))
                hot, member, side = np.zeros((len(label), d)), np.zeros((len(label), 2 * GROUPS)), np.zeros((len(label), 2))
                hot[rows[:, None], np.stack([np.searchsorted(e, some[:, i], "right") + offset[i] for i, e in enumerate(edges)], 1)] = 1
                member[rows, label * GROUPS + at] = 1
                side[rows, label] = first[label, cell]
                one += side.T @ hot
                cross += member.T @ hot
                square += (hot * second[label, at][:, None]).T @ hot
            return np.concatenate([one.ravel(), cross.ravel(), square[np.triu_indices(d)]])

        got = total(sums, 2 * d + 2 * GROUPS * d + d * (d + 1) // 2)
        one, cross = got[: 2 * d].reshape(2, d), got[2 * d : 2 * (GROUPS + 1) * d].reshape(2, GROUPS, d)
        slope = one[0] / (FINE * n_bad) - one[1] / (FINE * n_good) + decay * w
        square = np.zeros((d, d))
        square[np.triu_indices(d)] = got[2 * (GROUPS + 1) * d :] / (FINE * n)
        square += np.triu(square, 1).T
        both = cross[1].T @ curve @ cross[0] / (n_good * n_bad)
        step, t = np.linalg.solve(square - both - both.T + decay * np.eye(d), slope), 1.0
        while (new := counted(w - t * step))[3] > loss and t > 1 / 64:
            t /= 2
        gain = loss - new[3]
        if gain <= 0:
            break
        w = w - t * step
        ranker, low, count, loss = new
        if gain < 1e-6:
            break
    # Every edge of a cell is tried: bad rows below it and good rows from it on.
    below = np.concatenate([np.zeros((2, 1)), np.cumsum(count, 1)], 1)
    right = (n_good - below[1]) / n_good + below[0] / n_bad
    best = np.flatnonzero(right >= right.max() - 1e-12)
    return Ranker(edges, ranker.weights, float((low + best[len(best) // 2]) / CELLS))


def fit(x: np.ndarray, labels: np.ndarray, rounds: int = 12, decay: float = 1e-4) -> Ranker:
    """``train`` on rows in memory."""
    return train(lambda f, size: f(labels, x), x.shape[1], rounds, decay)


def total_of(rows: DataFrame, width: int) -> Total:
    """Totals over a table ``label, x``: tasks add up their rows, Spark adds up the tasks."""

    def total(f: Callable, size: int) -> np.ndarray:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(size)
            for batch in batches:
                out += f(batch.column(0).to_numpy(), unpacked(batch.column(1), width))
            at = np.flatnonzero(out)
            yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(out[at].astype(np.int64))], names=["slot", "value"])

        got = rows.mapInArrow(add, "slot int, value long").groupBy("slot").agg(F.sum("value").alias("value")).toArrow()
        out = np.zeros(size)
        out[got.column("slot").to_numpy()] = got.column("value").to_numpy()
        return out

    return total


def unpacked(x: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.to_pylist()), np.float32).reshape(-1, width).astype(float)


def score_quality(docs: DataFrame, labels: DataFrame, fit_on: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rounds: int = 12, decay: float = 1e-4) -> DataFrame:
    """``id, score`` for every document, from its whole text.

    The ranker is fitted on all labelled documents for which ``fit_on`` (on the labels' columns) holds. A null or empty text has
    features of zero and is scored by them. Nulls among labels or their ids do not count; rows that
    repeat are scored each; an empty table gives no rows; other columns are not read. Texts are read once: their features are a written table.
    """
    spark, width = docs.sparkSession, N_FEATURES
    kind = docs.schema[id_col].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, off in pieces(batch.column(1)):
                x = features(buf, off).astype(np.float32)
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "x"])

    tables = Tables(spark, "ranking")
    measured = tables.keep(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(measure, f"id {kind}, x binary"))
    told = tables.keep(known(labels, id_col, label_col, fit_on))
    rows = measured.join(told, F.col("id") == F.col("__id")).select("label", "x")
    rows = tables.keep(rows.repartition(max(8, told.count() // TASK)))
    held = spark.sparkContext.broadcast(train(total_of(rows, width), width, rounds, decay))
    tables.drop(rows, told)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranker = held.value
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(ranker.score(unpacked(batch.column(1), width)))], names=["id", "score"])

    return measured.mapInArrow(score, f"id {kind}, score double").withColumnRenamed("id", id_col)
