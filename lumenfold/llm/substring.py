"""Substring deduplication by recompression.

Two rounds rename every text: a pair of neighbours becomes one symbol if the first draws 0 and the
second 1 (equal neighbours draw alike, so a run waits and is named by its symbol and length, inside a span of symbols).
A name is a 64-bit function of what it stands for, so it is the same everywhere: a global dictionary
without a shuffle. Two equal passages get the same symbols but for a few at their ends. Spans of
symbols that documents share show where passages may repeat; there the windows themselves are compared.

Why nothing is lost: whether two neighbours join depends on these two alone. So in a window of 13 words the
first round is known but for one word at each end, the second but for two words more; the seven words
left are whole symbols of at most four words. The span that starts at the first of them and ends with
the symbol that reaches four words has at most seven words, so it lies in every copy of the window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.rows import positions
from lumenfold.llm.store import Tables
from lumenfold.llm.textarrays import BASE, U, Words, mix, pieces, windows

WINDOW = 13
SPAN = 4
ROUNDS = 2
#: Bytes of text in a block of documents, and of names in a bucket; a task holds one of them at a time.
BLOCK_BYTES = 4 << 20
SHORT, SECOND = U((1 << 48) - 1), U((1 << 32) - 1)
BUCKET_BYTES = 8 << 20


def recompress(words: Words, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols after ``rounds`` rounds: name, first word (counting those of all documents), number of words."""
    doc, name = words.doc, words.name
    at, size = np.arange(len(name)), np.ones(len(name), np.int64)
    with np.errstate(over="ignore"):
        for level in range(rounds if len(name) else 0):
            tag = U(2 * level + 1)
            bit = (mix(name + tag * BASE[0]) >> U(63)).astype(bool)
            first = np.zeros(len(name), bool)
            first[:-1] = ~bit[:-1] & bit[1:] & (doc[1:] == doc[:-1])
            keep = np.flatnonzero(~np.concatenate([[False], first[:-1]]))
            made, nxt = first[keep], np.minimum(keep + 1, len(name) - 1)
            name = np.where(made, mix(name[keep] * BASE[0] + mix(name[nxt] + tag)), name[keep])
            size = size[keep] + np.where(made, size[nxt], 0)
            at, doc = at[keep], doc[keep]
    return name, at, size


def spans(words: Words, rounds: int = ROUNDS, least: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At each symbol, the shortest span of whole symbols with ``least`` words or more: name, first word, last word + 1.

    Inside a span, a run of one symbol is named by the symbol and its length.
    """
    name, at, size = recompress(words, rounds)
    n = len(name)
    doc = words.doc[at]
    done, run = np.zeros(n, bool), np.zeros(n, U)
    acc, total = np.zeros(n, U), np.zeros(n, np.int64)
    with np.errstate(over="ignore"):
        for j in range(least):
            live = np.flatnonzero(~done)
            live = live[live + j < n]
            live = live[doc[live + j] == doc[live]]
            same = name[live + j] == name[live + j - 1] if j else np.zeros(len(live), bool)
            run[live] = np.where(same, run[live] + U(1), U(1))
            acc[live] = np.where(same, acc[live] + mix(name[live + j] + run[live]), mix(acc[live]) * BASE[1] + name[live + j])
            total[live] += size[live + j]
            done[live[total[live] >= least]] = True
    ok = np.flatnonzero(done)
    return mix(acc[ok]), at[ok], at[ok] + total[ok]


def _blocks(column: pa.Array) -> Iterator[tuple[int, int, Words]]:
    for a, b, buf, off in pieces(column, 1 << 20):
        yield a, b, Words(buf, off, names=2)


def _packed(bucket: np.ndarray, names: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Sets of names by bucket, the low 48 bits of each: of 1e13 names, 4 % then meet another's by chance, which costs a comparison and no result."""
    order = np.argsort(bucket, kind="stable")
    bucket, short = bucket[order], names[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else []
    for i, a in enumerate(cut):
        b = cut[i + 1] if i + 1 < len(cut) else len(bucket)
        yield int(bucket[a]), short[a:b].tobytes()


def _names(cells: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """The packed names of all rows, and the row of each."""
    short = np.frombuffer(b"".join(cells), np.uint8).reshape(-1, 6)
    out = np.zeros((len(short), 8), np.uint8)
    out[:, :6] = short
    return out.view("<u8")[:, 0], np.repeat(np.arange(len(cells)), [len(x) // 6 for x in cells])


def _candidates(words: Words, shared: np.ndarray, window: int) -> np.ndarray:
    """First words of the windows that hold a whole shared span."""
    at, _ = windows(words, window)
    key, first, last = spans(words)
    hit = np.isin(key & SHORT, shared)
    first, last = first[hit], last[hit]
    mark = np.zeros(len(words.doc) + 1, np.int64)
    np.add.at(mark, np.maximum(last - window, words.first[words.doc[first]]), 1)
    np.add.at(mark, first + 1, -1)
    return at[np.cumsum(mark)[at] > 0]


def _runs(ids: np.ndarray) -> tuple[bytes, bytes]:
    """Ids that follow each other, packed: each run's id and its length."""
    head = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)
    return ids[head].astype(np.int64).tobytes(), np.diff(np.append(head, len(ids))).astype(np.uint32).tobytes()


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Whether a row of sorted keys differs from the one before."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """``id, n_words, n_removed, kept_sha256, kept_text``: documents without passages seen in a document of smaller id.

    A word goes if a window of ``window`` words that covers it also starts in a document with a smaller id; windows are
    judged on the input. Words are maximal runs outside ``[\\x20\\x09-\\x0D]``, unchanged. A null or
    empty text has no words; a text shorter than the window stays whole. A document whose id is null stays
    whole and makes no other lose words. Rows that share an id lose nothing to each other. Ids of any type that sorts will do: others
    than whole numbers are numbered in their order first. An empty
    table gives no rows; other columns are not read. ``kept_text`` is null unless ``with_text``.

    ``window`` is at least 13, the length for which two rounds are proven to show every repeat.

    One exchange deals the texts out in blocks of a few MB; all three passes over the texts reuse it. A block sends each name
    and each candidate window once, with its least id, however often it holds it: a passage that a third of all documents share costs a bucket
    one entry a block, not one a document.
    """
    if window < WINDOW:
        raise ValueError("the two rounds show every repeat of 13 words or more")
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("shown"), F.col(text_col).alias("text"))
    size = base.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, min(size[0], -(-int(size[1]) // BLOCK_BYTES)))
    buckets = max(1, -(-int(size[1]) // BUCKET_BYTES))
    whole = id_type in ("tinyint", "smallint", "int", "bigint")
    if whole:
        base = base.select(F.col("shown").cast("long").alias("id"), F.lit(None).cast("string").alias("shown"), "text")
    else:
        numbers = positions(base.select("shown").where("shown IS NOT NULL").distinct(), [F.col("shown")], Tables(spark, "substring"))
        base = base.join(numbers.withColumnRenamed("shown", "__shown"), F.col("shown") == F.col("__shown"), "left").select(F.col("position").alias("id"), F.col("shown").cast("string").alias("shown"), "text")
    # Rows that share an id, or have none, lie apart by their texts.
    row = F.xxhash64("id", "text").alias("row")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), blocks // 4)
    dealt = base.select(F.coalesce("id", F.lit(0)).alias("id"), F.col("id").isNotNull().alias("known"), "shown", "text", row, F.pmod(row, F.lit(blocks)).alias("block")).repartition(parts, "block")

    def names_of(pdf: pd.DataFrame) -> pd.DataFrame:
        """Of a block, the names of its documents' spans, by bucket; those that two of its documents have once more, as block -1."""
        own, pdf = int(pdf.block.iloc[0]), pdf[pdf.known]
        ids = pdf.id.to_numpy()
        key, of = [np.zeros(0, U)], [np.zeros(0, np.int64)]
        for a, _, words in _blocks(pa.array(pdf.text, pa.string())):
            k, first, _ = spans(words)
            key.append(k & SHORT)
            of.append(ids[words.doc[first] + a] if len(k) else of[0])
        key, of = np.concatenate(key), np.concatenate(of)
        order = np.lexsort((of, key))
        key, of = key[order], of[order]
        same = key[1:] == key[:-1]
        twice = np.unique(key[1:][same & (of[1:] != of[:-1])])
        key = key[_groups(key)]
        out = [(x, own, c) for x, c in _packed((key % U(buckets)).astype(np.int64), key)]
        out += [(x, -1, c) for x, c in _packed((twice % U(buckets)).astype(np.int64), twice)]
        return pd.DataFrame(out, columns=["bucket", "block", "cells"])

    def shared_of(pdf: pd.DataFrame) -> pd.DataFrame:
        """Of a bucket, the names that two documents have, sent back to each block that has them."""
        cells, row = _names(pdf.cells)
        where = pdf.block.to_numpy()[row]
        order = np.argsort(cells, kind="stable")
        cells, where = cells[order], where[order]
        same = cells[1:] == cells[:-1]
        many = np.zeros(len(cells), bool)
        many[1:] |= same
        many[:-1] |= same
        ok = many & (where >= 0)
        return pd.DataFrame(list(_packed(where[ok], cells[ok])), columns=["block", "cells"])

    def windows_of(texts: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
        """Of a block, the windows that may repeat, each once: two names and the least id, by bucket. Those that repeat in the block itself are settled here, by row and place."""
        own = int(texts.block.iloc[0]) if len(texts) else -1
        shared = np.unique(_names(keys.cells)[0]) if len(keys) else np.zeros(0, U)
        texts = texts[texts.known] if len(texts) else texts
        cells = [(np.zeros(0, U), np.zeros(0, U), *[np.zeros(0, np.int64)] * 3)]
        if len(shared) and len(texts):
            ids, rows = texts.id.to_numpy(), texts.row.to_numpy()
            for a, _, words in _blocks(pa.array(texts.text, pa.string())):
                at = _candidates(words, shared, window)
                if len(at):
                    where, one = windows(words, window, 0)
                    _, two = windows(words, window, 1)
                    pick, doc = np.searchsorted(where, at), words.doc[at]
                    cells.append((one[pick], two[pick] & SECOND, ids[a + doc], at - words.first[doc], rows[a + doc]))
        one, two, of, at, row = (np.concatenate(x) for x in zip(*cells, strict=True))
        order = np.lexsort((of, two, one))
        one, two, of, at, row = one[order], two[order], of[order], at[order], row[order]
        new = _groups(one, two)
        out = []
        later = np.flatnonzero(of > of[np.flatnonzero(new)][np.cumsum(new) - 1]) if len(of) else np.zeros(0, np.int64)
        if len(later):
            later = later[np.lexsort((at[later], row[later]))]
            out.append((own % buckets, own, *_runs(row[later]), None, None, at[later].astype(np.uint32).tobytes()))
        one, two, of = one[new], two[new], of[new]
        bucket = (one % U(buckets)).astype(np.int64)
        order = np.lexsort((of, bucket))
        for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []:
            out.append((int(bucket[part[0]]), own, *_runs(of[part]), one[part].tobytes(), two[part].astype(np.uint32).tobytes(), None))
        return pd.DataFrame(out, columns=["bucket", "block", "ids", "many", "one", "two", "at"])

    def repeats_of(pdf: pd.DataFrame) -> pd.DataFrame:
        """Of a bucket, for each block the windows that start in a smaller document of another block: both names agree, 96 bits of the words. Settled places pass through."""
        settled = pdf[pdf["at"].notna()]
        out = [(int(r.block), r.ids, r.many, r["at"], None, None) for _, r in settled.iterrows()]
        pdf = pdf[pdf["at"].isna()]
        pile = {c: np.frombuffer(b"".join(pdf[c]), kind) for c, kind in (("ids", np.int64), ("many", np.uint32), ("one", U), ("two", np.uint32))}
        ids, one, two = np.repeat(pile["ids"], pile["many"]), pile["one"], pile["two"]
        block = np.repeat(pdf.block.to_numpy(), [len(x) // 8 for x in pdf.one]) if len(pdf) else np.zeros(0, np.int64)
        order = np.lexsort((ids, two, one))
        ids, one, two, block = ids[order], one[order], two[order], block[order]
        new = _groups(one, two)
        ok = np.flatnonzero(ids > ids[np.flatnonzero(new)][np.cumsum(new) - 1]) if len(ids) else np.zeros(0, np.int64)
        # A block whose least id is the least of all may hold the window in more documents: it settled those itself.
        ok = ok[np.argsort(block[ok], kind="stable")]
        for part in np.split(ok, np.flatnonzero(np.diff(block[ok])) + 1) if len(ok) else []:
            out.append((int(block[part[0]]), None, None, None, one[part].tobytes(), two[part].tobytes()))
        return pd.DataFrame(out, columns=["block", "ids", "many", "at", "one", "two"])

    def cut(texts: pd.DataFrame, gone: pd.DataFrame) -> pd.DataFrame:
        if not len(texts):
            return pd.DataFrame([], columns=["id", "shown", "n_words", "n_removed", "kept_sha256", "kept_text"]).astype({"id": "Int64"})
        settled, named = gone[gone["at"].notna()], gone[gone["one"].notna()]
        at_of: dict[int, list[np.ndarray]] = {}
        for keys, many, at in zip(settled["ids"], settled["many"], settled["at"], strict=True):
            ends = np.cumsum(np.frombuffer(many, np.uint32)).tolist()
            at = np.frombuffer(at, np.uint32).astype(np.int64)
            for key, a, b in zip(np.frombuffer(keys, np.int64).tolist(), [0, *ends], ends, strict=False):
                at_of.setdefault(key, []).append(at[a:b])
        places = {i: at_of[key].copy() for i, key in enumerate(texts.row.tolist()) if key in at_of}  # by row of the block
        one = np.frombuffer(b"".join(named.one), U) if len(named) else np.zeros(0, U)
        two = np.frombuffer(b"".join(named.two), np.uint32) if len(named) else np.zeros(0, np.uint32)
        if len(one):
            order = np.lexsort((two, one))
            one, two = one[order], two[order]
            known = texts.known.to_numpy()
            for a, _, words in _blocks(pa.array(texts.text, pa.string())):
                at, w1 = windows(words, window, 0)
                _, w2 = windows(words, window, 1)
                low, high = np.searchsorted(one, w1, "left"), np.searchsorted(one, w1, "right")
                hit = np.zeros(len(at), bool)
                step = 0
                while (live := np.flatnonzero(low + step < high)).size:
                    hit[live] |= two[low[live] + step] == (w2[live] & SECOND)
                    step += 1
                doc = words.doc[at] + a
                hit &= known[doc]
                doc, place = doc[hit], (at - words.first[words.doc[at]])[hit]
                cuts = np.flatnonzero(np.diff(doc)) + 1
                for part in np.split(np.arange(len(doc)), cuts) if len(doc) else []:
                    places.setdefault(int(doc[part[0]]), []).append(place[part])
        out = []
        for row, (i, known, shown, text) in enumerate(zip(texts.id.tolist(), texts.known.tolist(), texts.shown, texts.text, strict=True)):
            words = (text or "").encode().split()
            n = len(words)
            if row in places:
                cover = np.zeros(n + window + 1, np.int64)
                at = np.concatenate(places[row])
                np.add.at(cover, at, 1)
                np.add.at(cover, at + window, -1)
                words = [w for w, c in zip(words, np.cumsum(cover).tolist(), strict=False) if not c]
            kept = b" ".join(words)
            out.append((i if known else None, shown, n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
        return pd.DataFrame(out, columns=["id", "shown", "n_words", "n_removed", "kept_sha256", "kept_text"]).astype({"id": "Int64"})

    names = dealt.groupBy("block").applyInPandas(names_of, "bucket long, block long, cells binary")
    common = names.groupBy("bucket").applyInPandas(shared_of, "block long, cells binary").repartition(parts, "block")
    found = dealt.groupBy("block").cogroup(common.groupBy("block")).applyInPandas(windows_of, "bucket long, block long, ids binary, many binary, one binary, two binary, at binary")
    starts = found.groupBy("bucket").applyInPandas(repeats_of, "block long, ids binary, many binary, at binary, one binary, two binary").repartition(parts, "block")
    out = dealt.groupBy("block").cogroup(starts.groupBy("block")).applyInPandas(cut, "id long, shown string, n_words long, n_removed long, kept_sha256 string, kept_text string")
    back = F.col("id") if whole else F.col("shown")
    return out.select(back.cast(id_type).alias(id_col), "n_words", "n_removed", "kept_sha256", "kept_text")


ORACLE = r"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, w[i:i + 12] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM t WHERE len(w) >= 13)
), least AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g),
hit AS (SELECT win.doc_id, win.i FROM win JOIN least USING (g) WHERE least.m < win.doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM hit),
lost AS (SELECT doc_id, count(*) AS n, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string([w[p] FOR p IN range(1, len(w) + 1) IF n IS NULL OR NOT list_contains(ps, p)], ' '), '')) AS kept_sha256
FROM t LEFT JOIN lost USING (doc_id)
"""
