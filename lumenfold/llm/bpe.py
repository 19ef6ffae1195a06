"""Byte-level BPE: encoding by a pair occurrence index, and decoding."""

from __future__ import annotations

import hashlib
import heapq
import json
from collections import defaultdict
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The published split pattern of byte-level BPE (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of text whose new words are merged together, and words kept between such pieces.
PIECE, KEPT = 2 << 20, 200_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: printable Latin-1 for itself, the others from code point 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, ranked merges and special strings of a tokenizer file."""

    def __init__(self, text: str):
        spec = json.loads(text)
        letters = byte_letters()
        ids = spec["model"]["vocab"]
        self.bytes: list[bytes] = [b""] * (max([*ids.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for token, i in ids.items():
            self.bytes[i] = bytes(letters[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.single = [ids[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.left, self.right, self.made = [], [], []
        for m in spec["model"]["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            self.left.append(ids[a])
            self.right.append(ids[b])
            self.made.append(ids[a + b])


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.rank = {(a, b): r for r, (a, b) in enumerate(zip(vocabulary.left, vocabulary.right, strict=True))}
        self.split = regex.compile(PATTERN).findall
        marks = sorted(vocabulary.special, key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, marks)) + ")") if marks else None
        self.known: dict[str, bytes] = {}
        self.single = np.array(vocabulary.single, np.int32)
        # Ranks of two bytes; 256 stands for the end of a word.
        self.first = np.full((257, 257), -1, np.int32)
        byte = {x: k for k, x in enumerate(vocabulary.single)}
        rights, lefts = defaultdict(list), defaultdict(list)
        for (a, b), r in self.rank.items():
            rights[a].append((b, r))
            lefts[b].append((a, r))
            if a in byte and b in byte:
                self.first[byte[a], byte[b]] = r
        # Of each symbol the symbols that pair with it on its right (left), and the ranks.
        self.rights, self.lefts = ({x: np.array(some).T for x, some in side.items()} for side in (rights, lefts))
        # Ranks by symbol, filled for one symbol's pairs at a time; the last two are of ends and of merged symbols.
        self.ranks = np.full(len(vocabulary.bytes) + 2, -1, np.int32)

    def _ranked(self, side: dict[int, np.ndarray], c: int, others: np.ndarray) -> np.ndarray | None:
        pairs = side.get(c)
        if pairs is None:
            return None
        self.ranks[pairs[0]] = pairs[1]
        out = self.ranks[others]
        self.ranks[pairs[0]] = -1
        return out

    def _merge(self, words: list[str]) -> None:
        """Ids of many words at once.

        The index maps every rank that is present to the positions of its pair's first symbol. Ranks are applied in ascending order, each at
        all its positions together; a merge replaces two symbols by one and enters its two new neighbours. As a merged
        symbol only occurs in pairs of higher rank than its own, one ascending pass applies all.
        """
        v = self.v
        coded = [w.encode("utf-8", "surrogatepass") for w in words]
        ends = np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded)) + 1) - 1
        n = int(ends[-1]) + 1
        within = np.ones(n, bool)
        within[ends] = False
        data = np.full(n, 256, np.int16)
        data[within] = np.frombuffer(b"".join(coded), np.uint8)
        symbols = np.full(n, -1, np.int32)
        symbols[within] = self.single[data[within]]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        index: dict[int, list[np.ndarray]] = {}
        present: list[int] = []

        def enter(ranks: np.ndarray, places: np.ndarray) -> None:
            hit = np.flatnonzero(ranks >= 0)
            if not len(hit):
                return
            ranks, places = ranks[hit], places[hit]
            order = np.argsort(ranks, kind="stable")
            ranks, places = ranks[order], places[order]
            cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
            for r, i, j in zip(ranks[cuts[:-1]].tolist(), cuts, cuts[1:], strict=False):
                if r in index:
                    index[r].append(places[i:j])
                else:
                    index[r] = [places[i:j]]
                    heapq.heappush(present, r)

        enter(self.first[data[:-1], data[1:]], np.arange(n - 1))
        while present:
            r = heapq.heappop(present)
            a, b, c = v.left[r], v.right[r], v.made[r]
            i = np.sort(np.concatenate(index.pop(r)))
            i = i[np.concatenate([[True], i[1:] != i[:-1]])]
            j = after[i]
            still = (symbols[i] == a) & (symbols[j] == b)
            i, j = i[still], j[still]
            if a == b and len(i) > 1:
                # Of positions that overlap in a row, every second one merges, from the left.
                at = np.arange(len(i))
                begin = np.maximum.accumulate(np.where(np.concatenate([[True], i[1:] != j[:-1]]), at, 0))
                alternate = (at - begin) % 2 == 0
                i, j = i[alternate], j[alternate]
            if not len(i):
                continue
            k = after[j]
            symbols[i], symbols[j] = c, -2
            after[i] = k
            before[k] = i
            new = self._ranked(self.rights, c, symbols[k])
            if new is not None:
                enter(new, i)
            h = before[i]
            new = self._ranked(self.lefts, c, symbols[h])
            if new is not None:
                enter(new, h)
        left = symbols[symbols != -2]
        cuts = (4 * (np.flatnonzero(left == -1) - np.arange(len(words)))).tolist()
        ids = left[left >= 0].astype("<i4").tobytes()
        for w, x, y in zip(words, [0, *cuts], cuts, strict=False):
            self.known[w] = ids[x:y]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        parts = []
        for text in texts:
            pieces = self.marks.split(text) if self.marks else [text]
            parts.append([p if k % 2 else self.split(p) for k, p in enumerate(pieces)])
        words = set().union(*(p for doc in parts for p in doc if not isinstance(p, str)))
        new = words - self.known.keys()
        if new:
            if len(self.known) + len(new) > KEPT and self.known:
                self.known.clear()
                new = words
            self._merge(list(new))
        get = self.known.__getitem__
        return [b"".join([self.v.special[p].to_bytes(4, "little") if isinstance(p, str) else b"".join(map(get, p)) for p in doc]) for doc in parts]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.v.bytes.__getitem__, memoryview(ids).cast("I") if ids else ())).decode("utf-8", "replace")


def id_lists(got: list[bytes]) -> pa.ListArray:
    """The ids of many texts as lists, without an object for each id."""
    ends = np.cumsum([0, *(len(x) // 4 for x in got)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(got), "<i4"), pa.int32()))


def encode_documents(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """``id, n_tokens, ids_sha256, decoded_sha256, ids``: every whole text encoded and decoded again.

    The strings of special tokens in a text become those tokens. A null text counts as empty, and has no tokens. Rows
    that repeat are encoded each; a null id stays null. An empty table gives no rows. ``ids`` (array<int>) is null unless ``with_ids``.
    The vocabulary is read by the driver and broadcast; its size does not depend on the data. Distinct words
    of a piece of the partition are merged together; a bounded number is kept for the next piece.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    held = spark.sparkContext.broadcast(Path(vocabulary_path).read_text(encoding="utf-8"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(Vocabulary(held.value))
        for batch in batches:
            at, n = 0, batch.num_rows
            while at < n:
                texts, size, first = [], 0, at
                while at < n and (not texts or size < PIECE):
                    texts.append(batch.column(1)[at].as_py() or "")
                    size += len(texts[-1])
                    at += 1
                got = coder.encode(texts)
                cols = [
                    batch.column(0).slice(first, len(texts)),
                    pa.array([len(x) // 4 for x in got], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in got], pa.string()),
                    pa.array([hashlib.sha256(coder.decode(x).encode("utf-8", "replace")).hexdigest() for x in got], pa.string()),
                    id_lists(got) if with_ids else pa.nulls(len(texts), pa.list_(pa.int32())),
                ]
                yield pa.record_batch(cols, names=["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>")
    return out.withColumnRenamed("id", id_col)
