"""Exact byte-pair encoding by dynamic programming over prefixes.

For every prefix of a piece exactly one vocabulary token can be the last of its encoding. It is found among the
tokens that are suffixes of the prefix (one pass of a suffix-matching automaton) by testing whether it may follow
the last token of the shorter prefix: two tokens may stand side by side if no merge of lower rank would have run
across their boundary. Back-pointers give the ids. The cost is linear in the length of the piece, however long.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import os
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from partita.tables import table

#: The pre-tokeniser's pattern of the byte_bpe_50k vocabulary (a fixed value of the format).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = os.environ.get("PARTITA_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Pieces whose ids a worker remembers; beyond that it forgets all.
REMEMBER = 200_000
MOST_BYTES = 64 << 20  # of a vocabulary file


class Encoder:
    def __init__(self, vocabulary: bytes):
        ranks = {}
        for line in vocabulary.splitlines():
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
        self.ranks, self.pattern = ranks, regex.compile(PATTERN)
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()
        self.joined: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            self.halves[rank] = (rank, rank)
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None and left < rank and right < rank and self.fit(left, right):
                    self.joined[left, right] = rank
                    self.halves[rank] = (left, right)
                    break
        self._fits.clear()
        self.known: dict[str, list[int]] = {}

    def fit(self, left: int, right: int) -> bool:
        """Whether the encoding of the two tokens' bytes is these two tokens.

        Undoes the merges of both, the latest first; if the two tokens that then touch have a merge earlier than
        the one undone, the encoder would have joined them instead.
        """
        before = None
        while True:
            merge = self.joined.get((left, right))
            if merge is not None and (before is None or merge < before):
                return False
            undo_left = left > right
            if undo_left:
                before, parts = left, self.halves[left]
                if parts[0] != left:
                    left = parts[1]
                    continue
                before, parts = right + 1, self.halves[right]
                if parts[0] == right:
                    return True
                right = parts[0]
            else:
                before, parts = right + 1, self.halves[right]
                if parts[0] != right:
                    right = parts[0]
                    continue
                before, parts = left, self.halves[left]
                if parts[0] == left:
                    return True
                left = parts[1]

    def piece(self, data: bytes) -> list[int]:
        """The ids of one piece of the pre-tokeniser."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        n = len(data)
        last, size = [-1] * (n + 1), [0] * (n + 1)
        fits, end, found = self._fits, -1, []

        def settle(end: int, found: list[tuple[int, int]]) -> None:
            for rank, length in found:
                start = end - length
                if start:
                    left = last[start]
                    if left < 0:
                        continue
                    ok = fits.get((left, rank))
                    if ok is None:
                        ok = fits[left, rank] = self.fit(left, rank)
                    if not ok:
                        continue
                last[end], size[end] = rank, length
                return

        for at, hit in self.automaton.iter(data.decode("latin-1")):
            if at != end:
                if found:
                    settle(end + 1, found)
                end, found = at, []
            found.append(hit)
        settle(end + 1, found)
        if len(fits) > 2_000_000:
            fits.clear()
        out, at = [], n
        while at > 0:
            out.append(last[at])
            at -= size[at]
        return out[::-1]

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text, without special tokens. Null and empty texts have none. Lone surrogates count as U+FFFD."""
        if not text:
            return []
        known, out = self.known, []
        for p in self.pattern.findall(text):
            ids = known.get(p)
            if ids is None:
                ids = self.piece(p.encode("utf-8", "replace") if p.isascii() else p.encode("utf-16", "surrogatepass").decode("utf-16", "replace").encode())
                if len(p) <= 64:
                    if len(known) >= REMEMBER:
                        known.clear()
                    known[p] = ids
            out += ids
        return out


@functools.cache
def encoder(path: str = VOCABULARY) -> Encoder:
    """An encoder for use on the driver."""
    with open(path, "rb") as f:
        return Encoder(f.read())


_HERE: dict[bytes, Encoder] = {}


def _here(key: bytes, sent) -> Encoder:
    """The encoder of this Python worker, made once for all of its tasks."""
    if key not in _HERE:
        _HERE.clear()
        _HERE[key] = Encoder(sent.value)
    return _HERE[key]


def shipped(spark: SparkSession, path: str = VOCABULARY):
    """A function that gives a task its worker's encoder. The driver reads the vocabulary, or fails at once, and sends its bytes along; executors need no file."""
    with open(path, "rb") as f:
        data = f.read(MOST_BYTES + 1)
    if len(data) > MOST_BYTES:
        raise ValueError(f"a vocabulary of over {MOST_BYTES} bytes")
    sent, key = spark.sparkContext.broadcast(data), hashlib.md5(data).digest()

    return lambda: _here(key, sent)


def texts_of(column: pa.Array) -> list[str | None]:
    """Texts of a string column; invalid UTF-8 is read with U+FFFD for the broken bytes."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [None if x is None else x.decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]


def encoded(docs: DataFrame, id_: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(id, ids): the ids of every row's text; null and empty texts have an empty list, repeated rows stay. No shuffle."""
    schema = f"`{id_}` {docs.schema[id_].dataType.simpleString()}, ids array<int>"

    get = shipped(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = get()
        for b in batches:
            texts = texts_of(b.column(1))
            for lo in range(0, len(texts), 512):
                ids = [enc.encode(t) for t in texts[lo : lo + 512]]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = np.fromiter((i for x in ids for i in x), dtype=np.int32, count=offsets[-1])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, 512), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[id_, "ids"])

    return docs.select(id_, text).mapInArrow(run, schema)


def sized(docs: DataFrame, id_: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(id, tokens): the number of ids of every row's text, without sending the ids anywhere."""
    schema = f"`{id_}` {docs.schema[id_].dataType.simpleString()}, tokens long"

    get = shipped(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = get()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(enc.encode(t)) for t in texts_of(b.column(1))], pa.int64())], names=[id_, "tokens"])

    return docs.select(id_, text).mapInArrow(run, schema)


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoded(table(spark, d, "documents"))
