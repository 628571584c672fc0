"""Encoding of a corpus with a public byte-level BPE vocabulary (problem 6).

A text is cut by the vocabulary's pre-token pattern; the bytes of each piece form a doubly linked list, and a
priority queue of merge ranks joins neighbours, lowest rank first, skipping entries whose symbols have changed.
Pieces recur, so each worker keeps the ids of those it has seen. Decoding joins the vocabulary's strings.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Folder of the vocabulary files; the environment or a caller may name another.
FOLDER = os.environ.get("TOKENIZER_FOLDER", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k"

#: Fixed value: the pre-token pattern of the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: At most so many pieces of at most so many bytes stay in a worker's memory.
KEPT_PIECES, KEPT_BYTES = 500_000, 64


def read_ranks(folder: str, name: str) -> dict[bytes, int]:
    """The vocabulary as byte strings with their ids, which are also their merge ranks."""
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    end = list(range(1, n + 1))  # end[i]: where the symbol that starts at i ends; 0 once it has been taken in
    before = list(range(-1, n - 1))
    queue = []
    for i in range(n - 1):
        rank = ranks.get(piece[i : i + 2])
        if rank is not None:
            queue.append((rank, i, i + 2))
    heapq.heapify(queue)
    while queue:
        _, i, stop = heapq.heappop(queue)
        middle = end[i]
        if not middle or middle >= n or end[middle] != stop:
            continue  # stale: a neighbour has changed since
        end[i], end[middle] = stop, 0
        if stop < n:
            before[stop] = i
            rank = ranks.get(piece[i : end[stop]])
            if rank is not None:
                heapq.heappush(queue, (rank, i, end[stop]))
        left = before[i]
        if left >= 0:
            rank = ranks.get(piece[left:stop])
            if rank is not None:
                heapq.heappush(queue, (rank, left, stop))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class Encoder:
    """Encodes and decodes with one vocabulary, given by its folder and name or by its ranks."""

    def __init__(self, folder: str = FOLDER, name: str = VOCABULARY, ranks: dict[bytes, int] | None = None):
        self.ranks = read_ranks(folder, name) if ranks is None else ranks
        self.strings = {v: k for k, v in self.ranks.items()}
        self.split = regex.compile(PATTERN).findall
        self.kept: dict[str, list[int]] = {}

    def encode(self, text: str) -> list[int]:
        """The ids of a text; strings of special tokens are ordinary text. Lone surrogates become U+FFFD."""
        ids: list[int] = []
        kept = self.kept
        for piece in self.split(text):
            found = kept.get(piece)
            if found is None:
                data = piece.encode("utf-8", "surrogatepass").decode("utf-8", "replace").encode()
                found = merge(data, self.ranks)
                if len(data) <= KEPT_BYTES:
                    if len(kept) >= KEPT_PIECES:
                        kept.clear()
                    kept[piece] = found
            ids += found
        return ids

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.strings[i] for i in ids).decode("utf-8", "replace")


_ENCODERS: dict[tuple[str, str, str], Encoder] = {}


def _sent(documents: DataFrame, folder: str, name: str) -> Callable[[], Encoder]:
    """What gives a task its worker's encoder. The driver reads the vocabulary, a file of fixed size, and sends it with
    the job; Spark keeps Python workers, which keep the encoder with the pieces it has seen."""
    sc = documents.sparkSession.sparkContext
    ranks = sc.broadcast(read_ranks(folder, name))
    key = (sc.applicationId, folder, name)

    def encoder() -> Encoder:
        if key not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[key] = Encoder(ranks=ranks.value)
        return _ENCODERS[key]

    return encoder


def encode(documents: DataFrame, folder: str = FOLDER, name: str = VOCABULARY) -> DataFrame:
    """``doc_id`` and ``ids`` of every row of ``documents``; no shuffle.

    An empty or null text has the empty list; blank text has the ids of its blanks. Texts of any length are
    encoded whole. Repeated rows come out as often as they occur; other columns are ignored.
    """
    kind = pa.list_(pa.int32())
    encoder = _sent(documents, folder, name)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder()
        for b in batches:
            ids = [e.encode(t) if t else [] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, kind)], ["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(work, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, folder: str = FOLDER, name: str = VOCABULARY) -> DataFrame:
    """``doc_id`` and ``text`` of rows with ``ids``; null ids give a null text."""
    encoder = _sent(encoded, folder, name)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder()
        for b in batches:
            texts = [None if ids is None else e.decode(ids) for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(work, "doc_id long, text string")
