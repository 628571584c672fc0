"""Evaluation items that leak into a corpus (problem 7).

A BM25 index of the items, kept in blocks with the greatest weight of each word per block, is queried with every
passage of every document by block-max WAND: each word of a passage points at its next block, the pivot is the first
block at which the greatest weights of the words up to it reach the threshold, and a block is opened only if its own
bounds do. Many passages move their pointers in step. Weights are scaled item by item so that any eight successive
words of an item reach 1: the threshold 1 then loses no leak, whatever the passage. What is retrieved is verified word
by word over the whole document. Documents meet the index in one map without a shuffle.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavemill.functions.lineage import cut

#: So many successive words of an item are a leak.
RUN = 8
#: Words of a passage; successive passages share ``RUN`` − 1 words, so that every run lies whole in one.
PASSAGE = 64
#: Items of a block, and BM25's parameters.
BLOCK, K1, B = 8, 1.2, 0.75
#: Items of more words in all are cut into shards of about so many, each sent to the tasks and queried by itself.
MAX_WORDS = 2_000_000
#: Words of passages that move their pointers in step, and word lists of items that a worker keeps.
STEP_TERMS, KEPT_ITEMS = 200_000, 5_000

_HIDDEN = re.compile(r"[­͏؜​-‏‪-‮⁠-⁤︀-️﻿]")
_BLOCK_TAG = re.compile(r"</?(?:br|p|div|li|ul|ol|td|th|tr|table|h[1-6]|pre|blockquote|hr)\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>|<!--.*?-->", re.S)
_CUT_WORD = re.compile(r"(?<=\w)[-‐‑­][ \t]*(?:\r\n|[\n\r])[\s>#*/|;%-]*(?=\w)")
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """The words of a text as a reader sees them: no case, punctuation, markup, quote or comment marks, line
    breaks inside words, or hidden characters. Numbers and single letters are words."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _HIDDEN.sub("", unicodedata.normalize("NFKC", text))
    if "<" in text:
        text = _TAG.sub("", _BLOCK_TAG.sub(" ", text))
    return _WORD.findall(_CUT_WORD.sub("", text).casefold())


def item_words(items: DataFrame) -> DataFrame:
    """``item_id``, ``pos``, ``word`` of every item."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([words(t) for t in b.column("text").to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([b.column("item_id"), found], ["item_id", "words"])

    rows = items.select("item_id", "text").mapInArrow(work, "item_id long, words array<string>")
    return rows.select("item_id", F.posexplode("words").alias("pos", "word"))


def item_index(at: DataFrame) -> DataFrame:
    """Postings (``item_id``, ``word``, ``weight``) of items given as ``item_id``, ``pos``, ``word``.

    ``weight`` is the BM25 weight divided by the least sum that any run of ``RUN`` words of the item collects
    over its distinct words. Items of fewer words have no postings.
    """
    long = at.groupBy("item_id").agg(F.count("*").alias("len")).filter(F.col("len") >= RUN)
    tf = at.join(long, "item_id").groupBy("item_id", "word", "len").agg(F.count("*").alias("tf"))
    totals = long.agg(F.count("*").alias("n"), F.avg("len").alias("mean")).first()
    df = tf.groupBy("word").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(totals.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(totals.mean or 1.0)))
    bm25 = tf.join(df, "word").select("item_id", "word", weight.alias("w"))
    ahead = Window.partitionBy("item_id").orderBy("pos").rowsBetween(0, RUN - 1)
    runs = at.withColumn("run", F.collect_list("word").over(ahead)).filter(F.size("run") == RUN)
    sums = (
        runs.select("item_id", "pos", F.explode(F.array_distinct("run")).alias("word"))
        .join(bm25, ["item_id", "word"])
        .groupBy("item_id", "pos")
        .agg(F.sum("w").alias("s"))
    )
    least = sums.groupBy("item_id").agg(F.min("s").alias("least"))
    return bm25.join(least, "item_id").select("item_id", "word", (F.col("w") / F.col("least")).alias("weight"))


class Index:
    """One shard of the index as arrays: postings and block bounds by word, and the words of the items."""

    def __init__(self, postings: pd.DataFrame, at: pd.DataFrame):
        postings = postings.sort_values(["word", "item_id"])
        self.items = np.sort(postings["item_id"].unique())
        word, names = pd.factorize(postings["word"])
        self.ids = {w: k for k, w in enumerate(names)}
        item = np.searchsorted(self.items, postings["item_id"].to_numpy())
        self.weight = postings["weight"].to_numpy()
        self.blocks = len(self.items) // BLOCK + 1
        self.posting = word.astype(np.int64) * (self.blocks * BLOCK) + item  # sorted
        key = word.astype(np.int64) * (self.blocks + 1) + item // BLOCK
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        bound = np.maximum.reduceat(self.weight, first)
        most = np.maximum.reduceat(bound, np.flatnonzero(np.append(True, word[first][1:] != word[first][:-1])))
        self.most = np.append(most, 0.0)  # of each word; the last stands for no word
        ends = np.arange(len(names) + 1, dtype=np.int64) * (self.blocks + 1) + self.blocks  # each word's list ends in block ``blocks``
        every = np.concatenate([key[first], ends])
        order = np.argsort(every, kind="stable")
        self.key, self.bound = every[order], np.concatenate([bound, np.zeros(len(ends))])[order]
        self.start = np.searchsorted(self.key, np.arange(len(names) + 1, dtype=np.int64) * (self.blocks + 1))
        at = at[at["item_id"].isin(self.items)].sort_values(["item_id", "pos"])
        of = np.searchsorted(self.items, at["item_id"].to_numpy())
        self.text = np.fromiter((self.ids[w] for w in at["word"]), np.int32, len(at))
        self.first = np.searchsorted(of, np.arange(len(self.items) + 1))
        self.kept: dict[int, dict[tuple[int, ...], list[int]]] = {}

    def runs(self, item: int) -> dict[tuple[int, ...], list[int]]:
        """The places of each run of ``RUN`` words in an item."""
        found = self.kept.get(item)
        if found is None:
            if len(self.kept) >= KEPT_ITEMS:
                self.kept.clear()
            words_of = self.text[self.first[item] : self.first[item + 1]].tolist()
            found = self.kept[item] = {}
            for k in range(len(words_of) - RUN + 1):
                found.setdefault(tuple(words_of[k : k + RUN]), []).append(k)
        return found


ENOUGH = 1 - 1e-9


def open_blocks(index: Index, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The blocks to open for each passage: (passage, block). ``terms`` has a row for each passage, its distinct words
    padded with the number of words of the index.

    All passages move in step. In each round a passage finds its pivot block; its pointers before and at the pivot move
    there, where the block's own bounds decide; then they move on. A passage ends when the greatest weights of the words
    that still point anywhere no longer reach the threshold.
    """
    width, end = index.blocks + 1, index.blocks
    most = index.most[terms]
    alive = np.flatnonzero(most.sum(1) >= ENOUGH)
    most, base = most[alive], terms[alive].astype(np.int64) * width
    at = index.start[terms[alive]]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    while len(alive):
        block = index.key[at] - base
        order = np.argsort(block, 1)
        ahead = np.take_along_axis(block, order, 1)
        sums = np.cumsum(np.where(ahead < end, np.take_along_axis(most, order, 1), 0.0), 1)
        reach = sums[:, -1] >= ENOUGH
        if not reach.all():
            alive, at, base, most, block, ahead, sums = (a[reach] for a in (alive, at, base, most, block, ahead, sums))
            if not len(alive):
                break
        pivot = ahead[np.arange(len(alive)), (sums >= ENOUGH).argmax(1)][:, None]
        behind = block < pivot
        p, t = np.nonzero(behind)
        at[p, t] = np.searchsorted(index.key, base[p, t] + pivot[p, 0])
        here = index.key[at] - base == pivot
        hit = (np.where(here, index.bound[at], 0.0)).sum(1) >= ENOUGH
        found.append((alive[hit], pivot[hit, 0]))
        at = at + here
    return np.concatenate([f[0] for f in found] or [np.zeros(0, int)]), np.concatenate([f[1] for f in found] or [np.zeros(0, int)])


def retrieve(index: Index, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passages and items with a score of at least 1: (passage, item, score)."""
    passage, block = open_blocks(index, terms)
    room = index.blocks * BLOCK
    out = []
    step = max(1, STEP_TERMS // max(terms.shape[1], 1))
    for k in range(0, len(passage), step):
        p, b = passage[k : k + step], block[k : k + step]
        low = np.searchsorted(index.posting, terms[p].astype(np.int64) * room + b[:, None] * BLOCK)
        n = np.searchsorted(index.posting, terms[p].astype(np.int64) * room + (b[:, None] + 1) * BLOCK) - low
        owner = np.repeat(np.repeat(p, terms.shape[1]), n.ravel())
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n.ravel(), n.ravel()) + np.repeat(low.ravel(), n.ravel())
        key, place = np.unique(owner * np.int64(room) + index.posting[at] % room, return_inverse=True)
        score = np.bincount(place, index.weight[at], len(key))
        hit = score >= ENOUGH
        out.append((key[hit] // room, key[hit] % room, score[hit]))
    return tuple(np.concatenate([o[j] for o in out] or [np.zeros(0)]).astype(t) for j, t in enumerate((np.int64, np.int64, float)))


def _passages(lists: list[np.ndarray], none: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct known words of each passage of the documents, padded with ``none``, and each passage's document."""
    step = PASSAGE - RUN + 1
    n = np.array([len(x) for x in lists])
    count = np.maximum(1, -(-np.maximum(n - RUN + 1, 0) // step))  # passages of each document
    offset = np.cumsum(count) - count
    ids = np.concatenate(lists) if lists else np.zeros(0, np.int32)
    doc = np.repeat(np.arange(len(lists)), n)
    pos = np.arange(len(ids)) - (np.cumsum(n) - n)[doc]
    own = np.minimum(pos // step, count[doc] - 1)
    shared = (pos - own * step < RUN - 1) & (own > 0)  # also at the end of the passage before
    known = ids >= 0
    passage = np.concatenate([(offset[doc] + own)[known], (offset[doc] + own - 1)[known & shared]])
    term = np.concatenate([ids[known], ids[known & shared]]).astype(np.int64)
    pairs = np.unique(passage * (none + 1) + term)
    passage, term = pairs // (none + 1), pairs % (none + 1)
    of = np.bincount(passage, minlength=int(count.sum()))
    terms = np.full((len(of), max(int(of.max(initial=0)), 1)), none, np.int64)
    terms[passage, np.arange(len(term)) - (np.cumsum(of) - of)[passage]] = term
    return terms, np.repeat(np.arange(len(lists)), count)


def _search(index: Index, doc_ids: list[int], lists: list[list[str]]) -> list[tuple[int, int, float, int]]:
    coded = [np.fromiter((index.ids.get(w, -1) for w in x), np.int32, len(x)) for x in lists]
    out = []
    begin = 0
    while begin < len(coded):  # documents of about ``STEP_TERMS`` words at once
        stop, n = begin, 0
        while stop < len(coded) and (stop == begin or n + len(coded[stop]) <= STEP_TERMS):
            n += len(coded[stop])
            stop += 1
        terms, owner = _passages(coded[begin:stop], len(index.ids))
        best: dict[tuple[int, int], float] = {}
        for first in range(0, len(terms), STEP_TERMS // PASSAGE):  # a very long document has many passages
            p, items, scores = retrieve(index, terms[first : first + STEP_TERMS // PASSAGE])
            for d, i, s in zip((owner[first + p] + begin).tolist(), items.tolist(), scores.tolist()):
                best[d, i] = max(best.get((d, i), 0.0), s)
        grams, known, of = [], set(), -1
        for (d, i), s in sorted(best.items()):
            if d != of:
                ids, of = coded[d].tolist(), d
                grams = [tuple(ids[k : k + RUN]) for k in range(len(ids) - RUN + 1)]
                known = set(grams)
            runs = index.runs(i)
            if not known.isdisjoint(runs):
                out.append((int(doc_ids[d]), int(index.items[i]), s, _longest(grams, runs)))
        begin = stop
    return out


def _longest(grams: list[tuple[int, ...]], runs: dict[tuple[int, ...], list[int]]) -> int:
    """The most successive words that stand in the document as in the item; ``grams`` are the document's runs, ``runs``
    the places of the item's."""
    most = 0
    before: dict[int, int] = {}
    for gram in grams:
        places = runs.get(gram)
        before = {at: before.get(at - 1, 0) + 1 for at in places} if places else {}
        if before:
            most = max(most, max(before.values()) + RUN - 1)
    return most


_OUT = "doc_id long, item_id long, score double, words int"


def _against(rows: DataFrame, index: Index) -> DataFrame:
    """``_OUT`` of rows with ``doc_id`` and either ``text`` or its ``words``."""
    sent = rows.sparkSession.sparkContext.broadcast(index)
    split = "words" not in rows.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [words(t) for t in b.column("text").to_pylist()] if split else b.column("words").to_pylist()
            cols = list(zip(*_search(sent.value, b.column("doc_id").to_pylist(), lists))) or [[], [], [], []]
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "item_id", "score", "words"])

    return rows.mapInArrow(work, _OUT)


def _split(documents: DataFrame) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([words(t) for t in b.column("text").to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), found], ["doc_id", "words"])

    return documents.mapInArrow(work, "doc_id long, words array<string>")


def leaks(documents: DataFrame, items: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """``doc_id``, ``item_id``, ``score`` and ``words`` (the longest run, over the whole text) of every document that
    contains at least ``RUN`` successive words of an item.

    The index is written once, in shards of about ``max_words`` words of items. One shard at a time is in the driver's
    memory and goes to the tasks; with several, the corpus is split into words once and each shard's leaks are written
    before the next comes. Null and empty texts and items of fewer words leak nothing; texts of any length are searched
    whole; repeated rows come out once; empty tables give no rows; other columns are ignored.
    """
    at = cut(item_words(items.filter("item_id is not null")).distinct())
    n = at.count()
    rows = documents.select("doc_id", "text").filter("doc_id is not null")
    shards = max(1, -(-n // max_words))
    postings = item_index(at)
    mine = F.pmod(F.xxhash64("item_id"), F.lit(shards))
    if shards > 1:
        rows = cut(_split(rows))
        at, postings = (cut(x.withColumn("shard", mine).repartition(shards, "shard").sortWithinPartitions("shard")) for x in (at, postings))
    out = None
    for k in range(shards):
        p, a = (x.filter(F.col("shard") == k).drop("shard") if shards > 1 else x for x in (postings, at))
        p = p.toPandas()  # about max_words rows at most
        if not len(p):
            continue
        found = _against(rows, Index(p, a.toPandas()))
        found = cut(found) if shards > 1 else found
        out = found if out is None else out.unionByName(found)
    if out is None:
        return documents.sparkSession.createDataFrame([], _OUT)
    return out.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), F.max("words").alias("words"))
