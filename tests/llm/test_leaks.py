"""Leaks against brute force over all runs of words, with reshaped passages."""

import random

import pytest

from wavemill.llm import leaks as L


@pytest.mark.parametrize(
    "text, words",
    [("It's  RENA-\nmed, “by” 3 x", ["it", "s", "renamed", "by", "3", "x"]), ("dr​ought so­ft", ["drought", "soft"]), ("<b>held</b> mo<i>re</i><br>x &amp; y", ["held", "more", "x", "y"]),
     ("> a-\n> bout\n// the_end", ["about", "the", "end"]), ("Ｆｕｌｌ ﬁne", ["full", "fine"]), ("", []), (None, [])],
)
def test_words(text, words):
    assert L.words(text) == words


def brute(docs, items):
    runs = {}
    for i, t in items:
        w = L.words(t)
        for k in range(len(w) - L.RUN + 1):
            runs.setdefault(tuple(w[k : k + L.RUN]), set()).add(i)
    out = set()
    for d, t in docs:
        w = L.words(t)
        for k in range(len(w) - L.RUN + 1):
            out |= {(d, i) for i in runs.get(tuple(w[k : k + L.RUN]), ())}
    return out


@pytest.mark.parametrize("max_words", [10**6, 60])
def test_equals_brute_force(spark, max_words):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(90)] + ["the", "of", "and"] * 12
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(text(rng.randrange(4, 40)))) for i in range(30)] + [(90, None), (91, ""), (92, "one two")]
    docs = []
    for d in range(150):
        body = text(rng.randrange(0, 300))
        w = L.words(items[d % 30][1])
        if len(w) > 9:
            at, size = rng.randrange(len(w) - 7), rng.choice([7, 8, 9])
            body[len(body) // 2 : len(body) // 2] = w[at : at + size]
        docs.append((d, " ".join(body).upper() if d % 3 else ", ".join(body)))
    docs += [(900, None), (901, ""), (902, items[0][1] + " " + items[1][1]), (902, items[0][1])]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id int").repartition(4)
    i = spark.createDataFrame([(*r, "s") for r in items], "item_id long, text string, doc_id string")
    got = [tuple(r)[:2] for r in L.leaks(d, i, max_words).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(docs, items)


def test_long_text_and_empty_tables(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota"
    d = spark.createDataFrame([(1, "noise " * 100_000 + item)], "doc_id long, text string")
    i = spark.createDataFrame([(5, item)], "item_id long, text string")
    row = L.leaks(d, i).collect()
    assert [(r.doc_id, r.item_id, r.words) for r in row] == [(1, 5, 9)]
    assert L.leaks(d.limit(0), i).count() == 0 and L.leaks(d, i.limit(0)).count() == 0


def longest(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0] + [row[j] + 1 if x == y else 0 for j, y in enumerate(b)]
        best = max(best, *row)
    return best


def test_words_of_runs_over_passage_edges(spark):
    rng = random.Random(9)
    item = [f"w{i}" for i in range(150)]
    item[120:135] = item[20:27] + item[60:68]  # runs of an item that only overlap are no longer run
    docs = []
    for d, (at, size, lead) in enumerate([(0, 150, 0), (3, 68, 20), (10, 46, 30), (30, 47, 40), (0, 8, 57), (18, 20, 50), (5, 130, 300)]):
        docs.append((d, [f"n{rng.randrange(50)}" for _ in range(lead)] + item[at : at + size] + ["end"] * (d * 11)))
    docs.append((50, item[100:127] + item[27:40] + ["z"] + item[40:60]))
    d = spark.createDataFrame([(k, " ".join(w)) for k, w in docs], "doc_id long, text string")
    i = spark.createDataFrame([(5, " ".join(item)), (6, " ".join(item[40:]))], "item_id long, text string")
    want = {(k, j): n for k, w in docs for j, x in ((5, item), (6, item[40:])) if (n := longest(w, x)) >= L.RUN}
    assert {(r.doc_id, r.item_id): r.words for r in L.leaks(d, i).collect()} == want
    assert max(want.values()) == 150


def test_corpus(spark):
    t = lambda n: spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet")
    docs = [tuple(r) for r in t("documents").select("doc_id", "text").collect()]
    items = [tuple(r) for r in t("benchmark").select("item_id", "text").collect()]
    assert {tuple(r)[:2] for r in L.leaks(t("documents"), t("benchmark")).collect()} == brute(docs, items)


def test_corpus_words(spark):
    t = lambda n: spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet")
    docs = {r.doc_id: L.words(r.text) for r in t("documents").select("doc_id", "text").collect()}
    items = {r.item_id: L.words(r.text) for r in t("benchmark").select("item_id", "text").collect()}
    assert all(r.words == longest(docs[r.doc_id], items[r.item_id]) for r in L.leaks(t("documents"), t("benchmark")).collect())


def test_many_items_in_little_memory():
    import tracemalloc

    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(2)
    n, size = 4_000, 20
    common = np.minimum(rng.zipf(1.3, (n, size)), 30_000)
    at = pd.DataFrame({"item_id": np.repeat(np.arange(n), size), "pos": np.tile(np.arange(size), n), "word": [f"w{k}" for k in common.ravel()]})
    df = at.drop_duplicates(["item_id", "word"]).groupby("word")["item_id"].transform("size")
    postings = at.drop_duplicates(["item_id", "word"]).assign(weight=np.log(1 + n / df))[["item_id", "word", "weight"]]
    w = dict(zip(zip(postings.item_id, postings.word), postings.weight))
    least = {i: min(sum(w[i, x] for x in set(g[k : k + L.RUN])) for k in range(size - L.RUN + 1)) for i, g in at.groupby("item_id")["word"].agg(list).items()}
    postings["weight"] /= postings["item_id"].map(least)
    index = L.Index(postings, at)
    texts = [[f"w{k}" for k in np.minimum(rng.zipf(1.3, 120), 30_000)] for _ in range(30)]
    for d in range(0, 30, 2):
        texts[d][50:60] = at.word[d * size + 5 : d * size + 15].tolist()
    tracemalloc.start()
    got = {(d, i) for d, i, _, _ in L._search(index, list(range(30)), texts)}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    runs = {}
    for i, g in at.groupby("item_id")["word"].agg(list).items():
        for k in range(size - L.RUN + 1):
            runs.setdefault(tuple(g[k : k + L.RUN]), set()).add(i)
    assert got == {(d, i) for d, t in enumerate(texts) for k in range(len(t) - L.RUN + 1) for i in runs.get(tuple(t[k : k + L.RUN]), ())}
    assert len(got) >= 15 and peak < 100e6
