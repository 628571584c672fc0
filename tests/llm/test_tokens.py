"""Encoding against the library that reads the same vocabulary, and round trips."""

import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from wavemill.llm import tokens as T


@pytest.fixture(scope="module")
def own():
    return T.Encoder()


@pytest.fixture(scope="module")
def library(own):
    return tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=200))
def test_any_text(own, library, text):
    ids = own.encode(text)
    assert ids == library.encode_ordinary(text)
    assert own.decode(ids) == text


def test_long_pieces(own, library):
    rng = random.Random(1)
    for text in ("a" * 20_000, "".join(rng.choice("ab. \n") for _ in range(50_000)), "日本" * 3000, " " * 5000 + "x", "<|endoftext|>"):
        ids = own.encode(text)
        assert ids == library.encode_ordinary(text) and own.decode(ids) == text


def test_table(spark, own):
    df = spark.createDataFrame([(1, "Hello world", 0), (2, "", 0), (3, None, 0), (3, None, 0), (4, " \n", 0), (None, "x", 0)], "doc_id long, text string, ids int")
    got = T.encode(df)
    assert got.count() == 6
    by = {r.doc_id: r.ids for r in got.collect()}
    assert by[1] == own.encode("Hello world") and by[2] == [] and by[3] == [] and by[4]
    assert {r.doc_id: r.text for r in T.decode(got).collect()}[1] == "Hello world"
    assert T.encode(df.limit(0)).count() == 0


def test_corpus(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r.ids for r in T.encode(docs.repartition(3)).collect()}
    for r in docs.select("doc_id", "text").collect():
        assert got[r.doc_id] == (library.encode_ordinary(r.text) if r.text else [])
