"""Figures of texts and their kinds."""

import numpy as np
import pytest

from wavemill.llm import quality as Q

PROSE = "What worked for me was to copy the file while the old cache was stale. I would rather split it, but tastes differ."


@pytest.mark.parametrize(
    "text, kind",
    [(PROSE, "prose"), ("Thanks, solved!", "prose"), ("same problem here", "prose"), ("Man sollte zuerst den Filter prüfen\nund danach den Datensatz löschen", "prose"),
     ("日本語の質問も歓迎です。ありがとうございます。", "prose"), ("The driver skips\nmy old cable when\nyou copy the\nfile to it.", "prose"),
     ("The page at\nhttps://files.example/t/3839 is gone,\nso here is the gist: shift each\nvote, never the trace... A digest\nskips it once the disk is full.", "prose"),
     ("kernel client,\nelectrode,\nwrapper (legacy),\nparser callback,\nAnything else?", "list"),
     (PROSE + "\n```\nfor t in range(3):\n    x[t] += 1\n    y;z;w\n    a;b;c\n```", "prose"), ("- red fuse\n- cable\n- old clock (slow)\n- pin", "list"),
     ("Steps I took so far:\n1. copy the trace as soon as it starts\n2. plot a volume\n3. split it every time\nThat is all.", "list"), ("fuse\n  cable\nold clock\npin driver\nmerge", "list"),
     ("a,b,c\n1,2,3\n4,,6\n7,8,9", "table"), ("Results so far:\n|x | y | z|\n|--- | --- | ---|\n|1 | 2 | 3|\n|4 | 5 | 6|", "table"), ("name    size    rate\nfuse    12      3.5\ncable   9       1.5", "table"),
     ("buy now " * 20, "junk"), ("up\n" * 30, "junk"), ("https://a.example/1\nhttp://b.example/2", "junk"), ("<td><a>&nbsp;</a></td><div>&nbsp;</div>", "junk"),
     ("sdwe;we;fj gsah;wg kwqddhf saql;jwwa hswajd qwjse kqgefk;ehh wqkd", "junk"), ("7d7b1ddd 234a4083 e0f65147 627bea2a b9bc1efb", "junk"), ("+-!=<+ |<-#-+%=^^%^+%#_#! !~-+/-=", "junk"),
     ("", None), ("  \n", None), (None, None), ("​", None)],
)
def test_kinds(text, kind):
    assert Q.figures(text)["kind"] == kind


def test_figures():
    f = Q.figures("The cat sat.\nno end here\n")
    assert f["words"] == 6 and f["mean_word_length"] == pytest.approx(18 / 6) and f["punctuated_lines"] == 0.5
    assert f["symbol_ratio"] == pytest.approx(1 / 19) and f["common_words"] == pytest.approx(3 / 6)


def test_divergence_bounds():
    p = np.array([[1.0, 0.0], [0.0, 0.0], [3.0, 1.0]])
    d = Q.divergence(p, np.array([0.75, 0.25]))
    assert d[1] == 0 and abs(d[2]) < 1e-12 and 0 < d[0] < 1


def test_profiles_are_distributions():
    for _, *parts in Q.PROFILES:
        assert all(sum(p) < 1 and min(p) > 0 for p in parts)


def test_divergence_alone_tells_plain_cases():
    texts = {
        "prose": [PROSE, PROSE * 4, "Man sollte zuerst den Filter prüfen, und danach den Datensatz löschen."],
        "list": ["- red fuse\n- cable\n- old clock (slow)\n- pin", "red fuse\nlong cable\nold clock\npin\nbroken wheel"],
        "table": ["a,b,c\n1,2,3\n4,5,6\n7,8,9", "fuse\t12\t3.5\ncable\t9\t1.5\npin\t77\t0.5"],
        "junk": ["sdwe;we;fj gsah;wg kwqddhf saql;jwwa hswajd qwjse kqgefk;ehh wqkd", "+-!=<+ |<-#-+%=^^%^+%#_#! !~-+/-=", "up\n" * 30, "first!!! " * 30],
    }
    for kind, some in texts.items():
        scored = Q.by_kind(Q.shapes([Q.outside_code(t) for t in some]))
        assert (scored[:, 0] < scored[:, 1:].min(1)).all() if kind == "prose" else (scored[:, 0] > scored[:, 1:].min(1) - Q.CLEAR).all()


def test_shapes_of_one_text():
    tokens, chars, ends, lengths, novelty = Q.shapes([["The cat saw 12 dogs.", "Ω the (end)"]])
    assert tokens.tolist() == [[2, 5, 1, 3]] and ends.tolist() == [[1, 1, 0]]  # Ω is a word of another script
    assert lengths.tolist() == [[3, 5, 0, 0]] and novelty.tolist() == [[6, 1]]
    assert chars[0, 4] == 2 and chars[0, :4].sum() == 19 and chars[0, 5] == 3


def test_batch_equals_single(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: (r.words, r.kind) for r in Q.text_figures(docs.repartition(3)).collect()}
    for r in docs.collect():
        f = Q.figures(r.text)
        assert got[r.doc_id] == (f["words"], f["kind"])


def test_table_edges(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "x " * 300_000, 1), (3, "x " * 300_000, 1), (None, PROSE, 1)], "doc_id long, text string, kind int")
    rows = Q.text_figures(df).collect()
    assert len(rows) == 5 and {r.doc_id: r.words for r in rows} == {1: None, 2: 0, 3: 300_000, None: Q.figures(PROSE)["words"]}
    assert Q.not_prose(df.limit(0)).count() == 0
    assert [tuple(r) for r in Q.not_prose(df).collect()] == [(3, "junk")] * 2
    assert [tuple(r) for r in Q.not_prose(spark.createDataFrame([(None, "up " * 30)], "doc_id long, text string")).collect()] == [(None, "junk")]
