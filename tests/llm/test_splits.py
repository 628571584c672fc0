"""Splits that keep related records together, against union-find."""

import random

import pytest
from pyspark.sql import functions as F

from wavemill.llm import splits as S


def groups(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    out = {}
    for x in list(parent):
        out.setdefault(find(x), set()).add(x)
    return {frozenset(g) for g in out.values()}


@pytest.mark.parametrize("seed, hub_edges", [(1, 100_000), (2, 4)])
def test_components_equal_union_find(spark, seed, hub_edges):
    rng = random.Random(seed)
    edges = [(str(rng.randrange(60)), str(rng.randrange(60))) for _ in range(45)] + [("hub", f"h{i}") for i in range(30)] + [(f"c{i}", f"c{i + 1}") for i in range(25)]
    df = spark.createDataFrame(edges + edges[:5] + [(None, "x")], "a string, b string")
    named = S.components(df, hub_edges=hub_edges).collect()
    got = {}
    for r in named:
        got.setdefault(r.component, set()).add(r.vertex)
    assert len(named) == len({r.vertex for r in named})
    assert {frozenset(g) for g in got.values()} == groups([e for e in edges if e[0] != e[1]])


def test_star_and_chain(spark):
    star = spark.range(100_000).select(F.lit("hub").alias("a"), F.concat(F.lit("x"), "id").alias("b"))
    chain = spark.range(20_000).select(F.concat(F.lit("c"), "id").alias("a"), F.concat(F.lit("c"), F.col("id") + 1).alias("b"))
    named = S.components(star.unionByName(chain), hub_edges=5_000)
    sizes = named.groupBy("component").agg(F.count("*").alias("n"), F.min("vertex").alias("v")).collect()
    assert sorted(r.n for r in sizes) == [20_001, 100_001]


def test_no_edges(spark):
    assert S.components(spark.createDataFrame([], "a string, b string")).count() == 0


@pytest.mark.parametrize(
    "remark, n",
    [("same person as sub-000009", 9), ("eyes closed / identisch mit S000012", 12), ("not the same person as sub-000009", None), ("re-enrolment, earlier code sub-7", 7),
     ("same room as sub-000009", None), ("electrodes swapped as for sub-3", None), ("formerly enrolled as  sub‑0014 ; eyes closed", 14), (None, None), ("", None)],
)
def test_same_person(spark, remark, n):
    assert spark.createDataFrame([(remark,)], "t string").select(S.same_person_number(F.col("t"))).first()[0] == n


REC = "subject string, family_id string, n_bytes long, sha256 string, remark string, clash int"


def test_relations_and_conflicts(spark):
    rec = spark.createDataFrame(
        [("sub-000001", "fam-0000005", 5, "a" * 64, None, 1), ("S000002", "FAM-0000005 ", 5, "b" * 64, None, 1), ("Sub 000003", "fam-0", 5, "B" * 64, None, 1),
         ("sub-000004", "fam-0", 0, "c" * 64, None, 1), ("sub-000005", None, 0, "C" * 64, "same person as sub-9", 1), ("sub-000006", "unknown", 7, "d" * 64, "not the same person as sub-000001", 1)], REC)
    plans = spark.createDataFrame(
        [(10, "sub-1", "train"), (11, "sub-000002", "Train "), (12, "S3", "test"), (13, "sub_000004", "val"), (14, "sub-000005", "train"), (15, "sub-000009", "validation"), (16, "sub-6", "test"),
         (17, "sub-000003", None), (18, None, "test"), (19, "sub-000001", "TEST")], "plan_id long, subject string, plan_partition string")
    rows = S.grouped_plans(plans, rec)
    assert rows.count() == 10
    for hot in (50_000, 1):
        got = {tuple(r) for r in S.split_conflicts(rows, hot).collect()}
        assert got == {(10, 12), (11, 12), (10, 19), (11, 19), (14, 15)}
    by_class = S.split_groups(rows).collect()
    assert sum(r.n for r in by_class) == 10 and sum(r.pairs for r in by_class) == 5
    split = S.split_components(rows).collect()
    assert len(split) == 10 and all(r.split for r in split)
    by = {}
    for r in split:
        by.setdefault(r.component, set()).add(r.split)
    assert all(len(v) == 1 for v in by.values())


def test_shares_are_near(spark):
    rows = spark.range(6000).select(F.concat(F.lit("s:"), F.col("id") % 1500).alias("component"), "id")
    big = spark.range(2000).select(F.lit("s:big").alias("component"), "id")
    n = {r.split: r["count"] for r in S.split_components(rows.unionByName(big)).groupBy("split").count().collect()}
    assert abs(n["train"] - 6400) < 80 and abs(n["validation"] - 800) < 80 and abs(n["test"] - 800) < 80


def test_order_and_partitions_do_not_matter(spark):
    rows = spark.range(500).select(F.concat(F.lit("s:"), F.col("id") % 90).alias("component"), "id")
    a = {tuple(r) for r in S.split_components(rows).select("id", "split").collect()}
    assert a == {tuple(r) for r in S.split_components(rows.orderBy(F.rand(3)).repartition(7)).select("id", "split").collect()}


def test_empty_tables(spark):
    rec, plans = spark.createDataFrame([], REC), spark.createDataFrame([], "plan_id long, subject string, plan_partition string")
    assert S.split_conflicts(S.grouped_plans(plans, rec)).count() == 0
    assert S.split_components(S.grouped_plans(plans, rec)).count() == 0
    assert S.split_groups(S.grouped_plans(plans, rec)).count() == 0
