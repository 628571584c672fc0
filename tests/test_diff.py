"""Differences of two copies: cancelling, least-cost pairing, hot keys, nulls."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wavemill.operators import diff as D


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 10**6))
def test_assign_is_least(n, m, seed):
    cost = np.random.default_rng(seed).integers(0, 5, (n, m)).astype(float)
    pairs = D.assign(cost)
    assert len(pairs) == min(n, m) == len({i for i, _ in pairs}) == len({j for _, j in pairs})
    short, long = (cost, m) if n <= m else (cost.T, n)
    best = min(sum(short[i, p[i]] for i in range(len(short))) for p in itertools.permutations(range(long), len(short)))
    assert sum(cost[i, j] for i, j in pairs) == best


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, a long, b string, extra int")


def run(spark, left, right, **options):
    pairs = D.pair_rows(frame(spark, left), frame(spark, right), ["k"], ["a", "b"], **options)
    found = D.field_differences(pairs, ["k"], ["a", "b"], options.get("within"))
    return sorted((tuple(r) for r in found.collect()), key=repr)


def test_cancel_pair_and_missing(spark):
    left = [("x", 1, "p", 0), ("x", 1, "p", 1), ("x", 2, "q", 0), ("y", None, None, 0), (None, 5, "z", 0)]
    right = [("x", 1, "p", 7), ("x", 1, "r", 7), ("x", 2, "s", 7), ("y", None, None, 0), ("w", 1, "o", 0)]
    want = [(None, "only_left", None, None), ("w", "only_right", None, None), ("x", "b", "p", "r"), ("x", "b", "q", "s")]
    assert run(spark, left, right) == sorted(want, key=repr)


def test_null_against_value_and_tolerance(spark):
    left, right = [("x", 1, None, 0), ("y", 100, "b", 0)], [("x", None, None, 0), ("y", 104, "b", 0)]
    assert run(spark, left, right) == [("x", "a", "1", None), ("y", "a", "100", "104")]
    assert run(spark, left, right, within={"a": 5}) == [("x", "a", "1", None)]


@pytest.mark.parametrize("exact_rows", [256, 3])
def test_hot_key_keeps_every_row(spark, exact_rows):
    left = [("h", i % 7, f"v{i % 5}", 0) for i in range(40)] + [("c", 1, "x", 0)]
    right = [("h", i % 6, f"v{i % 4}", 0) for i in range(33)] + [("c", 1, "x", 0)]
    pairs = D.pair_rows(frame(spark, left), frame(spark, right), ["k"], ["a", "b"], exact_rows=exact_rows).toPandas()
    assert set(pairs["k"]) == {"h"}
    from collections import Counter

    a, b = Counter((r[1], r[2]) for r in left[:-1]), Counter((r[1], r[2]) for r in right[:-1])
    rest_a, rest_b = a - b, b - a
    mine, theirs = pairs[pairs["_has_l"]], pairs[pairs["_has_r"]]
    assert Counter(zip(mine["_l_a"].astype(int), mine["_l_b"])) == rest_a
    assert Counter(zip(theirs["_r_a"].astype(int), theirs["_r_b"])) == rest_b
    assert (pairs["_has_l"] & pairs["_has_r"]).sum() == min(sum(rest_a.values()), sum(rest_b.values()))


@pytest.mark.parametrize("cut_to", [lambda v: v // 1000 * 1000, lambda v: (v + 500) // 1000 * 1000])
@pytest.mark.parametrize("n", [256, 257])
def test_tolerance_on_both_sides_of_the_switch(spark, n, cut_to):
    # every row has its partner in a copy with coarser times, five partners differ in b: the least total is 5. Above
    # the switch the pairs that differ are as few, but may differ in both fields.
    times = [v + (v % 1000 == 0) for v in (1 + 613 * i + i % 7 for i in range(n))]  # no two rows are equal
    left = [("h", v, "p", 0) for v in times]
    right = [("h", cut_to(v), "q" if i % (n // 5) == 3 and i < n // 5 * 5 else "p", 0) for i, v in enumerate(times)]
    pairs = D.pair_rows(frame(spark, left), frame(spark, right), ["k"], ["a", "b"], within={"a": 1000}, exact_rows=256).toPandas()
    assert len(pairs) == n and (pairs["_has_l"] & pairs["_has_r"]).all()
    far, other = abs(pairs["_l_a"] - pairs["_r_a"]) >= 1000, pairs["_l_b"] != pairs["_r_b"]
    assert (far | other).sum() == 5
    assert far.sum() + other.sum() == 5 if n <= 256 else 5 <= far.sum() + other.sum() <= 10


@pytest.mark.parametrize("seed", range(3))
def test_staged_cost_against_exact(spark, seed):
    rng = np.random.default_rng(seed)
    rows = lambda n: [("h", int(v) if v % 9 else None, f"v{v % 2}", 0) for v in rng.integers(0, 300, n)]
    left, right = frame(spark, rows(60)), frame(spark, rows(50))
    total = []
    for exact_rows in (256, 5):
        pairs = D.pair_rows(left, right, ["k"], ["a", "b"], {"a": 4}, exact_rows)
        found = [r.field for r in D.field_differences(pairs, ["k"], ["a", "b"], {"a": 4}).collect()]
        total.append((len(found), found.count("only_left"), found.count("only_right")))
    assert total[0] == total[1]


def test_least_cost_of_random_keys(spark):
    """Keys of 2 to 700 leftover rows a side, null key among them: every row once, and the cost of ``assign``."""
    rng = np.random.default_rng(11)
    left, right, want = [], [], 0
    for k in range(26):
        n, m = (700, 650) if k == 25 else rng.integers(0, 30, 2)
        a = [(int(x) if x else None, f"v{y}") for x, y in rng.integers(0, 6 if n < 100 else 60, (n, 2))]
        b = [(int(x) if x else None, f"v{y}") for x, y in rng.integers(0, 6 if n < 100 else 60, (m, 2))]
        key = f"k{k}" if k else None
        left += [(key, *r, 0) for r in a]
        right += [(key, *r, 1) for r in b]
        cost = np.array([[sum(x != y for x, y in zip(r, s)) for s in b] for r in a], float).reshape(n, m)
        want += sum(cost[i, j] for i, j in D.assign(cost)) + abs(n - m)
    found = D.field_differences(D.pair_rows(frame(spark, left).repartition(3), frame(spark, right), ["k"], ["a", "b"]), ["k"], ["a", "b"])
    assert found.count() == want


def test_empty_tables(spark):
    assert run(spark, [], []) == []
    assert run(spark, [], [("x", 1, "a", 0)]) == [("x", "only_right", None, None)]


def test_listing_forms(spark):
    columns = "rel_path string, sha256 string, n_bytes long, modified_at string, n_channels int, duration_s double, {} string"
    left = spark.createDataFrame(
        [("sub-1/ses-t1/eeg/a.edf", "ab" * 32, 5, "2024-01-01 00:00:00.5", 2, 10.001, "2024-01-02"),
         ("sub-2/ses-t1/eeg/a.edf", "cd" * 32, 5, "2024-01-01 00:00:00", 2, 10.0, "2024-01-02"),
         ("sub-3/ses-t1/eeg/a.edf", "cd" * 32, 5, "2024-01-01 00:00:00", 2, 10.0, "2024-01-02")], columns.format("listed_at"))
    right = spark.createDataFrame(
        [(".\\sub-1\\ses-t1\\eeg\\a.edf ", "SHA256:" + "AB" * 32, 5, "2024-01-01 00:00:00", 2, 10.001, "2024-01-03"),
         ("./sub-1/ses-t1//eeg/a.edf", None, 6, None, None, None, "2024-01-02"),
         ("/sub-2/ses-t1/eeg/a.edf", "cd" * 32, 5, "2024-01-01 00:00:01", 2, 10.001, "2024-01-03")], columns.format("seen_at"))
    left = left.withColumn("modified_at", left.modified_at.cast("timestamp"))
    right = right.withColumn("modified_at", right.modified_at.cast("timestamp"))
    found = sorted((r.rel_path, r.field) for r in D.manifest_against_mirror(left, right).collect())
    assert found == [("sub-2/ses-t1/eeg/a.edf", "duration_s"), ("sub-2/ses-t1/eeg/a.edf", "modified_at"), ("sub-3/ses-t1/eeg/a.edf", "only_manifest")]
