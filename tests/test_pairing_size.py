"""Pairs of least cost whatever the number of rows of a key."""

import itertools

import numpy as np
import pytest

from wavemill.operators import diff as D

FIELDS = ["a", "b", "c", "d"]


def total(spark, left, right, **options):
    """Fields that differ, one for a row alone, and the rows found."""
    left, right = (spark.createDataFrame([("h", *r) for r in rows], "k string, a long, b long, c long, d long") for rows in (left, right))
    pairs = D.pair_rows(left.repartition(3), right, ["k"], FIELDS, **options)
    found = sorted((tuple(r) for r in D.field_differences(pairs, ["k"], FIELDS, options.get("within")).collect()), key=repr)
    return len(found), found


@pytest.mark.parametrize("groups", [900, 1100])
def test_least_cost_above_2000_rows(spark, groups):
    """Of each two pairs of rows, those that agree in three fields must not meet: 1 + 4 fields would differ, not 2 + 2."""
    p, q, s, t = (10 * np.arange(groups) + i for i in range(4))
    left = [r for g in zip(p, q, s, t) for r in (g[:1] * 4, (g[3], g[3], g[0], g[1]))]
    right = [r for g in zip(p, q, s, t) for r in ((g[0], g[0], g[0], g[1]), (g[0], g[0], g[2], g[2]))]
    rows = lambda side: [tuple(map(int, r)) for r in side]
    assert total(spark, rows(left), rows(right))[0] == 4 * groups


def test_size_option_changes_nothing(spark):
    rng = np.random.default_rng(5)
    left, right = (rng.integers(0, (40, 3, 5, 30), (n, 4)).tolist() for n in (60, 55))
    some = [total(spark, left, right, within={"a": 3, "d": 2}, exact_rows=k) for k in (256, 5)]
    assert some[0] == some[1]


def test_transport_is_least():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n, m = rng.integers(1, 4, 2)
        supply, demand, cost = rng.integers(1, 3, n), rng.integers(1, 3, m), rng.integers(0, 5, (n, m))
        if supply.sum() > demand.sum():
            continue
        sent = np.zeros((n, m), int)
        for i, j, k in D.transport(lambda i: cost[i], supply, demand):
            sent[i, j] += k
        assert (sent.sum(1) == supply).all() and (sent.sum(0) <= demand).all()
        rows, columns = np.repeat(np.arange(n), supply), np.repeat(np.arange(m), demand)
        assert (sent * cost).sum() == min(sum(cost[i, j] for i, j in zip(rows, p)) for p in itertools.permutations(columns, len(rows)))
