"""Implausible values against brute force, with hot series, gaps and ties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.functions import distributions, robust
from wavemill.functions.quantiles import exact_quantiles
from wavemill.operators import spikes as S


def series(seed, n=120, hot=0):
    rng = np.random.default_rng(seed)
    rows = []
    for rec in range(4):
        for ch in (0, 1):
            m = hot if rec == 0 and ch == 0 and hot else n
            x = np.round(10 * rng.standard_normal(m), 2)
            x[5] = 900.0
            x[20:31] = 3.25
            x[40] = np.nan
            for i, v in enumerate(x):
                if i != 50:
                    rows.append((rec, ch, i, float(v), 7))
            rows += [(rec, ch, i, v, 7) for i, v in ((m // 2, None), (m // 2 + 1, float("nan")), (m, None))]
    return rows + rows[:30]


def brute(rows, nv):
    out = set()
    for key in {(r[0], r[1]) for r in rows}:
        pts = sorted({(r[2], r[3]) for r in rows if (r[0], r[1]) == key and r[3] is not None and r[3] == r[3]})
        v = np.array([x for _, x in pts])
        scatter = 1.4826 * np.median(np.abs(v - np.median(v)))
        bad = (np.abs(v - np.median(v)) >= 10 * scatter) if scatter > 0 else np.zeros(len(v), bool)
        bad |= np.abs(v) * nv / 1000 > 10_000
        at = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
        size = np.diff(np.r_[at, len(v)])
        bad |= np.repeat(size >= 10, size)
        out |= {(*key, i) for (i, _), b in zip(pts, bad) if b}
    return out


@pytest.mark.parametrize("hot_rows", [10**6, 300])
def test_equals_brute_force(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(S, "BLOCK_ROWS", 100)
    rows = series(1, hot=700)
    samples = spark.createDataFrame(rows, "rec_id long, channel int, idx long, data_uv double, clash int").repartition(3)
    units = spark.createDataFrame([(r, 1000.0) for r in range(4)], "rec_id long, unit_nv double")
    features = spark.createDataFrame([(0, 0, 0.5, 1), (0, 0, 0.5, 2), (1, 0, 10.0, 1), (2, 1, -3.0, 1), (9, 0, 1.0, 1)], "rec_id long, channel int, sd_uv double, clash int")
    got = [tuple(r) for r in S.implausible(samples, units, features, hot_rows).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows, 1000) | {(0, 0, -1), (2, 1, -1)}


def test_empty_and_unknown_unit(spark):
    kinds = "rec_id long, channel int, idx long, data_uv double"
    units = spark.createDataFrame([], "rec_id long, unit_nv double")
    assert S.series_flags(spark.createDataFrame([], kinds), units).count() == 0
    rows = [(1, 0, i, 1e9 + i % 3) for i in range(30)]
    assert S.series_flags(spark.createDataFrame(rows, kinds), units).filter("beyond").count() == 0


FLAGS = ["series", "rec_id", "channel", "idx", "spike", "far", "stuck", "beyond"]


@pytest.mark.parametrize("hot_rows", [100, 1000])
def test_flags_do_not_depend_on_size(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(S, "BLOCK_ROWS", 170)
    rng = np.random.default_rng(4)
    rows = []
    for rec, n in enumerate((60, 140, 500, 1300, 900, 400, 300)):
        t = np.arange(n)
        x = 0.03 * t + 4 * np.sin(2 * np.pi * t / 12) + rng.normal(0, 1, n).round(3)
        x[rng.integers(0, n, n // 30)] += 25
        x[n // 3 : n // 3 + 14] = 5.5
        if rec == 4:
            x[:] = 3.0  # no scatter at all
        if rec == 5:
            x[100:260] += 60  # a plateau of two fifths
        if rec == 6:
            x[7] = np.inf
        rows += [(rec, 0, int(i) * (1 + rec % 2), float(v)) for i, v in enumerate(x)]
        rows += [(rec, 0, n // 2, None), (rec, 0, n // 2, float("nan"))]
    samples = spark.createDataFrame(rows + rows[:50], "rec_id long, channel int, idx long, data_uv double").repartition(3)
    units = spark.createDataFrame([(r, 300_000.0) for r in range(5)], "rec_id long, unit_nv double")
    want = S.series_flags(samples, units).select(*FLAGS, F.round("scatter", 9).alias("s")).collect()
    got = S.series_flags(samples, units, hot_rows).select(*FLAGS, F.round("scatter", 9).alias("s")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr)
    assert sum(r.spike for r in want) > 50 and all(r.spike for r in want if r.far)


def test_esd_and_decomposition():
    rng = np.random.default_rng(3)
    t = np.arange(160)
    x = 0.05 * t + 4 * np.sin(2 * np.pi * t / 12) + rng.normal(0, 0.3, (20, 160))
    x[:, 77] += 6
    level = np.median(x, 1)
    mad = np.median(np.abs(x - level[:, None]), 1)
    rest = robust.decompose(x, np.tile(t % 12, (20, 1)), 12, 31, level, mad)
    marks = robust.extreme_deviates(rest, mad, 0.01)
    assert marks[:, 77].mean() > 0.9
    assert marks.mean() < 0.03


def test_local_trend_is_weighted_least_squares():
    rng = np.random.default_rng(5)
    y, w = rng.normal(size=(1, 80)), rng.random((1, 80)) * (rng.random((1, 80)) > 0.3)
    got = robust.local_trend(y, w, 31)[0]
    for i in (0, 3, 40, 79):
        at = np.arange(max(0, i - 15), min(80, i + 16))
        k = w[0, at] * (1 - (np.abs(at - i) / 16) ** 3) ** 3
        a = np.stack([np.ones(len(at)), at - i], 1)
        want = np.linalg.solve(a.T @ (a * k[:, None]), a.T @ (k * y[0, at]))[0]
        assert abs(got[i] - want) < 1e-9


def test_t_quantile_against_tables():
    for p, df, want in ((0.9995, 3, 12.924), (0.975, 1, 12.706), (0.975, 10, 2.2281), (0.995, 20, 2.8453), (0.9995, 60, 3.4602), (0.95, 120, 1.6577)):
        assert abs(distributions.t_quantile(p, df) - want) < 0.002


def test_exact_quantiles(spark):
    rng = np.random.default_rng(6)
    groups = {"a": rng.normal(size=997), "b": rng.integers(0, 5, 400).astype(float), None: np.array([3.0])}
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("a", None), ("c", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    got = {r.g: (r.n, r.q) for r in exact_quantiles(df, ["g"], "v", [0.0, 0.25, 0.5, 0.9], "q").collect()}
    assert set(got) == set(groups)
    for g, x in groups.items():
        assert got[g][0] == len(x) and np.allclose(got[g][1], np.quantile(x, [0.0, 0.25, 0.5, 0.9]))
