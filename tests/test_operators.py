"""Small closed-form cases of the reference operators: ties, gaps, nulls, empty tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.functions import codes, distributions
from wavemill.functions.ranking import average_ranks, ordered_rank, salted_rank
from wavemill.operators import blocks as B
from wavemill.operators import filters as FI
from wavemill.operators import regress, stats
from wavemill.operators import rules as R
from wavemill.operators import states as ST


def col(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def signal(spark, values, key=1):
    rows = [(key, i, None if v is None else float(v)) for i, v in values]
    return spark.createDataFrame(rows, "k long, idx long, x double")


@pytest.mark.parametrize("text, n", [("sub-000077", 77), ("S77", 77), ("Sub 0077", 77), ("sub‑077 ", 77), ("x", None), (None, None), ("", None)])
def test_subject_number(spark, text, n):
    assert spark.createDataFrame([(text,)], "t string").select(codes.subject_number(F.col("t"))).first()[0] == n


def test_paths_and_partitions(spark):
    df = spark.createDataFrame([(".\\sub-1\\eeg\\a.edf ", " Valid "), ("/sub-1//eeg/a.edf", "TRAIN"), (None, "?")], "p string, s string")
    assert [tuple(r) for r in df.select(codes.path(F.col("p")), codes.partition_name(F.col("s"))).collect()] == [
        ("sub-1/eeg/a.edf", "validation"), ("sub-1/eeg/a.edf", "train"), (None, None),
    ]


def test_blocks_drop_partial(spark):
    b = B.tumbling(signal(spark, [(i, i) for i in range(10)]), ["k"], 4)
    assert col(b, "block", "ptp", "n") == [(0, 3.0, 4), (1, 3.0, 4)]


def test_runs_end_at_gaps(spark):
    f = spark.createDataFrame([(1, i, i not in (2, 7)) for i in range(10) if i != 5], "k long, idx long, ok boolean")
    assert col(B.runs(f, ["k"], "idx", "ok", 2), "start", "stop", "n") == [(0, 2, 2), (3, 5, 2), (8, 10, 2)]


def test_dilate_and_distance(spark):
    f = spark.createDataFrame([(1, i, i == 3) for i in range(7) if i != 4], "k long, idx long, hot boolean")
    assert [r[1] for r in col(B.dilate(f, ["k"], "idx", "hot", 2), "idx", "dilated")] == [False, True, True, True, True, False]
    assert col(B.flag_distance(f, ["k"], "idx", "hot"), "idx", "distance") == [(0, 3), (1, 2), (2, 1), (3, 0), (5, 2), (6, 3)]


def test_lags_do_not_cross_gaps(spark):
    s = signal(spark, [(0, 1), (1, 2), (2, 4), (4, 8), (5, 16)])
    got = {r.idx: (r.x_1, r.x_2) for r in B.lagged(s, ["k"], "idx", "x", [1, 2]).collect()}
    assert got == {0: (None, None), 1: (1.0, None), 2: (2.0, 1.0), 4: (None, None), 5: (8.0, None)}


def test_kleene(spark):
    df = spark.createDataFrame([(1, True), (1, None), (2, False), (2, None), (3, True)], "g int, v boolean")
    assert {r.g: r.o for r in df.groupBy("g").agg(R.kleene_and("v").alias("o")).collect()} == {1: None, 2: False, 3: True}


def test_pareto_ties(spark):
    df = spark.createDataFrame([(1, 5.0, 1), (1, 5.0, 2), (2, 5.0, 3), (3, 4.0, 4), (4, 4.5, 5)], "c int, l double, t int").withColumn("g", F.lit(1))
    assert col(R.pareto(df, ["g"], "c", "l", "t"), "t") == [(1,), (4,)]
    assert col(R.within_tolerance(df, ["g"], "c", "l", 25, "t"), "t") == [(1,)]


def test_exact_limit(spark):
    df = spark.createDataFrame([(1, 20), (2, 39)], "p long, w long")
    assert [r[0] for r in df.select(R.exceeds(F.col("p"), F.col("w"), 1, 20)).collect()] == [False, True]


def test_ranks_number_every_row_once(spark):
    df = spark.range(1000).withColumn("g", F.lit(None).cast("int"))
    assert sorted(r.rank for r in salted_rank(df, ["g"], ["id"], buckets=8).collect()) == list(range(1, 1001))
    assert all(r.rank == r.id + 1 for r in ordered_rank(df, "id", width=64).collect())


def test_holm(spark):
    df = spark.createDataFrame([(1, 0.01, 1), (1, 0.04, 2), (1, 0.03, 3)], "g int, p double, t int")
    assert [round(r.p_holm, 9) for r in stats.holm(df, ["g"], "p", "t").orderBy("t").collect()] == [0.03, 0.06, 0.06]


def test_ranks_and_holm_of_many_rows(spark):
    rng = np.random.default_rng(8)
    rows = [(g, i, None if v == 7 else float(v)) for g in ("a", None) for i, v in enumerate(rng.integers(0, 60, 500))]
    df = spark.createDataFrame(rows, "g string, i int, x double").repartition(3)
    got = {(r.g, r.i): r.rank for r in average_ranks(df, ["g"], "x", "rank", buckets=8).collect()}
    holm = {(r.g, r.i): r.p_holm for r in stats.holm(df.withColumn("p", F.col("x") / 3000), ["g"], "p", "i").collect()}
    for g in ("a", None):
        x = {i: v for h, i, v in rows if h == g and v is not None}
        for i, v in x.items():
            assert got[g, i] == sum(u < v for u in x.values()) + (sum(u == v for u in x.values()) + 1) / 2
        most = 0.0
        for k, (v, i) in enumerate(sorted((v, i) for i, v in x.items())):
            most = max(most, (len(x) - k) * v / 3000)
            assert abs(holm[g, i] - min(1.0, most)) < 1e-12
        assert all(got[g, i] is None for h, i, v in rows if h == g and v is None)


def test_icc_of_equal_sessions(spark):
    df = spark.createDataFrame([(i, float(i), float(i) + 3, 1) for i in range(5)] + [(9, 1.0, None, 1)], "s int, a double, b double, g int")
    r = stats.icc31(df, ["g"], "s", "a", "b").first()
    assert r.n == 5 and abs(r.icc - 1) < 1e-12


def test_incomplete_beta_closed_forms():
    for x in (0.1, 0.5, 0.9):
        assert abs(distributions.log_beta_part(x, 1, 1) - x) < 1e-12
        assert abs(distributions.log_beta_part(x, 3, 1) - x**3) < 1e-12
        assert abs(distributions.log_beta_part(x, 1, 4) - (1 - (1 - x) ** 4)) < 1e-12
    assert abs(distributions.beta_quantile(0.95, 1, 60) - (1 - 0.05 ** (1 / 60))) < 1e-9


def test_f_quantile_and_interval(spark):
    for p in (0.5, 0.9, 0.975):
        assert abs(distributions.f_quantile(p, 2, 2) - p / (1 - p)) < 1e-9
    df = spark.createDataFrame([(3, 0.5), (1, 0.5), (3, None)], "n long, icc double")
    got = [(r.low, r.high) for r in stats.icc_interval(df, "n", "icc").collect()]
    q = 0.975 / 0.025
    assert abs(got[0][0] - (3 / q - 1) / (3 / q + 1)) < 1e-9 and abs(got[0][1] - (3 * q - 1) / (3 * q + 1)) < 1e-9
    assert got[1] == got[2] == (None, None)


def test_binomial_interval(spark):
    df = spark.createDataFrame([(0, 60), (60, 60), (0, 0)], "k long, n long")
    got = [(r.low, r.high) for r in stats.binomial_interval(df, "k", "n").collect()]
    assert got[0][0] == 0 and abs(got[0][1] - (1 - 0.025 ** (1 / 60))) < 1e-9 and got[1][1] == 1 and got[2] == (None, None)


def test_filter_gains():
    t = np.arange(8192) / 256
    for f, want in ((10.0, 1.0), (45.0, 0.5), (100.0, 0.0)):
        x = np.sin(2 * np.pi * f * t)[None]
        y = FI.apply_gain(x, 256.0, FI.butterworth(0.5, 45.0, 4))
        assert abs(np.std(y[0, 2000:-2000]) / np.std(x) - want) < 0.02
    hum = np.sin(2 * np.pi * 50 * t)[None] + np.sin(2 * np.pi * 100 * t)[None]
    assert np.abs(FI.apply_gain(hum, 256.0, FI.notch(50.0, 30.0))[0, 2000:-2000]).max() < 0.05
    assert np.std(FI.apply_gain(hum, 256.0, FI.notch(50.0, 30.0, harmonics=False))[0, 2000:-2000]) > 0.6


@pytest.mark.parametrize("gain", [FI.butterworth(0.5, 45.0, 4), FI.notch(50.0, 30.0), FI.low_pass_for(64.0)])
def test_blocks_filter_like_a_whole_series(spark, gain):
    """Two stretches of 20 000 and 9 000 samples at two rates: as the gain over each whole stretch."""
    rng = np.random.default_rng(0)
    parts = {(1, 5): (128.0, rng.standard_normal(20_000)), (1, 30_000): (128.0, rng.standard_normal(9_000)), (2, 0): (256.0, rng.standard_normal(17_000))}
    rows = [(k, at + i, float(v), fs) for (k, at), (fs, x) in parts.items() for i, v in enumerate(x)]
    df = spark.createDataFrame([*rows, (3, 1, 1.0, 128.0), (4, 1, 1.0, None), (None, 1, 2.0, 128.0)], "k long, idx long, x double, fs double")
    got = {(r.k, r.idx): r.y for r in FI.filtered(df, ["k"], gain).collect()}
    assert len(got) == len(rows)
    for (k, at), (fs, x) in parts.items():
        want = FI.apply_gain(x[None], fs, gain)[0]
        assert np.abs(np.array([got[k, at + i] for i in range(len(x))]) - want).max() < 1e-6


def test_downsample_and_deviation(spark):
    t = np.arange(4096) / 256
    rows = [(1, c, i, float(v), 256.0) for c in (0, 1) for i, v in enumerate((1 + c) * 30 * np.sin(2 * np.pi * 8 * t))]
    df = spark.createDataFrame(rows, "k long, c int, idx long, x double, fs double")
    y = [r.y for r in FI.downsampled(df.filter("c = 0"), ["k"], 64.0).orderBy("step").collect()]
    assert len(y) == 1024 and np.abs(np.array(y) - 30 * np.sin(2 * np.pi * 8 * t[::4]))[100:-100].max() < 1e-3
    assert FI.downsampled(df, ["k", "c"], 100.0).count() == 0
    row = FI.deviation_check(df, "k", "c").first()
    assert row.n == 2 and abs(row.median_sd - 45 / np.sqrt(2)) < 0.5 and row.passed


def test_surrogate_keeps_values():
    x = np.random.default_rng(1).standard_normal((3, 64))
    y = FI.surrogate(x, np.array([1, 1, 2]))
    assert np.allclose(np.sort(y, 1), np.sort(x, 1)) and not np.allclose(x, y)


def test_tv_derivative_of_a_ramp():
    x = np.concatenate([np.zeros(16), np.arange(16) * 2.0])[None]
    u = FI.tv_derivative(x, 0.01)[0]
    assert np.abs(u[4:12]).max() < 0.2 and np.abs(u[20:-2] - 2).max() < 0.2


def test_tv_derivative_is_least():
    rng = np.random.default_rng(4)
    n, weight, fs = 24, 0.05, 4.0
    x = np.cumsum(rng.normal(size=(3, n)), 1)
    u = FI.tv_derivative(x, weight, fs, 1e-7, 20_000)

    def cost(v):
        area = np.concatenate([[0], np.cumsum((v[1:] + v[:-1]) / 2)]) / fs
        return np.square(area - (row - row[0])).sum() / 2 + weight * np.abs(np.diff(v)).sum()

    for row, v in zip(x, u):
        assert all(cost(v) <= cost(v + rng.normal(0, s, n)) + 1e-9 for s in (1e-3, 1e-2, 0.1) for _ in range(200))


def test_level_filter_is_a_kalman_filter():
    x = np.random.default_rng(2).standard_normal((2, 12))
    q, r = 0.3, 0.7
    nis, smooth = ST.level_filter(x, q, r)
    # the smoother solves the penalised least squares of the same model, the first sample being its own prior
    n = 12
    d = np.diff(np.eye(n), axis=0)
    h = np.eye(n) / r + d.T @ d / q
    prior = np.zeros((n, n))
    prior[0, 0] = 1 / (r + q)
    want = np.linalg.solve(h + prior, (x / r + np.outer(x[:, 0], np.eye(n)[0]) / (r + q)).T).T
    assert np.allclose(smooth, want)


def test_equation_refuses_other_text():
    with pytest.raises(ValueError):
        regress.equation("a; drop", {"a": "x"})
    with pytest.raises(ValueError):
        regress.equation("b + 1", {"a": "x"})


def two_channels(spark, n=330):
    rng = np.random.default_rng(5)
    rows, whole = [], {}
    m1, m2 = np.array([[0.5, 0.2], [0.0, 0.3]]), np.array([[-0.4, 0.0], [0.3, -0.3]])
    for rec in range(10):
        z = [np.zeros(2), np.zeros(2)]
        for _ in range(n):
            z.append(m1 @ z[-1] + m2 @ z[-2] + rng.standard_normal(2))
        z = np.array(z[30:])
        whole[rec] = z
        rows += [(rec, c, i + (i >= 120), float(z[i, c])) for i in range(len(z)) for c in (0, 1)]
    recordings = spark.createDataFrame([(r, f"sub-{r // 2}", "now") for r in range(10)], "rec_id long, subject string, received_at string")
    return spark.createDataFrame(rows, "rec_id long, channel int, idx long, data_uv double").repartition(5), recordings, whole


def test_order_of_a_known_process(spark, monkeypatch):
    monkeypatch.setattr(regress, "DESIGN_BLOCK", 50)
    samples, recordings, whole = two_channels(spark)
    found = regress.cross_validated_order(samples, recordings, 4, 5).collect()
    mse = {r.p: r.mse for r in found}
    assert mse[1] > mse[2] * 1.1 and abs(mse[3] / mse[2] - 1) < 0.02 and [r.p for r in found if r.chosen][0] in (2, 3)
    # the same by ordinary least squares over the whole design
    fold = {r.rec_id: r.fold for r in regress.subject_folds(recordings, 5).collect()}
    assert all(fold[r] == fold[r ^ 1] for r in range(10))
    parts = {}
    for rec, z in whole.items():
        z = (z - z.mean(0)) / z.std(0, ddof=1)
        for part in (z[:120], z[120:]):
            parts.setdefault(fold[rec], []).append(regress.lag_matrix(part[:, 0], part[:, 1], 4))
    parts = {k: np.vstack(v) for k, v in parts.items()}
    for p in (1, 3):
        total = 0.0
        for k, held in parts.items():
            rest = np.vstack([v for j, v in parts.items() if j != k])
            coef = np.linalg.lstsq(rest[:, : 2 * p + 1], rest[:, -2:], rcond=None)[0]
            total += np.square(held[:, -2:] - held[:, : 2 * p + 1] @ coef).sum()
        assert abs(mse[p] - total / (2 * sum(map(len, parts.values())))) < 1e-8
    s = {r.rec_id: (r.mse, r.n) for r in regress.scores(samples, recordings, 4, 5).collect()}
    n = len(whole[0])
    assert set(s) == set(range(10)) and all(v[1] == n - 8 and 0.2 < v[0] < 1 for v in s.values())


def test_order_of_empty_tables(spark):
    samples, recordings, _ = two_channels(spark, 40)
    assert regress.cross_validated_order(samples.limit(0), recordings, 4, 5).count() == 0
    assert regress.scores(samples, recordings.limit(0), 4, 5).count() == 0


def test_resampling_draws_like_chance(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(200)], "id long, v double")
    r = stats.resamples(df, "id", ["v"], 400).groupBy("b").agg(F.count("*").alias("n"), F.avg("v").alias("m")).collect()
    assert {x.n for x in r} == {200} and len(r) == 400
    means = np.array([x.m for x in r])
    spread = np.arange(200).std() / math.sqrt(200)
    assert abs(means.mean() - 99.5) < 1 and 0.85 < means.std() / spread < 1.15


def gaussian_levels(idx, x, q, r):
    """Levels as the posterior mean of one Gaussian vector: first sample known with variance q + r before it is seen."""
    idx = np.array(idx, float)
    prior = r + q + q * np.minimum.outer(idx - idx[0], idx - idx[0])
    return x[0] + prior @ np.linalg.solve(prior + r * np.eye(len(idx)), np.array(x) - x[0])


@pytest.mark.parametrize("batch", [200_000, 10])
def test_levels_run_through_gaps_and_blocks(spark, monkeypatch, batch):
    monkeypatch.setattr(ST, "BATCH", batch)
    rng = np.random.default_rng(3)
    series = {"a": list(range(5, 90)), "b": [i for i in range(75) if i % 9 != 4 and not 30 < i < 41], "c": [7], None: [1, 2, 40]}
    rows = [(k, i, float(v)) for k, at in series.items() for i, v in zip(at, rng.normal(size=len(at)).cumsum())]
    df = spark.createDataFrame(rows, "k string, idx long, x double").repartition(3)
    got = {(r.k, r.block * 32 + r.step): r.level for r in ST.smoothed(df, ["k"], 0.1, 0.25).collect()}
    want = {(k, i): v for k, at in series.items() for i, v in zip(at, gaussian_levels(at, [x for n, _, x in rows if n == k], 0.1, 0.25))}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    nis = {(r.k, r.q): r.nis for r in ST.nis_by_q(df, ["k"], [0.1, 1.0], 0.25).collect()}
    assert set(nis) == {(k, q) for k in "ab" for q in (0.1, 1.0)}
    whole = ST.level_filter(np.array([[x for k, _, x in rows if k == "a"]]), 0.1, 0.25)[0][0, 4:].mean()
    assert abs(nis["a", 0.1] - whole) < 1e-9


@pytest.mark.parametrize("seed", [1, 2])
def test_span_windows_equal_whole_series(spark, seed):
    """Segments, places, islands and dwell in spans of 8 indices against loops over whole series, null key among them."""
    rng = np.random.default_rng(seed)
    rows, seg, runs, fired = [], {}, [], {}
    for k in ("a", "b", None):
        at = [i for i in range(120) if rng.random() > 0.12]
        values = [None if v == 3 else int(v) for v in np.repeat(rng.integers(0, 4, 60), rng.integers(1, 20, 60))[: len(at)]]
        start, held = None, 0
        for n, (i, v) in enumerate(zip(at, values)):
            start = i if not n or at[n - 1] != i - 1 else start
            seg[k, i] = (start, n + 1)
            if n and values[n - 1] == v:
                runs[-1][3] += 1
            else:
                runs.append([k, v, i, 1])
            held = held + 1 if v == 1 else 0
            if held == 5:
                fired.setdefault(k, i)
        rows += [(k, i, v) for i, v in zip(at, values)]
    df = spark.createDataFrame(rows, "k string, idx long, v int").repartition(3)
    s = B.placed(B.segmented(df, ["k"], width=8), ["k"], "idx", width=8)
    assert {(r.k, r.idx): (r.segment, r.place) for r in s.collect()} == seg
    got = [[r.k, r.v, r.start, r.n] for r in B.islands(df, ["k"], "idx", "v", width=8).collect()]
    assert sorted(got, key=repr) == sorted(runs, key=repr)
    one = df.withColumn("f", F.coalesce(F.col("v") == 1, F.lit(False)))
    assert {r.k: r.fired for r in B.dwell(one, ["k"], "idx", "f", 5).collect()} == fired
    assert B.segmented(df.limit(0), ["k"]).count() == 0 and B.islands(df.limit(0), ["k"], "idx", "v").count() == 0


def test_blocks_begin_at_segments(spark):
    b = B.tumbling(signal(spark, [(i, i) for i in [3, 4, 5, 6, 7, 9, 10, 11, 12, 13, 14, 15, 16]]), ["k"], 4)
    assert col(b, "segment", "block") == [(3, 0), (9, 0), (9, 1)]
