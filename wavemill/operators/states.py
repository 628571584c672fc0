"""A local-level state filter and smoother over whole series, many series at once.

The level follows a random walk of variance ``q``, samples scatter around it with variance ``r``. The recursion
runs over time on whole batches of series.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: So many samples at least are filtered at once.
BATCH = 200_000


def level_filter(x: np.ndarray, q: float, r: float) -> tuple[np.ndarray, np.ndarray]:
    """Normalised innovations squared, and smoothed levels, of the rows of ``x``."""
    m, n = x.shape
    mean, var = np.empty((n, m)), np.empty(n)
    before = np.empty((n, m))
    nis = np.empty((n, m))
    a, p = x[:, 0], r
    for t in range(n):
        before[t] = a
        spread = p + q + r
        gap = x[:, t] - a
        nis[t] = gap * gap / spread
        gain = (p + q) / spread
        a, p = a + gain * gap, (1 - gain) * (p + q)
        mean[t], var[t] = a, p
    smooth = mean.copy()
    for t in range(n - 2, -1, -1):
        smooth[t] += var[t] / (var[t] + q) * (smooth[t + 1] - mean[t])
    return nis.T, smooth.T


def series_filter(x: np.ndarray, step: np.ndarray, starts: np.ndarray, q: float, r: float) -> tuple[np.ndarray, np.ndarray]:
    """The same for series of any lengths that lie one after the other in ``x``, each from one of ``starts`` on.

    ``step`` is the distance in time from the sample before, 1 at a start: the state is predicted through gaps.
    """
    n = np.diff(np.append(starts, len(x)))
    order = np.argsort(-n, kind="stable")
    first, n = starts[order], n[order]
    live = [int(np.searchsorted(-n, -t)) for t in range(int(n[0]))]  # series of more than t samples
    mean, var, nis = np.empty(len(x)), np.empty(len(x)), np.empty(len(x))
    a, p = x[first].copy(), np.full(len(first), float(r))
    for t, m in enumerate(live):
        at = first[:m] + t
        before = p[:m] + step[at] * q
        spread = before + r
        gap = x[at] - a[:m]
        nis[at] = gap * gap / spread
        gain = before / spread
        a[:m] += gain * gap
        p[:m] = (1 - gain) * before
        mean[at], var[at] = a[:m], p[:m]
    smooth = mean.copy()
    for t in range(len(live) - 2, -1, -1):
        at = first[: live[t + 1]] + t
        smooth[at] += var[at] / (var[at] + step[at + 1] * q) * (smooth[at + 1] - mean[at])
    return nis, smooth


def _whole_series(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]]:
    """Tables of whole series from sorted batches, with ``x``, ``step`` and ``starts``."""

    def cut(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[:1] = True
        for k in key:
            code = t.column(k).combine_chunks().dictionary_encode("encode").indices.to_numpy()
            new[1:] |= code[1:] != code[:-1]
        return np.flatnonzero(new)

    def arrays(t: pa.Table, starts: np.ndarray) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
        idx = t.column("idx").to_numpy()
        step = np.ones(len(idx))
        step[1:] = np.diff(idx)
        step[starts] = 1
        return t, t.column("x").to_numpy(), step, starts

    held: list[pa.RecordBatch] = []
    n, limit = 0, BATCH
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n < limit:
            continue
        t = pa.Table.from_batches(held)
        starts = cut(t)
        if len(starts) > 1:
            yield arrays(t.slice(0, starts[-1]), starts[:-1])
        t = t.slice(starts[-1])
        held, n = t.to_batches(), t.num_rows
        limit = max(BATCH, 2 * n)
    if n:
        t = pa.Table.from_batches(held)
        yield arrays(t, cut(t))


def _sorted(df: DataFrame, key: list[str]) -> DataFrame:
    rows = df.select(*key, "idx", F.col("x").cast("double").alias("x")).filter("idx is not null and x is not null")
    return rows.repartition(*key).sortWithinPartitions(*key, "idx", "x")


def nis_by_q(df: DataFrame, key: list[str], grid: list[float], r: float, size: int = 32) -> DataFrame:
    """``key``, ``q`` and ``nis``: the mean normalised innovation of each whole series, gaps predicted, without
    its first ``size`` // 8 samples, for every q of the grid. Series (``key``, ``idx``, ``x``) of fewer than
    ``size`` samples have no row. A task holds the longest of its series."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, x, step, starts in _whole_series(batches, key):
            n = np.diff(np.append(starts, len(x)))
            late = np.arange(len(x)) - np.repeat(starts, n) >= size // 8
            enough = n >= size
            heads = t.select(key).take(pa.array(starts[enough])).combine_chunks()
            for q in grid:
                nis = np.add.reduceat(np.where(late, series_filter(x, step, starts, q, r)[0], 0.0), starts)[enough] / (n[enough] - size // 8)
                both = heads.append_column("q", pa.array(np.full(len(nis), float(q)))).append_column("nis", pa.array(nis))
                yield from both.to_batches()

    kinds = [df.schema[k] for k in key]
    return _sorted(df, key).mapInArrow(work, T.StructType([*kinds, T.StructField("q", T.DoubleType()), T.StructField("nis", T.DoubleType())]))


def choose_q(scores: DataFrame, target: float, matched: int) -> DataFrame:
    """The q whose mean NIS over all series is nearest the target, ties to the smaller; null ``q`` where fewer
    than ``matched`` series have scores."""
    g = scores.groupBy("q").agg(F.avg("nis").alias("nis"), F.count("*").alias("n")).withColumn("d", F.abs(F.col("nis") - target))
    best = g.agg(F.min(F.struct("d", "q", "nis", "n")).alias("b"))
    return best.select(F.when(F.col("b.n") >= matched, F.col("b.q")).alias("q"), F.col("b.nis").alias("nis"), F.col("b.n").alias("n"))


def smoothed(df: DataFrame, key: list[str], q: float, r: float, size: int = 32) -> DataFrame:
    """Smoothed levels of every sample, from its whole series with gaps predicted: ``key``, ``block``, ``step``
    (``idx`` = ``block`` × ``size`` + ``step``), ``level``. A task holds the longest of its series."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, x, step, starts in _whole_series(batches, key):
            level = pa.array(series_filter(x, step, starts, q, r)[1])
            yield from t.select([*key, "idx"]).append_column("level", level).to_batches()

    rows = _sorted(df, key)
    out = T.StructType([*[df.schema[k] for k in key], rows.schema["idx"], T.StructField("level", T.DoubleType())])
    block = F.floor(F.col("idx") / size)
    return rows.mapInArrow(work, out).select(*key, block.alias("block"), (F.col("idx") - block * size).cast("int").alias("step"), "level")
