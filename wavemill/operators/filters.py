"""Zero-phase filters, resampling, surrogates and derivatives of series, at each series' own rate.

A series is cut at its gaps, and a stretch of more than ``BLOCK_S`` seconds into blocks with a margin on both sides
(overlap-save) of about the length of the impulse response, so that a long one spreads over many tasks; numpy works on
many blocks of one length and rate at once. The gains are those of Butterworth and notch filters run forward and
backward, applied in the frequency domain after odd reflection at the ends of a stretch.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.operators.blocks import segmented

#: Seconds of a block, and of its margins and the reflection: a 0.5 Hz filter of order 4 has died down to 10^-8 by then.
BLOCK_S, MARGIN_S = 64, 16

Gain = Callable[[np.ndarray, float], np.ndarray]


def butterworth(low: float, high: float | None, order: int) -> Gain:
    """Gain of a band-pass run forward and backward: −6 dB at both cut-offs. Without ``high`` a high-pass, with ``low`` 0
    a low-pass."""

    def gain(f: np.ndarray, fs: float) -> np.ndarray:
        up = 1 / (1 + (f / high) ** (2 * order)) if high else 1.0
        down = np.where(f > 0, 1 / (1 + (low / np.where(f > 0, f, 1)) ** (2 * order)), 0.0) if low else 1.0
        return up * down

    return gain


def notch(centre: float, quality: float, harmonics: bool = True) -> Gain:
    """Gain of second-order notches run forward and backward, at ``centre`` and each harmonic below half the rate."""

    def gain(f: np.ndarray, fs: float) -> np.ndarray:
        out = np.ones_like(f)
        k = 1
        while k * centre < fs / 2 and (harmonics or k == 1):
            off = (f * f - (k * centre) ** 2) ** 2
            out *= off / (off + (f * k * centre / quality) ** 2 + 1e-300)
            k += 1
        return out

    return gain


def low_pass_for(rate: float) -> Gain:
    """All below 0.8 of half the new rate, nothing above half of it, a cosine between."""

    def gain(f: np.ndarray, fs: float) -> np.ndarray:
        if rate >= fs:
            return np.ones_like(f)
        place = np.clip((f / (rate / 2) - 0.8) / 0.2, 0, 1)
        return 0.5 + 0.5 * np.cos(np.pi * place)

    return gain


def apply_gain(x: np.ndarray, fs: float, gain: Gain) -> np.ndarray:
    """Rows of ``x`` after the gain, with odd reflection at both ends."""
    n = x.shape[1]
    pad = min(int(MARGIN_S * fs), n - 1)
    if pad > 0:
        left = 2 * x[:, :1] - x[:, pad:0:-1]
        right = 2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]
        x = np.concatenate([left, x, right], 1)
    y = np.fft.irfft(np.fft.rfft(x, axis=1) * gain(np.fft.rfftfreq(x.shape[1], 1 / fs), fs), x.shape[1], axis=1)
    return y[:, pad : pad + n]


def surrogate(x: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Amplitude-adjusted surrogates of rows: the same values, the spectrum of a Gaussian copy of the ranks, and
    phases drawn from each row's own seed."""
    out = np.empty_like(x)
    n = x.shape[1]
    for i, row in enumerate(x):
        rng = np.random.default_rng(int(seeds[i]) & 0x7FFFFFFFFFFFFFFF)
        normal = np.sort(rng.standard_normal(n))
        rank = np.argsort(np.argsort(row, kind="stable"), kind="stable")
        spectrum = np.fft.rfft(normal[rank])
        phases = np.exp(2j * np.pi * rng.random(len(spectrum)))
        phases[0] = 1
        if n % 2 == 0:
            phases[-1] = 1
        mixed = np.fft.irfft(spectrum * phases, n)
        out[i] = np.sort(row)[np.argsort(np.argsort(mixed, kind="stable"), kind="stable")]
    return out


@lru_cache(maxsize=16)
def _tv_system(n: int, fs: float, weight: float) -> tuple[np.ndarray, np.ndarray, float]:
    """The matrix that maps right-hand sides to derivatives, the integral as a matrix, and the step between splits."""
    integral = (np.cumsum(np.eye(n), 0) - np.eye(n) / 2 - 0.5 * np.eye(n)[0]) / fs
    integral[0] = 0
    jumps = np.diff(np.eye(n), axis=0)
    rho = 5 * weight / fs  # jumps of about a fifth of the rate are usual in series of unit SD
    return np.linalg.inv(integral.T @ integral + rho * jumps.T @ jumps + 1e-12 * np.eye(n)), integral, rho


def tv_derivative(x: np.ndarray, weight: float, fs: float = 1.0, tolerance: float = 1e-3, most: int = 2_000) -> np.ndarray:
    """Derivatives per second of rows under a total-variation penalty: the u that minimises
    |∫u − (x − x0)|² / 2 + weight · Σ|Δu|, with the trapezoid integral.

    Alternating directions: a linear solve with one matrix for all rows, then shrinkage of the jumps; a row is left
    as it is once its split residual stays under ``tolerance`` of its size, all after ``most`` steps.
    """
    m, n = x.shape
    inverse, integral, rho = _tv_system(n, fs, weight)
    target = (x - x[:, :1]) @ integral
    jump, dual = np.zeros((m, n - 1)), np.zeros((m, n - 1))
    out = np.zeros((m, n))
    live = np.arange(m)
    for step in range(most):
        pull = rho * (jump[live] - dual[live])
        u = (target[live] + np.pad(pull, ((0, 0), (1, 0))) - np.pad(pull, ((0, 0), (0, 1)))) @ inverse
        moved = np.diff(u, axis=1)
        new = np.sign(moved + dual[live]) * np.maximum(np.abs(moved + dual[live]) - weight / rho, 0)
        dual[live] += moved - new
        apart = np.maximum(np.abs(moved - new).max(1), np.abs(new - jump[live]).max(1))
        jump[live], out[live] = new, u
        live = live[apart > tolerance * np.maximum(np.abs(u).max(1), 1e-12)]
        if not len(live):
            break
    return out


def _alike(arrays: pd.Series, rates: pd.Series, work: Callable[[np.ndarray, float, np.ndarray], np.ndarray]) -> pd.Series:
    """``work(matrix, rate, positions)`` over the arrays of each length and rate; those of under four values give null."""
    out: list = [None] * len(arrays)
    length = arrays.map(lambda v: 0 if v is None else len(v)).to_numpy()
    for fs in rates.dropna().unique():
        for n in np.unique(length[(length > 3) & (rates == fs).to_numpy()]):
            at = np.flatnonzero((length == n) & (rates == fs).to_numpy())
            for i, row in zip(at, work(np.stack([np.asarray(arrays.iloc[i], float) for i in at]), float(fs), at)):
                out[i] = row
    return pd.Series(out)


def _blocks(df: DataFrame, key: list[str], margin_s: float) -> DataFrame:
    """Blocks of each stretch as arrays in order: ``at`` (positions from the stretch's start), ``v``, with margins."""
    pos, size, margin = F.col("idx") - F.col("segment"), F.lit(BLOCK_S) * F.col("fs"), F.lit(margin_s) * F.col("fs")
    own = F.floor(pos / size)
    near = F.array_distinct(F.array(F.greatest(F.floor((pos - margin) / size), F.lit(0)), own, F.floor((pos + margin) / size)))
    spread = segmented(df, key).withColumn("_pos", pos).withColumn("_own", own).withColumn("block", F.explode(near))
    packed = spread.groupBy(*key, "segment", "fs", "block").agg(F.array_sort(F.collect_list(F.struct("_pos", "x"))).alias("s"), F.max(F.col("_own") == F.col("block")).alias("_any"))
    return packed.filter("_any").select(*key, "segment", "fs", "block", F.transform("s", lambda s: s["_pos"]).alias("at"), F.transform("s", lambda s: s.x).alias("v"))


def _unpacked(df: DataFrame, key: list[str], name: str) -> DataFrame:
    rows = df.filter("y is not null").select(*key, "segment", "fs", "block", "at", F.posexplode("y").alias("_p", name))
    rows = rows.withColumn("_pos", F.get("at", F.col("_p")))
    return rows.filter(F.floor(F.col("_pos") / (F.lit(BLOCK_S) * F.col("fs"))) == F.col("block")).select(*key, "segment", "fs", (F.col("segment") + F.col("_pos")).alias("idx"), name)


def filtered(df: DataFrame, key: list[str], gain: Gain, name: str = "y") -> DataFrame:
    """Series (``key``, ``idx``, ``x``, ``fs``, unique by index) after a gain: ``segment``, ``fs``, ``idx`` and ``name``.

    Rows with a null key, rate, value or index take no part; no filter crosses a gap; stretches of fewer than four
    samples give no rows; ``fs`` is constant in a series and at least 1.
    """

    @F.pandas_udf("array<double>")
    def work(v: pd.Series, fs: pd.Series) -> pd.Series:
        return _alike(v, fs, lambda m, rate, _: apply_gain(m, rate, gain))

    return _unpacked(_blocks(_whole(df, key), key, MARGIN_S).withColumn("y", work("v", "fs")), key, name)


def _whole(df: DataFrame, key: list[str]) -> DataFrame:
    return df.filter(" and ".join(f"{c} is not null" for c in (*key, "idx", "x", "fs")) + " and fs >= 1")


def downsampled(df: DataFrame, key: list[str], rate: float, name: str = "y") -> DataFrame:
    """Series at ``rate``: every so-many-th sample of each stretch after a low-pass. Series whose own rate isn't a whole
    multiple of it give no rows. ``step`` numbers the samples of a stretch."""
    whole = (F.col("fs") >= rate) & (F.col("fs") % rate == 0)
    ratio = (F.col("fs") / rate).cast("long")
    y = filtered(df.filter(whole), key, low_pass_for(rate), name).withColumn("_pos", F.col("idx") - F.col("segment"))
    return y.filter(F.col("_pos") % ratio == 0).withColumn("step", (F.col("_pos") / ratio).cast("long")).drop("_pos")


def surrogates(df: DataFrame, key: list[str], seed: int, name: str = "y") -> DataFrame:
    """One amplitude-adjusted surrogate of each stretch (of each block of a longer one), drawn from the seed, key, stretch
    and block."""

    @F.pandas_udf("array<double>")
    def work(v: pd.Series, fs: pd.Series, s: pd.Series) -> pd.Series:
        seeds = s.to_numpy()
        return _alike(v, fs, lambda m, _, at: surrogate(m, seeds[at]))

    b = _blocks(_whole(df, key), key, 0)
    return _unpacked(b.withColumn("y", work("v", "fs", F.xxhash64(F.lit(seed), *key, "segment", "block"))), key, name)


def derivative(df: DataFrame, key: list[str], weight: float, size: int = 32, name: str = "slope") -> DataFrame:
    """Total-variation derivatives in windows of ``size`` samples from the start of each stretch: ``segment``,
    ``window``, ``step``, ``name``; partial windows are dropped."""

    @F.pandas_udf("array<double>")
    def work(v: pd.Series, fs: pd.Series) -> pd.Series:
        return _alike(v, fs, lambda m, rate, _: tv_derivative(m, weight, rate))

    window = F.floor((F.col("idx") - F.col("segment")) / size).alias("window")
    packed = segmented(_whole(df, key), key).groupBy(*key, "segment", "fs", window).agg(F.array_sort(F.collect_list(F.struct("idx", "x"))).alias("s"))
    full = packed.filter(F.size("s") == size).withColumn("y", work(F.transform("s", lambda s: s.x), "fs"))
    return full.select(*key, "segment", "window", F.posexplode("y").alias("step", name))


def deviation_check(df: DataFrame, recording: str, channel: str, low: float = 2.0, high: float = 200.0) -> DataFrame:
    """Whether each recording's amplitudes can be right: ``recording``, ``n`` channels, ``median_sd``, ``passed``.

    Of series in µV (``recording``, ``channel``, ``idx``, ``x``, ``fs``): the sample SD of each channel after a 0.5 Hz
    high-pass, and its median over the channels, which passes from ``low`` to ``high``. Channels of fewer than four
    samples on end don't count.
    """
    y = filtered(df, [recording, channel], butterworth(0.5, None, 4))
    sd = y.groupBy(recording, channel).agg(F.stddev_samp("y").alias("_sd"))
    out = sd.groupBy(recording).agg(F.count("_sd").alias("n"), F.median("_sd").alias("median_sd"))  # as many values as channels
    return out.withColumn("passed", F.col("median_sd").between(low, high))
