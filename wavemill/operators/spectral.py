"""Spectra of short blocks by SQL expressions alone.

A block is an array of ``size`` values. Its discrete Fourier transform is a projection on cosines and sines,
computed with higher-order functions inside the row: no join, no shuffle, no Python.
"""

from __future__ import annotations

import json
from math import cos, pi, sin

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def window_weights(size: int, periodic: bool = False) -> list[float]:
    """Hann weights; symmetric, or periodic as Welch's method takes them."""
    return [0.5 - 0.5 * cos(2 * pi * t / (size if periodic else size - 1)) for t in range(size)]


def blocks_of(df: DataFrame, key: list[str], place: Column, x: str, size: int, step: int) -> DataFrame:
    """Complete blocks of ``size`` samples every ``step`` places, a divisor of ``size``, as arrays in order: ``block``,
    ``v``. One aggregation."""
    first = F.floor(place / step)
    of = F.filter(F.array(*[first - k for k in range(size // step)]), lambda b: b >= 0)
    spread = df.select(*key, place.alias("_p"), F.col(x).cast("double").alias("_x"), F.explode(of).alias("block"))
    packed = spread.groupBy(*key, "block").agg(F.collect_list(F.struct("_p", "_x")).alias("_s"))
    return packed.filter(F.size("_s") == size).select(*key, "block", F.transform(F.array_sort("_s"), lambda s: s["_x"]).alias("v"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def transform(df: DataFrame, key: list[str], size: int, bins: list[int], windowed: bool = True, periodic: bool = False) -> DataFrame:
    """``k``, ``re`` and ``im`` of each block's mean-removed, Hann-weighted values at the given bins. The basis is
    one constant of the plan."""
    hann = window_weights(size, periodic) if windowed else [1.0] * size
    table = [
        {
            "k": k,
            "c": [h * cos(2 * pi * k * t / size) for t, h in enumerate(hann)],
            "s": [-h * sin(2 * pi * k * t / size) for t, h in enumerate(hann)],
        }
        for k in bins
    ]
    # a literal that Catalyst folds to one constant; thousands of number literals would slow the planning
    basis = F.from_json(F.lit(json.dumps(table)), "array<struct<k:int,c:array<double>,s:array<double>>>")
    mean = F.aggregate("v", F.lit(0.0), lambda s, a: s + a) / size
    centred = df.withColumn("_m", mean).withColumn("_c", F.transform("v", lambda a: a - F.col("_m")))
    wide = centred.select(*key, "_c", F.explode(basis).alias("_b"))
    return wide.select(*key, F.col("_b.k").alias("k"), _dot(F.col("_c"), F.col("_b.c")).alias("re"), _dot(F.col("_c"), F.col("_b.s")).alias("im"))


def power(spectrum: DataFrame) -> DataFrame:
    return spectrum.withColumn("power", F.col("re") * F.col("re") + F.col("im") * F.col("im")).drop("re", "im")


def band(lo: int, hi: int) -> Column:
    """The power in bins lo to hi, both included (an aggregate)."""
    return F.sum(F.when(F.col("k").between(lo, hi), F.col("power")))


def peak(df: DataFrame, key: list[str], lo: int, hi: int) -> DataFrame:
    """The bin of greatest power in the band; the lowest of equals."""
    inside = df.filter(F.col("k").between(lo, hi))
    best = inside.groupBy(*key).agg(F.max(F.struct(F.col("power"), -F.col("k"))).alias("_b"))
    return best.select(*key, (-F.col("_b.col2")).alias("peak"))


def coherence(left: DataFrame, right: DataFrame, epoch: list[str], key: list[str]) -> DataFrame:
    """Weighted phase lag index and imaginary coherency per bin over epochs of two channels' spectra."""
    a = left.select(*epoch, "k", F.col("re").alias("ar"), F.col("im").alias("ai"))
    b = right.select(*epoch, "k", F.col("re").alias("br"), F.col("im").alias("bi"))
    both = a.join(b, [*epoch, "k"])
    im = F.col("ai") * F.col("br") - F.col("ar") * F.col("bi")
    pa = F.col("ar") ** 2 + F.col("ai") ** 2
    pb = F.col("br") ** 2 + F.col("bi") ** 2
    s = both.groupBy(*key, "k").agg(
        F.count("*").alias("n"), F.avg(im).alias("_im"), F.avg(F.abs(im)).alias("_abs"), F.avg(pa).alias("_pa"), F.avg(pb).alias("_pb")
    )
    return s.select(
        *key, "k", "n",
        F.when(F.col("_abs") > 0, F.abs("_im") / F.col("_abs")).alias("wpli"),
        F.when((F.col("_pa") > 0) & (F.col("_pb") > 0), F.col("_im") / F.sqrt(F.col("_pa") * F.col("_pb"))).alias("icoh"),
    )
