"""Pooled two-channel autoregression from merged triangular factors, and stored equations.

The lag design of a stretch is never stored: tasks build it block by block and keep one triangular factor of it for each
fold, a matrix of fixed size that holds all that least squares needs. Factors are merged pairwise, first among tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavemill.functions import codes
from wavemill.functions.lineage import cut
from wavemill.operators import blocks as B

KEY = ["rec_id", "channel"]

#: What a stored equation may consist of besides its column names.
_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][-+]?\d+)?)|([A-Za-z_]\w*)|([-+*/(),]))")
_CALLS = ("tanh", "exp")


def equation(text: str, columns: dict[str, str]) -> Column:
    """A stored equation as a column: ``+ - * /``, brackets, numbers, tanh, exp and the given names.

    Any other text raises ``ValueError``. A division by 0 follows the session's ANSI setting.
    """
    out, at = [], 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"not allowed in an equation: {text[at:]!r}")
        number, name, mark = m.groups()
        if name and name not in _CALLS and name not in columns:
            raise ValueError(f"unknown name {name!r}")
        out.append(f"{number}D" if number else f"`{columns[name]}`" if name in columns else name or mark)
        at = m.end()
    return F.expr(" ".join(out))


def standardised(samples: DataFrame) -> DataFrame:
    """Clean samples with every series brought to mean 0 and SD 1: ``z``; constant series are left out."""
    s = B.clean_samples(samples)
    stats = s.groupBy(*KEY).agg(F.avg("x").alias("_m"), F.stddev_samp("x").alias("_s")).filter("_s > 0")
    return s.join(stats, KEY).select(*KEY, "idx", ((F.col("x") - F.col("_m")) / F.col("_s")).alias("z"))


#: Samples of a block of the lag design, and first-stage merges of a fold's factors.
DESIGN_BLOCK, MERGES = 2048, 16


def pairs(samples: DataFrame) -> DataFrame:
    """``rec_id``, ``idx``, ``a``, ``b``: both channels' standardised values where both are there, channel 0 first.
    An index with several values of a channel has their greatest."""
    at = lambda c: F.max(F.when(F.col("channel") == c, F.col("z")))
    both = standardised(samples).groupBy("rec_id", "idx").agg(at(0).alias("a"), at(1).alias("b"))
    return both.filter("a is not null and b is not null")


def subject_folds(recordings: DataFrame, folds: int) -> DataFrame:
    """``rec_id`` and ``fold``: all recordings of a subject share one; recordings without a readable subject are folds
    by their own number."""
    n = F.coalesce(codes.subject_number(F.col("subject")), F.col("rec_id"))
    return recordings.groupBy("rec_id").agg(F.min(n).alias("_s")).select("rec_id", F.pmod(F.col("_s") * 7919 % 100003, F.lit(folds)).cast("int").alias("fold"))


def design_blocks(samples: DataFrame, recordings: DataFrame, most: int, folds: int) -> DataFrame:
    """Stretches without a gap as blocks of arrays: ``rec_id``, ``fold``, ``a`` and ``b`` with up to ``most`` values
    before the block. Blocks without a row of the design are left out."""
    rows = B.segmented(pairs(samples), ["rec_id"])
    pos = F.col("idx") - F.col("segment")
    own = F.floor(pos / DESIGN_BLOCK)
    near = F.array_distinct(F.array(own, F.floor((pos + most) / DESIGN_BLOCK)))
    spread = rows.withColumn("_block", F.explode(near))
    packed = spread.groupBy("rec_id", "segment", "_block").agg(F.array_sort(F.collect_list(F.struct("idx", "a", "b"))).alias("_s"))
    full = packed.filter(F.size("_s") > most).join(subject_folds(recordings, folds), "rec_id")
    return full.select("rec_id", "fold", F.transform("_s", lambda s: s["a"]).alias("a"), F.transform("_s", lambda s: s["b"]).alias("b"))


def lag_matrix(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Rows 1, a and b one step before, …, ``most`` steps before, and a and b themselves."""
    z = np.stack([a, b], 1)
    n = len(z) - most
    lags = [z[most - k : most - k + n] for k in range(1, most + 1)]
    return np.hstack([np.ones((n, 1)), *lags, z[most:]])


def _factor(blocks: list[np.ndarray]) -> np.ndarray:
    r = np.linalg.qr(np.vstack(blocks), mode="r")
    return np.vstack([r, np.zeros((r.shape[1] - len(r), r.shape[1]))])  # of fewer rows than columns: zeros below


def factors(blocks: DataFrame, most: int) -> dict[int, np.ndarray]:
    """One triangular factor of the lag design for each fold; only these few small matrices reach the driver."""
    size = 2 * most + 3

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}
        waiting: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for fold, a, b in zip(batch.column("fold").to_pylist(), batch.column("a"), batch.column("b")):
                part = waiting.setdefault(fold, [kept[fold]] if fold in kept else [])
                part.append(lag_matrix(np.array(a.as_py(), float), np.array(b.as_py(), float), most))
                if sum(map(len, part)) > 4 * DESIGN_BLOCK:
                    kept[fold] = _factor(waiting.pop(fold))
        for fold, part in waiting.items():
            kept[fold] = _factor(part)
        yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.int32()), pa.array([r.ravel() for r in kept.values()], pa.list_(pa.float64()))], ["fold", "r"])

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        r = _factor([np.array(v).reshape(size, size) for v in rows["r"]])
        return pd.DataFrame({"fold": rows["fold"].iloc[:1].to_numpy(), "r": [r.ravel()]})

    one = blocks.select("fold", "a", "b").mapInArrow(first, "fold int, r array<double>")
    two = one.groupBy("fold", (F.spark_partition_id() % MERGES).alias("_m")).applyInPandas(merged, "fold int, r array<double>")
    found = two.groupBy("fold").applyInPandas(merged, "fold int, r array<double>").collect()
    return {r.fold: np.array(r.r).reshape(size, size) for r in found}


def coefficients(r: np.ndarray, order: int) -> np.ndarray:
    """The least-squares coefficients (1, then both channels' lags) of an order, from a factor."""
    return np.linalg.lstsq(r[:, : 2 * order + 1], r[:, -2:], rcond=None)[0]


def _errors(parts: dict[int, np.ndarray], most: int) -> tuple[dict[int, float], np.ndarray]:
    whole = _factor(list(parts.values()))
    n = sum(float(np.square(r[:, 0]).sum()) for r in parts.values())  # rows: the column of ones
    total = dict.fromkeys(range(1, most + 1), 0.0)
    for fold, held in parts.items():
        rest = _factor([r for k, r in parts.items() if k != fold])
        for p in total:
            total[p] += float(np.square(held[:, -2:] - held[:, : 2 * p + 1] @ coefficients(rest, p)).sum())
    return {p: e / (2 * n) for p, e in total.items()}, whole


def cross_validated_order(samples: DataFrame, recordings: DataFrame, most: int = 32, folds: int = 5) -> DataFrame:
    """``p``, ``mse`` and ``chosen`` for each order up to ``most`` of the autoregression of both channels: folds of
    subjects, mean squared one-step error over rows and channels; ties go to the smaller order. All orders use the same
    rows. With fewer than two folds with rows there is no result. The factors are computed when this is called.
    """
    spark = samples.sparkSession
    parts = factors(design_blocks(samples, recordings, most, folds), most)
    if len(parts) < 2:
        return spark.createDataFrame([], "p int, mse double, chosen boolean")
    mse, _ = _errors(parts, most)
    best = min(mse, key=lambda p: (mse[p], p))
    return spark.createDataFrame([(p, round(e, 9), p == best) for p, e in mse.items()], "p int, mse double, chosen boolean")


def scores(samples: DataFrame, recordings: DataFrame, most: int = 32, folds: int = 5) -> DataFrame:
    """``rec_id``, ``mse``, ``n``: one-step squared error of both channels under the coefficients of the chosen order
    fitted to all recordings. Recordings without a stretch of more than ``most`` samples have no row."""
    kind = "rec_id long, sse double, rows long"
    blocks = cut(design_blocks(samples, recordings, most, folds))
    parts = factors(blocks, most)
    if len(parts) < 2:
        return samples.sparkSession.createDataFrame([], "rec_id long, mse double, n long")
    mse, whole = _errors(parts, most)
    order = min(mse, key=lambda p: (mse[p], p))
    coef = coefficients(whole, order)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sse, n = [], []
            for a, b in zip(batch.column("a"), batch.column("b")):
                x = lag_matrix(np.array(a.as_py(), float), np.array(b.as_py(), float), most)
                sse.append(float(np.square(x[:, -2:] - x[:, : 2 * order + 1] @ coef).sum()))
                n.append(len(x))
            yield pa.RecordBatch.from_arrays([batch.column("rec_id"), pa.array(sse, pa.float64()), pa.array(n, pa.int64())], ["rec_id", "sse", "rows"])

    each = blocks.select("rec_id", "a", "b").mapInArrow(work, kind)
    return each.groupBy("rec_id").agg((F.sum("sse") / (2 * F.sum("rows"))).alias("mse"), F.sum("rows").alias("n"))
