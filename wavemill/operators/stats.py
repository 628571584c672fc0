"""Statistics over groups, resampling included. Randomness is a fixed function of the seed and the position."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavemill.functions.distributions import beta_quantile, f_quantile
from wavemill.functions.quantiles import same_key
from wavemill.functions.ranking import value_buckets

MAD_SCALE = 1.4826


def robust_sd(df: DataFrame, key: list[str], x: str) -> DataFrame:
    """``center`` (median) and ``robust_sd`` (1.4826 × median absolute deviation) of each group."""
    mid = df.groupBy(*key).agg(F.median(x).alias("center"))
    near = df.join(mid, key).withColumn("_d", F.abs(F.col(x) - F.col("center")))
    return near.groupBy(*key).agg(F.first("center").alias("center"), (F.median("_d") * MAD_SCALE).alias("robust_sd"))


def rescale(df: DataFrame, key: list[str], x: str, mu: float, sigma: float, name: str) -> DataFrame:
    """``mu + sigma·(x − mean)/sd`` with the group's own mean and sample SD; null where the SD is 0 or null."""
    stats = df.groupBy(*key).agg(F.avg(x).alias("_m"), F.stddev_samp(x).alias("_s"))
    z = F.when(F.col("_s") > 0, mu + sigma * (F.col(x) - F.col("_m")) / F.col("_s"))
    return df.join(stats, key).withColumn(name, z).drop("_m", "_s")


def zscores(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds ``z_<column>``: population z-scores over the whole table; null for a constant column. One row of
    means and SDs goes over the driver."""
    stats = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    z = {c: (F.col(c) - F.lit(stats[f"m_{c}"])) / F.lit(stats[f"s_{c}"]) if stats[f"s_{c}"] else F.lit(None).cast("double") for c in columns}
    return df.withColumns({f"z_{c}": e for c, e in z.items()})


def holm(df: DataFrame, key: list[str], p: str, tie: str) -> DataFrame:
    """Holm's step-down adjusted p-values of each family, of any size: ``p_holm``. Rows without a p-value are left out.

    A task sorts one range of p-values of a family; ranks and the greatest step so far are carried from range to range.
    """
    rows = value_buckets(df, key, p)
    inside = Window.partitionBy(*key, "_bucket").orderBy(p, tie)
    v = Window.partitionBy(*key).orderBy("_bucket")
    earlier = v.rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*key, "_bucket").agg(F.count("*").alias("_n"))
    counts = counts.withColumns({"_before": F.coalesce(F.sum("_n").over(earlier), F.lit(0)), "_m": F.sum("_n").over(Window.partitionBy(*key))})
    at = counts.select(*[F.col(c).alias(f"_o_{c}") for c in [*key, "_bucket"]], "_before", "_m")
    step = (F.col("_m") - F.col("_before") - F.row_number().over(inside) + 1) * F.col(p)
    stepped = rows.join(at, same_key([*key, "_bucket"], "_o_")).withColumn("_step", step)
    most = stepped.groupBy(*key, "_bucket").agg(F.max("_step").alias("_most"))
    most = most.select(*[F.col(c).alias(f"_q_{c}") for c in [*key, "_bucket"]], F.max("_most").over(earlier).alias("_earlier"))
    upto = F.greatest(F.max("_step").over(inside.rowsBetween(Window.unboundedPreceding, 0)), F.col("_earlier"))
    out = stepped.join(most, same_key([*key, "_bucket"], "_q_")).withColumn("p_holm", F.least(F.lit(1.0), upto))
    return out.select(*df.columns, "p_holm")


def icc31(df: DataFrame, key: list[str], subject: str, a: str, b: str) -> DataFrame:
    """Consistency of two sessions, ICC(3,1) = (MSR − MSE)/(MSR + MSE), from sums alone; subjects need both.

    Null where fewer than two subjects are left or the denominator is 0.
    """
    full = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    s = full.groupBy(*key).agg(F.count("*").alias("n"), *[F.sum(e).alias(f"_{c}") for c, e in _icc_terms(a, b).items()])
    return s.select(*key, "n", _icc("n").alias("icc"))


def _icc_terms(a: str, b: str) -> dict[str, Column]:
    """What is summed for ICC(3,1): of both sessions the values, the squares of their sum and the sum of their squares."""
    x, y = F.col(a), F.col(b)
    return {"a": x, "b": y, "r": F.pow(x + y, 2), "q": x * x + y * y}


def _icc(n: str) -> Column:
    """ICC(3,1) from those sums, ``_a``, ``_b``, ``_r`` and ``_q``, over ``n`` subjects; null where ``icc31`` says so."""
    n, total = F.col(n), F.col("_a") + F.col("_b")
    correction = total * total / (2 * n)
    ssr, ssc = F.col("_r") / 2 - correction, (F.col("_a") ** 2 + F.col("_b") ** 2) / n - correction
    others = F.when(n > 1, n - 1)
    msr, mse = ssr / others, (F.col("_q") - correction - ssr - ssc) / others
    return F.when(msr + mse != 0, (msr - mse) / (msr + mse))


def resampled_icc(df: DataFrame, subject: str, a: str, b: str, times: int) -> DataFrame:
    """``icc``, as in ``icc31``, of each of ``times`` bootstrap resamples of the subjects with both sessions."""
    full = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    terms = {f"_{c}": e for c, e in _icc_terms(a, b).items()}
    sums = resampled_sums(full.select(subject, *[e.alias(c) for c, e in terms.items()]), subject, list(terms), times)
    return sums.select("b", _icc("n").alias("icc"))


def icc_interval(df: DataFrame, n: str, icc: str, level: float = 0.95) -> DataFrame:
    """Adds the F-based limits ``low`` and ``high`` of ICC(3,1) over two sessions; null for fewer than two
    subjects or an ICC of 1 or more. Rows are groups: one small function a row."""
    tail = 1 - (1 - level) / 2

    @F.pandas_udf("low double, high double")
    def limits(count: pd.Series, value: pd.Series) -> pd.DataFrame:
        rows = []
        for m, r in zip(count, value):
            if m is None or m < 2 or r is None or not abs(r) < 1:
                rows.append((None, None))
                continue
            f, q = (1 + r) / (1 - r), f_quantile(tail, m - 1, m - 1)
            rows.append(((f / q - 1) / (f / q + 1), (f * q - 1) / (f * q + 1)))
        return pd.DataFrame(rows, columns=["low", "high"], dtype="float64")

    return df.withColumn("_l", limits(F.col(n), F.col(icc))).select(*df.columns, "_l.low", "_l.high")


#: Slots drawn at a time; their numbers stay in a core's cache.
SLOTS = 16_384


def drawn(b: int, slot: np.ndarray, n: int) -> np.ndarray:
    """The indices, 0 to n − 1, that resample ``b`` draws into the slots: whole-number mixing, the same anywhere."""
    m = 2147483647
    h = ((b * 48271 + slot * 69621 + 12345) % m * 16807 + b) % m
    for shift, times in ((15, 48271), (13, 69621), (16, 16807)):  # without the shifts the draws of a resample hang together
        h = (h ^ (h >> shift)) * times % m
    return h % n


def _draws(b: int, n: int) -> Iterator[np.ndarray]:
    """The indices that resample ``b`` draws, in pieces."""
    for lo in range(0, n, SLOTS):
        yield drawn(b, np.arange(lo, min(lo + SLOTS, n)), n)


def _by_resample(
    values: DataFrame, order: str, columns: list[Column | str], b: int, schema: T.StructType, work: Callable[[pa.Table, range], Iterator[pa.RecordBatch]]
) -> DataFrame:
    """What ``work`` gives for ``columns``, sorted by the unique ``order`` (null last), and some of the resamples 0 to b − 1.

    A shuffle brings all rows to every task, which makes its share of the resamples: neither draws nor rows are joined,
    broadcast or seen by the driver. No resample depends on how they are shared out. The work is b × rows.
    """
    parts = min(values.sparkSession.sparkContext.defaultParallelism * 2, b)
    sent = values.select(F.col(order).alias("_order"), *columns).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (got := list(batches)):
            return
        held = pa.Table.from_batches(got)
        for part in pc.unique(held.column("_part")).to_pylist():
            mine = held.filter(pc.equal(held.column("_part"), part)).drop_columns("_part")
            mine = mine.take(pc.sort_indices(mine.column("_order"), null_placement="at_end")).drop_columns("_order")
            yield from work(mine.combine_chunks(), range(part, b, parts))

    return sent.repartitionById(parts, F.col("_part")).mapInArrow(each, schema)


def resamples(values: DataFrame, order: str, columns: list[str], b: int) -> DataFrame:
    """``b`` bootstrap resamples of the rows of a table: columns ``b`` and ``columns``, a row for each draw."""
    schema = T.StructType([T.StructField("b", T.IntegerType()), *[values.schema[c] for c in columns]])

    def work(rows: pa.Table, some: range) -> Iterator[pa.RecordBatch]:
        for k in some:
            for at in _draws(k, rows.num_rows):
                hit = rows.take(pa.array(at)).combine_chunks()
                yield from hit.add_column(0, "b", pa.array(np.full(len(at), k, np.int32))).to_batches()

    return _by_resample(values, order, columns, b, schema, work)


def resampled_sums(values: DataFrame, order: str, columns: list[str], b: int) -> DataFrame:
    """Sums over each of ``b`` bootstrap resamples: ``b``, ``n`` (rows drawn) and of every column its sum as a double
    (null without a value) and ``n_<column>``, the number of values summed."""
    schema = T.StructType().add("b", "integer").add("n", "long")
    for c in columns:
        schema = schema.add(c, "double").add(f"n_{c}", "long")

    def work(rows: pa.Table, some: range) -> Iterator[pa.RecordBatch]:
        n = rows.num_rows
        there = [c.is_valid().to_numpy() if c.null_count else None for c in rows.columns]
        numbers = [c.fill_null(0.0).to_numpy() for c in rows.columns]
        sums, counts = np.zeros((len(columns), len(some))), np.full((len(columns), len(some)), n)
        for j, k in enumerate(some):
            for at in _draws(k, n):
                for i, (x, valid) in enumerate(zip(numbers, there)):
                    sums[i, j] += x.take(at).sum()
                    if valid is not None:
                        counts[i, j] -= len(at) - np.count_nonzero(valid.take(at))
        out = [pa.array(some, pa.int32()), pa.array(np.full(len(some), n))]
        for x, c in zip(sums, counts):
            out += [pa.array(x, mask=c == 0), pa.array(c)]
        yield pa.RecordBatch.from_arrays(out, schema.names)

    return _by_resample(values, order, [F.col(c).cast("double").alias(c) for c in columns], b, schema, work)


def binomial_interval(df: DataFrame, hits: str, n: str, level: float = 0.95) -> DataFrame:
    """Adds the two-sided Clopper–Pearson limits ``low`` and ``high``; null for no cases. Rows are groups, of
    which there are few: one small function a row."""
    tail = (1 - level) / 2

    @F.pandas_udf("low double, high double")
    def limits(k: pd.Series, m: pd.Series) -> pd.DataFrame:
        rows = []
        for x, t in zip(k, m):
            if not t:
                rows.append((None, None))
                continue
            low = 0.0 if x == 0 else beta_quantile(tail, x, t - x + 1)
            rows.append((low, 1.0 if x == t else beta_quantile(1 - tail, x + 1, t - x)))
        return pd.DataFrame(rows, columns=["low", "high"], dtype="float64")

    return df.withColumn("_l", limits(F.col(hits), F.col(n))).select(*df.columns, "_l.low", "_l.high")
