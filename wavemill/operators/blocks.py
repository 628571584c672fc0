"""Blocks, runs, masks and neighbourhoods along the sample axis.

Inputs are long tables: one row per sample with the series' key columns, an integer index and a value. Null keys
form a series of their own; null values are left out by each aggregate as SQL does; empty tables give no rows.
Windows over samples work on spans of a series, whose few numbers are carried on; windows over a whole series work on
blocks, of which there are a block length fewer than samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sent_samples(samples: DataFrame) -> DataFrame:
    """Samples with a value, as often as they were sent: ``rec_id``, ``channel``, ``idx``, ``x``."""
    return samples.select("rec_id", "channel", "idx", F.col("data_uv").alias("x")).filter("x is not null and not isnan(x)")


def clean_samples(samples: DataFrame) -> DataFrame:
    """Distinct samples with a value: ``rec_id``, ``channel``, ``idx``, ``x``."""
    return sent_samples(samples).distinct()


def segmented(df: DataFrame, key: list[str], idx: str = "idx", width: int = 4096, name: str = "segment", repeated: bool = False) -> DataFrame:
    """Adds the index at which each row's stretch without a gap begins.

    Rows are looked at in spans of ``width`` indices, of which each hands on its last start: no task sorts a series,
    however long. An index that occurs twice is no gap. Where rows are ``repeated``, equal ones count once, without a
    shuffle of their own.
    """
    # one column holds series and span, so that windows, counts and the join share one shuffle, null keys among them
    parts = df.withColumn("_at", F.struct(*key, F.floor(F.col(idx) / width).alias("_span"))).repartition("_at")
    parts = parts.distinct() if repeated else parts
    w = Window.partitionBy("_at").orderBy(idx)
    gap = F.when(F.col(idx) - F.lag(idx).over(w) > 1, F.col(idx))
    marked = parts.withColumn("_gap", gap).withColumn("_last", F.max("_gap").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    spans = marked.groupBy("_at").agg(F.min(idx).alias("_lo"), F.max(idx).alias("_hi"), F.max("_gap").alias("_g"))
    v = Window.partitionBy(*[F.col(f"_at.{k}") for k in key]).orderBy("_at._span")
    first = F.when(F.coalesce(F.col("_lo") - F.lag("_hi").over(v) > 1, F.lit(True)), F.col("_lo"))
    spans = spans.withColumn("_first", first).select(
        "_at", F.greatest(F.max("_first").over(v.rowsBetween(Window.unboundedPreceding, 0)), F.max("_g").over(v.rowsBetween(Window.unboundedPreceding, -1))).alias("_begin")
    )
    return marked.join(spans, "_at").withColumn(name, F.coalesce("_last", "_begin")).select(*df.columns, name)


def tumbling(df: DataFrame, key: list[str], size: int, idx: str = "idx", x: str = "x", repeated: bool = False) -> DataFrame:
    """Complete blocks of ``size`` samples, counted from the start of each stretch without a gap: ``segment`` (its first
    index), ``block``, ``rms``, ``ptp``, ``mean``, ``n``. Partial ones are dropped."""
    block = F.floor((F.col(idx) - F.col("segment")) / size)
    return (
        segmented(df, key, idx, repeated=repeated)
        .groupBy(*key, "segment", block.alias("block"))
        .agg(
            F.sqrt(F.avg(F.col(x) * F.col(x))).alias("rms"),
            (F.max(x) - F.min(x)).alias("ptp"),
            F.avg(x).alias("mean"),
            F.count(x).alias("n"),
        )
        .filter(F.col("n") == size)
    )


def runs(df: DataFrame, key: list[str], order: str, flag: str, least: int = 1) -> DataFrame:
    """Maximal runs of successive ``order`` values with ``flag`` true: ``start``, ``stop`` (exclusive), ``n``.

    A gap in ``order`` ends a run.
    """
    w = Window.partitionBy(*key).orderBy(order)
    marked = df.filter(F.col(flag)).withColumn("_g", F.col(order) - F.row_number().over(w))
    return (
        marked.groupBy(*key, "_g")
        .agg(F.min(order).alias("start"), (F.max(order) + 1).alias("stop"), F.count("*").alias("n"))
        .filter(F.col("n") >= least)
        .drop("_g")
    )


def islands(df: DataFrame, key: list[str], order: str, value: str, width: int = 4096) -> DataFrame:
    """Runs of successive rows with equal ``value`` (null among them) whatever the gaps: ``value``, ``start`` (its first
    ``order`` value) and ``n``. Rows are ordered by a unique index and looked at in spans, over whose edges runs carry."""
    parts = df.select(*key, order, value).withColumn("_span", F.floor(F.col(order) / width))
    w = Window.partitionBy(*key, "_span").orderBy(order)
    new = ~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)
    marked = parts.withColumn("_new", new.cast("int")).withColumn("_g", F.sum("_new").over(w))
    inner = marked.groupBy(*key, "_span", "_g", value).agg(F.min(order).alias("start"), F.count("*").alias("n"))
    # of each span only the first and the last run can go on over its edges
    v = Window.partitionBy(*key, "_span").orderBy("_g")
    edge = (F.row_number().over(v) == 1) | (F.lead("_g").over(v).isNull())
    ends = inner.withColumn("_edge", edge)
    u = Window.partitionBy(*key).orderBy("start")
    touching = (F.col(value).eqNullSafe(F.lag(value).over(u))) & (F.lag("_span").over(u) != F.col("_span"))
    first = ends.filter("_edge").withColumn("_begins", F.when(touching, 0).otherwise(1)).withColumn("_run", F.sum("_begins").over(u))
    joined = first.groupBy(*key, "_run", value).agg(F.min("start").alias("start"), F.sum("n").alias("n")).select(*key, value, "start", "n")
    return joined.unionByName(ends.filter("not _edge").select(*key, value, "start", "n"))


def dilate(df: DataFrame, key: list[str], order: str, flag: str, pad: int, name: str = "dilated") -> DataFrame:
    """True where any row within ``pad`` index steps is flagged. Flagged rows mark their neighbours in one
    aggregation by key and index; no task sorts a series."""
    reach = F.when(F.col(flag), F.sequence(F.col(order) - pad, F.col(order) + pad))
    marks = df.select(*key, F.explode(reach).alias(order), F.lit(True).alias("_m"), F.lit(False).alias("_own"))
    own = df.select(*key, order, F.lit(False).alias("_m"), F.lit(True).alias("_own"))
    both = own.unionByName(marks).groupBy(*key, order).agg(F.bool_or("_m").alias(name), F.bool_or("_own").alias("_own"))
    return both.filter("_own").drop("_own")


def flag_distance(df: DataFrame, key: list[str], order: str, flag: str, name: str = "distance") -> DataFrame:
    """Index steps to the nearest flagged row of the series; null where none is flagged."""
    at = F.when(F.col(flag), F.col(order))
    back = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*key).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    near = F.least(F.col(order) - F.last(at, True).over(back), F.first(at, True).over(ahead) - F.col(order))
    return df.withColumn(name, near)


def raised_cosine(distance: Column, pad: int) -> Column:
    """1 at a flag, falling to 0 beyond ``pad`` steps; 0 without a flag."""
    return F.when(distance <= pad, 0.5 * (1 + F.cos(F.lit(3.141592653589793) * distance / (pad + 1)))).otherwise(0.0)


def placed(df: DataFrame, key: list[str], order: str, width: int = 4096, name: str = "place") -> DataFrame:
    """Numbers the rows of each series from 1 in the order of a unique index, span by span: no task sorts a series."""
    parts = df.withColumn("_span", F.floor(F.col(order) / width))
    counts = parts.groupBy(*key, "_span").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*key).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(k).alias(f"_k_{k}") for k in [*key, "_span"]], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    on = F.lit(True)
    for k in [*key, "_span"]:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    inside = F.row_number().over(Window.partitionBy(*key, "_span").orderBy(order))
    return parts.join(offsets, on).withColumn(name, F.col("_o") + inside).select(*df.columns, name)


def scoring_mask(df: DataFrame, key: list[str], order: str, skip_segment: int, skip_series: int) -> DataFrame:
    """Adds ``segment`` (the index at which the row's stretch without a gap begins) and ``kept``: beyond the first
    samples of both the segment and the series. The index is unique in a series."""
    seg = placed(segmented(df, key, order), key, order, name="_n")
    kept = (F.col(order) - F.col("segment") >= skip_segment) & (F.col("_n") > skip_series)
    return seg.withColumn("kept", kept).drop("_n")


def dwell(df: DataFrame, key: list[str], order: str, flag: str, least: int) -> DataFrame:
    """The first index of each series at which ``flag`` has held for ``least`` successive rows: ``fired``. The index is
    unique in a series."""
    rows = placed(df.select(*key, order, flag), key, order, name="_i")
    held = islands(rows, key, "_i", flag).filter(F.col(flag) & (F.col("n") >= least))
    at = held.groupBy(*key).agg((F.min("start") + (least - 1)).alias("_i"))
    on = F.col("_i") == F.col("_at")
    for k in key:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    ends = at.select(*[F.col(k).alias(f"_k_{k}") for k in key], F.col("_i").alias("_at"))
    return rows.join(ends, on).select(*key, F.col(order).alias("fired"))


def first_n(df: DataFrame, key: list[str], draw: list[str], n: int, eligible: Column) -> DataFrame:
    """The first ``n`` eligible rows of each key in the order of ``draw``."""
    w = Window.partitionBy(*key).orderBy(*draw)
    return df.filter(eligible).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def lagged(df: DataFrame, key: list[str], order: str, x: str, lags: list[int], width: int = 4096) -> DataFrame:
    """Adds ``x_k``, the value ``k`` index steps earlier, for each lag (negative: later, ``x_m1``). A gap in the
    index gives null, so that no lag crosses it. The index is unique within a key.

    A series is cut into spans of ``width`` indices, to which the rows just beyond their edges are copied: every row is
    shuffled once, and no task sorts more than a span.
    """
    far = [0, max(lags), min(lags)]
    span = F.floor(F.col(order) / width)
    near = F.array_distinct(F.array(*[F.floor((F.col(order) + k) / width) for k in far]))
    w = Window.partitionBy(*key, "_span").orderBy(order)
    wide = df.withColumn("_span", F.explode(near))
    for k in lags:
        value = F.when(F.lag(order, k).over(w) == F.col(order) - k, F.lag(x, k).over(w)) if k else F.col(x)
        wide = wide.withColumn(f"{x}_{k}".replace("-", "m"), value)
    return wide.filter(F.col("_span") == span).drop("_span")


def fractional_lag(df: DataFrame, key: list[str], order: str, x: str, delay: float, name: str) -> DataFrame:
    """The value ``delay`` steps earlier, linear between its two neighbours; null where one is missing."""
    n = int(delay)
    part = delay - n
    both = lagged(df, key, order, x, [n, n + 1])
    return both.withColumn(name, (1 - part) * F.col(f"{x}_{n}") + part * F.col(f"{x}_{n + 1}")).drop(f"{x}_{n}", f"{x}_{n + 1}")


def fir(df: DataFrame, key: list[str], order: str, x: str, kernels: dict[str, dict[int, float]]) -> DataFrame:
    """Weighted sums of neighbours, for each name its taps (lag → weight), of one gathering of neighbours; null where the
    kernel does not fit."""
    lags = sorted({k for taps in kernels.values() for k in taps})
    wide = lagged(df, key, order, x, lags)
    cols = {k: f"{x}_{k}".replace("-", "m") for k in lags}
    for name, taps in kernels.items():
        total = None
        for k, c in taps.items():
            total = F.lit(c) * F.col(cols[k]) if total is None else total + F.lit(c) * F.col(cols[k])
        wide = wide.withColumn(name, total)
    return wide.drop(*cols.values())


def trapezoid(df: DataFrame, key: list[str], order: str, x: str, name: str = "area") -> DataFrame:
    """Cumulative integral over successive rows; 0 at the first."""
    w = Window.partitionBy(*key).orderBy(order)
    step = F.coalesce((F.col(x) + F.lag(x).over(w)) / 2, F.lit(0.0))
    return df.withColumn("_s", step).withColumn(name, F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def starts(df: DataFrame, key: list[str], n: str, size: int, step: int) -> DataFrame:
    """Start positions of windows of ``size`` every ``step`` rows that fit into a series of ``n`` rows."""
    last = F.col(n) - size
    at = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(step)))
    return df.select(*key, F.explode(at).alias("start"))
