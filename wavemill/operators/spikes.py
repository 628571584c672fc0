"""Implausible values in measured series, judged by each series' own behaviour (problem 5).

Samples reach the tasks sorted by recording, channel and index after one shuffle; there, in Arrow batches, each
series gets a robust seasonal-trend decomposition, whose residuals pass a generalised ESD test, and separate
checks for constant runs and the amplifier's range. Series of more than ``HOT_ROWS`` rows go the same way in blocks:
the local steps run block by block, the medians and sums that a series needs are exact aggregations, and the
flags are those that one task would give.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from wavemill.functions import robust
from wavemill.functions.distributions import esd_limit
from wavemill.functions.lineage import cut
from wavemill.functions.quantiles import exact_median, exact_quantiles

#: A series of more rows is worked on in blocks of ``BLOCK_ROWS`` rows; that changes no result.
HOT_ROWS = 2_000_000
BLOCK_ROWS = 200_000
#: At least so many successive equal values are a stuck channel.
RUN = 10
#: So many times the scatter from the median is far off.
FAR = 10.0
#: No amplifier here can give more than so many µV.
RANGE_UV = 10_000.0
#: Decomposition: season in samples, window of the local regression; level of the ESD test.
PERIOD, WINDOW, ALPHA = 12, 31, 0.01

OUT = (
    "series boolean, rec_id long, channel int, idx long, value double, center double, scatter double, "
    "nv double, spike boolean, far boolean, stuck boolean, beyond boolean"
)
_TYPES = [pa.bool_(), pa.int64(), pa.int32(), pa.int64(), *[pa.float64()] * 4, *[pa.bool_()] * 4]
_NAMES = [c.split()[0] for c in OUT.split(", ")]
KEY = ["rec_id", "channel"]


def _runs(changes: np.ndarray, least: int) -> np.ndarray:
    """Marks the members of runs of at least ``least``; ``changes`` marks the first member of every run."""
    at = np.flatnonzero(changes)
    length = np.diff(np.append(at, len(changes)))
    return np.repeat(length >= least, length)


def _judge(rec, chan, idx, x, nv) -> pa.RecordBatch:
    """Flags of whole series; the arrays are sorted by series, index and value and of one length."""
    if len(x):
        new = np.ones(len(x), bool)
        new[1:] = (rec[1:] != rec[:-1]) | (chan[1:] != chan[:-1]) | (idx[1:] != idx[:-1]) | (x[1:] != x[:-1])
        rec, chan, idx, x, nv = (a[new] for a in (rec, chan, idx, x, nv))
    first = np.ones(len(x), bool)
    first[1:] = (rec[1:] != rec[:-1]) | (chan[1:] != chan[:-1])
    start = np.flatnonzero(first)
    n = np.diff(np.append(start, len(x)))
    series = np.repeat(np.arange(len(start)), n)
    center, mad = np.empty(len(start)), np.empty(len(start))
    spike = np.zeros(len(x), bool)
    todo = np.argsort(n, kind="stable")
    while len(todo):  # series of like length together, so that little is padded
        most = 500_000
        take = max(1, int(np.searchsorted(n[todo] * np.arange(1, len(todo) + 1), most, "right")))
        rows, todo = todo[:take], todo[take:]
        width = int(n[rows].max())
        place = np.arange(width)[None, :]
        there = place < n[rows][:, None]
        at = np.where(there, start[rows][:, None] + place, 0)
        v = np.where(there, x[at], np.nan)
        c = robust.row_median(np.sort(v, 1), n[rows])
        with np.errstate(invalid="ignore"):  # infinite values
            m = robust.row_median(np.sort(np.abs(v - c[:, None]), 1), n[rows])
        center[rows], mad[rows] = c, m
        plain = np.isfinite(c) & np.isfinite(m)
        finite = np.where(np.isfinite(v) & plain[:, None], v, np.nan)
        rest = robust.decompose(finite, (idx[at] % PERIOD).astype(np.int64), PERIOD, WINDOW, np.where(plain, c, 0.0), np.where(plain, m, 0.0))
        marks = robust.extreme_deviates(rest, np.where(plain, m, 0.0), ALPHA) | (np.isinf(v) & (plain & (m > 0))[:, None])
        spike[at[there]] = marks[there]
    middle = center[series]
    scatter = robust.MAD_SCALE * mad[series]
    with np.errstate(invalid="ignore"):
        far = (scatter > 0) & (np.abs(x - middle) >= FAR * scatter)
    steps = first.copy()
    steps[1:] |= x[1:] != x[:-1]
    stuck = _runs(steps, RUN) if len(x) else steps
    beyond = np.abs(x) * nv > RANGE_UV * 1000  # no unit: NaN, no case
    hit = spike | far | stuck | beyond
    s = start
    both = [
        (np.ones(len(s), bool), np.zeros(hit.sum(), bool)),
        (rec[s], rec[hit]),
        (chan[s], chan[hit]),
        (np.full(len(s), -1), idx[hit]),
        (np.full(len(s), np.nan), x[hit]),
        (middle[s], middle[hit]),
        (scatter[s], scatter[hit]),
        (nv[s], nv[hit]),
        *[(np.zeros(len(s), bool), f[hit]) for f in (spike, far, stuck, beyond)],
    ]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(p), t) for p, t in zip(both, _TYPES)], _NAMES)


def _columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted batches in, flags out; what may go on in the next batch is kept back. A recording's row with
    channel -1, which sorts first, holds the nanovolts of its unit."""
    kept: list[dict[str, np.ndarray]] = []
    waiting = 0

    def flush(parts: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
        c = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
        unit = c["channel"] < 0
        new = np.ones(len(unit), bool)
        new[1:] = c["rec_id"][1:] != c["rec_id"][:-1]
        of = np.cumsum(new) - 1
        nv = np.full(of[-1] + 1 if len(of) else 0, np.nan)
        nv[of[unit]] = c["data_uv"][unit]
        keep = ~unit & ~np.isnan(c["data_uv"])
        rec, chan, idx, x = (c[k][keep] for k in ("rec_id", "channel", "idx", "data_uv"))
        return _judge(rec, chan, idx, x, nv[of[keep]])

    for batch in batches:
        if not batch.num_rows:
            continue
        c = _columns(batch)
        rec = c["rec_id"]
        kept.append(c)
        waiting += len(rec)
        if waiting < 100_000 or rec[0] == rec[-1] and all(k["rec_id"][0] == rec[-1] for k in kept):
            continue
        last = rec[-1]
        at = int(np.searchsorted(rec, last))
        if at == 0:
            continue
        kept[-1] = {k: v[:at] for k, v in c.items()}
        yield flush(kept)
        kept = [{k: v[at:] for k, v in c.items()}]
        waiting = len(rec) - at
    if kept:
        yield flush(kept)


def _weight(distance: Column, mad: Column) -> Column:
    """``robust.bisquare`` as a column."""
    share = F.least(F.abs(distance) / (robust.CUT_OFF * mad), F.lit(1.0))
    return F.when(mad > 0, F.pow(1 - share * share, 2)).otherwise(1.0)


def _positions(rows: DataFrame) -> DataFrame:
    """Adds ``pos``, the place of each row in its series from 0, by spans of the index: no task sorts a series."""
    span = F.floor(F.col("idx") / BLOCK_ROWS)
    parts = rows.withColumn("_span", span)
    counts = parts.groupBy(*KEY, "_span").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*KEY).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    offset = counts.select(*KEY, "_span", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*KEY, "_span").orderBy("idx", "data_uv")
    placed = parts.join(offset, [*KEY, "_span"])
    return placed.withColumn("pos", F.col("_offset") + F.row_number().over(inside) - 1).drop("_span", "_offset")


def _in_blocks(df: DataFrame, added: dict[str, str], work) -> DataFrame:
    """Adds columns that ``work`` makes of each block's Arrow columns in the order of ``pos``; a block sees a margin
    on both sides, whose rows come out of their own block only."""
    margin = max(RUN, WINDOW)
    own = F.floor(F.col("pos") / BLOCK_ROWS)
    near = F.array_distinct(F.array(F.floor((F.col("pos") - margin) / BLOCK_ROWS), own, F.floor((F.col("pos") + margin) / BLOCK_ROWS)))
    spread = df.withColumn("_own", own).withColumn("_block", F.explode(near))
    names = df.columns

    def block(t: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        core = t.column("_own").to_numpy() == t.column("_block").to_numpy()
        new = work({c: t.column(c).to_numpy() for c in t.column_names})
        out = t.select(names)
        for k, v in new.items():
            out = out.append_column(k, v)
        return out.filter(pa.array(core))

    schema = df.schema
    for c, kind in added.items():
        schema = schema.add(c, kind)
    return spread.groupBy(*KEY, "_block").applyInArrow(block, schema)


def _trend_of(value: str, weight: str):
    def work(c: dict[str, np.ndarray]) -> dict[str, pa.Array]:
        return {"trend": pa.array(robust.local_trend(c[value][None], c[weight][None], WINDOW)[0])}

    return work


def _trend_and_runs(c: dict[str, np.ndarray]) -> dict[str, pa.Array]:
    x = c["data_uv"]
    steps = np.ones(len(x), bool)
    steps[1:] = x[1:] != x[:-1]
    return {**_trend_of("y", "w")(c), "stuck": pa.array(_runs(steps, RUN))}


def _with_season(df: DataFrame) -> DataFrame:
    """Adds ``season``, the weighted mean of ``y - trend`` of the row's phase, centred over the phases of its series."""
    sums = df.groupBy(*KEY, "phase").agg(F.sum(F.col("w") * (F.col("y") - F.col("trend"))).alias("_p"), F.sum("w").alias("_t"))
    mean = sums.filter("_t > 1e-9").select(*KEY, "phase", (F.col("_p") / F.col("_t")).alias("_mean"))
    centred = F.col("_mean") - F.avg("_mean").over(Window.partitionBy(*KEY))  # at most PERIOD rows a series
    season = cut(mean.select(*KEY, "phase", centred.alias("season")))
    return df.drop("season").join(season, [*KEY, "phase"], "left").withColumn("season", F.coalesce("season", F.lit(0.0)))


@F.pandas_udf(DoubleType())
def _esd_limits(n: pd.Series, i: pd.Series) -> pd.Series:
    return pd.Series([esd_limit(int(a), int(b), ALPHA) if a >= 8 and b <= a // 2 else float("inf") for a, b in zip(n, i)], dtype=float)


def _hot_flags(rows: DataFrame, units: DataFrame) -> DataFrame:
    """The flags of long series, by the steps of ``robust`` as aggregations and blocks."""
    rows = cut(_positions(rows.distinct()))
    middle = exact_quantiles(rows, KEY, "data_uv", [0.5], "_q").select(*KEY, "n", F.col("_q")[0].alias("center"))
    away = rows.join(cut(middle), KEY).withColumn("_d", F.abs(F.col("data_uv") - F.col("center")))
    mad = exact_median(away, KEY, "_d", "mad")
    nv = units.select("rec_id", F.col("unit_nv").cast("double").alias("nv"))
    plain = F.abs("center") < float("inf")
    stats = middle.join(mad, KEY).join(nv, "rec_id", "left").select(
        *KEY, "n", "center", F.when(F.abs("mad") < float("inf"), F.col("mad")).alias("mad"), F.coalesce("nv", F.lit(float("nan"))).alias("nv"), plain.alias("_plain")
    )
    stats = cut(stats)  # one row a long series
    y = F.col("data_uv") - F.col("center")
    finite = F.abs("data_uv") < float("inf")
    ready = (
        rows.join(stats, KEY)
        .withColumn("y", F.when(finite & F.col("_plain"), y).otherwise(0.0))
        .withColumn("w", F.when(finite & F.col("_plain"), _weight(F.col("y"), F.coalesce("mad", F.lit(0.0)))).otherwise(0.0))
        .withColumn("phase", F.pmod("idx", F.lit(PERIOD)))
        .select(*KEY, "idx", "data_uv", "pos", "phase", "y", "w")
    )
    one = _with_season(cut(_in_blocks(ready, {"trend": "double", "stuck": "boolean"}, _trend_and_runs)))
    one = cut(one.withColumn("rest", F.abs(F.col("y") - F.col("trend") - F.col("season"))))
    spread = cut(exact_median(one.filter(finite), KEY, "rest", "_spread"))
    two = one.join(spread, KEY, "left").withColumn("w", F.col("w") * _weight(F.col("rest"), F.coalesce("_spread", F.lit(0.0))))
    two = two.withColumn("v", F.col("y") - F.col("season")).select(*KEY, "idx", "data_uv", "pos", "phase", "y", "w", "v", "stuck")
    two = _with_season(cut(_in_blocks(two, {"trend": "double"}, _trend_of("v", "w"))))
    most = robust.FIT_SCATTERS * robust.MAD_SCALE * F.col("mad")
    fit = F.greatest(F.least(F.col("trend") + F.col("season"), most), -most)
    last = cut(two.join(stats, KEY).withColumn("rest", F.abs(F.col("y") - fit)))
    rest_mad = cut(exact_median(last.filter(finite), KEY, "rest", "_rest_mad"))
    scale = robust.MAD_SCALE * F.greatest(F.least(F.col("_rest_mad"), F.col("mad")), 1e-9 * F.col("mad"))
    counted = last.filter(finite).groupBy(*KEY).agg(F.count("*").alias("_m"))
    bounds = cut(counted.join(rest_mad, KEY).join(stats.select(*KEY, "mad"), KEY).select(*KEY, "_m", scale.alias("_scale"), _esd_limits("_m", F.floor(F.col("_m") / 2)).alias("_least")))
    r = F.col("rest") / F.col("_scale")
    top = cut(last.filter(finite).join(bounds, KEY).filter((F.col("_scale") > 0) & (r > F.col("_least"))).select(*KEY, "_m", r.alias("_r")))
    cell = F.floor(F.log("_r") * 512)  # ranks run cell by cell, greatest first
    cells = top.withColumn("_cell", cell)
    ahead = Window.partitionBy(*KEY).orderBy(F.desc("_cell")).rowsBetween(Window.unboundedPreceding, -1)
    offset = cells.groupBy(*KEY, "_cell").agg(F.count("*").alias("_c")).select(*KEY, "_cell", F.coalesce(F.sum("_c").over(ahead), F.lit(0)).alias("_o"))
    ranked = cells.join(offset, [*KEY, "_cell"]).withColumn("_i", F.col("_o") + F.row_number().over(Window.partitionBy(*KEY, "_cell").orderBy(F.desc("_r"))))
    outlying = ranked.filter(F.col("_r") > _esd_limits("_m", "_i")).groupBy(*KEY).agg(F.min("_r").alias("_cut"))
    cuts = cut(bounds.join(outlying, KEY).select(*KEY, "_scale", "_cut"))
    spike = F.coalesce(F.when(finite, r >= F.col("_cut")).otherwise(F.col("mad") > 0), F.lit(False))
    scatter = robust.MAD_SCALE * F.col("mad")
    far = F.coalesce((scatter > 0) & (F.abs(F.col("data_uv") - F.col("center")) >= FAR * scatter), F.lit(False))
    beyond = ~F.isnan("nv") & (F.abs("data_uv") * F.col("nv") > RANGE_UV * 1000)
    nan = F.lit(float("nan"))
    flagged = (
        last.join(cuts, KEY, "left")
        .select(F.lit(False).alias("series"), *KEY, "idx", F.col("data_uv").alias("value"), "center", scatter.alias("scatter"), "nv",
                spike.alias("spike"), far.alias("far"), "stuck", beyond.alias("beyond"))
        .filter("spike or far or stuck or beyond")
    )
    series = stats.select(
        F.lit(True).alias("series"), *KEY, F.lit(-1).cast("long").alias("idx"), nan.alias("value"), "center", scatter.alias("scatter"), "nv",
        *[F.lit(False).alias(c) for c in ("spike", "far", "stuck", "beyond")],
    )
    return flagged.unionByName(series)


def series_flags(samples: DataFrame, units: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Flagged samples, and one row (``series`` true, ``idx`` -1) with the statistics of every series.

    ``samples``: ``rec_id``, ``channel``, ``idx``, ``data_uv``; ``units``: ``rec_id`` and ``unit_nv``, the
    nanovolts of one recorded unit. Columns are those of ``OUT``. ``spike``: outside the ESD limits of the
    decomposition's residuals; ``far``: at least ``FAR`` scatters from the median; ``stuck``: in a run of at least
    ``RUN`` equal values; ``beyond``: outside the amplifier's range. Rows with a null key, null or NaN value are gaps
    and left out first; equal rows count once; a recording without unit has no ``beyond``; a series whose scatter is 0
    has no ``spike``; an empty table gives no row. Other columns are ignored.
    """
    rows = samples.select("rec_id", "channel", "idx", "data_uv").filter(
        "rec_id is not null and channel >= 0 and idx is not null and data_uv is not null and not isnan(data_uv)"
    )
    counts = rows.groupBy(*KEY).count().filter(F.col("count") > hot_rows).select(*KEY)
    hot = cut(counts)
    some = not hot.isEmpty()
    calm = rows.join(hot, KEY, "left_anti") if some else rows
    factor = units.select(
        "rec_id", F.lit(-1).alias("channel"), F.lit(-1).cast("long").alias("idx"), F.col("unit_nv").cast("double").alias("data_uv")
    ).filter("rec_id is not null and data_uv is not null")
    flags = (
        calm.unionByName(factor)
        .repartition("rec_id")
        .sortWithinPartitions("rec_id", "channel", "idx", "data_uv")
        .mapInArrow(_scan, OUT)
    )
    if not some:
        return flags
    return flags.unionByName(_hot_flags(rows.join(hot, KEY, "left_semi"), units))


def implausible(samples: DataFrame, units: DataFrame, features: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``rec_id``, ``channel``, ``idx`` of each sample that the ESD test calls a spike and that lies at least ``FAR``
    scatters from the median, or that is stuck or beyond the range, and, with ``idx`` -1, of each row of ``features``
    whose SD is at most a tenth or at least ten times its series' scatter.

    The fit of the decomposition stays within three scatters of the median, so that a sample ten away leaves a
    residual of seven, over the ESD limit of any series of up to 3·10⁹ values: the check on ``far`` only removes.
    """
    flags = cut(series_flags(samples, units, hot_rows))
    found = flags.filter("not series and (spike and far or stuck or beyond)").select("rec_id", "channel", "idx")
    scatter = flags.filter("series").select("rec_id", "channel", (F.col("scatter") * F.col("nv") / 1000).alias("uv"))
    odd = (
        features.select("rec_id", "channel", "sd_uv")
        .filter("not isnan(sd_uv)")
        .distinct()
        .join(scatter, ["rec_id", "channel"])
        .filter("uv > 0 and (sd_uv * 10 <= uv or sd_uv >= uv * 10)")
        .select("rec_id", "channel", F.lit(-1).cast("long").alias("idx"))
    )
    return found.unionByName(odd).distinct()
