"""Queries over the sample axis: blocks, runs, masks, lags, spectra. ``samples`` is the signal table; a series is a
recording's channel."""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavemill.functions.quantiles import exact_quantiles
from wavemill.operators import blocks as B
from wavemill.operators import filters as FI
from wavemill.operators import rules as R
from wavemill.operators import spectral as P
from wavemill.operators import states as ST
from wavemill.operators import stats as S
from wavemill.operators import units as U
from wavemill.plans.registry import Registry, Tables

REG = Registry()
KEY = ["rec_id", "channel"]
SEG = [*KEY, "segment"]
SIZE = 16

_S = (
    "with s as (select distinct rec_id, channel, idx, data_uv as x from samples "
    "where data_uv is not null and not isnan(data_uv))"
)
_SEG = _S + (
    ", i as (select *, idx - dense_rank() over (partition by rec_id, channel order by idx) as island from s), "
    "g0 as (select rec_id, channel, idx, x, min(idx) over (partition by rec_id, channel, island) as segment from i)"
)
_BLK = _SEG + (
    f", blk as (select rec_id, channel, segment, (idx - segment) // {SIZE} as block, sqrt(avg(x * x)) as rms, max(x) - min(x) as ptp, avg(x) as mean, count(*) as n "
    f"from g0 group by all having count(*) = {SIZE})"
)
_FLAG = _BLK + (
    ", med as (select rec_id, channel, median(ptp) as m from blk group by all)"
    ", f as (select blk.rec_id, blk.channel, segment, block, ptp, rms, m, ptp > 2 * m as hot, ptp = 0 as flat, rms > 10 * m as loud from blk join med using (rec_id, channel))"
)


def _clean(t: Tables) -> DataFrame:
    return B.clean_samples(t.samples)


def _blocks(t: Tables) -> DataFrame:
    return B.tumbling(B.sent_samples(t.samples), KEY, SIZE, repeated=True)


def _flags(t: Tables) -> DataFrame:
    blk = _blocks(t)
    med = blk.groupBy(*KEY).agg(F.median("ptp").alias("m"))
    return blk.join(med, KEY).select(
        *SEG, "block", "ptp", "rms", "m",
        (F.col("ptp") > 2 * F.col("m")).alias("hot"), (F.col("ptp") == 0).alias("flat"), (F.col("rms") > 10 * F.col("m")).alias("loud"),
    )


@REG.add(_BLK + " select rec_id, channel, segment, block, ptp, round(rms / ptp, 6) as crest from blk where ptp > 0")
def block_rms_ptp(t: Tables) -> DataFrame:
    """RMS and peak-to-peak of complete blocks (WIN1, AGG1)."""
    return _blocks(t).filter("ptp > 0").select(*SEG, "block", "ptp", F.round(F.col("rms") / F.col("ptp"), 6).alias("crest"))


@REG.add(_BLK + " select rec_id, channel, count(*) as blocks, count_if(ptp = 0)::bigint as flat from blk group by all")
def flat_block_count(t: Tables) -> DataFrame:
    """Blocks without any change (AGG2)."""
    return _blocks(t).groupBy(*KEY).agg(F.count("*").alias("blocks"), F.count_if(F.col("ptp") == 0).alias("flat"))


@REG.add(
    _S + ", c as (select rec_id, channel, median(x) as m from s group by all), "
    "d as (select rec_id, channel, 1.4826 * median(abs(x - m)) as r from s join c using (rec_id, channel) group by all) "
    "select rec_id, channel, count(*) as n, count_if(abs(x - m) > 6 * r)::bigint as outside from s join c using (rec_id, channel) join d using (rec_id, channel) group by all"
)
def robust_sd_flags(t: Tables) -> DataFrame:
    """Samples beyond six robust SDs of the median (AGG3 and the blink predicate of DSP5)."""
    s = _clean(t)
    r = S.robust_sd(s, KEY, "x")
    far = F.abs(F.col("x") - F.col("center")) > 6 * F.col("robust_sd")
    return s.join(r, KEY).groupBy(*KEY).agg(F.count("*").alias("n"), F.count_if(far).alias("outside"))


@REG.add(
    _S + ", e as (select rec_id, channel, max(x) as hi, min(x) as lo from s group by all), "
    "q as (select s.*, x = hi or x = lo as at_end, row_number() over (partition by rec_id, channel order by idx, x) as i from s join e using (rec_id, channel)), "
    "g as (select rec_id, channel, i - row_number() over (partition by rec_id, channel, x order by idx) as g, x from q where at_end) "
    "select rec_id, channel, max(n) as longest from (select rec_id, channel, x, g, count(*) as n from g group by all) group by all"
)
def longest_run_at_extreme(t: Tables) -> DataFrame:
    """The longest run of samples at the series' own minimum or maximum (WIN3)."""
    s = _clean(t)
    e = s.groupBy(*KEY).agg(F.max("x").alias("hi"), F.min("x").alias("lo"))
    marked = s.join(e, KEY).withColumn("v", F.when((F.col("x") == F.col("hi")) | (F.col("x") == F.col("lo")), F.col("x")))
    return B.islands(marked, KEY, "idx", "v").filter("v is not null").groupBy(*KEY).agg(F.max("n").alias("longest"))


@REG.add(
    _FLAG + ", g as (select rec_id, channel, segment, block, block - row_number() over (partition by rec_id, channel, segment order by block) as g from f where not hot and not flat) "
    "select rec_id, channel, segment, min(block) as start, max(block) + 1 as stop, count(*) as n from g group by rec_id, channel, segment, g having count(*) >= 3"
)
def clean_runs_min_len(t: Tables) -> DataFrame:
    """Runs of at least three clean blocks (WIN2)."""
    f = _flags(t).withColumn("ok", ~F.col("hot") & ~F.col("flat"))
    return B.runs(f, SEG, "block", "ok", 3)


@REG.add(
    _FLAG + " select rec_id, channel, segment, block, max(hot) over (partition by rec_id, channel, segment order by block range between 1 preceding and 1 following) as dilated from f"
)
def dilate_flags(t: Tables) -> DataFrame:
    """Hot blocks and their neighbours (WIN4)."""
    return B.dilate(_flags(t), SEG, "block", "hot", 1).select(*SEG, "block", "dilated")


@REG.add(
    _FLAG + ", d as (select rec_id, channel, segment, block, least(block - last_value(case when hot then block end ignore nulls) over (partition by rec_id, channel, segment order by block rows between unbounded preceding and current row), "
    "first_value(case when hot then block end ignore nulls) over (partition by rec_id, channel, segment order by block rows between current row and unbounded following) - block) as distance from f) "
    f"select rec_id, channel, segment, block, coalesce(distance, -1) as distance, round(case when distance <= 2 then 0.5 * (1 + cos({pi} * distance / 3)) else 0 end, 6) as weight from d"
)
def distance_to_flag_weight(t: Tables) -> DataFrame:
    """Blocks to the nearest hot block, and a raised-cosine weight (WIN5)."""
    d = B.flag_distance(_flags(t), SEG, "block", "hot")
    return d.select(*SEG, "block", F.coalesce("distance", F.lit(-1)).alias("distance"), F.round(B.raised_cosine(F.col("distance"), 2), 6).alias("weight"))


@REG.add(
    _FLAG + ", r as (select rec_id, segment, block, bool_or(hot) as hot, bool_or(flat) as flat, bool_or(loud) as loud from f group by all) "
    "select rec_id, segment, block, concat_ws('+', case when hot then 'ptp' end, case when flat then 'flat' end, case when loud then 'loud' end) as rules from r"
)
def multi_rule_reject(t: Tables) -> DataFrame:
    """The rules that reject a block in either channel (FLT3, FLT4)."""
    r = _flags(t).groupBy("rec_id", "segment", "block").agg(*[F.bool_or(c).alias(c) for c in ("hot", "flat", "loud")])
    return r.select("rec_id", "segment", "block", R.reasons({"ptp": F.col("hot"), "flat": F.col("flat"), "loud": F.col("loud")}).alias("rules"))


@REG.add(
    _FLAG + ", v as (select * from (values ('normal', 2.0), ('strict', 1.5)) as v(variant, times)) "
    "select variant, rec_id, count(*) as blocks, count_if(ptp > times * m)::bigint as rejected from f, v group by all"
)
def strict_variant(t: Tables) -> DataFrame:
    """The same rule with each variant's limit (FLT5, JN10)."""
    v = F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), F.lit(x).alias("times")) for n, x in (("normal", 2.0), ("strict", 1.5))]))
    wide = _flags(t).withColumn("_v", v).select("*", "_v.*")
    return wide.groupBy("variant", "rec_id").agg(
        F.count("*").alias("blocks"), F.count_if(F.col("ptp") > F.col("times") * F.col("m")).alias("rejected")
    )


@REG.add(
    _FLAG + ", c as (select rec_id, channel, count(*) as n, count_if(hot)::bigint as hot, count_if(flat)::bigint as flat from f group by all), "
    "r as (select rec_id, bool_or(flat > 0) as electrode, bool_or(hot * 10 > n) as excess, min(n - hot) as clean from c group by all) "
    "select rec_id, case when electrode then 'bad_electrode' when excess then 'blink_excess' when clean < 5 then 'too_little' else 'ok' end as decision from r"
)
def first_failing_rule(t: Tables) -> DataFrame:
    """The first rule that excludes a recording; a share is exceeded strictly, in whole numbers (FLT6 to FLT8)."""
    c = _flags(t).groupBy(*KEY).agg(F.count("*").alias("n"), F.count_if("hot").alias("hot"), F.count_if("flat").alias("flat"))
    r = c.groupBy("rec_id").agg(
        F.bool_or(F.col("flat") > 0).alias("electrode"),
        F.bool_or(R.exceeds(F.col("hot"), F.col("n"), 1, 10)).alias("excess"),
        F.min(F.col("n") - F.col("hot")).alias("clean"),
    )
    rules = {"bad_electrode": F.col("electrode"), "blink_excess": F.col("excess"), "too_little": F.col("clean") < 5}
    return r.select("rec_id", R.first_reason(rules).alias("decision"))


@REG.add(
    _S + ", g as (select *, case when idx - lag(idx) over w > 1 then 1 else 0 end as b, row_number() over w as n from s window w as (partition by rec_id, channel order by idx)), "
    "h as (select *, sum(b) over (partition by rec_id, channel order by idx) as segment from g), "
    "k as (select *, row_number() over (partition by rec_id, channel, segment order by idx) > 4 and n > 20 as kept from h) "
    "select rec_id, channel, (max(segment) + 1)::bigint as segments, count(*) as n, count_if(kept)::bigint as kept from k group by all"
)
def scoring_mask(t: Tables) -> DataFrame:
    """Samples kept beyond the burn-in of segment and series (WIN9, WIN10)."""
    m = B.scoring_mask(_clean(t), KEY, "idx", 4, 20)
    return m.groupBy(*KEY).agg(F.countDistinct("segment").alias("segments"), F.count("*").alias("n"), F.count_if("kept").alias("kept"))


@REG.add(
    _S + ", c as (select rec_id, channel, median(x) as m from s group by all), q as (select s.rec_id, s.channel, idx, x > m as up, row_number() over (partition by s.rec_id, s.channel order by idx) as i from s join c using (rec_id, channel)), "
    "g as (select *, i - row_number() over (partition by rec_id, channel order by idx) as g from q where up), "
    "h as (select *, row_number() over (partition by rec_id, channel, g order by idx) as c from g) select rec_id, channel, min(idx) as fired from h where c = 4 group by all"
)
def dwell_rule(t: Tables) -> DataFrame:
    """Where a condition has held four samples on end for the first time (WIN11)."""
    s = _clean(t)
    m = s.groupBy(*KEY).agg(F.median("x").alias("m"))
    return B.dwell(s.join(m, KEY).withColumn("up", F.col("x") > F.col("m")), KEY, "idx", "up", 4)


@REG.add(
    _S + ", l as (select rec_id, channel, idx, x, lag(x, 1) over w as a, lag(idx, 1) over w as ia, lag(x, 2) over w as b, lag(idx, 2) over w as ib from s window w as (partition by rec_id, channel order by idx)) "
    "select rec_id, channel, idx, x, a as x_1, b as x_2 from l where ia = idx - 1 and ib = idx - 2"
)
def lag_design(t: Tables) -> DataFrame:
    """Each sample with the two before it, never across a gap (WIN6)."""
    return B.lagged(_clean(t), KEY, "idx", "x", [1, 2]).filter("x_1 is not null and x_2 is not null").select(*KEY, "idx", "x", "x_1", "x_2")


@REG.add(
    _S + ", l as (select rec_id, channel, idx, lag(x, 2) over w as a, lag(idx, 2) over w as ia, lag(x, 3) over w as b, lag(idx, 3) over w as ib from s window w as (partition by rec_id, channel order by idx)) "
    "select rec_id, channel, idx, 0.5 * a + 0.5 * b as delayed from l where ia = idx - 2 and ib = idx - 3"
)
def fractional_lag(t: Tables) -> DataFrame:
    """The value 2.5 samples earlier (WIN7)."""
    d = B.fractional_lag(_clean(t), KEY, "idx", "x", 2.5, "delayed")
    return d.filter("delayed is not null").select(*KEY, "idx", "delayed")


@REG.add(
    _S + ", l as (select rec_id, channel, idx, x, lag(x) over w as a, lag(idx) over w as ia, lead(x) over w as b, lead(idx) over w as ib from s window w as (partition by rec_id, channel order by idx)) "
    "select rec_id, channel, idx, (b - a) / 2 as slope, a * 0.25 + x * 0.5 + b * 0.25 as smooth from l where ia = idx - 1 and ib = idx + 1"
)
def fir_derivative(t: Tables) -> DataFrame:
    """Central difference and matched smoothing where the kernel fits (WIN8)."""
    s = B.fir(_clean(t), KEY, "idx", "x", {"slope": {-1: 0.5, 1: -0.5}, "smooth": {1: 0.25, 0: 0.5, -1: 0.25}})
    return s.filter("slope is not null").select(*KEY, "idx", "slope", "smooth")


@REG.add(
    _BLK + ", q as (select *, coalesce((rms + lag(rms) over (partition by rec_id, channel, segment order by block)) / 2, 0) as step from blk) "
    "select rec_id, channel, segment, block, round(sum(step) over (partition by rec_id, channel, segment order by block rows unbounded preceding), 3) as area from q"
)
def cumulative_trapezoid(t: Tables) -> DataFrame:
    """The running integral of block RMS (WIN18)."""
    return B.trapezoid(_blocks(t), SEG, "block", "rms").select(*SEG, "block", F.round("area", 3).alias("area"))


@REG.add(
    _BLK + ", c as (select rec_id, channel, count(*) as n from blk group by all) "
    "select distinct rec_id, size, start from (select rec_id, size, unnest(range(0, n - size + 1, step)) as start from c, (values (2, 1), (4, 2)) as v(size, step) where n >= size)"
)
def capture_positions(t: Tables) -> DataFrame:
    """Start positions of windows of several lengths, over both channels (WIN15, WIN16)."""
    c = _blocks(t).groupBy(*KEY).agg(F.count("*").alias("n"))
    parts = [B.starts(c, KEY, "n", size, step).select("rec_id", F.lit(size).alias("size"), F.col("start")) for size, step in ((2, 1), (4, 2))]
    return parts[0].unionByName(parts[1]).distinct()


@REG.add(
    _BLK + ", e as (select *, row_number() over (partition by rec_id order by hash_order, segment, block, channel) as place from (select *, ((segment + block) * 7919 + channel * 104729 + rec_id) % 1009 as hash_order from blk where ptp > 0)) "
    "select rec_id, channel, segment, block, place::int as place from e where place <= 3"
)
def first_n_eligible(t: Tables) -> DataFrame:
    """The first three blocks with any change in a drawn order (WIN17)."""
    d = _blocks(t).withColumn("d", ((F.col("segment") + F.col("block")) * 7919 + F.col("channel") * 104729 + F.col("rec_id")) % 1009)
    return B.first_n(d, ["rec_id"], ["d", "segment", "block", "channel"], 3, F.col("ptp") > 0).select(*SEG, "block", "place")


@REG.add(
    _S + ", p as (select rec_id, idx, max(case when channel = 0 then x end) as a, max(case when channel = 1 then x end) as b from s group by all) "
    "select rec_id, idx, a - b as diff from p where a is not null and b is not null"
)
def bipolar(t: Tables) -> DataFrame:
    """Channel 0 minus channel 1 at each index; one aggregation instead of a self-join (PRJ1)."""
    at = lambda c: F.max(F.when(F.col("channel") == c, F.col("x")))
    p = _clean(t).groupBy("rec_id", "idx").agg(at(0).alias("a"), at(1).alias("b"))
    return p.filter("a is not null and b is not null").select("rec_id", "idx", (F.col("a") - F.col("b")).alias("diff"))


@REG.add(
    _S + ", e as (select rec_id, channel, min(idx) as lo, max(idx) as hi from s group by all) "
    "select rec_id, channel, count(*) as n, round(avg(x) / max(abs(x)), 6) as mean from s join e using (rec_id, channel) where idx between lo + 8 and hi - 8 group by all"
)
def edge_trim(t: Tables) -> DataFrame:
    """Series without eight samples at either end (PRJ2); NaN, as 0/0 in SQL, where all that is left is 0."""
    s = B.sent_samples(t.samples)
    e = s.groupBy(*KEY).agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"))
    inside = s.join(e, KEY).filter(F.col("idx").between(F.col("lo") + 8, F.col("hi") - 8)).distinct()  # in the shuffle of the join
    sums = inside.groupBy(*KEY).agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.max(F.abs("x")).alias("most"))
    share = F.when(F.col("most") == 0, F.lit(float("nan"))).otherwise(F.col("mean") / F.col("most"))
    return sums.select(*KEY, "n", F.round(share, 6).alias("mean"))


@REG.add(
    _S + ", e as (select rec_id, channel, avg(x) as m, stddev_samp(x) as sd from s group by all) "
    "select rec_id, channel, idx, round(7.57 + 1.13 * (x - m) / sd, 6) as y from s join e using (rec_id, channel) where sd > 0"
)
def rescale_to_reference(t: Tables) -> DataFrame:
    """Series brought to a reference mean and SD (PRJ3, PRJ6)."""
    y = S.rescale(_clean(t), KEY, "x", 7.57, 1.13, "y")
    return y.filter("y is not null").select(*KEY, "idx", F.round("y", 6).alias("y"))


@REG.add(
    _S + ", r as (select rec_id, channel, x, lag(x) over w as a, lag(idx) over w as ia, idx from s window w as (partition by rec_id, channel order by idx)), "
    "f as (select rec_id, channel, count(*) as n, regr_slope(x, a) as phi from r where ia = idx - 1 group by all having count(*) > 2 and var_pop(a) > 0) select rec_id, channel, n, round(phi, 6) as phi from f"
)
def ar1_fit(t: Tables) -> DataFrame:
    """First-order autoregression of each series (STA10 for order 1)."""
    r = B.lagged(_clean(t), KEY, "idx", "x", [1]).filter("x_1 is not null")
    f = r.groupBy(*KEY).agg(F.count("*").alias("n"), F.regr_slope("x", "x_1").alias("phi"), F.var_pop("x_1").alias("v"))
    return f.filter("n > 2 and v > 0").select(*KEY, "n", F.round("phi", 6).alias("phi"))


_N = 64
_EMB = (
    f"with v as (select vec_id, label, unnest(embedding)::double as x, unnest(range({_N})) as t from embeddings where len(embedding) = {_N}), "
    f"c as (select vec_id, t, x - avg(x) over (partition by vec_id) as x from v), "
    f"h as (select vec_id, t, x * (0.5 - 0.5 * cos(2 * pi() * t / {_N - 1})) as x from c), "
    f"d as (select vec_id, k, sum(x * cos(2 * pi() * k * t / {_N})) as re, -sum(x * sin(2 * pi() * k * t / {_N})) as im from h, (select unnest(range(1, 33)) as k) group by all), "
    "p as (select vec_id, k, re * re + im * im as power from d)"
)


def _spectrum(t: Tables) -> DataFrame:
    e = t.embeddings.filter(F.size("embedding") == _N).select("vec_id", "label", F.transform("embedding", lambda a: a.cast("double")).alias("v"))
    return P.transform(e, ["vec_id", "label"], _N, list(range(1, 33)))


@REG.add(_EMB + " select vec_id, k, round(power, 6) as power from p")
def dft_power(t: Tables) -> DataFrame:
    """Hann periodogram of 64-sample epochs (DSP7)."""
    return P.power(_spectrum(t)).select("vec_id", F.col("k").cast("long").alias("k"), F.round("power", 6).alias("power"))


@REG.add(
    _EMB + ", b as (select vec_id, sum(case when k between 2 and 3 then power end) as theta, sum(case when k between 4 and 7 then power end) as alpha, max(power) as top from p group by all) "
    "select vec_id, round(alpha, 6) as alpha, round(theta, 6) as theta, round(alpha / theta, 4) as ratio from b"
)
def band_ratio(t: Tables) -> DataFrame:
    """Power of two bands and their ratio (DSP8, DSP9)."""
    b = P.power(_spectrum(t)).groupBy("vec_id").agg(P.band(2, 3).alias("theta"), P.band(4, 7).alias("alpha"))
    return b.select("vec_id", F.round("alpha", 6).alias("alpha"), F.round("theta", 6).alias("theta"), F.round(F.col("alpha") / F.col("theta"), 4).alias("ratio"))


@REG.add(_EMB + " select vec_id, arg_max(k, power) as peak from p where k between 4 and 20 group by all")
def spectral_peak(t: Tables) -> DataFrame:
    """The bin of greatest power in a band (TOP5)."""
    return P.peak(P.power(_spectrum(t)), ["vec_id"], 4, 20).select("vec_id", F.col("peak").cast("long").alias("peak"))


@REG.add(
    _EMB + " select k, round(quantile_cont(power, 0.25), 5) as q25, round(quantile_cont(power, 0.5), 5) as q50, round(quantile_cont(power, 0.75), 5) as q75 from p group by all"
)
def spectral_percentiles(t: Tables) -> DataFrame:
    """Quartiles of each bin over all epochs (AGG4)."""
    q = exact_quantiles(P.power(_spectrum(t)), ["k"], "power", [0.25, 0.5, 0.75], "q")
    return q.select(F.col("k").cast("long").alias("k"), *[F.round(F.col("q")[i], 5).alias(n) for i, n in enumerate(("q25", "q50", "q75"))])


@REG.add(
    _EMB + ", g as (select vec_id // 10 as epoch, k, vec_id % 2 as side, avg(log10(power)) as l from p group by all), "
    "w as (select epoch, k, max(case when side = 0 then l end) as a, max(case when side = 1 then l end) as b from g group by all) "
    "select epoch, round(avg(abs(a - b)), 6) as error from w group by all"
)
def log_spectral_error(t: Tables) -> DataFrame:
    """Mean absolute difference of mean log spectra of two sides (DSP10, DSP11)."""
    p = P.power(_spectrum(t)).withColumn("epoch", F.floor(F.col("vec_id") / 10)).withColumn("side", F.col("vec_id") % 2)
    w = p.groupBy("epoch", "k").agg(*[F.avg(F.when(F.col("side") == i, F.log10("power"))).alias(n) for i, n in enumerate("ab")])
    return w.groupBy("epoch").agg(F.round(F.avg(F.abs(F.col("a") - F.col("b"))), 6).alias("error"))


@REG.add(
    _EMB + ", x as (select a.vec_id // 2 % 5 as grp, a.k, a.im * b.re - a.re * b.im as im, a.re * a.re + a.im * a.im as pa, b.re * b.re + b.im * b.im as pb from d a join d b on b.vec_id = a.vec_id + 1 and a.k = b.k where a.vec_id % 2 = 0), "
    "g as (select grp, k, count(*) as n, avg(im) as i, avg(abs(im)) as ai, avg(pa) as pa, avg(pb) as pb from x group by all) "
    "select grp, k, n, round(abs(i) / ai, 6) as wpli, round(i / sqrt(pa * pb), 6) as icoh from g"
)
def wpli_icoh(t: Tables) -> DataFrame:
    """Weighted phase lag index and imaginary coherency of pairs of epochs (DSP12)."""
    d = _spectrum(t).withColumn("pair", F.floor(F.col("vec_id") / 2)).withColumn("grp", F.col("pair") % 5)
    c = P.coherence(d.filter("vec_id % 2 = 0"), d.filter("vec_id % 2 = 1"), ["pair", "grp"], ["grp"])
    return c.select("grp", F.col("k").cast("long").alias("k"), "n", F.round("wpli", 6).alias("wpli"), F.round("icoh", 6).alias("icoh"))


@REG.add(
    _EMB + ", l as (select vec_id, k, log10(k) as f, log10(power) as y from p where k between 1 and 20), "
    "s as (select vec_id, regr_slope(y, f) as slope, regr_intercept(y, f) as icept from l where k not between 7 and 9 group by all) "
    "select vec_id, round(any_value(slope), 5) as slope, arg_max(k, y - icept - slope * f) as peak from l join s using (vec_id) group by all"
)
def aperiodic_slope(t: Tables) -> DataFrame:
    """Log-log line without a band, and the bin furthest above it (DSP14 by TL10's rule)."""
    p = P.power(_spectrum(t)).filter("k between 1 and 20").select("vec_id", "k", F.log10("k").alias("f"), F.log10("power").alias("y"))
    out = p.filter("k not between 7 and 9").groupBy("vec_id").agg(F.regr_slope("y", "f").alias("slope"), F.regr_intercept("y", "f").alias("icept"))
    rest = F.col("y") - F.col("icept") - F.col("slope") * F.col("f")
    best = p.join(out, "vec_id").groupBy("vec_id").agg(F.round(F.first("slope"), 5).alias("slope"), F.max(F.struct(rest.alias("r"), -F.col("k"))).alias("b"))
    return best.select("vec_id", "slope", (-F.col("b.col2")).cast("long").alias("peak"))


@REG.add(
    _EMB + ", b as (select vec_id, avg(case when k between 8 and 13 then power end) as inside, avg(case when k between 4 and 7 or k between 14 and 17 then power end) as flank from p group by all) "
    "select vec_id, round(inside / flank, 5) as prominence from b"
)
def band_prominence(t: Tables) -> DataFrame:
    """Mean power of a band over that of its flanks (TL9)."""
    mean = lambda c: F.avg(F.when(c, F.col("power")))
    k = F.col("k")
    b = P.power(_spectrum(t)).groupBy("vec_id").agg(mean(k.between(8, 13)).alias("i"), mean(k.between(4, 7) | k.between(14, 17)).alias("f"))
    return b.select("vec_id", F.round(F.col("i") / F.col("f"), 5).alias("prominence"))


_W = 32


@REG.add(
    _SEG + f", h as (select rec_id, channel, segment, idx, x, unnest([(idx - segment) // {_W // 2}, (idx - segment) // {_W // 2} - 1]) as block from g0), "
    f"b as (select rec_id, channel, segment, block, list(x order by idx) as v from h where block >= 0 group by all having count(*) = {_W}), "
    f"u as (select rec_id, channel, segment, block, unnest(v) as x, unnest(range({_W})) as t from b), "
    "c as (select *, x - avg(x) over (partition by rec_id, channel, segment, block) as y from u), "
    f"d as (select rec_id, channel, segment, block, k, sum(y * (0.5 - 0.5 * cos(2 * pi() * t / {_W})) * cos(2 * pi() * k * t / {_W})) as re, sum(y * (0.5 - 0.5 * cos(2 * pi() * t / {_W})) * sin(2 * pi() * k * t / {_W})) as im from c, (select unnest(range(1, 17)) as k) group by all), "
    "w as (select rec_id, channel, k, avg(re * re + im * im) as p from d group by all), t as (select rec_id, channel, sum(p) as total from w group by all) "
    "select rec_id, channel, k, round(p / total, 6) as share from w join t using (rec_id, channel) where total > 1e-9"
)
def welch_shares(t: Tables) -> DataFrame:
    """Mean spectrum over a series' blocks that overlap by half, as shares of its total (WIN15, DSP10)."""
    b = P.blocks_of(B.segmented(B.sent_samples(t.samples), KEY, repeated=True), SEG, F.col("idx") - F.col("segment"), "x", _W, _W // 2)
    p = P.power(P.transform(b, [*SEG, "block"], _W, list(range(1, 17)), periodic=True))
    w = p.groupBy(*KEY, "k").agg(F.avg("power").alias("p"))
    total = w.groupBy(*KEY).agg(F.sum("p").alias("total"))
    return w.join(total, KEY).filter("total > 1e-9").select(*KEY, F.col("k").cast("long").alias("k"), F.round(F.col("p") / F.col("total"), 6).alias("share"))


_TAUS = [round(0.5 * 1.5**i, 6) for i in range(12)]


@REG.add(
    _EMB + f", g as (select vec_id, i, sum(power * l) as pl, sum(power * power) as pp, sum(l * l) as ll from (select p.*, i, 1 / (1 + pow(k / tau, 2)) as l from p, (values {', '.join(f'({i}, {x}::double)' for i, x in enumerate(_TAUS))}) as g(i, tau)) group by all) "
    "select vec_id, arg_min(i, (round((pp - pl * pl / ll) / pp, 9), i))::int as corner, round(arg_min(pl / ll, (round((pp - pl * pl / ll) / pp, 9), i)), 4) as scale from g group by all"
)
def corner_fit(t: Tables) -> DataFrame:
    """The corner, of a log-spaced grid, and the scale at which a Lorentzian fits each spectrum with the least squares; ties
    to the lower corner (TOP6). The grid is a set of sums in one aggregation."""
    p, k = F.col("power"), F.col("k")
    shape = [1 / (1 + F.pow(k / x, 2)) for x in _TAUS]
    sums = [F.sum(p * s).alias(f"pl{i}") for i, s in enumerate(shape)] + [F.sum(s * s).alias(f"ll{i}") for i, s in enumerate(shape)]
    g = P.power(_spectrum(t)).groupBy("vec_id").agg(F.sum(p * p).alias("pp"), *sums)
    fit = [F.struct(F.round((F.col("pp") - F.col(f"pl{i}") ** 2 / F.col(f"ll{i}")) / F.col("pp"), 9).alias("sse"), F.lit(i).alias("i"), (F.col(f"pl{i}") / F.col(f"ll{i}")).alias("s")) for i in range(len(_TAUS))]
    best = F.array_min(F.array(*fit))
    return g.select("vec_id", best["i"].alias("corner"), F.round(best["s"], 4).alias("scale"))


@REG.add(
    _FLAG + ", q as (select * from f where not hot and not flat) select a.rec_id, a.segment + 16 * a.block as start, round(a.ptp / a.m, 6) as first, round(b.ptp / b.m, 6) as second "
    "from q a join q b on a.rec_id = b.rec_id and a.segment + 16 * a.block = b.segment + 16 * b.block where a.channel = 0 and b.channel = 1 and a.m > 0 and b.m > 0"
)
def common_windows(t: Tables) -> DataFrame:
    """Windows that are clean in both channels, with both values (JN5)."""
    q = _flags(t).filter("not hot and not flat and m > 0").select("rec_id", (F.col("segment") + SIZE * F.col("block")).alias("start"), "channel", F.round(F.col("ptp") / F.col("m"), 6).alias("v"))
    a = q.filter("channel = 0").select("rec_id", "start", F.col("v").alias("first"))
    return a.join(q.filter("channel = 1").select("rec_id", "start", F.col("v").alias("second")), ["rec_id", "start"])


def _scaled(t: Tables) -> DataFrame:
    """Series in units of their own SD, so that results of all units compare."""
    return S.rescale(_clean(t), KEY, "x", 0.0, 1.0, "z").filter("z is not null").select(*KEY, "idx", F.col("z").alias("x"))


def _rated(t: Tables) -> DataFrame:
    """The same with each recording's rate."""
    fs = t.recordings.groupBy("rec_id").agg(F.max("fs_hz").alias("fs"))
    return _scaled(t).join(fs, "rec_id")


@REG.add()
def band_pass(t: Tables) -> DataFrame:
    """Each series between 0.5 and 45 Hz, at its own rate and never across a gap (DSP1)."""
    return FI.filtered(_rated(t), KEY, FI.butterworth(0.5, 45.0, 4)).select(*KEY, "idx", F.round("y", 6).alias("y"))


@REG.add()
def notch_50(t: Tables) -> DataFrame:
    """Each series without mains hum and its harmonics (DSP2)."""
    return FI.filtered(_rated(t), KEY, FI.notch(50.0, 30.0)).select(*KEY, "idx", F.round("y", 6).alias("y"))


@REG.add()
def fft_downsample(t: Tables) -> DataFrame:
    """Each series at 64 Hz (DSP3)."""
    return FI.downsampled(_rated(t), KEY, 64.0).select(*KEY, "segment", "step", F.round("y", 6).alias("y"))


@REG.add()
def blink_samples(t: Tables) -> DataFrame:
    """Samples of the 0.5 to 5 Hz copy beyond six robust SDs of its median, counted (DSP5)."""
    y = FI.filtered(_rated(t), KEY, FI.butterworth(0.5, 5.0, 4))
    far = F.abs(F.col("y") - F.col("center")) > 6 * F.col("robust_sd")
    return y.join(S.robust_sd(y, KEY, "y"), KEY).groupBy(*KEY).agg(F.count("*").alias("n"), F.count_if(far).alias("outside"))


@REG.add()
def amplitude_check(t: Tables) -> DataFrame:
    """Each recording's median SD over its channels after a high-pass, in µV, and whether it can be right (FLT1)."""
    units = U.recording_units(t.recordings, t.units_checks, t.samples, t.amplifiers).select("rec_id", "unit_nv")
    fs = t.recordings.groupBy("rec_id").agg(F.max("fs_hz").alias("fs")).join(units, "rec_id")
    uv = _clean(t).join(fs, "rec_id").withColumn("x", F.col("x") * F.col("unit_nv") / 1000)
    return FI.deviation_check(uv, "rec_id", "channel").select("rec_id", "n", F.round("median_sd", 6).alias("median_sd"), "passed")


@REG.add()
def aaft_surrogate(t: Tables) -> DataFrame:
    """One surrogate of each stretch without a gap (DSP13)."""
    return FI.surrogates(_rated(t), KEY, 42).select(*KEY, "idx", F.round("y", 6).alias("y"))


@REG.add()
def tv_derivative(t: Tables) -> DataFrame:
    """Total-variation derivatives per second of 32-sample windows (DSP15)."""
    return FI.derivative(_rated(t), KEY, 1e-4).select(*KEY, "segment", "window", "step", F.round("slope", 2).alias("slope"))


_Q, _R = [0.001, 0.01, 0.1, 1.0], 0.25


def _levels(grid: list[float]) -> str:
    """CTEs: ``z`` (scaled samples with their place and step) and ``f`` (the level filter for each q, by recursion)."""
    return (
        _S.replace("with s", "with recursive s") + ", e as (select rec_id, channel, avg(x) as m, stddev_samp(x) as sd from s group by all having stddev_samp(x) > 0), "
        "z as (select s.rec_id, s.channel, idx, (x - m) / sd as z, row_number() over w as n, idx - lag(idx) over w as step from s join e using (rec_id, channel) window w as (partition by s.rec_id, s.channel order by idx)), "
        f"g as (select unnest({grid}::double[]) as q), "
        f"f as (select rec_id, channel, q, n, z as a, (1 - ({_R} + q) / (2 * {_R} + q)) * ({_R} + q) as p, 0::double as nis from z, g where n = 1 union all "
        f"select z.rec_id, z.channel, f.q, z.n, a + (p + step * q) / (p + step * q + {_R}) * (z - a), (1 - (p + step * q) / (p + step * q + {_R})) * (p + step * q), "
        f"(z - a) * (z - a) / (p + step * q + {_R}) from f join z on z.rec_id = f.rec_id and z.channel = f.channel and z.n = f.n + 1)"
    )


_NIS = _levels(_Q) + ", k as (select rec_id, channel, q, avg(case when n > 4 then nis end) as nis from f group by all having count(*) >= 32)"


@REG.add(_NIS + " select rec_id, channel, q, round(nis, 6) as nis from k")
def nis_by_q(t: Tables) -> DataFrame:
    """Mean normalised innovation of each series for each q of a grid (KER7 re-aimed, AGG8, JN10)."""
    return ST.nis_by_q(_scaled(t), KEY, _Q, _R).select(*KEY, "q", F.round("nis", 6).alias("nis"))


@REG.add(
    _NIS + ", m as (select q, avg(nis) as nis, count(*) as n from k group by all) "
    "select case when n >= 15 then q end as q, round(nis, 6) as nis, n from m order by abs(nis - 1), q limit 1"
)
def chosen_q(t: Tables) -> DataFrame:
    """The q whose innovations are nearest their expectation (TOP2)."""
    return ST.choose_q(ST.nis_by_q(_scaled(t), KEY, _Q, _R), 1.0, 15).withColumn("nis", F.round("nis", 6))


@REG.add(
    _levels([0.1]) + ", c as (select f.*, idx, max(f.n) over (partition by f.rec_id, f.channel) as last, lead(step) over (partition by f.rec_id, f.channel order by f.n) as ahead from f join z using (rec_id, channel, n)), "
    "b as (select rec_id, channel, n, idx, a as level from c where n = last union all "
    "select c.rec_id, c.channel, c.n, c.idx, c.a + c.p / (c.p + ahead * 0.1) * (b.level - c.a) from b join c on c.rec_id = b.rec_id and c.channel = b.channel and c.n = b.n - 1) "
    "select rec_id, channel, idx // 32 as block, (idx % 32)::int as step, round(level, 6) as level from b"
)
def smoothed_level(t: Tables) -> DataFrame:
    """Smoothed levels of whole series, gaps predicted (KER8 re-aimed)."""
    return ST.smoothed(_scaled(t), KEY, 0.1, 0.25).select(*KEY, "block", "step", F.round("level", 6).alias("level"))


@REG.add(
    _S + ", a as (select rec_id, idx, x from s where channel = 0), b as (select rec_id, idx, x from s where channel = 1), "
    "l as (select rec_id, idx, x, lag(x) over w as p, lag(idx) over w as ip, lead(x) over w as n, lead(idx) over w as inx from a window w as (partition by rec_id order by idx)) "
    "select l.rec_id, l.idx, l.x as u_tgt, b.x as u_src, (n - p) / 2 as y from l join b on b.rec_id = l.rec_id and b.idx = l.idx - 2 where ip = l.idx - 1 and inx = l.idx + 1"
)
def residual_rows(t: Tables) -> DataFrame:
    """Regression rows: a channel's derivative with its own value and the other's delayed one (KER15)."""
    s = _clean(t)
    a = B.fir(s.filter("channel = 0").select("rec_id", "idx", "x"), ["rec_id"], "idx", "x", {"y": {-1: 0.5, 1: -0.5}}).filter("y is not null")
    b = s.filter("channel = 1").select("rec_id", (F.col("idx") + 2).alias("idx"), F.col("x").alias("u_src"))
    return a.join(b, ["rec_id", "idx"]).select("rec_id", "idx", F.col("x").alias("u_tgt"), "u_src", "y")


@REG.add(
    _BLK + ", e as (select *, row_number() over (partition by rec_id, channel order by segment desc, block desc) as back from blk), m as (select rec_id, channel, median(ptp) as m from blk group by all) "
    "select rec_id, channel, case when max(ptp) > 1.5 * any_value(m) then 'wide' else 'settled' end as regime from e join m using (rec_id, channel) where back <= 3 group by all"
)
def regime_label(t: Tables) -> DataFrame:
    """A label from the span of a series' last blocks (KER5)."""
    b = _blocks(t)
    m = b.groupBy(*KEY).agg(F.median("ptp").alias("m"))
    back = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("segment"), F.desc("block")))
    tail = b.withColumn("_back", back).filter("_back <= 3").join(m, KEY)
    wide = F.max("ptp") > 1.5 * F.first("m")
    return tail.groupBy(*KEY).agg(F.when(wide, "wide").otherwise("settled").alias("regime"))


@REG.add(
    _BLK + ", c as (select rec_id, channel, median(mean) as m from blk group by all), q as (select blk.rec_id, blk.channel, block, sign(mean - m) as s, lag(sign(mean - m)) over (partition by blk.rec_id, blk.channel, segment order by block) as p from blk join c using (rec_id, channel)) "
    "select rec_id, channel, count_if(s * p < 0)::bigint as roots from q group by all"
)
def sign_changes(t: Tables) -> DataFrame:
    """Sign changes of block means around their median: the bracket scan of a root search (KER3)."""
    b = _blocks(t)
    c = b.groupBy(*KEY).agg(F.median("mean").alias("m"))
    s = F.signum(F.col("mean") - F.col("m"))
    w = Window.partitionBy(*SEG).orderBy("block")
    q = b.join(c, KEY).withColumn("s", s).withColumn("p", F.lag("s").over(w))
    return q.groupBy(*KEY).agg(F.count_if(F.col("s") * F.col("p") < 0).alias("roots"))
