"""Statistical queries: groups, fits, agreement, resampling, verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.functions import codes
from wavemill.functions.quantiles import exact_median, exact_quantiles
from wavemill.functions.ranking import average_ranks
from wavemill.operators import regress
from wavemill.operators import rules as R
from wavemill.operators import stats as S
from wavemill.plans.registry import Registry, Tables

REG = Registry()

_NUM = r"try_cast(regexp_extract(subject, '(\d+)\D*$', 1) as bigint)"
_SES = r"'ses-t' || ltrim(regexp_extract(session, '(\d+)\D*$', 1), '0')"
_FEAT = "with f as (select distinct name, rec_id, channel, sd_uv, alpha_peak_hz, alpha_theta_ratio, aperiodic_exponent from features where sd_uv > 0)"
_SUP = "with s as (select l_suppkey, avg(l_quantity) as m0, avg(l_discount * 100) as m1, avg(l_tax * 100) as m2, count(*) as n, sum(l_quantity) as q from lineitem group by all)"
_TWO = (
    f"with r as (select distinct rec_id, {_NUM} as subject_no, {_SES} as ses from recordings), "
    "f as (select rec_id, avg(sd_uv) as sd, avg(alpha_theta_ratio) as vig from (select distinct rec_id, channel, sd_uv, alpha_theta_ratio from features where sd_uv > 0) group by all), "
    "x as (select subject_no, max(case when ses = 'ses-t1' then sd end) as a, max(case when ses = 'ses-t2' then sd end) as b, max(case when ses = 'ses-t1' then vig end) as va from r join f using (rec_id) group by all)"
)


def _features(t: Tables) -> DataFrame:
    return t.features.filter("sd_uv > 0").select("name", "rec_id", "channel", "sd_uv", "alpha_peak_hz", "alpha_theta_ratio", "aperiodic_exponent").distinct()


def _suppliers(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey").agg(
        F.avg("l_quantity").alias("m0"), F.avg(F.col("l_discount") * 100).alias("m1"), F.avg(F.col("l_tax") * 100).alias("m2"),
        F.count("*").alias("n"), F.sum("l_quantity").alias("q"),
    )


def _two_sessions(t: Tables) -> DataFrame:
    r = t.recordings.select("rec_id", codes.subject_number(F.col("subject")).alias("subject_no"), codes.session_code(F.col("session")).alias("ses")).distinct()
    f = t.features.filter("sd_uv > 0").select("rec_id", "channel", "sd_uv", "alpha_theta_ratio").distinct()
    f = f.groupBy("rec_id").agg(F.avg("sd_uv").alias("sd"), F.avg("alpha_theta_ratio").alias("vig"))
    at = lambda s, c: F.max(F.when(F.col("ses") == s, F.col(c)))
    return r.join(f, "rec_id").groupBy("subject_no").agg(at("ses-t1", "sd").alias("a"), at("ses-t2", "sd").alias("b"), at("ses-t1", "vig").alias("va"))


@REG.add(
    _FEAT + " select channel, count(*) as n, round(median(sd_uv), 6) as med_sd, round(median(alpha_peak_hz), 6) as med_peak, round(stddev_samp(alpha_theta_ratio), 6) as sd_ratio from f group by all"
)
def feature_medians(t: Tables) -> DataFrame:
    """Medians and sample SDs of the feature table (AGG19)."""
    f = _features(t)
    sums = f.groupBy("channel").agg(F.count("*").alias("n"), F.round(F.stddev_samp("alpha_theta_ratio"), 6).alias("sd_ratio"))
    for x, name in (("sd_uv", "med_sd"), ("alpha_peak_hz", "med_peak")):
        q = exact_quantiles(f, ["channel"], x, [0.5], "_q").select("channel", F.round(F.col("_q")[0], 6).alias(name))
        sums = sums.join(q, "channel", "left")
    return sums


@REG.add(
    "select l_returnflag, l_linestatus, count(*) as n, quantile_cont(l_quantity, 0.25) as q25, quantile_cont(l_quantity, 0.5) as q50, quantile_cont(l_quantity, 0.75) as q75 from lineitem group by all"
)
def quartile_profile(t: Tables) -> DataFrame:
    """Quartiles by level (AGG4, AGG11, AGG15)."""
    q = exact_quantiles(t.lineitem, ["l_returnflag", "l_linestatus"], "l_quantity", [0.25, 0.5, 0.75], "_q")
    return q.select("l_returnflag", "l_linestatus", "n", *[F.col("_q")[i].alias(c) for i, c in enumerate(("q25", "q50", "q75"))])


@REG.add(
    "with m as (select avg(l_quantity) as m, stddev_pop(l_quantity) as s from lineitem) "
    "select l_returnflag as level, count(*) as n, round(median(abs(l_quantity - m) / s), 6) as middle, round(max(abs(l_quantity - m) / s), 6) as most from lineitem, m group by all"
)
def level_summary(t: Tables) -> DataFrame:
    """Rows of each level, and the median and greatest distance of a value from the table's mean in its SDs (AGG15)."""
    z = S.zscores(t.lineitem.select("l_returnflag", "l_quantity"), ["l_quantity"]).select(F.col("l_returnflag").alias("level"), F.abs("z_l_quantity").alias("z"))
    m = exact_median(z, ["level"], "z", "m").select("level", F.round("m", 6).alias("middle"))
    return z.groupBy("level").agg(F.count("*").alias("n"), F.round(F.max("z"), 6).alias("most")).join(m, "level", "left")


@REG.add(
    _FEAT + ", r as (select channel, median(sd_uv) as ref from f group by all) "
    "select channel, round(any_value(ref), 6) as reference, round(median(abs(sd_uv - ref) / abs(ref)), 6) as change from f join r using (channel) group by all"
)
def relative_change(t: Tables) -> DataFrame:
    """Median relative distance of a channel's SDs from their median (STA8)."""
    f = _features(t)
    ref = exact_median(f, ["channel"], "sd_uv", "ref")
    away = f.join(ref, "channel").withColumn("d", F.abs(F.col("sd_uv") - F.col("ref")) / F.abs("ref"))
    change = exact_median(away, ["channel"], "d", "c")
    return ref.join(change, "channel").select("channel", F.round("ref", 6).alias("reference"), F.round("c", 6).alias("change"))


@REG.add(
    "select o_orderpriority, median(case when o_orderstatus = 'F' then 'inf'::double else o_totalprice end) as m from orders group by all having median(case when o_orderstatus = 'F' then 'inf'::double else o_totalprice end) < 'inf'::double "
    "union all select o_orderpriority, -1 from orders group by all having not median(case when o_orderstatus = 'F' then 'inf'::double else o_totalprice end) < 'inf'::double"
)
def median_with_inf(t: Tables) -> DataFrame:
    """Medians in which a failed case counts as infinite; −1 where the median is (AGG9)."""
    x = F.when(F.col("o_orderstatus") == "F", F.lit(float("inf"))).otherwise(F.col("o_totalprice"))
    m = exact_median(t.orders.select("o_orderpriority", x.alias("x")), ["o_orderpriority"], "x", "m")
    return m.withColumn("m", F.when(F.col("m") < float("inf"), F.col("m")).otherwise(-1.0))


@REG.add(
    "with u as (select l_returnflag as level, 'quantity' as param, 1 - l_quantity / 50 as c from lineitem union all select l_returnflag, 'discount', 1 - l_discount * 10 from lineitem union all select l_returnflag, 'tax', 1 - l_tax * 10 from lineitem) "
    "select level, param, round(median(c), 6) as contraction, median(c) >= 0.5 as ok from u group by all"
)
def contraction_table(t: Tables) -> DataFrame:
    """Median contraction by parameter and level, the columns turned to rows (AGG10, PRJ12)."""
    cells = F.explode(
        F.array(
            F.struct(F.lit("quantity").alias("param"), (1 - F.col("l_quantity") / 50).alias("c")),
            F.struct(F.lit("discount").alias("param"), (1 - F.col("l_discount") * 10).alias("c")),
            F.struct(F.lit("tax").alias("param"), (1 - F.col("l_tax") * 10).alias("c")),
        )
    )
    u = t.lineitem.select(F.col("l_returnflag").alias("level"), cells.alias("u")).select("level", "u.*")
    m = exact_median(u, ["level", "param"], "c", "m")
    return m.select("level", "param", F.round("m", 6).alias("contraction"), (F.col("m") >= 0.5).alias("ok"))


@REG.add(
    "with p as (select l_suppkey, l_suppkey % 5 as family, (1 + count_if(l_quantity >= 49)) / (count(*) + 1.0) as p from lineitem group by all), "
    "k as (select *, row_number() over (partition by family order by p, l_suppkey) as r, count(*) over (partition by family) as m from p) "
    "select l_suppkey, family, round(least(1.0, max((m - r + 1) * p) over (partition by family order by r rows unbounded preceding)), 9) as p_holm from k"
)
def holm_adjust(t: Tables) -> DataFrame:
    """Holm's step-down adjustment in families, of the share of a supplier's rows beyond a limit (WIN13, JN13, STA7)."""
    p = t.lineitem.groupBy("l_suppkey").agg(((1 + F.count_if(F.col("l_quantity") >= 49)) / (F.count("*") + 1.0)).alias("p")).withColumn("family", F.col("l_suppkey") % 5)
    return S.holm(p, ["family"], "p", "l_suppkey").select("l_suppkey", "family", F.round("p_holm", 9).alias("p_holm"))


@REG.add(
    _TWO + ", k as (select a, b, subject_no from x where a is not null and b is not null), u as (select subject_no, a as v, 0 as s from k union all select subject_no, b, 1 from k), "
    "g as (select avg(v) as gm, count(*) / 2 as n from u), sm as (select subject_no, avg(v) as m from u group by all), cm as (select s, avg(v) as m from u group by all), "
    "ss as (select sum(2 * pow(m - gm, 2)) as r from sm, g), cc as (select sum(n * pow(m - gm, 2)) as c from cm, g), tt as (select sum(pow(v - gm, 2)) as t from u, g) "
    "select n::bigint as n, round((r / (n - 1) - (t - r - c) / (n - 1)) / (r / (n - 1) + (t - r - c) / (n - 1)), 6) as icc from ss, cc, tt, g"
)
def icc_two_sessions(t: Tables) -> DataFrame:
    """Agreement of two sessions, ICC(3,1) (STA2)."""
    return S.icc31(_two_sessions(t), [], "subject_no", "a", "b").select("n", F.round("icc", 6).alias("icc"))


@REG.add()
def icc_limits(t: Tables) -> DataFrame:
    """The F-based interval of that agreement and its verdict (STA3, STA6)."""
    r = S.icc_interval(S.icc31(_two_sessions(t), [], "subject_no", "a", "b"), "n", "icc")
    return r.select("n", *[F.round(c, 6).alias(c) for c in ("icc", "low", "high")], (F.col("low") >= 0.4).alias("verdict"))


@REG.add(
    _TWO + ", k as (select * from x where a is not null and va is not null), l as (select regr_slope(a, va) as s, regr_intercept(a, va) as i from k) select subject_no, round(a - i - s * va, 5) as residual from k, l"
)
def ols_residuals(t: Tables) -> DataFrame:
    """What a pooled line on a covariate leaves (STA1, STA13)."""
    k = _two_sessions(t).filter("a is not null and va is not null").select("subject_no", "a", "va")
    line = k.agg(F.regr_slope("a", "va").alias("s"), F.regr_intercept("a", "va").alias("i")).first()
    return k.select("subject_no", F.round(F.col("a") - F.lit(line.i) - F.lit(line.s) * F.col("va"), 5).alias("residual"))


@REG.add(
    _FEAT + ", k as (select channel, (rank() over (partition by channel order by sd_uv) + count(*) over (partition by channel) + 1 - rank() over (partition by channel order by sd_uv desc)) / 2.0 as ra, "
    "(rank() over (partition by channel order by aperiodic_exponent) + count(*) over (partition by channel) + 1 - rank() over (partition by channel order by aperiodic_exponent desc)) / 2.0 as rb from f where aperiodic_exponent is not null and sd_uv is not null) "
    "select channel, count(*) as n, round(corr(ra, rb), 6) as rho from k group by all"
)
def spearman_sensitivity(t: Tables) -> DataFrame:
    """Rank correlation with average ranks (STA8, WIN14)."""
    f = _features(t).filter("aperiodic_exponent is not null")
    k = average_ranks(average_ranks(f, ["channel"], "sd_uv", "ra"), ["channel"], "aperiodic_exponent", "rb")
    return k.groupBy("channel").agg(F.count("*").alias("n"), F.round(F.corr("ra", "rb"), 6).alias("rho"))


@REG.add(
    _FEAT + ", w as (select rec_id, max(case when channel = 0 then alpha_theta_ratio end) as a, max(case when channel = 1 then alpha_theta_ratio end) as b from f group by all) "
    "select count(*) as n, round(corr(a, b), 6) as r, round(stddev_samp(a + b), 6) as sd_sum, round(stddev_samp(a - b), 6) as sd_diff, round(sqrt(var_pop(a - b)) / stddev_pop(b), 6) as rms_ratio from w where a is not null and b is not null"
)
def pair_correlation(t: Tables) -> DataFrame:
    """Two channels: correlation, spread of sum and difference, centred RMS ratio (TL5, TL11, STA9)."""
    at = lambda c: F.max(F.when(F.col("channel") == c, F.col("alpha_theta_ratio")))
    w = _features(t).groupBy("rec_id").agg(at(0).alias("a"), at(1).alias("b")).filter("a is not null and b is not null")
    a, b = F.col("a"), F.col("b")
    return w.agg(
        F.count("*").alias("n"), F.round(F.corr("a", "b"), 6).alias("r"), F.round(F.stddev_samp(a + b), 6).alias("sd_sum"),
        F.round(F.stddev_samp(a - b), 6).alias("sd_diff"), F.round(F.sqrt(F.var_pop(a - b)) / F.stddev_pop("b"), 6).alias("rms_ratio"),
    )


@REG.add(
    _SUP + " select l_suppkey % 10 as grp, round(max(greatest(abs(m0 - 25) / 2, abs(m1 - 5) / 1, abs(m2 - 4) / 1)), 6) as excursion, round(avg((abs(m0 - 25) > 1)::int), 6) as beyond from s group by all"
)
def largest_excursion(t: Tables) -> DataFrame:
    """The largest scaled excursion of several parameters, and the share beyond a limit (TL6, TL7)."""
    far = F.greatest(F.abs(F.col("m0") - 25) / 2, F.abs(F.col("m1") - 5), F.abs(F.col("m2") - 4))
    return _suppliers(t).groupBy((F.col("l_suppkey") % 10).alias("grp")).agg(
        F.round(F.max(far), 6).alias("excursion"), F.round(F.avg((F.abs(F.col("m0") - 25) > 1).cast("int")), 6).alias("beyond")
    )


@REG.add(
    "with m as (select avg(l_quantity) as mq, stddev_pop(l_quantity) as sq, avg(l_discount) as md, stddev_pop(l_discount) as sd, avg(l_tax) as mt, stddev_pop(l_tax) as st from lineitem), "
    "z as (select l_suppkey, (l_quantity - mq) / sq as a, (l_discount - md) / sd as b, (l_tax - mt) / st as c from lineitem, m) "
    "select l_suppkey, round(avg(a), 6) as a, round(avg(a * b), 6) as ab, round(avg(a * c), 6) as ac, round(avg(b * c), 6) as bc from z group by all"
)
def zscore_design(t: Tables) -> DataFrame:
    """z-scores over the table and their products, averaged by supplier (PRJ4, PRJ5)."""
    z = S.zscores(t.lineitem.select("l_suppkey", "l_quantity", "l_discount", "l_tax"), ["l_quantity", "l_discount", "l_tax"])
    a, b, c = F.col("z_l_quantity"), F.col("z_l_discount"), F.col("z_l_tax")
    means = {"a": a, "ab": a * b, "ac": a * c, "bc": b * c}
    return z.groupBy("l_suppkey").agg(*[F.round(F.avg(e), 6).alias(n) for n, e in means.items()])


@REG.add(
    "with k as (select l_suppkey, avg(case when l_linenumber > 1 then l_quantity end) as score, count(*) as n from lineitem group by all) "
    "select l_suppkey % 5 as fold, round(avg(score), 6) as headline, round(sum(score * n) / sum(n), 6) as pooled from k where score is not null group by all"
)
def mean_of_means(t: Tables) -> DataFrame:
    """Masked means by subject, then their plain and weighted mean (AGG5, AGG6, AGG8)."""
    k = t.lineitem.groupBy("l_suppkey").agg(F.avg(F.when(F.col("l_linenumber") > 1, F.col("l_quantity"))).alias("score"), F.count("*").alias("n"))
    return k.filter("score is not null").groupBy((F.col("l_suppkey") % 5).alias("fold")).agg(
        F.round(F.avg("score"), 6).alias("headline"), F.round(F.sum(F.col("score") * F.col("n")) / F.sum("n"), 6).alias("pooled")
    )


@REG.add(
    "select l_linestatus, l_returnflag, count(*) as n, count_if(l_quantity > 45)::bigint as diverged, count_if(l_quantity > 45) * 100 > count(*) * 10 as excess, min(l_tax) as least, bool_and(l_discount <= 0.1) as ok from lineitem group by all"
)
def divergence_counts(t: Tables) -> DataFrame:
    """Counts of a flag, an exact limit, extremes and an all-zero verdict (AGG7, AGG14, AGG18, STA12)."""
    hit = F.count_if(F.col("l_quantity") > 45)
    return t.lineitem.groupBy("l_linestatus", "l_returnflag").agg(
        F.count("*").alias("n"), hit.alias("diverged"), R.exceeds(hit, F.count("*"), 10, 100).alias("excess"), F.min("l_tax").alias("least"),
        F.bool_and(F.col("l_discount") <= 0.1).alias("ok"),
    )


@REG.add(
    _FEAT + ", b as (select rec_id, bool_or(sd_uv > 100) as bad from f group by all), r as (select distinct rec_id, " + _NUM + " as subject_no from recordings) "
    "select count_if(bad)::bigint as recordings, count(distinct case when bad then subject_no end) as subjects from b join r using (rec_id)"
)
def flag_summary(t: Tables) -> DataFrame:
    """Recordings and subjects with at least one bad channel (AGG20)."""
    b = _features(t).groupBy("rec_id").agg(F.bool_or(F.col("sd_uv") > 100).alias("bad"))
    r = t.recordings.select("rec_id", codes.subject_number(F.col("subject")).alias("subject_no")).distinct()
    return b.join(r, "rec_id").agg(F.count_if("bad").alias("recordings"), F.countDistinct(F.when(F.col("bad"), F.col("subject_no"))).alias("subjects"))


#: Resamples of every bootstrap.
_B = 10_000
_MIX = "((b * 48271 + slot * 69621 + 12345) % 2147483647 * 16807 + b) % 2147483647"


def _drawn(source: str, key: str, b: int) -> str:
    """CTEs ``k`` (numbered rows) and ``d`` (rows of every resample) over a CTE ``source``."""
    return (
        f", k as (select *, row_number() over (order by {key}) - 1 as i, count(*) over () as n_all from {source}), "
        f"w as (select b, i as slot, n_all as n from k, (select unnest(range({b})) as b)), h1 as (select b, n, {_MIX} as h from w), "
        "h2 as (select b, n, xor(h, h >> 15) * 48271 % 2147483647 as h from h1), h3 as (select b, n, xor(h, h >> 13) * 69621 % 2147483647 as h from h2), "
        "w2 as (select b, xor(h, h >> 16) * 16807 % 2147483647 % n as i from h3), "
        "d as (select w2.b, k.* from w2 join k using (i))"
    )


@REG.add(
    _SUP + _drawn("s", "l_suppkey", _B) + ", g as (select b, avg(m1 - m2) as x from d group by all) "
    "select round(quantile_cont(x, 0.025), 9) as low, round(quantile_cont(x, 0.975), 9) as high, round(least(1.0, (2 * least(count_if(x <= 0), count_if(x >= 0)) + 2) / (2.0 * count(*) + 2)), 9) as p, quantile_cont(x, 0.975) < 0 as verdict from g"
)
def paired_bootstrap(t: Tables) -> DataFrame:
    """Percentile interval and two-sided p of a paired difference (SMP6, SMP7, JN11, STA5)."""
    sums = S.resampled_sums(_suppliers(t).withColumn("d", F.col("m1") - F.col("m2")), "l_suppkey", ["d"], _B)
    d = sums.select((F.col("d") / F.col("n_d")).alias("d"))
    q = F.percentile("d", F.array(F.lit(0.025), F.lit(0.975)))
    two = 2 * F.least(F.count_if(F.col("d") <= 0), F.count_if(F.col("d") >= 0)) + 2
    g = d.agg(q.alias("q"), (two / (2.0 * F.count("*") + 2)).alias("p"))
    low, high = F.round(F.col("q")[0], 9), F.round(F.col("q")[1], 9)
    return g.select(low.alias("low"), high.alias("high"), F.round(F.least(F.lit(1.0), F.col("p")), 9).alias("p"), (F.col("q")[1] < 0).alias("verdict"))


@REG.add(
    _SUP + _drawn("s", "l_suppkey", _B) + ", g as (select b, sum(q) / sum(d.n) as x from d group by all) "
    "select round(quantile_cont(x, 0.025), 9) as low, round(quantile_cont(x, 0.5), 9) as mid, round(quantile_cont(x, 0.975), 9) as high from g"
)
def cluster_bootstrap(t: Tables) -> DataFrame:
    """Interval of a ratio of cluster sums to cluster counts (SMP8)."""
    sums = S.resampled_sums(_suppliers(t).select("l_suppkey", "q", F.col("n").alias("rows")), "l_suppkey", ["q", "rows"], _B)
    g = sums.select((F.col("q") / F.col("rows")).alias("d")).agg(F.percentile("d", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("q"))
    return g.select(*[F.round(F.col("q")[i], 9).alias(c) for i, c in enumerate(("low", "mid", "high"))])


@REG.add(
    _SUP + _drawn("s", "l_suppkey", _B) + ", g as (select b, avg(m0) / avg(m1) as x from d group by all) "
    "select round(quantile_cont(x, 0.025), 9) as low, round(quantile_cont(x, 0.975), 9) as high, quantile_cont(x, 0.975) <= 1.2 as ok from g"
)
def ratio_bootstrap(t: Tables) -> DataFrame:
    """Interval of a ratio of means over the same resample (SMP9); as in SQL, infinite over a mean of 0."""
    sums = S.resampled_sums(_suppliers(t), "l_suppkey", ["m0", "m1"], _B)
    m0, m1 = F.col("m0") / F.col("n_m0"), F.col("m1") / F.col("n_m1")
    ratio = F.when(F.col("m1") == 0, m0 * F.lit(float("inf"))).otherwise(m0 / m1)
    g = sums.select(ratio.alias("d")).agg(F.percentile("d", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return g.select(F.round(F.col("q")[0], 9).alias("low"), F.round(F.col("q")[1], 9).alias("high"), (F.col("q")[1] <= 1.2).alias("ok"))


@REG.add()
def icc_bootstrap(t: Tables) -> DataFrame:
    """Interval of the agreement of two sessions; undefined resamples are dropped and counted (SMP10, STA6)."""
    d = S.resampled_icc(_two_sessions(t), "subject_no", "a", "b", _B)
    g = d.agg(F.percentile("icc", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.count_if(F.col("icc").isNull()).alias("dropped"))
    return g.select(F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "dropped", (F.col("q")[0] >= 0.4).alias("verdict"))


@REG.add(
    _SUP + ", k as (select l_suppkey % 10 as grp, count_if(m0 >= 25.5) as k, count(*) as n from s group by all) select grp, n, round((1 + k) / (n + 1), 9) as p from k"
)
def surrogate_p(t: Tables) -> DataFrame:
    """(1 + exceedances) / (n + 1) (STA7)."""
    k = _suppliers(t).groupBy((F.col("l_suppkey") % 10).alias("grp")).agg(F.count_if(F.col("m0") >= 25.5).alias("k"), F.count("*").alias("n"))
    return k.select("grp", "n", F.round((1 + F.col("k")) / (F.col("n") + 1), 9).alias("p"))


@REG.add()
def binomial_limits(t: Tables) -> DataFrame:
    """Clopper–Pearson limits of the share of failed checks by unit text (STA4, TL1)."""
    u = F.coalesce(F.lower(F.trim("unit_text")), F.lit(""))
    k = t.units_checks.distinct().groupBy(u.alias("unit_text")).agg(F.count_if(~F.col("passed")).alias("k"), F.count("passed").alias("n"))
    return S.binomial_interval(k, "k", "n").select("unit_text", "k", "n", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


@REG.add(
    "with p as (select l_suppkey, greatest(least(0.01 * l_linenumber * 10, 0.5), 0) as m, l_quantity as y1, l_extendedprice / 1000 as y2 from lineitem) "
    "select l_suppkey, round(avg(25 + (y1 - 25) + m * (y2 - 25)), 5) as o1, round(avg(25 + m * (y1 - 25) + (y2 - 25)), 5) as o2, round(avg(2 * 2.5 / (1 + exp(0.56 * (6 - y1)))), 6) as s from p group by all"
)
def mixing_and_sigmoid(t: Tables) -> DataFrame:
    """Two channels mixed by a clipped share, and a sigmoid (PRJ7, PRJ8, PRJ9)."""
    m = F.greatest(F.least(F.lit(0.01) * F.col("l_linenumber") * 10, F.lit(0.5)), F.lit(0))
    y1, y2 = F.col("l_quantity"), F.col("l_extendedprice") / 1000
    return t.lineitem.groupBy("l_suppkey").agg(
        F.round(F.avg(25 + (y1 - 25) + m * (y2 - 25)), 5).alias("o1"), F.round(F.avg(25 + m * (y1 - 25) + (y2 - 25)), 5).alias("o2"),
        F.round(F.avg(2 * 2.5 / (1 + F.exp(0.56 * (6 - y1)))), 6).alias("s"),
    )


@REG.add("select p_partkey, round(sqrt(p_retailprice * p_size), 6) as a, round(sqrt(p_retailprice / p_size), 6) as b from part where p_size > 0")
def product_and_ratio(t: Tables) -> DataFrame:
    """A pair of parameters from its product and ratio (PRJ10)."""
    return t.part.filter("p_size > 0").select(
        "p_partkey", F.round(F.sqrt(F.col("p_retailprice") * F.col("p_size")), 6).alias("a"), F.round(F.sqrt(F.col("p_retailprice") / F.col("p_size")), 6).alias("b")
    )


@REG.add(
    "select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(tanh(l_discount) * l_quantity + exp(0 - l_tax) / (1 + l_quantity), 6) as y from lineitem"
)
def equation_values(t: Tables) -> DataFrame:
    """A stored equation evaluated on columns (PRJ11)."""
    f = regress.equation("tanh(u_tgt) * u_src + exp(0 - S_src) / (1 + u_src)", {"u_tgt": "l_discount", "u_src": "l_quantity", "S_src": "l_tax"})
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(f, 6).alias("y"))


@REG.add(
    "select rec_id, case when isnan(median_sd_uv) or isinf(median_sd_uv) then null else median_sd_uv end as v, passed is null as pending from (select distinct check_id, rec_id, median_sd_uv, passed from units_checks)"
)
def json_hygiene(t: Tables) -> DataFrame:
    """NaN and infinite values as null, states picked from a record (PRJ13, PRJ14)."""
    v = F.col("median_sd_uv")
    return t.units_checks.select("check_id", "rec_id", "median_sd_uv", "passed").distinct().select(
        "rec_id", F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v).alias("v"), F.col("passed").isNull().alias("pending")
    )


@REG.add()
def var_order(t: Tables) -> DataFrame:
    """Order, 1 to 32, of the autoregression of both channels by cross-validation over subjects (STA10, AGG21, TOP1)."""
    return regress.cross_validated_order(t.samples, t.recordings)


@REG.add()
def var_scores(t: Tables) -> DataFrame:
    """One-step prediction error of each recording under the pooled fit of that order (STA10, STA11)."""
    return regress.scores(t.samples, t.recordings).select("rec_id", F.round("mse", 9).alias("mse"), "n")
