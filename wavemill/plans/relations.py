"""Queries on the tables around the recordings: key matches, set operations, checks, selection, sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavemill.functions import codes
from wavemill.operators import rules as R
from wavemill.operators.blocks import placed
from wavemill.plans.registry import Registry, Tables

REG = Registry()

_NUM = r"try_cast(regexp_extract(subject, '(\d+)\D*$', 1) as bigint)"
_SES = r"'ses-t' || ltrim(regexp_extract(session, '(\d+)\D*$', 1), '0')"
_REC = (
    f"with r as (select distinct rec_id, {_NUM} as subject_no, {_SES} as ses, wave, n_bytes, rel_path, sha256, fs_hz, device_id from recordings)"
)


def _recordings(t: Tables) -> DataFrame:
    return t.recordings.select(
        "rec_id", codes.subject_number(F.col("subject")).alias("subject_no"), codes.session_code(F.col("session")).alias("ses"),
        "wave", "n_bytes", "rel_path", "sha256", "fs_hz", "device_id",
    ).distinct()


@REG.add(
    "with m as (select rel_path, max(row(listed_at, coalesce(sha256, ''), coalesce(n_bytes, -1))) as v from manifest_files group by all), "
    "w as (select rel_path, max(row(seen_at, coalesce(sha256, ''), coalesce(n_bytes, -1))) as v from mirror_files group by all) "
    "select coalesce(m.rel_path, w.rel_path) as rel_path, case when w.rel_path is null then 'missing' when m.rel_path is null then 'unexpected' "
    "when m.v[3] <> w.v[3] then 'size' when m.v[2] <> w.v[2] then 'hash' else 'ok' end as status from m full join w on m.rel_path = w.rel_path"
)
def manifest_full_outer(t: Tables) -> DataFrame:
    """Latest listing against latest scan, as written: missing, unexpected, size, then hash (JN6, FLT15). Of equally late
    ones the greatest digest and size hold together."""

    def last(df: DataFrame, at: str) -> DataFrame:
        whole = F.struct(F.col(at).alias("at"), F.coalesce("sha256", F.lit("")).alias("sha256"), F.coalesce("n_bytes", F.lit(-1)).alias("n_bytes"))
        return df.groupBy("rel_path").agg(F.max(whole).alias("v"))

    m, w = last(t.manifest_files, "listed_at"), last(t.mirror_files, "seen_at").select(F.col("rel_path").alias("p"), F.col("v").alias("u"))
    j = m.join(w, F.col("rel_path") == F.col("p"), "full_outer")
    rules = {"missing": F.col("p").isNull(), "unexpected": F.col("rel_path").isNull(), "size": F.col("v.n_bytes") != F.col("u.n_bytes"), "hash": F.col("v.sha256") != F.col("u.sha256")}
    return j.select(F.coalesce("rel_path", "p").alias("rel_path"), R.first_reason(rules).alias("status"))


@REG.add(
    "select 'local' as side, rel_path from (select distinct rel_path from manifest_files) where rel_path not in (select rel_path from mirror_files) "
    "union all select 'remote', rel_path from (select distinct rel_path from mirror_files) where rel_path not in (select rel_path from manifest_files)"
)
def listing_anti(t: Tables) -> DataFrame:
    """Paths as written that only one listing has (JN7, SET3, SET4)."""
    a, b = t.manifest_files.select("rel_path").distinct(), t.mirror_files.select("rel_path").distinct()
    one = a.join(b, "rel_path", "left_anti").select(F.lit("local").alias("side"), "rel_path")
    return one.unionByName(b.join(a, "rel_path", "left_anti").select(F.lit("remote").alias("side"), "rel_path"))


@REG.add(
    "with keep as (select distinct rel_path from manifest_files where rel_path like '%.edf' and not contains(rel_path, 'sub-000077')) "
    "select rel_path from keep union select distinct rel_path from manifest_files where rel_path like '%ses-t1/%.json'"
)
def include_exclude_union(t: Tables) -> DataFrame:
    """Include less exclude, with the essentials (SRC6, SET1, SET5)."""
    p = t.manifest_files.select("rel_path")
    keep = p.filter(F.col("rel_path").endswith(".edf") & ~F.col("rel_path").contains("sub-000077"))
    return keep.unionByName(p.filter(F.col("rel_path").rlike(r"ses-t1/.*\.json$"))).distinct()


@REG.add(
    _REC + f", plan as (select distinct {_NUM} as subject_no from subject_plans where mode = 'pilot') "
    "select rec_id, subject_no, subject_no in (select subject_no from plan) as allowed from r"
)
def allow_list_semi(t: Tables) -> DataFrame:
    """Recordings inside and outside the pilot's allow-list (FLT9, DRV3)."""
    plan = t.subject_plans.filter("mode = 'pilot'").select(codes.subject_number(F.col("subject")).alias("subject_no")).distinct()
    r = _recordings(t).select("rec_id", "subject_no")
    inside = r.join(plan, "subject_no", "left_semi").withColumn("allowed", F.lit(True))
    return inside.unionByName(r.join(plan, "subject_no", "left_anti").withColumn("allowed", F.lit(False)))


@REG.add(
    _REC + ", p as (select subject_no, count(distinct ses) as k from r group by all) "
    "select count(*) as subjects, count_if(k > 1)::bigint as more_sessions, (select count(distinct rec_id) from r) as recordings, (select count(distinct rel_path) from r) as paths from p"
)
def domain_counts(t: Tables) -> DataFrame:
    """The counts a dataset is checked against (FLT10)."""
    r = _recordings(t)
    count = F.countDistinct
    p = r.groupBy("subject_no").agg(count("ses").alias("k"), count("rec_id").alias("r"), count("rel_path").alias("p"))
    return p.agg(
        F.count("*").alias("subjects"), F.count_if(F.col("k") > 1).alias("more_sessions"), F.sum("r").alias("recordings"), F.sum("p").alias("paths")
    )


@REG.add(
    f"with p as (select {_NUM} as n, case when lower(trim(plan_partition)) in ('train', 'training') then 'train' when lower(trim(plan_partition)) in ('validation', 'valid', 'val') then 'validation' when lower(trim(plan_partition)) = 'test' then 'test' end as part from subject_plans) "
    "select n as subject_no, count(distinct part) as parts, bool_or(part = 'train') and bool_or(part = 'test') as overlap from p where part is not null group by all"
)
def split_validation(t: Tables) -> DataFrame:
    """Subjects of a plan in more than one partition (FLT11, SET2)."""
    p = t.subject_plans.select(codes.subject_number(F.col("subject")).alias("subject_no"), codes.partition_name(F.col("plan_partition")).alias("part"))
    return p.filter("part is not null").groupBy("subject_no").agg(
        F.countDistinct("part").alias("parts"), (F.bool_or(F.col("part") == "train") & F.bool_or(F.col("part") == "test")).alias("overlap")
    )


@REG.add(
    f"with p as (select distinct {_NUM} as n, case when lower(trim(plan_partition)) in ('train', 'training') then 'train' when lower(trim(plan_partition)) in ('validation', 'valid', 'val') then 'validation' when lower(trim(plan_partition)) = 'test' then 'test' end as part from subject_plans) "
    "select part, count(*) as subjects, sum(n * 48271 % 1000003)::bigint as checksum from p where part is not null and n is not null group by all"
)
def split_sizes(t: Tables) -> DataFrame:
    """Subjects of each partition and a checksum of them in any order, to hold against a stored split (FLT11)."""
    p = t.subject_plans.select(codes.subject_number(F.col("subject")).alias("n"), codes.partition_name(F.col("plan_partition")).alias("part"))
    p = p.filter("part is not null and n is not null").distinct()
    return p.groupBy("part").agg(F.count("*").alias("subjects"), F.sum(F.col("n") * 48271 % 1000003).alias("checksum"))


@REG.add(
    "with f as (select distinct name, rec_id, channel, sd_uv, alpha_peak_hz, alpha_theta_ratio, aperiodic_exponent from features) "
    "select rec_id, channel, sd_uv, alpha_peak_hz from f where sd_uv is not null and alpha_peak_hz is not null and alpha_theta_ratio is not null and aperiodic_exponent is not null and sd_uv > 0"
)
def valid_features(t: Tables) -> DataFrame:
    """Distinct feature rows without a gap (FLT12, FLT13)."""
    return _features(t).select("rec_id", "channel", "sd_uv", "alpha_peak_hz")


def _features(t: Tables) -> DataFrame:
    cols = ["sd_uv", "alpha_peak_hz", "alpha_theta_ratio", "aperiodic_exponent"]
    f = t.features.select("name", "rec_id", "channel", *cols).distinct()
    return f.filter(" and ".join(f"{c} is not null and not isnan({c})" for c in cols) + " and sd_uv > 0")


@REG.add(
    "with b as (select *, min(p_retailprice) over (partition by p_brand order by p_size, p_retailprice, p_partkey rows between unbounded preceding and 1 preceding) as best from part) "
    "select p_brand, p_partkey, p_size, p_retailprice from b where best is null or p_retailprice < best"
)
def pareto_front(t: Tables) -> DataFrame:
    """Entries that beat every simpler one (FLT14)."""
    return R.pareto(t.part, ["p_brand"], "p_size", "p_retailprice", "p_partkey").select("p_brand", "p_partkey", "p_size", "p_retailprice")


@REG.add(
    "with m as (select *, min(p_retailprice) over (partition by p_brand) as least from part), "
    "k as (select *, row_number() over (partition by p_brand order by p_size, p_retailprice, p_partkey) as k from m where p_retailprice * 100 <= least * 105) "
    "select p_brand, p_partkey, p_size from k where k = 1"
)
def select_within_tolerance(t: Tables) -> DataFrame:
    """The least complex entry within 5 % of the best (TOP3)."""
    return R.within_tolerance(t.part, ["p_brand"], "p_size", "p_retailprice", 5, "p_partkey").select("p_brand", "p_partkey", "p_size")


@REG.add(
    "with g as (select p_brand, p_size, median(p_retailprice) as m from part group by all) "
    "select p_brand, arg_min(p_size, (m, p_size)) as smallest, arg_min(p_size, (m, -p_size)) as largest from g group by all"
)
def tie_rules(t: Tables) -> DataFrame:
    """Least median; ties once to the smaller and once to the larger parameter (TOP1, TOP2, TOP4)."""
    g = t.part.groupBy("p_brand", "p_size").agg(F.median("p_retailprice").alias("m"))
    return g.groupBy("p_brand").agg(
        F.min_by("p_size", F.struct("m", "p_size")).alias("smallest"), F.min_by("p_size", F.struct(F.col("m"), (-F.col("p_size")).alias("_n"))).alias("largest")
    )


@REG.add(
    _REC + ", f as (select rec_id, avg(sd_uv) as sd from (select distinct rec_id, channel, sd_uv from features where sd_uv > 0) group by all), "
    "x as (select subject_no, max(case when ses = 'ses-t1' then sd end) as a, max(case when ses = 'ses-t2' then sd end) as b, bool_or(ses = 'ses-t1') as t1, bool_or(ses = 'ses-t2') as t2 from r left join f using (rec_id) group by all) "
    "select subject_no, case when not t1 then 'no_t1' when not t2 then 'no_t2' when a is null or b is null then 'no_value' else 'paired' end as reason, round(b - a, 6) as diff from x"
)
def session_pairs(t: Tables) -> DataFrame:
    """Session 1 with session 2 of each subject, or the reason why not (JN2)."""
    f = t.features.filter("sd_uv > 0").select("rec_id", "channel", "sd_uv").distinct().groupBy("rec_id").agg(F.avg("sd_uv").alias("sd"))
    r = _recordings(t).join(f, "rec_id", "left")
    at = lambda s: F.max(F.when(F.col("ses") == s, F.col("sd")))
    x = r.groupBy("subject_no").agg(
        at("ses-t1").alias("a"), at("ses-t2").alias("b"), F.bool_or(F.col("ses") == "ses-t1").alias("t1"), F.bool_or(F.col("ses") == "ses-t2").alias("t2")
    )
    rules = {"no_t1": ~F.col("t1"), "no_t2": ~F.col("t2"), "no_value": F.col("a").isNull() | F.col("b").isNull()}
    return x.select("subject_no", R.first_reason(rules, "paired").alias("reason"), F.round(F.col("b") - F.col("a"), 6).alias("diff"))


@REG.add(
    _REC + ", k as (select subject_no, ses, bool_and(n_bytes > 0) as ok from r group by all), a as (select * from k where ses = 'ses-t1'), b as (select * from k where ses = 'ses-t2') "
    "select a.subject_no, a.ok as t1, case when not a.ok then false else coalesce(b.ok, false) end as t2, case when not a.ok then 'excluded' when b.ok then 'both' else 'first_only' end as status from a left join b on a.subject_no = b.subject_no"
)
def session_consequence(t: Tables) -> DataFrame:
    """A failed first session voids the second (JN3)."""
    k = _recordings(t).groupBy("subject_no", "ses").agg(F.bool_and(F.col("n_bytes") > 0).alias("ok"))
    a = k.filter("ses = 'ses-t1'").select("subject_no", F.col("ok").alias("t1"))
    b = k.filter("ses = 'ses-t2'").select("subject_no", F.col("ok").alias("_b"))
    second = F.when(~F.col("t1"), False).otherwise(F.coalesce("_b", F.lit(False)))
    status = F.when(~F.col("t1"), "excluded").when(F.col("_b"), "both").otherwise("first_only")
    return a.join(b, "subject_no", "left").select("subject_no", "t1", second.alias("t2"), status.alias("status"))


@REG.add(
    _REC + ", c as (select distinct check_id, rec_id, passed from units_checks), v as (select subject_no, wave, bool_and(coalesce(passed, false)) as ok from c join r using (rec_id) where subject_no is not null group by all), "
    "n as (select count(distinct wave) as n from v) select subject_no from v, n group by subject_no, n.n having bool_and(ok) and count(*) * 2 >= n.n"
)
def matched_in_every_variant(t: Tables) -> DataFrame:
    """Subjects with checks in at least half of all deliveries, every check of each of which passed (JN4)."""
    r = _recordings(t).select("rec_id", "subject_no", "wave").filter("subject_no is not null")
    c = t.units_checks.select("check_id", "rec_id", "passed").distinct().join(r, "rec_id")
    v = c.groupBy("subject_no", "wave").agg(F.bool_and(F.coalesce("passed", F.lit(False))).alias("ok"))
    n = v.agg(F.countDistinct("wave")).first()[0]  # one number
    return v.groupBy("subject_no").agg(F.bool_and("ok").alias("ok"), F.count("*").alias("k")).filter(F.col("ok") & (F.col("k") * 2 >= n)).select("subject_no")


@REG.add(
    _REC + ", a as (select distinct rec_id, channel, sd_uv from features), b as (select rec_id, channel, count(*) as n from (select distinct rec_id, channel, idx, data_uv from samples where data_uv is not null and not isnan(data_uv)) group by all) "
    "select coalesce(x.rec_id, y.rec_id) as rec_id, coalesce(x.channel, y.channel) as channel, x.k as features, y.n as samples, "
    "case when x.rec_id is null then 'no_features' when y.rec_id is null then 'no_samples' when x.k > 1 then 'several_features' when y.n < 100 then 'short' else 'joined' end as cover "
    "from (select rec_id, channel, count(*) as k from a group by all) x full join b y on x.rec_id = y.rec_id and x.channel = y.channel"
)
def score_cover(t: Tables) -> DataFrame:
    """Feature rows with the series they score, one to one, and why a side has no or no single partner (JN1)."""
    a = t.features.select("rec_id", "channel", "sd_uv").distinct().groupBy("rec_id", "channel").agg(F.count("*").alias("features"))
    s = t.samples.select("rec_id", "channel", "idx", "data_uv").filter("data_uv is not null and not isnan(data_uv)").distinct()
    b = s.groupBy("rec_id", "channel").agg(F.count("*").alias("samples"))
    rules = {"no_features": F.col("features").isNull(), "no_samples": F.col("samples").isNull(), "several_features": F.col("features") > 1, "short": F.col("samples") < 100}
    return a.join(b, ["rec_id", "channel"], "full_outer").select("rec_id", "channel", "features", "samples", R.first_reason(rules, "joined").alias("cover"))


_AXES = ((2.0, 10.0, 20.0, 40.0, 80.0), (8.0, 9.5, 11.0, 12.5), (0.5, 1.5, 3.0))
_GRID = [(i, a, b, c) for i, (a, b, c) in enumerate((a, b, c) for a in _AXES[0] for b in _AXES[1] for c in _AXES[2])]
_GRID_SQL = "(values " + ", ".join(f"({i}, {a}::double, {b}::double, {c}::double)" for i, a, b, c in _GRID) + ") as g(i, a, b, c)"
_DIST = "pow((sd_uv - a) / 20, 2) + pow((alpha_peak_hz - b) / 2, 2) + pow((alpha_theta_ratio - c) / 1, 2)"


@REG.add(
    "with f as (select distinct rec_id, channel, sd_uv, alpha_peak_hz, alpha_theta_ratio, aperiodic_exponent from features where sd_uv > 0 and alpha_peak_hz is not null and alpha_theta_ratio is not null and aperiodic_exponent is not null) "
    f"select rec_id, channel, arg_min(i, ({_DIST}, i))::int as point from f, {_GRID_SQL} group by rec_id, channel, sd_uv, alpha_peak_hz, alpha_theta_ratio"
)
def nearest_grid_point(t: Tables) -> DataFrame:
    """The nearest of a fixed grid's points, ties to the first; the grid is an array in the plan, no join (JN8, JN9, TL13)."""
    grid = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for i, a, b, c in _GRID])

    def far(g):
        return F.struct(
            (F.pow((F.col("sd_uv") - g.a) / 20, 2) + F.pow((F.col("alpha_peak_hz") - g.b) / 2, 2) + F.pow((F.col("alpha_theta_ratio") - g.c) / 1, 2)).alias("d"),
            g.i.alias("i"),
        )

    near = F.array_min(F.transform(grid, far))
    f = _features(t).select("rec_id", "channel", "sd_uv", "alpha_peak_hz", "alpha_theta_ratio", "aperiodic_exponent").distinct()
    return f.select("rec_id", "channel", near.i.alias("point"))


@REG.add("select f.rec_id, channel, greatest(alpha_theta_ratio, aperiodic_exponent, alpha_peak_hz / 10) as worst from (select distinct rec_id, channel, alpha_theta_ratio, aperiodic_exponent, alpha_peak_hz from features) f")
def worst_of_scores(t: Tables) -> DataFrame:
    """The greatest of three scores, without those that are missing (TOP8)."""
    f = t.features.select("rec_id", "channel", "alpha_theta_ratio", "aperiodic_exponent", "alpha_peak_hz").distinct()
    return f.select("rec_id", "channel", F.greatest("alpha_theta_ratio", "aperiodic_exponent", F.col("alpha_peak_hz") / 10).alias("worst"))


@REG.add(
    "with d as (select doc_id, tags from documents where tags is not null), n as (select count(*) as sets from d), e as (select distinct doc_id, unnest(tags) as element from d) "
    "select element, count(*) as n, count(*) * 10 >= any_value(sets) * 7 as stable from e, n where element is not null group by all"
)
def signature_recurrence(t: Tables) -> DataFrame:
    """In how many sets an element recurs (AGG17)."""
    return R.recurrence(t.documents.filter("tags is not null"), "doc_id", "tags").filter("element is not null")


@REG.add(
    "with c as (select distinct * from units_checks) select rec_id, count(*) as n, case when bool_or(not passed) then false when count_if(passed is null) > 0 then null else true end as verdict from c group by all"
)
def kleene_verdict(t: Tables) -> DataFrame:
    """False before unknown before true (AGG16)."""
    return t.units_checks.distinct().groupBy("rec_id").agg(F.count("*").alias("n"), R.kleene_and("passed").alias("verdict"))


@REG.add(
    "with c as (select distinct * from units_checks) select rec_id % 7 as grp, count_if(passed)::bigint as yes, count_if(not passed)::bigint as no, count_if(passed is null)::bigint as unknown from c group by all"
)
def crosstab_status(t: Tables) -> DataFrame:
    """Three-valued status counts in columns (AGG12, AGG13)."""
    p = F.col("passed")
    return t.units_checks.distinct().groupBy((F.col("rec_id") % 7).alias("grp")).agg(
        F.count_if(p).alias("yes"), F.count_if(~p).alias("no"), F.count_if(p.isNull()).alias("unknown")
    )


@REG.add(
    _REC + ", c as (select r.wave, c.check_id, passed from (select distinct check_id, rec_id, passed from units_checks) c join r using (rec_id)) "
    "select wave, count(*) as n, count_if(not passed)::bigint as failed, count_if(not passed) * 20 > count(*) as halt, case when count(*) < 20 then 'INCONCLUSIVE' when count_if(not passed) * 10 <= count(*) then 'PASS' else 'FAIL' end as outcome from c group by all"
)
def exact_fraction_halt(t: Tables) -> DataFrame:
    """Halt where strictly more than 5 % fail; three outcomes (FLT2, FLT16, TL3)."""
    r = _recordings(t).select("rec_id", "wave")
    c = t.units_checks.select("check_id", "rec_id", "passed").distinct().join(r, "rec_id")
    g = c.groupBy("wave").agg(F.count("*").alias("n"), F.count_if(~F.col("passed")).alias("failed"))
    return g.withColumn("halt", R.exceeds(F.col("failed"), F.col("n"), 1, 20)).withColumn(
        "outcome", R.three_outcomes(F.col("n"), 20, F.col("failed") * 10 <= F.col("n"))
    )


@REG.add(
    "with f as (select distinct rec_id, channel, sd_uv, alpha_peak_hz, alpha_theta_ratio from features) "
    "select rec_id, channel, concat_ws('+', case when sd_uv <= 0 or sd_uv > 500 then 'sd' end, case when alpha_peak_hz is null then 'peak' end, case when alpha_theta_ratio > 3 then 'ratio' end) as reasons from f"
)
def truth_label(t: Tables) -> DataFrame:
    """All reasons against a feature row (TL4)."""
    f = t.features.select("rec_id", "channel", "sd_uv", "alpha_peak_hz", "alpha_theta_ratio").distinct()
    rules = {"sd": (F.col("sd_uv") <= 0) | (F.col("sd_uv") > 500), "peak": F.col("alpha_peak_hz").isNull(), "ratio": F.col("alpha_theta_ratio") > 3}
    return f.select("rec_id", "channel", R.reasons(rules).alias("reasons"))


@REG.add(
    _REC + " select device_id % 4 as config, count_if(n_bytes = 0)::bigint as empty, count_if(n_bytes > 0)::bigint as filled from r group by all "
    "union all select -1, count_if(n_bytes = 0)::bigint, count_if(n_bytes > 0)::bigint from r"
)
def sensitivity_table(t: Tables) -> DataFrame:
    """Counts by configuration with a pooled row (TL2)."""
    cols = [F.count_if(F.col("n_bytes") == 0).alias("empty"), F.count_if(F.col("n_bytes") > 0).alias("filled")]
    r = _recordings(t).withColumn("config", F.col("device_id") % 4)
    return r.groupBy("config").agg(*cols).unionByName(r.agg(*cols).withColumn("config", F.lit(-1)))


@REG.add(
    _REC + ", q as (select rec_id, subject_no, row_number() over (partition by subject_no order by rec_id) as k, count(*) over (partition by subject_no) as n from r) "
    "select rec_id, subject_no, case when k > n - (2 * n + 5) // 10 then 'validation' else 'fit' end as side from q"
)
def time_split(t: Tables) -> DataFrame:
    """The last fifth of each subject's recordings, rounded half up in whole numbers (SMP4).

    Positions are taken in hash buckets, so that no task sorts a large subject.
    """
    r = _recordings(t).select("rec_id", "subject_no")
    b = r.withColumn("_span", F.floor(F.col("rec_id") / 4096))
    counts = b.groupBy("subject_no", "_span").agg(F.count("*").alias("_c"))
    w = Window.partitionBy("subject_no").orderBy("_span")
    offs = counts.withColumn("_o", F.sum("_c").over(w) - F.col("_c")).withColumn("n", F.sum("_c").over(Window.partitionBy("subject_no")))
    k = F.col("_o") + F.row_number().over(Window.partitionBy("subject_no", "_span").orderBy("rec_id"))
    q = b.join(offs, ["subject_no", "_span"]).withColumn("k", k)
    return q.select("rec_id", "subject_no", F.when(F.col("k") > F.col("n") - F.floor((2 * F.col("n") + 5) / 10), "validation").otherwise("fit").alias("side"))


@REG.add(
    f"with s as (select distinct {_NUM} as n from subject_plans), p as (select n, row_number() over (order by n * 7919 % 100003, n) - 1 as p, count(*) over () as c from s) "
    "select n as subject_no, (case when p < (c % 5) * (c // 5 + 1) then p // (c // 5 + 1) else (c % 5) + (p - (c % 5) * (c // 5 + 1)) // (c // 5) end)::int as fold from p"
)
def k_folds(t: Tables) -> DataFrame:
    """Five folds of drawn subjects, larger ones first (SMP2, SMP3, SMP12).

    The drawn order is ranked over ranges of the drawn value, never in one task.
    """
    s = t.subject_plans.select(codes.subject_number(F.col("subject")).alias("n")).distinct().withColumn("d", F.col("n") * 7919 % 100003)
    s = s.withColumn("b", F.floor(F.col("d") / 512))
    counts = s.groupBy("b").agg(F.count("*").alias("c_b"))  # at most 196 rows
    w = Window.partitionBy(F.lit(1)).orderBy("b")
    offs = counts.withColumn("o", F.sum("c_b").over(w) - F.col("c_b")).withColumn("c", F.sum("c_b").over(Window.partitionBy(F.lit(1))))
    p = s.join(F.broadcast(offs), "b").withColumn("p", F.col("o") + F.row_number().over(Window.partitionBy("b").orderBy("d", "n")) - 1)
    big, few = F.col("c") % 5, F.floor(F.col("c") / 5)
    fold = F.when(F.col("p") < big * (few + 1), F.floor(F.col("p") / (few + 1))).otherwise(big + F.floor((F.col("p") - big * (few + 1)) / few))
    return p.select(F.col("n").alias("subject_no"), fold.cast("int").alias("fold"))


_BUDGET = 2  # rows for each subject on average


@REG.add(
    _REC + ", r1 as (select distinct rec_id, subject_no from r where subject_no is not null), g as (select subject_no, count(*) as n from r1 group by all), tot as (select count(*) * 2 as budget from g), "
    "lv as (select distinct n as level from g), f as (select level, sum(least(n, level)) as used, count_if(n > level) as more from lv, g group by all), "
    "best as (select max(case when used <= budget then level end) as level, any_value(budget) as budget from f, tot), "
    "b2 as (select coalesce(best.level, 0) as level, budget, coalesce((select used from f where f.level = best.level), 0) as used, coalesce((select more from f where f.level = best.level), (select count(*) from g)) as more from best), "
    "lev as (select level + case when more > 0 then (budget - used) // more else 0 end as fill, case when more > 0 then (budget - used) % more else 0 end as extra from b2), "
    "w as (select subject_no, n, fill, extra, row_number() over (order by (n > fill) desc, subject_no * 7919 % 100003, subject_no) as k from g, lev), "
    "qt as (select subject_no, least(n, fill) + case when n > fill and k <= extra then 1 else 0 end as quota from w), "
    "o as (select r1.*, row_number() over (partition by subject_no order by rec_id * 31 % 1009, rec_id) as k from r1) "
    "select rec_id, subject_no from o join qt using (subject_no) where k <= quota"
)
def equal_quota(t: Tables) -> DataFrame:
    """Drawn recordings under a budget of two for each subject on average, in equal quotas: what small subjects leave
    goes to larger ones, the remainder to drawn subjects (SMP5)."""
    r = _recordings(t).select("rec_id", "subject_no").filter("subject_no is not null").distinct()
    return R.equal_quotas(r, "subject_no", "rec_id", _BUDGET)


@REG.add(
    f"with s as (select {_NUM} as n, max(case when mode = 'pilot' then 1 else 0 end) as pilot, count(distinct {_SES}) > 1 as t2 from subject_plans where {_NUM} is not null group by 1), "
    "p as (select *, row_number() over (partition by pilot, t2 order by n * 48271 % 2147483647, n) as k, count(*) over (partition by pilot, t2) as c from s) "
    "select n as subject_no, pilot = 1 as is_pilot, t2 as has_t2, case when pilot = 0 and k <= (3 * c + 5) // 10 then 'test' when pilot = 0 and k <= (3 * c + 5) // 10 + (c - (3 * c + 5) // 10) // 5 then 'validation' else 'train' end as side from p"
)
def train_test_split(t: Tables) -> DataFrame:
    """Subjects to sides in exact numbers by stratum (pilot or not, second session or not): a seeded order, three tenths
    to test, a fifth of the rest to validation, pilots always in train (SMP1, SMP3, SMP11)."""
    s = t.subject_plans.groupBy(codes.subject_number(F.col("subject")).alias("subject_no")).agg(
        F.bool_or(F.coalesce(F.col("mode") == "pilot", F.lit(False))).alias("is_pilot"), (F.countDistinct(codes.session_code(F.col("session"))) > 1).alias("has_t2")
    )
    drawn = s.filter("subject_no is not null").withColumn("_d", F.col("subject_no") * 48271 % 2147483647 * 1_000_000_000 + F.col("subject_no") % 1_000_000_000)
    p = placed(drawn, ["is_pilot", "has_t2"], "_d", 1 << 52, "_k").join(drawn.groupBy("is_pilot", "has_t2").agg(F.count("*").alias("_c")), ["is_pilot", "has_t2"])
    test = F.floor((3 * F.col("_c") + 5) / 10)
    held = test + F.floor((F.col("_c") - test) / 5)
    side = F.when(F.col("is_pilot") | (F.col("_k") > held), "train").when(F.col("_k") <= test, "test").otherwise("validation")
    return p.select("subject_no", "is_pilot", "has_t2", side.alias("side"))


@REG.add(
    _REC + " select rec_id, sha256(concat_ws('|', rec_id::varchar, subject_no::varchar, ses, n_bytes::varchar)) as key from r"
)
def content_key(t: Tables) -> DataFrame:
    """A key over what a result depends on (CAT2, SRC5, DRV14)."""
    text = F.concat_ws("|", F.col("rec_id").cast("string"), F.col("subject_no").cast("string"), "ses", F.col("n_bytes").cast("string"))
    return _recordings(t).select("rec_id", F.sha2(text, 256).alias("key"))


@REG.add(_REC + " select rec_id from r where rec_id not in (select rec_id from features)")
def cache_anti_join(t: Tables) -> DataFrame:
    """Work that no stored result covers (CAT1, CAT4)."""
    return _recordings(t).select("rec_id").join(t.features.select("rec_id").distinct(), "rec_id", "left_anti")


@REG.add(
    "with d as (select distinct * from units_checks), k as (select rec_id, count(*) as claims from d group by all) select rec_id, claims, claims > 1 as blocked from k"
)
def ledger_conflicts(t: Tables) -> DataFrame:
    """Keys that more than one entry claims (CAT3, JN12)."""
    return t.units_checks.distinct().groupBy("rec_id").agg(F.count("*").alias("claims")).withColumn("blocked", F.col("claims") > 1)


@REG.add(
    r"select rel_path, split_part(rel_path, '/', 1) as subject, split_part(rel_path, '/', 2) as session, regexp_extract(rel_path, '\.([a-z]+)$', 1) as suffix from (select distinct rel_path from manifest_files)"
)
def path_parts(t: Tables) -> DataFrame:
    """Subject and session from a path (PRJ15, SRC4)."""
    p = t.manifest_files.select("rel_path").distinct()
    part = F.split("rel_path", "/")
    return p.select("rel_path", part[0].alias("subject"), part[1].alias("session"), F.regexp_extract("rel_path", r"\.([a-z]+)$", 1).alias("suffix"))


@REG.add(
    "with p as (select distinct plan_id, subject, session, wave, listed_at from subject_plans) select wave, count(*) as n, strftime(max(listed_at), '%Y-%m-%d') as latest from p group by all"
)
def plan_waves(t: Tables) -> DataFrame:
    """Rows and latest listing of each wave, in canonical order (TOP9, DRV18)."""
    p = t.subject_plans.select("plan_id", "subject", "session", "wave", "listed_at").distinct()
    return p.groupBy("wave").agg(F.count("*").alias("n"), F.date_format(F.max("listed_at"), "yyyy-MM-dd").alias("latest"))


@REG.add(
    "with d as (select distinct rel_path, sha256, n_bytes from manifest_files) "
    "select split_part(rel_path, '/', 1) as subject, count(*) as files, sum(n_bytes)::bigint as bytes, sum(('0x' || left(sha256, 7))::bigint)::bigint as checksum from d group by all"
)
def manifest_digest(t: Tables) -> DataFrame:
    """Files, bytes and a checksum, in any order, of each subject's digests (SRC3, SNK5)."""
    d = t.manifest_files.select("rel_path", "sha256", "n_bytes").distinct()
    return d.groupBy(F.split("rel_path", "/")[0].alias("subject")).agg(
        F.count("*").alias("files"), F.sum("n_bytes").alias("bytes"), F.sum(F.conv(F.left("sha256", F.lit(7)), 16, 10).cast("long")).alias("checksum")
    )


@REG.add(
    "with b as (select *, min(p_retailprice) over (partition by p_brand order by p_size, p_retailprice, p_partkey rows between unbounded preceding and 1 preceding) as best from part), "
    "f as (select p_brand, p_retailprice, row_number() over (partition by p_brand order by p_size, p_partkey) as pos from b where best is null or p_retailprice < best), "
    "o as (select p_brand, coalesce(lead(p_brand) over (order by p_brand), first_value(p_brand) over (order by p_brand)) as other from (select distinct p_brand from part)) "
    "select a.p_brand, b.p_brand as other, count(*) as same_places, bool_and(abs(a.p_retailprice - b.p_retailprice) <= 0.05 * abs(b.p_retailprice)) as equivalent "
    "from o join f a on a.p_brand = o.p_brand join f b on a.pos = b.pos and b.p_brand = o.other group by all"
)
def front_comparison(t: Tables) -> DataFrame:
    """The front of each brand with that of the next in order, place by place within a tolerance (KER19)."""
    front = R.pareto(t.part, ["p_brand"], "p_size", "p_retailprice", "p_partkey")
    pos = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_size", "p_partkey"))
    f = front.select("p_brand", "p_retailprice", pos.alias("pos"))
    w = Window.orderBy("p_brand").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # one row a brand
    o = t.part.select("p_brand").distinct().select("p_brand", F.coalesce(F.lead("p_brand").over(Window.orderBy("p_brand")), F.first("p_brand").over(w)).alias("other"))
    b = f.select(F.col("p_brand").alias("other"), F.col("p_retailprice").alias("q"), "pos")
    close = F.abs(F.col("p_retailprice") - F.col("q")) <= 0.05 * F.abs("q")
    return f.join(o, "p_brand").join(b, ["other", "pos"]).groupBy("p_brand", "other").agg(F.count("*").alias("same_places"), F.bool_and(close).alias("equivalent"))
