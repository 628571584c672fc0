"""Queries of the numbered problems in the core: units (2), differences (3), implausible values (5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wavemill.operators import diff, spikes, units
from wavemill.sources.tables import table


def _harmonised(spark: SparkSession, d: str) -> DataFrame:
    return units.harmonise(*[table(spark, d, t) for t in ("recordings", "units_checks", "samples", "amplifiers")])


def _recording_units(spark: SparkSession, d: str) -> DataFrame:
    return units.recording_units(*[table(spark, d, t) for t in ("recordings", "units_checks", "samples", "amplifiers")])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return units.not_in_microvolts(_harmonised(spark, d))


def p2_checks(spark: SparkSession, d: str) -> DataFrame:
    """Each check in µV, judged anew."""
    return units.checks_in_microvolts(_harmonised(spark, d))


def p2_review(spark: SparkSession, d: str) -> DataFrame:
    """The checks and recordings whose unit is uncertain, with both candidates."""
    return units.for_review(_harmonised(spark, d))


def p2_samples(spark: SparkSession, d: str) -> DataFrame:
    """Every sample in µV."""
    return units.samples_in_microvolts(table(spark, d, "samples"), _recording_units(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    found = diff.manifest_against_mirror(table(spark, d, "manifest_files"), table(spark, d, "mirror_files"))
    return found.select("rel_path", "field").distinct()


def p3_listings(spark: SparkSession, d: str) -> DataFrame:
    """Every listing against every scan, repeated ones paired at least cost."""
    return diff.all_listings_compared(table(spark, d, "manifest_files"), table(spark, d, "mirror_files"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return spikes.implausible(table(spark, d, "samples"), _recording_units(spark, d), table(spark, d, "features"))


def p5_flags(spark: SparkSession, d: str) -> DataFrame:
    """Every flagged sample with the checks that flag it, the ESD test on decomposition residuals among them."""
    flags = spikes.series_flags(table(spark, d, "samples"), _recording_units(spark, d))
    return flags.filter("not series").select("rec_id", "channel", "idx", "value", "spike", "far", "stuck", "beyond")


def p5_spikes(spark: SparkSession, d: str) -> DataFrame:
    """The samples whose residuals lie outside the ESD limits, whatever their distance from the median."""
    flags = spikes.series_flags(table(spark, d, "samples"), _recording_units(spark, d))
    return flags.filter("not series and spike").select("rec_id", "channel", "idx", "value")


def p5_unitless(spark: SparkSession, d: str) -> DataFrame:
    """The samples of ``p5_found`` that need no unit: spikes far off, and stuck values."""
    flags = spikes.series_flags(table(spark, d, "samples"), _recording_units(spark, d))
    return flags.filter("not series and (spike and far or stuck)").select("rec_id", "channel", "idx").distinct()


QUERIES = {f.__name__: f for f in (p2_found, p2_checks, p2_review, p2_samples, p3_found, p3_listings, p5_found, p5_flags, p5_spikes, p5_unitless)}

SQL = {
    "p3_found": r"""
with man as (
  select distinct rel_path, sha256, n_bytes, modified_at, n_channels, duration_s from manifest_files
), clean as (
  select regexp_replace(regexp_replace(trim(regexp_replace(rel_path, '[\\/]+(\.[\\/]+)*', '/', 'g')), '^(\./|/)+', ''), '\s+$', '') as rel_path,
         regexp_replace(lower(trim(sha256)), '^sha-?256:', '') as sha256, n_bytes, modified_at, n_channels, duration_s, seen_at
  from mirror_files
), mir as (
  select * exclude (k) from (select *, row_number() over (partition by rel_path order by seen_at desc) as k from clean) where k = 1
), pairs as (
  select coalesce(a.rel_path, b.rel_path) as rel_path, a.rel_path is null as no_a, b.rel_path is null as no_b,
         a.sha256 is distinct from b.sha256 as d1, a.n_bytes is distinct from b.n_bytes as d2,
         coalesce(abs(epoch_us(a.modified_at) - epoch_us(b.modified_at)) >= 1000000, (a.modified_at is null) <> (b.modified_at is null)) as d3,
         a.n_channels is distinct from b.n_channels as d4,
         coalesce(abs(round(a.duration_s * 1e6) - round(b.duration_s * 1e6)) >= 1000, (a.duration_s is null) <> (b.duration_s is null)) as d5
  from man a full join mir b on a.rel_path = b.rel_path
)
select rel_path, 'only_mirror' as field from pairs where no_a
union all select rel_path, 'only_manifest' from pairs where no_b
union all select rel_path, 'sha256' from pairs where d1 and not no_a and not no_b
union all select rel_path, 'n_bytes' from pairs where d2 and not no_a and not no_b
union all select rel_path, 'modified_at' from pairs where d3 and not no_a and not no_b
union all select rel_path, 'n_channels' from pairs where d4 and not no_a and not no_b
union all select rel_path, 'duration_s' from pairs where d5 and not no_a and not no_b
""",
    "p5_unitless": """
with s as (select distinct rec_id, channel, idx, data_uv as x from samples where data_uv is not null and not isnan(data_uv)),
m as (select rec_id, channel, median(x) as m from s group by all),
d as (select rec_id, channel, 1.4826 * median(abs(x - m)) as r from s join m using (rec_id, channel) group by all),
n as (select *, row_number() over (partition by rec_id, channel order by idx) - row_number() over (partition by rec_id, channel, x order by idx) as run from s),
c as (select rec_id, channel, idx, x, count(*) over (partition by rec_id, channel, x, run) as len from n)
select rec_id, channel, idx from c join m using (rec_id, channel) join d using (rec_id, channel) where len >= 10 or (r > 0 and abs(x - m) >= 10 * r)
""",
}
