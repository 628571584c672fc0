"""Queries of the numbered problems about language-model data, with SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wavemill.llm import leaks, quality, sampling, splits, tokens
from wavemill.sources.tables import table


def _plans(spark: SparkSession, d: str) -> DataFrame:
    return splits.grouped_plans(table(spark, d, "subject_plans"), table(spark, d, "recordings"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.split_conflicts(_plans(spark, d))


def p1_split(spark: SparkSession, d: str) -> DataFrame:
    """Every plan row with its related group and new partition."""
    return splits.split_components(_plans(spark, d)).select("plan_id", "component", "split")


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    """Each related group, named by its first plan row, with its rows by given partition and the pairs that differ."""
    return splits.split_groups(_plans(spark, d)).drop("component")


def p4_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sample_subjects(table(spark, d, "subject_plans"))


def p4_plans(spark: SparkSession, d: str) -> DataFrame:
    """The plan rows of the sampled subjects."""
    return sampling.sample_plans(table(spark, d, "subject_plans")).select("plan_id", "subject", "wave")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_leaks(spark, d).select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Each leak with its best score and longest run of words."""
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.not_prose(table(spark, d, "documents"))


def p8_figures(spark: SparkSession, d: str) -> DataFrame:
    """The figures of every document."""
    return quality.text_figures(table(spark, d, "documents"))


def _sample_sql(select: str, group: str = "") -> str:
    steps = sampling.feistel_sql("n", 42)
    number = r"try_cast(regexp_extract(subject, '(\d+)\D*$', 1) as bigint)"
    sql = f"select *, {number} as n from subject_plans"
    sql = f"select *, {steps[0][0]} as l, {steps[0][1]} as r from ({sql}) where n is not null and n < {sampling.DOMAIN}"
    for left, right in steps[1:]:
        sql = f"select * exclude (l, r), {left} as l, {right} as r from ({sql})"
    limit = round(0.2 * sampling.DOMAIN)
    return f"select {select} from ({sql}) where l * {1 << sampling.HALF_BITS} + r < {limit} {group}"


QUERIES = {f.__name__: f for f in (
    p1_found, p1_split, p1_groups, p4_sample, p4_plans, p6_ids, p7_found, p7_leaks, p8_found, p8_figures,
)}

_NUMBER = r"try_cast(regexp_extract({}, '(\d+)\D*$', 1) as bigint)"
_SAME = (
    r"(?:same person as|identisch mit|duplicate enrolment of|formerly enrolled as|earlier code)\s+(\D{0,4}\d+)"
)

_GROUPS = rf"""
with recursive r as (
  select 's' || {_NUMBER.format("subject")} as s, {_NUMBER.format("family_id")} as f, lower(trim(sha256)) as h, n_bytes,
         regexp_replace(lower(remark), 'not the same person as', '') as m
  from recordings
), one as (
  select s as a, 'f' || f as b from r where f > 0
  union select s, 'c' || h from r where n_bytes > 0
  union select s, 's' || {_NUMBER.format(f"regexp_extract(m, '{_SAME}', 1)")} from r where regexp_matches(m, '{_SAME}')
), e as (
  select a, b from one union select b, a from one
), reach as (
  select distinct a as v, a as w from e
  union
  select reach.v, e.b from reach join e on reach.w = e.a
), comp as (
  select v, min(w) as c from reach group by v
), p as (
  select plan_id, coalesce(c, 's' || {_NUMBER.format("subject")}) as c,
         case when lower(trim(plan_partition)) in ('train', 'training') then 'train' when lower(trim(plan_partition)) in ('validation', 'valid', 'val') then 'validation'
              when lower(trim(plan_partition)) = 'test' then 'test' end as part
  from subject_plans left join comp on v = 's' || {_NUMBER.format("subject")}
)
"""

SQL = {
    "p1_found": _GROUPS + "select x.plan_id as plan_lo, y.plan_id as plan_hi from p x join p y on x.c = y.c and x.part <> y.part and x.plan_id < y.plan_id",
    "p1_groups": _GROUPS + """, g as (
  select min(plan_id) as first_plan, count(*) as n, count(*) filter (part = 'train') as train, count(*) filter (part = 'validation') as validation,
         count(*) filter (part = 'test') as test from p group by coalesce(c, 'p' || plan_id)
)
select *, train * validation + train * test + validation * test as pairs from g""",
    "p4_sample": _sample_sql("n as subject_no, min(wave) as first_wave, count(*) as n_plans", "group by n"),
    "p4_plans": _sample_sql("plan_id, subject, wave"),
}
