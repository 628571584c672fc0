"""Queries on odd inputs: the rows of their SQL on tables made for the case."""

import math

import duckdb

from tests.oracle import canon, connect
from wavemill.plans import catalog


def folder(tmp_path, **tables):
    """A data folder with each table as the SQL that makes it."""
    for name, sql in tables.items():
        duckdb.sql(sql).write_parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def both(spark, name, at):
    got = catalog.QUERIES[name](spark, at).toPandas()
    want = connect(at).execute(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)
    return got


def test_edge_trim_of_zero_series(spark, tmp_path):
    x = "case when i % 4 = 0 or i % 4 = 1 and k between 8 and 31 then 0 when i % 4 = 2 and k = 20 then 'inf'::double else sin(k) * i end"
    at = folder(tmp_path, samples=f"select i // 2 as rec_id, (i % 2)::int as channel, k as idx, {x} as data_uv from range(8) a(i), range(40) b(k)")
    got = both(spark, "edge_trim", at)
    assert len(got) == 8 and sum(map(math.isnan, got["mean"])) == 6


def lineitem(rows):
    """Rows (l_suppkey, l_quantity, l_discount, l_tax)."""
    return f"select * from (values {', '.join(rows)}) v(l_suppkey, l_quantity, l_discount, l_tax)"


SUPPLIERS = [f"({k % 40 if k % 40 else 'null'}::bigint, {k * 7 % 50}::double, {k * 3 % 11 / 100 if k % 13 else 'null'}::double, {k * 5 % 9 / 100}::double)" for k in range(120)]


def test_bootstrap_sends_nothing_to_the_driver(spark, tmp_path):
    """No join of draws, whose broadcast the driver could not hold; a null supplier is a row like any other."""
    at = folder(tmp_path, lineitem=lineitem(SUPPLIERS))
    plan = catalog.QUERIES["paired_bootstrap"](spark, at)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan
    both(spark, "paired_bootstrap", at)


def test_ratio_and_cluster_bootstrap_without_join(spark, tmp_path):
    at = folder(tmp_path, lineitem=lineitem(SUPPLIERS))
    for name in ("ratio_bootstrap", "cluster_bootstrap"):
        plan = catalog.QUERIES[name](spark, at)._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Broadcast" not in plan
        both(spark, name, at)


def test_ratio_bootstrap_over_a_mean_of_zero(spark, tmp_path):
    at = folder(tmp_path, lineitem=lineitem([f"({k}::bigint, 3::double, {d}::double, 0::double)" for k, d in enumerate((0, 0, 0.01))]))
    got = both(spark, "ratio_bootstrap", at)  # the upper limit is infinite, the lower one is not
    assert math.isinf(got["high"][0]) and got["low"][0] == 3


def test_icc_bootstrap_without_join(spark, tmp_path):
    """Against the draws in SQL; a subject without a number is a row like any other, as in icc_two_sessions."""
    from wavemill.plans.statistics import _TWO, _drawn

    subject = "case when k = 7 then 'sub-x' else 'sub-' || lpad(k::varchar, 3, '0') end"
    at = folder(
        tmp_path,
        recordings=f"select 2 * k + s as rec_id, {subject} as subject, 'ses-t' || (s + 1) as session from range(30) a(k), range(2) b(s)",
        features="select 2 * k + s as rec_id, c as channel, 5 + k % 9 + (k * 7 + s * 3 + c) % 4 as sd_uv, 1.5 as alpha_theta_ratio from range(30) a(k), range(2) b(s), range(2) d(c) where k <> 11 or s = 0",
    )
    query = catalog.QUERIES["icc_bootstrap"](spark, at)
    plan = query._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode(sequence(0, 9999" not in plan and "cast(b#" not in plan
    sums = "select b, count(*) as n, sum(a) as a, sum(b_) as b_, sum(pow(a + b_, 2)) as r, sum(a * a + b_ * b_) as q from d group by all"
    squares = "select *, pow(a + b_, 2) / (2 * n) as c, r / 2 - pow(a + b_, 2) / (2 * n) as ssr, (a * a + b_ * b_) / n - pow(a + b_, 2) / (2 * n) as ssc from e"
    sql = (
        _TWO.replace("as b,", "as b_,") + ", y as (select subject_no, a, b_ from x where a is not null and b_ is not null)" + _drawn("y", "subject_no", 10_000)
        + f", e as ({sums}), g as ({squares}), h as (select (ssr - (q - c - ssr - ssc)) / (ssr + (q - c - ssr - ssc)) as icc from g) "
        "select round(quantile_cont(icc, 0.025), 6), round(quantile_cont(icc, 0.975), 6) from h"
    )
    got = query.first()
    assert connect(at).execute(sql).fetchone() == (round(got.low, 6), round(got.high, 6)) and got.dropped == 0


def test_icc_bootstrap_of_one_subject(spark, tmp_path):
    at = folder(
        tmp_path,
        recordings="select s as rec_id, 'sub-001' as subject, 'ses-t' || (s + 1) as session from range(2) b(s)",
        features="select s as rec_id, 0 as channel, 5.0 + s as sd_uv, 1.5 as alpha_theta_ratio from range(2) b(s)",
    )
    assert tuple(catalog.QUERIES["icc_bootstrap"](spark, at).first()) == (None, None, 10_000, None)
