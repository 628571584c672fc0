"""The sample: a permutation, stable, whatever the writing of a code."""

from pyspark.sql import functions as F

from wavemill.llm import sampling as S


def test_permutation_without_collisions(spark):
    df = spark.range(200_000).select(S.feistel(F.col("id"), 42).alias("v"))
    row = df.agg(F.countDistinct("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("m")).first()
    assert row.n == 200_000 and row.lo >= 0 and row.hi < S.DOMAIN and abs(row.m / S.DOMAIN - 0.5) < 0.01


def test_rate_and_nesting(spark):
    df = spark.range(50_000).select("id", S.in_sample(F.col("id"), 0.1, 7).alias("a"), S.in_sample(F.col("id"), 0.3, 7).alias("b"), S.in_sample(F.col("id"), 0.1, 8).alias("c"))
    row = df.agg(F.avg(F.col("a").cast("int")).alias("a"), F.avg(F.col("b").cast("int")).alias("b"), F.count_if(F.col("a") & ~F.col("b")).alias("x"), F.count_if(F.col("a") & F.col("c")).alias("y")).first()
    assert abs(row.a - 0.1) < 0.01 and abs(row.b - 0.3) < 0.015 and row.x == 0 and abs(row.y - 500) < 150


def test_waves_and_writings(spark):
    rows = [(f"sub-{i:06d}", 1 + i % 3) for i in range(300)]
    df = spark.createDataFrame(rows + [(None, 1), ("?", 1), ("sub-99999999999", 2)], "subject string, wave int")
    early = {r.subject_no for r in S.sample_subjects(df.filter("wave <= 2")).collect()}
    late = {r.subject_no for r in S.sample_subjects(df.repartition(5)).collect()}
    assert early <= late and 30 < len(late) < 90
    other = df.withColumn("subject", F.regexp_replace("subject", "sub-0*", "S"))
    assert {r.subject_no for r in S.sample_subjects(other).collect()} == late
    assert S.sample_plans(df).count() == len(late)
    assert S.sample_subjects(df.limit(0)).count() == 0


def test_whole_domain_ends(spark):
    df = spark.createDataFrame([(-1,), (0,), (S.DOMAIN - 1,), (S.DOMAIN,), (None,)], "n long")
    assert [r[0] for r in df.select(S.in_sample(F.col("n"), 1.0, 1)).collect()] == [None, True, True, None, None]


def test_fixed_values(spark):
    """The permutation never changes: values computed by hand with whole numbers of any size."""
    n = [0, 1, 77, 10**18 - 1]
    df = spark.createDataFrame([(x,) for x in n], "n long")
    assert [r[0] for r in df.select(S.feistel(F.col("n"), 42)).collect()] == [372497722015628311, 12140069506850510, 1109961605081765370, 207332589441037180]
    plans = spark.range(60).select(F.concat(F.lit("sub-"), "id").alias("subject"), F.lit(1).alias("wave"))
    assert sorted(r.subject_no for r in S.sample_subjects(plans).collect()) == [1, 4, 7, 14, 17, 18, 19, 20, 34, 36, 38, 49, 59]
