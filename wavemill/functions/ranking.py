"""Row numbers inside groups of any size, without one task holding a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavemill.functions.lineage import cut
from wavemill.functions.quantiles import same_key


def salted_rank(df: DataFrame, group: list[str], order: list[str], name: str = "rank", buckets: int = 256) -> DataFrame:
    """Number the rows of each group from 1, in an order that depends on the row values alone.

    Rows are first cut into ``buckets`` by a hash of ``order``; the numbers run bucket by bucket, so that a task
    sorts one bucket of a group and only ``buckets`` counts of a group meet. Equal rows get successive numbers.
    """
    salted = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = salted.groupBy(*group, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    o = offsets.select(*[F.col(c).alias(f"_o_{c}") for c in [*group, "_bucket"]], "_offset")
    on = F.lit(True)
    for c in [*group, "_bucket"]:
        on = on & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    inside = Window.partitionBy(*group, "_bucket").orderBy(*order)
    return (
        salted.join(o, on)
        .withColumn(name, F.col("_offset") + F.row_number().over(inside))
        .select(*df.columns, name)
    )


def ordered_rank(df: DataFrame, order: str, name: str = "rank", width: int = 4096) -> DataFrame:
    """Number all rows from 1 in the order of a unique whole-number column.

    Rows are cut into spans of ``width`` values; a task sorts one span, and one row a span gets its offset.
    """
    spans = df.withColumn("_span", F.floor(F.col(order) / width))
    counts = spans.groupBy("_span").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(F.lit(1)).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy("_span").orderBy(order)
    return spans.join(offsets, "_span").withColumn(name, F.col("_offset") + F.row_number().over(inside)).select(*df.columns, name)


def value_buckets(df: DataFrame, group: list[str], x: str, buckets: int = 64) -> DataFrame:
    """Adds ``_bucket``: ranges of ``x`` in order, of about equally many rows of each group; equal values share one.
    Rows with a null ``x`` are left out."""
    rows = df.filter(F.col(x).isNotNull())
    ends = F.array(*[F.lit(k / buckets) for k in range(1, buckets)])
    bounds = rows.groupBy(*group).agg(F.percentile_approx(x, ends, F.lit(1_000)).alias("_ends"))
    b = cut(bounds.select(*[F.col(c).alias(f"_b_{c}") for c in group], "_ends"))  # one row a group
    placed = rows.join(b, same_key(group, "_b_"))
    return placed.withColumn("_bucket", F.size(F.filter("_ends", lambda e: e < F.col(x)))).select(*df.columns, "_bucket")


def average_ranks(df: DataFrame, group: list[str], x: str, name: str, buckets: int = 64) -> DataFrame:
    """Ranks from 1 in each group of any size, ties at their mean rank; null for a null ``x``.

    Equal values are counted first; of the distinct ones a task sorts one range of a group.
    """
    counts = value_buckets(df.groupBy(*group, x).agg(F.count("*").alias("_c")), group, x, buckets)
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.groupBy(*group, "_bucket").agg(F.sum("_c").alias("_s"))
    offsets = offsets.select(*[F.col(c).alias(f"_o_{c}") for c in [*group, "_bucket"]], F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*group, "_bucket").orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("_offset") + F.sum("_c").over(inside)
    ranked = counts.join(offsets, same_key([*group, "_bucket"], "_o_")).select(
        *[F.col(c).alias(f"_r_{c}") for c in [*group, x]], (upto - (F.col("_c") - 1) / 2.0).alias(name)
    )
    return df.join(ranked, same_key([*group, x], "_r_"), "left").select(*df.columns, name)
