"""Exact quantiles of groups of any size, without one task or buffer that holds a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavemill.functions.lineage import cut

#: Accuracy of the sketch that brackets a rank: its error is at most one in so many.
ACCURACY = 20_000


def same_key(group: list[str], prefix: str) -> Column:
    """Null-safe equality of each column with its twin of that prefix."""
    on = F.lit(True)
    for c in group:
        on = on & F.col(c).eqNullSafe(F.col(f"{prefix}{c}"))
    return on


def exact_quantiles(df: DataFrame, group: list[str], value: str, shares: list[float], name: str) -> DataFrame:
    """``group`` columns, ``n`` (values that are not null) and ``name``: the array of the group's quantiles at
    ``shares``, linear between the two nearest ranks.

    A mergeable sketch brackets each rank; one map-side combined aggregation counts the rows below a bracket and
    the distinct values inside it, about a 3000th of the group, which alone are ranked. Nulls are left out, NaN
    counts as the greatest value; a group without values has no row.
    """
    rows = df.select(*group, F.col(value).cast("double").alias("_v")).filter("_v is not null")
    margins = (3 / ACCURACY, 0.02)  # the wider one where the other holds under two ranks; small groups are ranked whole
    ends = [e for s in shares for m in margins for e in (max(s - m, 0.0), min(s + m, 1.0))]
    sketch = rows.groupBy(*group).agg(F.percentile_approx("_v", F.array(*[F.lit(e) for e in ends]), F.lit(ACCURACY)).alias("_q"), F.count("_v").alias("_n"))
    g = cut(sketch.select(*[F.col(c).alias(f"_g_{c}") for c in group], "_q", "_n"))  # so that its size is known to Spark
    q, n, v = F.col("_q"), F.col("_n"), F.col("_v")
    low = [F.when(n * margins[0] > 2, q[4 * k]).when(n * margins[1] > 2, q[4 * k + 2]).otherwise(float("-inf")) for k in range(len(shares))]
    high = [F.when(n * margins[0] > 2, q[4 * k + 1]).when(n * margins[1] > 2, q[4 * k + 3]).otherwise(float("nan")) for k in range(len(shares))]
    inside = [F.struct(F.lit(k).alias("_k"), F.when(v >= low[k], v).alias("_v")) for k in range(len(shares))]
    spread = F.explode(F.array_compact(F.array(*[F.when(v <= high[k], s) for k, s in enumerate(inside)])))
    counted = (
        rows.join(g, same_key(group, "_g_"))
        .select(*group, "_n", spread.alias("_s"))
        .groupBy(*group, "_n", F.col("_s._k").alias("_k"), F.col("_s._v").alias("_v"))
        .agg(F.count("*").alias("_c"))
    )
    upto = Window.partitionBy(*group, "_n", "_k").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("_end", F.sum("_c").over(upto)).withColumn("_start", F.col("_end") - F.col("_c"))
    at = F.element_at(F.array(*[F.lit(float(s)) for s in shares]), F.col("_k") + 1) * (F.col("_n") - 1)
    place = ranked.withColumn("_at", at)
    first = F.floor(F.col("_at")) + 1
    hit = lambda r: F.max(F.when((F.col("_start") < r) & (F.col("_end") >= r), F.col("_v")))
    ends_of = place.groupBy(*group, "_n", "_k").agg(hit(first).alias("_a"), hit(F.ceil(F.col("_at")) + 1).alias("_b"), F.first("_at").alias("_at"))
    part = F.col("_at") - F.floor("_at")
    mixed = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(F.col("_a") + (F.col("_b") - F.col("_a")) * part)
    each = ends_of.select(*group, F.col("_n").alias("n"), F.struct("_k", mixed.alias("_x")).alias("_s"))
    out = each.groupBy(*group, "n").agg(F.array_sort(F.collect_list("_s")).alias("_l"))  # one entry a share
    return out.select(*group, "n", F.transform("_l", lambda s: s["_x"]).alias(name))


def exact_median(df: DataFrame, group: list[str], value: str, name: str) -> DataFrame:
    """``group`` columns and the median ``name`` of each group of any size; nulls are left out."""
    return exact_quantiles(df, group, value, [0.5], "_m").select(*group, F.col("_m")[0].alias(name))
