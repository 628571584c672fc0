"""Predicates, verdicts and selection rules with exact limits and defined ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exceeds(part: Column, whole: Column, num: int, den: int) -> Column:
    """Whether part/whole is strictly above num/den, in whole numbers."""
    return part * den > whole * num


def kleene_and(verdict: str) -> Column:
    """False if any is false, else null if any is null, else true (an aggregate)."""
    v = F.col(verdict)
    return F.when(F.coalesce(F.bool_or(~v), F.lit(False)), F.lit(False)).when(
        F.count_if(v.isNull()) > 0, F.lit(None).cast("boolean")
    ).otherwise(F.lit(True))


def reasons(rules: dict[str, Column]) -> Column:
    """The names of the rules that hold, in their order, joined by ``+``; empty if none does."""
    return F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()])), "+")


def first_reason(rules: dict[str, Column], otherwise: str = "ok") -> Column:
    """The name of the first rule that holds."""
    out = F.coalesce(*[F.when(c, F.lit(n)) for n, c in rules.items()], F.lit(otherwise))
    return out


def pareto(df: DataFrame, key: list[str], complexity: str, loss: str, tie: str) -> DataFrame:
    """Rows whose loss is strictly below that of every row before them by complexity (ties by ``tie``)."""
    w = Window.partitionBy(*key).orderBy(complexity, loss, tie).rowsBetween(Window.unboundedPreceding, -1)
    best = F.min(loss).over(w)
    return df.withColumn("_best", best).filter("_best is null or " + f"{loss} < _best").drop("_best")


def within_tolerance(df: DataFrame, key: list[str], complexity: str, loss: str, percent: int, tie: str) -> DataFrame:
    """Of the rows with loss ≤ min·(1 + percent/100), the least complex; then lower loss, then ``tie``."""
    least = df.groupBy(*key).agg(F.min(loss).alias("_least"))
    near = df.join(least, key).filter(F.col(loss) * 100 <= F.col("_least") * (100 + percent))
    w = Window.partitionBy(*key).orderBy(complexity, loss, tie)
    return near.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k", "_least")


def three_outcomes(n: Column, least: int, passed: Column) -> Column:
    """INCONCLUSIVE under ``least`` cases, else PASS or FAIL."""
    return F.when(n < least, "INCONCLUSIVE").when(passed, "PASS").otherwise("FAIL")


def in_every(df: DataFrame, member: str, variant: str, ok: str, variants: int) -> DataFrame:
    """Members present and ok in every variant (relational division)."""
    return (
        df.groupBy(member)
        .agg(F.bool_and(F.coalesce(F.col(ok), F.lit(False))).alias("_ok"), F.countDistinct(variant).alias("_n"))
        .filter((F.col("_n") == variants) & F.col("_ok"))
        .select(member)
    )


def recurrence(df: DataFrame, member: str, elements: str, num: int = 7, den: int = 10) -> DataFrame:
    """In how many sets each element stands, and whether that is at least num/den of all sets, empty ones too."""
    sets = F.lit(df.count())
    each = df.select(member, F.explode(F.array_distinct(F.col(elements))).alias("element")).groupBy("element").agg(F.count("*").alias("n"))
    return each.select("element", "n", (F.col("n") * den >= sets * num).alias("stable"))


def equal_quotas(rows: DataFrame, group: str, row: str, mean: int) -> DataFrame:
    """``row`` and ``group`` of rows drawn under a budget of ``mean`` for each group, in equal quotas.

    The level to which all groups can be filled comes from how many groups have how many rows, one row a size; groups
    above the level share the remainder in a drawn order. Rows are drawn by a mixed number, first in salts, so that no
    task sorts a large group. ``group`` and ``row`` are whole numbers, distinct together.
    """
    sizes = rows.groupBy(group).agg(F.count("*").alias("_n"))
    budget, groups = mean * sizes.count(), Window.orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    levels = sizes.groupBy("_n").agg(F.count("*").alias("_g")).withColumns({"_upto": F.sum("_g").over(groups), "_rows": F.sum(F.col("_n") * F.col("_g")).over(groups)})
    total = sizes.count()
    used = F.col("_rows") + F.col("_n") * (total - F.col("_upto"))
    best = levels.filter(used <= budget).agg(F.max(F.struct("_n", used.alias("used"), (total - F.col("_upto")).alias("more"))).alias("b")).first().b
    level, spent, more = (best["_n"], best["used"], best["more"]) if best else (0, 0, total)
    fill, extra = (level + (budget - spent) // more, (budget - spent) % more) if more else (level, 0)
    above = sizes.filter(F.col("_n") > fill).withColumn("_d", F.col(group) * 7919 % 100003)
    lucky = above.orderBy("_d", group).limit(int(extra)).select(group, F.lit(1).alias("_x"))
    quota = sizes.join(lucky, group, "left").select(group, (F.least("_n", F.lit(int(fill))) + F.coalesce("_x", F.lit(0))).alias("_q"))
    order = [F.col(row) * 31 % 1009, F.col(row)]
    salted = rows.withColumn("_s", F.pmod(F.xxhash64(row), F.lit(64)))
    first = salted.withColumn("_k", F.row_number().over(Window.partitionBy(group, "_s").orderBy(*order))).join(quota, group).filter("_k <= _q")
    return first.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter("_k <= _q").select(row, group)
