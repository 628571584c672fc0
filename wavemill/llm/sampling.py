"""A reproducible sample that stays stable as data grow (problem 4).

A Feistel network permutes a fixed domain of numeric identifiers; an identifier is in the sample if its permuted
value lies under rate × domain size. No state, no collisions, no look at other rows: the sample is the same for
every rerun, order and partitioning, and new identifiers change nothing for the old ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavemill.functions import codes

#: Two halves of so many bits: the domain is 0 .. 2^(2·HALF_BITS) − 1, wide enough for every code of 18 digits.
HALF_BITS = 30
#: Fixed value: the multiplier of the second mixing step, to which each round adds.
MIXER = 668265261
DOMAIN = 1 << (2 * HALF_BITS)
#: Rounds of the network, each with a key drawn from the seed.
ROUNDS = 6


def round_keys(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int]]:
    """An odd multiplier and an addend of ``HALF_BITS`` bits for each round (a linear congruential sequence)."""
    keys, state = [], (seed * 2862933555777941757 + 3037000493) % (1 << 64)
    for _ in range(rounds):
        state = (state * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        keys.append(((state >> 34) % (1 << HALF_BITS) | 1, (state >> 4) % (1 << HALF_BITS)))
    return keys


def feistel(n: Column, seed: int) -> Column:
    """The permuted value of ``n`` in the domain, by built-in integer functions alone (a fold over the round keys)."""
    mask, half = (1 << HALF_BITS) - 1, 1 << HALF_BITS
    keys = F.array(*[F.array(F.lit(mul).cast("long"), F.lit(add).cast("long"), F.lit(2 * k + MIXER)) for k, (mul, add) in enumerate(round_keys(seed))])

    def step(pair: Column, key: Column) -> Column:
        mixed = (pair["r"] * key[0] + key[1]).bitwiseAND(F.lit(mask))
        mixed = mixed.bitwiseXOR(F.shiftright(mixed, 13)) * key[2]
        mixed = F.shiftright(mixed, 15).bitwiseAND(F.lit(mask))
        return F.struct(pair["r"].alias("l"), pair["l"].bitwiseXOR(mixed).alias("r"))

    start = F.struct(F.shiftright(n, HALF_BITS).cast("long").alias("l"), n.bitwiseAND(F.lit(mask)).cast("long").alias("r"))
    return F.aggregate(keys, start, step, lambda p: p["l"] * half + p["r"])


def feistel_sql(n: str, seed: int) -> list[tuple[str, str]]:
    """The same as SQL: successive (left, right) expressions over columns ``l`` and ``r`` of the step before."""
    mask, half = (1 << HALF_BITS) - 1, 1 << HALF_BITS
    steps = [(f"{n} // {half}", f"{n} & {mask}")]
    for k, (mul, add) in enumerate(round_keys(seed)):
        mixed = f"((r * {mul} + {add}) & {mask})"
        mixed = f"(xor({mixed}, {mixed} >> 13) * {2 * k + MIXER})"
        steps.append(("r", f"xor(l, ({mixed} >> 15) & {mask})"))
    return steps


def in_sample(n: Column, rate: float, seed: int) -> Column:
    """Whether identifier ``n`` is in the sample; null for identifiers outside the domain."""
    limit = int(round(rate * DOMAIN))
    return F.when((n >= 0) & (n < DOMAIN), feistel(n, seed) < limit)


def sample_subjects(plans: DataFrame, rate: float = 0.2, seed: int = 42) -> DataFrame:
    """The subjects of the plans that are in the sample: ``subject_no``, ``first_wave``, ``n_plans``.

    A subject is its code's number, whatever the writing. A subject chosen at one wave stays chosen when later
    waves are added. Codes that cannot be read (null, or of more than 18 digits) are never chosen; repeated
    rows and an empty table are no special case; other columns are ignored.
    """
    n = codes.subject_number(F.col("subject"))
    rows = plans.select(n.alias("subject_no"), "wave").filter(F.coalesce(in_sample(F.col("subject_no"), rate, seed), F.lit(False)))
    return rows.groupBy("subject_no").agg(F.min("wave").alias("first_wave"), F.count("*").alias("n_plans"))


def sample_plans(plans: DataFrame, rate: float = 0.2, seed: int = 42) -> DataFrame:
    """All plan rows of the subjects in the sample, unchanged; a filter without any shuffle."""
    return plans.filter(F.coalesce(in_sample(codes.subject_number(F.col("subject")), rate, seed), F.lit(False)))
