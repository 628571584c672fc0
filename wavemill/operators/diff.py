"""Differences between two copies of a dataset whose keys may repeat (problem 3).

Identical rows cancel by multiplicity in one map-side combined aggregation. What is left of a key is paired so
that the pairs differ in as few fields as possible; a pair then reports each field that differs, a row without
a partner is missing on the other side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavemill.functions import codes
from wavemill.functions.lineage import cut

#: More than any distance of a search.
FAR = 1 << 30


def transport(costs: Callable[[int], np.ndarray], supply: np.ndarray, demand: np.ndarray) -> list[tuple[int, int, int]]:
    """(row, column, units) of least total cost that use up ``supply``, of which there is no more than ``demand``.

    ``costs`` gives a row of whole-number costs; only rows that a search looks at are asked for, and none is kept, so that
    memory grows with rows and columns, not with their product. Shortest augmenting paths with row and column
    potentials; of columns equally near, one with free units ends the search.
    """
    n, m = len(supply), len(demand)
    u, v = np.zeros(n, int), np.zeros(m, int)
    free = np.array(demand, int)
    units: list[dict[int, int]] = [{} for _ in range(m)]  # of each column, by row
    for row in range(n):
        left = int(supply[row])
        while left:
            best, via, seen = np.full(m, FAR), np.full(m, -1), np.zeros(m, bool)
            at, into = {row: 0}, {}  # distances of the rows reached, and the columns by which they were
            fresh = [row]
            while True:
                for i in fresh:
                    offer = costs(i) - v
                    offer += at[i] - u[i]
                    better = offer < best  # never of a seen column
                    best[better], via[better] = offer[better], i
                rest = np.where(seen, FAR, best)
                near = int(rest.min())
                tied = np.flatnonzero(rest == near)
                ends = tied[free[tied] > 0]
                if len(ends):
                    last = int(ends[0])
                    break
                seen[tied] = True
                fresh = []
                for j in tied.tolist():
                    for i in units[j]:
                        if i not in at:
                            at[i], into[i] = near, j
                            fresh.append(i)
            for i, d in at.items():
                u[i] += near - d
            v[seen] -= near - best[seen]
            path, j = [], last
            while True:
                i = int(via[j])
                path.append((i, j))
                if i == row:
                    break
                j = into[i]
            moved = min([left, int(free[last]), *[units[into[i]][i] for i, _ in path[:-1]]])
            for i, j in path:
                units[j][i] = units[j].get(i, 0) + moved
                if i != row:
                    old = units[into[i]]
                    old[i] -= moved
                    if not old[i]:
                        del old[i]
            free[last] -= moved
            left -= moved
    return [(i, j, k) for j, by in enumerate(units) for i, k in by.items()]


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of least total cost; the smaller side is paired whole."""
    if cost.shape[0] > cost.shape[1]:
        return [(i, j) for j, i in assign(cost.T)]
    n, m = cost.shape
    return [(i, j) for i, j, _ in transport(lambda i: cost[i].astype(int), np.ones(n, int), np.ones(m, int))]


def differs(field: str, within: dict[str, float], a: Column, b: Column) -> Column:
    """Whether two values of a field differ; null against a value does, null against null does not."""
    if field not in within:
        return ~a.eqNullSafe(b)
    far = F.abs(a - b) >= F.lit(within[field])
    return F.coalesce(far, ~(a.isNull() & b.isNull()))


def _costs(codes: list[tuple[np.ndarray, np.ndarray, float]], rows: np.ndarray, columns: np.ndarray) -> Callable[[int], np.ndarray]:
    """Gives, for one of the rows ``rows``, the number of fields in which each of ``columns`` differs from it. A field is
    its values, where they are null, and from which distance on two of them differ."""
    there = [(value[columns], null[columns]) for value, null, _ in codes]

    def row(i: int) -> np.ndarray:
        cost = np.zeros(len(columns), int)
        for (value, null, far), (theirs, no) in zip(codes, there):
            cost += ~no if null[rows[i]] else no | (np.abs(theirs - value[rows[i]]) >= far)
        return cost

    return row


def _solved(rows: DataFrame, keys: list[str], fields: list[str], within: dict[str, float]) -> DataFrame:
    """The leftover rows of keys in pairs of least total cost, or alone: each task streams through its keys, of which it
    holds one at a time. The order of rows, and so the choice among equal totals, depends on the rows alone."""
    n = rows.sparkSession.sparkContext.defaultParallelism * 2
    schema = T.StructType([rows.schema[k] for k in keys])
    for c in ("_has_l", "_has_r"):
        schema = schema.add(c, "boolean")
    for f in fields:
        schema = schema.add(f"_l_{f}", rows.schema[f].dataType).add(f"_r_{f}", rows.schema[f].dataType)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(t: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
            codes = []
            for f in fields:
                c = t.column(f).combine_chunks()
                null = c.is_null().to_numpy(zero_copy_only=False)
                value = c.fill_null(0).to_numpy(zero_copy_only=False).astype(float) if f in within else c.dictionary_encode("encode").indices.to_numpy().astype(float)
                codes.append((value, null, within.get(f, 0.5)))
            n_l, n_r = t.column("_l").to_numpy(), t.column("_r").to_numpy()
            mine, theirs = [], []
            for lo, hi in zip(starts, np.append(starts[1:], t.num_rows)):
                left, right = lo + np.flatnonzero(n_l[lo:hi]), lo + np.flatnonzero(n_r[lo:hi])
                swap = n_l[left].sum() > n_r[right].sum()
                few, more, n_few, n_more = (right, left, n_r, n_l) if swap else (left, right, n_l, n_r)
                found = np.array(transport(_costs(codes, few, more), n_few[few], n_more[more]), int).reshape(-1, 3)
                x, y = np.repeat(few[found[:, 0]], found[:, 2]), np.repeat(more[found[:, 1]], found[:, 2])
                spare = n_more[more].copy()
                np.subtract.at(spare, found[:, 1], found[:, 2])
                alone, nobody = np.repeat(more, spare), np.full(spare.sum(), -1)
                mine += [y, alone] if swap else [x, nobody]
                theirs += [x, nobody] if swap else [y, alone]
            a, b = np.concatenate(mine), np.concatenate(theirs)
            pick_a, pick_b = pa.array(a, mask=a < 0), pa.array(b, mask=b < 0)
            either = pa.array(np.maximum(a, b))
            out = [t.column(k).take(either) for k in keys] + [pa.array(a >= 0), pa.array(b >= 0)]
            for f in fields:
                out += [t.column(f).take(pick_a), t.column(f).take(pick_b)]
            yield from pa.Table.from_arrays(out, schema.names).combine_chunks().to_batches()

        held: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            new = np.zeros(t.num_rows, bool)
            new[:1] = True
            for k in keys:
                code = t.column(k).combine_chunks().dictionary_encode("encode").indices.to_numpy()
                new[1:] |= code[1:] != code[:-1]
            starts = np.flatnonzero(new)
            if len(starts) > 1:  # the last key may go on in the next batch
                yield from solved(t.slice(0, starts[-1]), starts[:-1])
                t = t.slice(starts[-1])
            held = t
        if held is not None and held.num_rows:
            yield from solved(held, np.zeros(1, int))

    ready = rows.select(*keys, *fields, F.col("_l").cast("long").alias("_l"), F.col("_r").cast("long").alias("_r"))
    return ready.repartition(n, *keys).sortWithinPartitions(*keys, *fields).mapInArrow(work, schema)


def pair_rows(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    fields: list[str],
    within: dict[str, float] | None = None,
    exact_rows: int | None = None,
) -> DataFrame:
    """The rows of two tables that do not cancel, in pairs.

    Columns: the keys, ``_has_l``, ``_has_r`` and ``_l_<field>``, ``_r_<field>`` of every field. ``within`` gives
    fields that count as different only from that distance on. Columns other than keys and fields are ignored,
    whatever their names. Null keys form a key of their own; null equals null in a field, and NaN null. An empty
    table makes every row of the other one a row without partner. Repeated rows count as often as they occur.
    A key of any size is paired at least cost in one task; ``exact_rows``, once the size up to which that was done, has
    no effect.
    """
    within = within or {}

    def clean(df: DataFrame) -> DataFrame:
        kinds = dict(df.dtypes)
        tidy = {f: F.when(~F.isnan(f), F.col(f)) if kinds[f] in ("double", "float") else F.col(f) for f in fields}
        return df.select(*keys, *[c.alias(f) for f, c in tidy.items()])

    both = (
        clean(left).withColumns({"_l": F.lit(1), "_r": F.lit(0)})
        .unionByName(clean(right).withColumns({"_l": F.lit(0), "_r": F.lit(1)}))
        .groupBy(*keys, *fields)
        .agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    )
    same = F.least("_l", "_r")
    rest = cut(both.filter("_l <> _r").withColumns({"_l": F.col("_l") - same, "_r": F.col("_r") - same}))
    per_key = rest.groupBy(*keys).agg(
        F.sum("_l").alias("_nl"),
        F.sum("_r").alias("_nr"),
        F.max(F.when(F.col("_l") > 0, F.struct(*fields))).alias("_a"),
        F.max(F.when(F.col("_r") > 0, F.struct(*fields))).alias("_b"),
    )
    few = F.greatest("_nl", "_nr") <= 1
    plain = per_key.filter(few).select(
        *keys,
        (F.col("_nl") > 0).alias("_has_l"),
        (F.col("_nr") > 0).alias("_has_r"),
        *[F.col(f"{s}.{f}").alias(f"{p}{f}") for f in fields for s, p in (("_a", "_l_"), ("_b", "_r_"))],
    )
    many = cut(per_key.filter(~few).select(*[F.col(k).alias(f"_k_{k}") for k in keys]))
    if many.isEmpty():
        return plain
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return plain.unionByName(_solved(rest.join(many, on), keys, fields, within))


def field_differences(
    pairs: DataFrame,
    keys: list[str],
    fields: list[str],
    within: dict[str, float] | None = None,
    only_left: str = "only_left",
    only_right: str = "only_right",
) -> DataFrame:
    """One row for each field of each pair that differs, with both values as text; the name of the side that
    alone has a row stands in ``field`` for rows without partner."""
    within = within or {}
    text = T.StringType()
    marks = [F.when(F.col("_has_l") & ~F.col("_has_r"), F.struct(F.lit(only_left).alias("field"), F.lit(None).cast(text).alias("left_value"), F.lit(None).cast(text).alias("right_value"))),
             F.when(F.col("_has_r") & ~F.col("_has_l"), F.struct(F.lit(only_right).alias("field"), F.lit(None).cast(text).alias("left_value"), F.lit(None).cast(text).alias("right_value")))]
    for f in fields:
        a, b = F.col(f"_l_{f}"), F.col(f"_r_{f}")
        marks.append(
            F.when(
                F.col("_has_l") & F.col("_has_r") & differs(f, within, a, b),
                F.struct(F.lit(f).alias("field"), a.cast(text).alias("left_value"), b.cast(text).alias("right_value")),
            )
        )
    return pairs.select(*keys, F.explode(F.array_compact(F.array(*marks))).alias("_d")).select(*keys, "_d.*")


#: Fields of a file listing, and from which distance on two values differ (micro-seconds).
FILE_FIELDS = ["sha256", "n_bytes", "modified_us", "n_channels", "duration_us"]
FILE_WITHIN = {"modified_us": 1_000_000, "duration_us": 1_000}
FILE_NAMES = {"modified_us": "modified_at", "duration_us": "duration_s"}


def file_listing(df: DataFrame) -> DataFrame:
    """A listing with paths and digests in one writing, times and durations as whole micro-seconds."""
    return df.withColumns(
        {
            "rel_path": codes.path(F.col("rel_path")),
            "sha256": codes.digest(F.col("sha256")),
            "n_bytes": F.col("n_bytes").cast("long"),
            "modified_us": F.unix_micros(F.col("modified_at").cast("timestamp")),
            "n_channels": F.col("n_channels").cast("int"),
            "duration_us": F.round(F.when(~F.isnan("duration_s"), F.col("duration_s")) * 1_000_000).cast("long"),
        }
    )


def latest(df: DataFrame, keys: list[str], at: str, fields: list[str]) -> DataFrame:
    """Of each key the row with the greatest ``at`` (ties: the greatest field values, in order)."""
    best = df.groupBy(*keys).agg(F.max(F.struct(at, *fields)).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.{f}").alias(f) for f in fields])


def manifest_against_mirror(manifest: DataFrame, mirror: DataFrame) -> DataFrame:
    """Files and fields in which the mirror's latest state differs from the manifest: ``rel_path``, ``field``,
    ``left_value``, ``right_value``. Equal listings of a file count once."""
    left = file_listing(manifest).select("rel_path", *FILE_FIELDS).distinct()
    right = latest(file_listing(mirror), ["rel_path"], "seen_at", FILE_FIELDS)
    pairs = pair_rows(left, right, ["rel_path"], FILE_FIELDS, FILE_WITHIN)
    return _named(field_differences(pairs, ["rel_path"], FILE_FIELDS, FILE_WITHIN, "only_manifest", "only_mirror"))


def all_listings_compared(manifest: DataFrame, mirror: DataFrame) -> DataFrame:
    """The same over every listing and every scan: repeated listings need as many equal scans."""
    pairs = pair_rows(file_listing(manifest), file_listing(mirror), ["rel_path"], FILE_FIELDS, FILE_WITHIN)
    return _named(field_differences(pairs, ["rel_path"], FILE_FIELDS, FILE_WITHIN, "only_manifest", "only_mirror"))


def _named(found: DataFrame) -> DataFrame:
    name = F.col("field")
    for short, full in FILE_NAMES.items():
        name = F.when(F.col("field") == short, full).otherwise(name)
    return found.withColumn("field", name)
