"""Splits that keep related records together (problem 1).

Connected components by random-mate contraction: in each round every vertex flips a coin, vertices with tails
that touch one with heads collapse into it, and the edges are rewritten, until none is left. The hooks of all
rounds are then unwound by pointer doubling. Every step is a SQL join or aggregation over tables in the
shared checkpoint folder, where each round leaves one table; nothing of a component is gathered in one place,
and a vertex with very many neighbours is split beforehand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from wavemill.functions import codes
from wavemill.functions.lineage import cut, cut_at, drop_cut

#: Rows of a component that meet in one task of the pair join.
CELL_ROWS = 10_000
#: A vertex keeps at most about so many neighbours; it is split into as many parts as that takes.
HUB_EDGES = 100_000
#: Buckets for the cumulative weight of all components.
BUCKETS = 4096

#: Words by which a remark says that its subject is the person known by the code after them.
SAME_PERSON = (
    r"(?:same (?:person|subject|participant) as|identisch mit|identical (?:to|with)|duplicate enrol?lment of|"
    r"formerly enrol?led as|re-?enrol?lment,? earlier code|previously (?:enrol?led|known) as|also known as|dieselbe person wie)"
)
_CODE = r"\s*[:=]?\s*((?:sub|s)?[\s_\p{Pd}]*\d+)"


def same_person_number(remark: Column) -> Column:
    """The subject number a remark names as the same person, or null. "Not the same person as" names none."""
    t = F.regexp_replace(F.lower(remark), r"\s+", " ")
    t = F.regexp_replace(t, rf"(?:not|never|nicht|no) (?:the |a |an )?{SAME_PERSON}", " ")
    return codes.subject_number(F.nullif(F.regexp_extract(t, SAME_PERSON + _CODE, 1), F.lit("")))


def subject_edges(recordings: DataFrame) -> DataFrame:
    """Distinct edges (``a``, ``b``) between vertices written as text: subjects ``s:``, households ``f:`` and
    contents ``c:``. A household or content is a vertex of its own, so a large one gives one edge a subject."""
    n = codes.subject_number(F.col("subject"))
    rows = recordings.select(
        F.concat(F.lit("s:"), n.cast("string")).alias("a"),
        F.array_compact(
            F.array(
                F.concat(F.lit("f:"), codes.family_number(F.col("family_id")).cast("string")),
                F.when(F.col("n_bytes") > 0, F.concat(F.lit("c:"), codes.digest(F.col("sha256")))),
                F.concat(F.lit("s:"), same_person_number(F.col("remark")).cast("string")),
            )
        ).alias("_to"),
    )
    edges = cut(rows.filter("a is not null").select("a", F.explode("_to").alias("b")).filter("a <> b").distinct())
    code = F.col("b").startswith("s:")
    shared = edges.filter(~code).groupBy("b").agg(F.count("*").alias("_n")).filter("_n > 1").select("b")
    return edges.filter(code).unionByName(edges.filter(~code).join(shared, "b", "left_semi").select("a", "b"))


def split_hubs(edges: DataFrame, most: int = HUB_EDGES) -> DataFrame:
    """The edges with each vertex of more than ``most`` neighbours split into parts, each with an edge to the vertex:
    the components stay the same but for the parts, whose names hold a line feed. ``edges`` are distinct and have no
    loops."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    parts = F.ceil(F.count("*") / most).cast("int")
    hubs = cut(both.groupBy(F.col("a").alias("_hub")).agg(parts.alias("_parts")).filter("_parts > 1"))
    if hubs.isEmpty():
        return edges

    def part(own: str, other: str) -> Column:
        return F.when(F.col("_parts").isNull(), F.col(own)).otherwise(F.concat_ws("\n", own, F.pmod(F.xxhash64(other), F.col("_parts")).cast("string")))

    one = edges.join(hubs, F.col("a") == F.col("_hub"), "left").select(part("a", "b").alias("a"), "b", F.col("a").alias("_a"))
    two = one.join(hubs, F.col("b") == F.col("_hub"), "left").select("a", part("b", "_a").alias("b"))
    numbers = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_n")
    return two.unionByName(hubs.select("_hub", numbers).select(F.concat_ws("\n", "_hub", F.col("_n").cast("string")).alias("a"), F.col("_hub").alias("b")))


def _contracted(now: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Round ``k``: each tail with a neighbour of heads hooks to the least of them. Hooks (``a``, ``to``) and the
    edges that are left."""
    heads = lambda c: F.pmod(F.shiftright(F.xxhash64(F.lit(k), F.col(c)), 17), F.lit(2)) == 1
    both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
    hook = both.filter(~heads("a") & heads("b")).groupBy("a").agg(F.min("b").alias("to"))
    one = now.join(hook.withColumnRenamed("to", "_a"), "a", "left").select(F.coalesce("_a", "a").alias("a"), "b")
    two = one.join(hook.select(F.col("a").alias("b"), F.col("to").alias("_b")), "b", "left").select("a", F.coalesce("_b", "b").alias("b"))
    return hook, two.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame, max_rounds: int = 200, hub_edges: int = HUB_EDGES) -> DataFrame:
    """``vertex`` and ``component`` (one of its vertices) of all vertices on an edge (``a``, ``b``).

    Null ends are no edge; repeated edges and edges of a vertex with itself change nothing. Coins depend on the
    vertex and the round alone, so that reruns give the same components and the same names. Names hold no line feed.
    """
    spark = edges.sparkSession
    clean = edges.filter("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    now, old = cut_at(split_hubs(cut(clean.distinct()), hub_edges))
    tables: list[DataFrame] = []
    written: list[str] = []
    rounds = 0
    while True:
        if rounds >= max_rounds:
            raise RuntimeError(f"edges are left after {max_rounds} rounds")
        hook, left = _contracted(now, rounds)
        rounds += 1
        seen = Observation()
        rows = hook.select(F.lit(True).alias("hook"), "a", F.col("to").alias("b"))
        rows = rows.unionByName(left.select(F.lit(False).alias("hook"), "a", "b")).observe(seen, F.count_if(~F.col("hook")).alias("edges"))
        table, path = cut_at(rows)
        tables.append(table.filter("hook").select(F.col("a").alias("vertex"), F.col("b").alias("component")))
        written.append(path)
        now = table.filter("not hook").select("a", "b")
        if not seen.get["edges"]:
            break
    names = tables[0]
    for t in tables[1:]:
        names = names.unionByName(t)
    names, path = cut_at(names)
    drop_cut(spark, old, *written)
    for _ in range((rounds - 1).bit_length()):  # a chain has a hook a round at most; each step doubles its reach
        up = names.select(F.col("vertex").alias("component"), F.col("component").alias("_top"))
        old = path
        names, path = cut_at(names.join(up, "component", "left").select("vertex", F.coalesce("_top", "component").alias("component")))
        drop_cut(spark, old)
    every = names.unionByName(names.select(F.col("component").alias("vertex"), "component").distinct())
    whole = F.substring_index("component", "\n", 1).alias("component")  # a part stands for its vertex
    return every.filter(~F.col("vertex").contains("\n")).select("vertex", whole)


def grouped_plans(plans: DataFrame, recordings: DataFrame) -> DataFrame:
    """Each plan row with its ``component``: the related group of its subject.

    A subject on no edge is a group of its own, and so is a plan row without a readable code. Other columns of
    the plans stay; ``component`` must not be among them.
    """
    named = components(subject_edges(recordings))
    subject = F.concat(F.lit("s:"), codes.subject_number(F.col("subject")).cast("string"))
    rows = plans.withColumn("_subject", F.coalesce(subject, F.concat(F.lit("p:"), F.col("plan_id").cast("string"))))
    of = named.filter(F.col("vertex").startswith("s:")).select(F.col("vertex").alias("_subject"), F.col("component").alias("_found"))
    return rows.join(of, "_subject", "left").withColumn("component", F.coalesce("_found", "_subject")).drop("_subject", "_found")


def split_components(rows: DataFrame, shares: dict[str, float] | None = None, seed: int = 42) -> DataFrame:
    """Adds ``split`` to rows with a ``component``: whole components go to each split, near the given shares.

    Components stand in order of a seeded hash, those that weigh over a thousandth first, and get the split in
    whose stretch of the cumulative weight their middle lies; a heavy component thus falls to the first, largest
    split. The cumulative weight is summed over a fixed number of buckets, then within each.
    """
    shares = shares or {"train": 0.8, "validation": 0.1, "test": 0.1}
    weight = cut(rows.groupBy("component").agg(F.count("*").alias("_w")))
    total = weight.agg(F.sum("_w")).first()[0] or 1
    h = F.xxhash64(F.lit(seed), F.col("component"))
    placed = weight.withColumn("_h", h).withColumn(
        "_bucket", F.when(F.col("_w") * 1000 > total, F.lit(-1)).otherwise(F.pmod("_h", F.lit(BUCKETS)))
    )
    upto = Window.partitionBy(F.lit(1)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("_bucket").agg(F.sum("_w").alias("_s"))  # BUCKETS + 1 rows at most
    sums = sums.select("_bucket", F.coalesce(F.sum("_s").over(upto), F.lit(0)).alias("_before"))
    inner = F.sum("_w").over(Window.partitionBy("_bucket").orderBy("_h", "component").rowsBetween(Window.unboundedPreceding, 0))
    middle = (F.col("_before") + F.col("_end") - F.col("_w") / 2) / F.lit(float(total))
    names, parts = list(shares), list(shares.values())
    name = F.lit(names[-1])
    for k in range(len(names) - 2, -1, -1):
        name = F.when(middle < sum(parts[: k + 1]) / sum(parts), names[k]).otherwise(name)
    chosen = placed.withColumn("_end", inner).join(F.broadcast(sums), "_bucket").select("component", name.alias("split"))
    return rows.join(chosen, "component", "left")


def split_conflicts(rows: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``plan_lo``, ``plan_hi``: rows of one component whose given partitions differ.

    Only rows that do differ meet: each component's rows are joined between unequal partitions, never with their
    own. The rows of a large component lie in a square of cells, so that about ``cell_rows`` of either side meet in a
    task.
    """
    part = codes.partition_name(F.col("plan_partition"))
    named = rows.select("component", "plan_id", part.alias("part")).filter("part is not null")
    mixed = named.groupBy("component").agg(F.countDistinct("part").alias("_k"), F.count("*").alias("_n")).filter("_k > 1")
    live = cut(named.join(mixed, "component").withColumn("_cells", F.ceil(F.col("_n") / cell_rows).cast("int")))
    own = F.pmod(F.xxhash64("plan_id"), F.col("_cells")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("_cells") - 1))
    left = live.select("component", "plan_id", "part", own.alias("_i"), every.alias("_j"))
    right = live.select("component", F.col("plan_id").alias("plan_hi"), F.col("part").alias("_other"), every.alias("_i"), own.alias("_j"))
    after = {"test": ("train", "validation"), "train": ("validation",)}
    pairs = None
    for one, others in after.items():
        p = left.filter(F.col("part") == one).join(right.filter(F.col("_other").isin(*others)), ["component", "_i", "_j"])
        pairs = p if pairs is None else pairs.unionByName(p)
    return pairs.select(F.least("plan_id", "plan_hi").alias("plan_lo"), F.greatest("plan_id", "plan_hi").alias("plan_hi")).distinct()


def split_groups(rows: DataFrame) -> DataFrame:
    """The same by class: one row for each component with its least ``plan_id`` (``first_plan``), its plan rows (``n``),
    those given to each partition, and the ``pairs`` of rows whose partitions differ. With ``component`` of every row
    (``grouped_plans``) the pairs follow."""
    part = codes.partition_name(F.col("plan_partition"))
    count = lambda name: F.count_if(F.coalesce(part == name, F.lit(False))).alias(name)
    g = rows.groupBy("component").agg(F.min("plan_id").alias("first_plan"), F.count("*").alias("n"), count("train"), count("validation"), count("test"))
    pairs = F.col("train") * F.col("validation") + F.col("train") * F.col("test") + F.col("validation") * F.col("test")
    return g.withColumn("pairs", pairs)
