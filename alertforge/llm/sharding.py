"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Rows are dealt to blocks by a hash of their identity. How many rows of each
block go to each shard is drawn exactly: splitting a population of N rows with
shard capacities C over blocks of sizes n is a multivariate hypergeometric
draw. Each block is then permuted locally, its first A[b][0] rows go to shard
0, the next A[b][1] to shard 1 and so on; inside each shard rows are permuted
again. The outcome is a uniform random permutation cut into shards whose sizes
differ by at most one (law ``rows``).

Only DataFrame functions: the matrix is drawn by nested ``aggregate`` calls on
a tree of blocks (fan-out 32), so no task holds more than 32 x shards counts,
and blocks, not shards, bound what a window sorts.

Defined results: ``df`` holds narrow identity columns (any may be null); rows
equal in all of them are counted first and told apart by an occurrence number.
The copies of one row come out of one array in one task, so a row may repeat up
to about two billion times; they spread over all blocks after that. An empty
table gives no rows. Fewer rows than shards leaves shards empty. Columns named
``shard``, ``slot`` or starting with ``_`` in ``df`` are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertforge.llm.common import freeze, prefix_sums, unit_interval

FAN_OUT = 32
ROWS_PER_BLOCK = 50_000
MIN_BLOCKS = 1024


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hypergeometric(population: Column, marked: Column, draws: Column, u: Column) -> Column:
    """Marked items among ``draws`` drawn without replacement, by inversion of ``u``.

    Probabilities relative to the left end follow from the ratio of
    neighbouring terms, so no factorial is needed. The walk spans the support,
    or ten standard deviations (and 30 values) around the mode where that is
    narrower; the mass beyond is under 1e-20, less than ``u`` resolves.
    """
    def dbl(c: Column) -> Column:
        return c.cast("double")

    lo = F.greatest(F.lit(0).cast("long"), draws - (population - marked))
    hi = F.least(draws, marked)
    mode = F.floor((dbl(draws) + 1) * (dbl(marked) + 1) / (dbl(population) + 2)).cast("long")
    spread = F.ceil(10 * F.sqrt(F.greatest(F.lit(0.0), dbl(draws) * dbl(marked) / dbl(population)
                                           * (1 - dbl(marked) / dbl(population))))).cast("long") + 30

    def walk(ends: Column) -> Column:
        left, right = ends["left"], ends["right"]

        def term(x: Column, weight: Column) -> Column:  # weight of x + 1 from that of x
            return (weight * dbl(marked - x) * dbl(draws - x)
                    / (dbl(x + 1) * dbl(population - marked - draws + x + 1)))

        steps = F.sequence(left, right)
        total = F.aggregate(
            steps, F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("w")),
            lambda s, x: F.struct((s["sum"] + s["w"]).alias("sum"),
                                  F.when(x < right, term(x, s["w"])).otherwise(F.lit(0.0)).alias("w")),
            lambda s: s["sum"])
        return _let(total * u, lambda goal: F.aggregate(
            steps, F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("w"), left.alias("x")),
            lambda s, x: F.struct(
                (s["sum"] + s["w"]).alias("sum"),
                F.when(x < right, term(x, s["w"])).otherwise(F.lit(0.0)).alias("w"),
                F.when(s["sum"] + s["w"] < goal, F.least(x + 1, right)).otherwise(s["x"]).alias("x")),
            lambda s: s["x"]))

    return F.when(lo >= hi, lo).otherwise(_let(
        F.struct(F.greatest(lo, mode - spread).alias("left"), F.least(hi, mode + spread).alias("right")), walk))


def _draw_children(capacities: Column, sizes: Column, node: Column, seed: int) -> Column:
    """Counts[child][shard] for the children of one node of the block tree."""
    empty = F.array().cast("array<bigint>")

    def child(state: Column, c: Column) -> Column:
        caps = state["caps"]
        size = F.get(sizes, c)
        start = F.struct(size.alias("k"),
                         F.aggregate(caps, F.lit(0).cast("long"), lambda a, x: a + x).alias("pop"),
                         empty.alias("out"))

        def shard(s: Column, j: Column) -> Column:
            cap = F.get(caps, j)
            u = unit_interval(F.xxhash64(F.lit(seed), node, c, j))
            x = _let(hypergeometric(s["pop"], cap, s["k"], u), lambda v: F.struct(
                (s["k"] - v).alias("k"), (s["pop"] - cap).alias("pop"),
                F.concat(s["out"], F.array(v)).alias("out")))
            return x

        drawn = F.aggregate(F.sequence(F.lit(0), F.size(caps) - 1), start, shard, lambda s: s["out"])
        return _let(drawn, lambda d: F.struct(
            F.zip_with(caps, d, lambda a, b: a - b).alias("caps"),
            F.concat(state["rows"], F.array(d)).alias("rows")))

    return F.aggregate(
        F.sequence(F.lit(0), F.size(sizes) - 1),
        F.struct(capacities.alias("caps"), F.array().cast("array<array<bigint>>").alias("rows")),
        child, lambda s: s["rows"])


def communication_matrix(counts: DataFrame, n_blocks: int, n_rows: int, n_shards: int, seed: int) -> DataFrame:
    """``(_block, _row)``: how many rows of each block go to each shard.

    ``counts`` holds ``(_block, _n)`` for the blocks that have rows.
    """
    levels = max(1, math.ceil(math.log(max(n_blocks, 2), FAN_OUT) - 1e-9))
    spark = counts.sparkSession
    share, rest = divmod(n_rows, n_shards)
    nodes = spark.range(1).select(
        F.lit(0).cast("long").alias("_node"),
        F.transform(F.sequence(F.lit(0), F.lit(n_shards - 1)),
                    lambda j: F.lit(share).cast("long") + (j < rest).cast("long")).alias("_caps"))
    for level in range(1, levels + 1):
        width = FAN_OUT ** (levels - level)  # blocks under a child
        child = F.floor(F.col("_block") / F.lit(width)).cast("long")
        kids = (counts.groupBy(child.alias("_child")).agg(F.sum("_n").alias("_n"))
                .groupBy(F.floor(F.col("_child") / FAN_OUT).cast("long").alias("_node"))
                .agg(F.sort_array(F.collect_list(F.struct("_child", "_n"))).alias("_kids")))
        # a fixed number of tasks: the rows are few and small, the draws are the work
        tasks = min(FAN_OUT ** (level - 1), int(spark.conf.get("spark.sql.shuffle.partitions")))
        drawn = nodes.join(kids, "_node").repartition(tasks, "_node").withColumn("_rows", _draw_children(
            F.col("_caps"), F.col("_kids._n"), F.hash(F.lit(level), F.col("_node")), seed))
        nodes = drawn.select(F.explode(F.arrays_zip(F.col("_kids._child").alias("c"), "_rows")).alias("_x")) \
            .select(F.col("_x.c").alias("_node"), F.col("_x._rows").alias("_caps"))
    return nodes.select(F.col("_node").alias("_block"), F.col("_caps").alias("_row"))


def hypergeometric_shuffle(df: DataFrame, n_shards: int, seed: int = 0,
                           rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """``df`` with ``shard`` and ``slot`` (gapless from 0 inside each shard)."""
    keys = [c for c in df.columns if c not in ("shard", "slot") and not c.startswith("_")]
    same = df.select(*keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("_same"))
    rows = freeze(same.select(
        *keys, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_same"))).alias("_copy")), "shard-rows")
    n_rows = rows.count()
    n_blocks = max(MIN_BLOCKS, math.ceil(n_rows / rows_per_block))

    def random(salt: int) -> Column:
        return F.xxhash64(F.lit(seed), F.lit(salt), *keys, "_copy")

    rows = rows.withColumns({"_block": F.pmod(random(1), F.lit(n_blocks)).cast("long"),
                             "_order": random(2), "_place": random(3)})
    counts = rows.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
    matrix = communication_matrix(counts, n_blocks, n_rows, n_shards, seed)
    ends = matrix.select("_block", F.transform(
        F.sequence(F.lit(1), F.size("_row")),
        lambda j: F.aggregate(F.slice("_row", 1, j), F.lit(0).cast("long"), lambda a, x: a + x)).alias("_ends"))

    # permute inside each block, cut the permutation by the block's row of the matrix
    tie = [F.col(c).asc_nulls_first() for c in keys] + [F.col("_copy")]
    local = Window.partitionBy("_block").orderBy("_order", *tie)
    dealt = (rows.withColumn("_k", F.row_number().over(local).cast("long") - 1)
             .join(ends, "_block")
             .withColumn("shard", F.size(F.filter("_ends", lambda e: e <= F.col("_k"))).cast("int"))
             .select(*keys, "_copy", "_place", "shard"))
    # permute again inside each shard: order by a second hash, in stretches of that hash
    stretches = max(8, math.ceil(n_blocks / n_shards))
    dealt = freeze(dealt.withColumn(
        "_stretch", F.floor(unit_interval(F.col("_place")) * stretches).cast("int")), "shard-dealt")
    sizes = dealt.groupBy("shard", "_stretch").agg(F.count(F.lit(1)).alias("_n"))
    starts = prefix_sums(sizes, ["shard"], "_stretch", "_n", "_start").drop("_n")
    within = Window.partitionBy("shard", "_stretch").orderBy("_place", *tie)
    return (dealt.withColumn("_k", F.row_number().over(within).cast("long") - 1)
            .join(starts, ["shard", "_stretch"])
            .select(*keys, "shard", (F.col("_start") + F.col("_k")).alias("slot")))
