"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight and a schedule (a piecewise linear curve over
training time 0 to 1 that scales the weight). The weight sets the source's
share of the budget; shares stop at ``max_repeats`` times the source's size
and the excess is reshared by weight (water filling). The integral of the
schedule is the source's cumulative token demand; a document whose words start
at cumulative offset ``c`` of its source is needed when demand reaches ``c``,
so its training position is the inverse of the demand curve at ``c``.
Documents are then range-sorted by position.

Only DataFrame functions. Offsets are running sums in hash order, cut into
stretches of that hash per source: a source with a third of all rows is spread
like any other, and the only table without a partition key has one row per
source.

Defined results: a null text has size 0, sources sort by code point with null
last; rows equal in doc_id, source and size are one unit of that many rows and
are taken alike; documents of size 0 follow the rule of their offset and never
count. A source of size 0 has target 0. An empty table gives no rows. Extra
columns are left to the caller: the plan holds doc_id, source and size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertforge.llm.common import freeze, n_words_of, prefix_sums, unit_interval

# FIXED VALUES: weights by source rank, share of all words, most repeats of a source.
WEIGHTS = (3, 1, 2)
BUDGET_PERCENT = 150
MAX_REPEATS = 2

# Schedules by source rank, repeating: knots (time, factor) of a curve with mean 1.
SCHEDULES = (
    ((0.0, 1.4), (0.5, 1.0), (1.0, 0.6)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.6), (0.5, 1.0), (1.0, 1.4)),
)
ROWS_PER_STRETCH = 50_000
MIN_STRETCHES = 256


def demand_inverse(share: Column, knots: tuple[tuple[float, float], ...]) -> Column:
    """Time at which the integral of the schedule reaches ``share`` of its total."""
    areas = [(t1 - t0) * (f0 + f1) / 2 for (t0, f0), (t1, f1) in zip(knots, knots[1:])]
    total = sum(areas)
    out, reached = F.lit(float(knots[-1][0])), total
    for ((t0, f0), (t1, f1)), area in reversed(list(zip(zip(knots, knots[1:]), areas))):
        start = reached - area
        need = share * F.lit(total) - F.lit(start)  # area wanted inside this piece
        slope = (f1 - f0) / (t1 - t0)
        if abs(slope) < 1e-12:
            dt = need / F.lit(f0)
        else:  # f0 dt + slope dt^2 / 2 = need, in the form that does not cancel
            root = F.sqrt(F.greatest(F.lit(0.0), F.lit(f0 * f0) + F.lit(2 * slope) * need))
            dt = F.lit(2.0) * need / F.greatest(F.lit(1e-300), F.lit(f0) + root)
        out = F.when(share * F.lit(total) < F.lit(reached), F.lit(t0) + dt).otherwise(out)
        reached = start
    return F.least(F.greatest(out, F.lit(float(knots[0][0]))), F.lit(float(knots[-1][0])))


def source_targets(units: DataFrame) -> DataFrame:
    """One row per source: size, weight rank and target after water filling."""
    sizes = units.groupBy("_s", "_null").agg(F.sum("_words").alias("source_size"))
    rank = Window.orderBy("_null", "_s")  # one row per source
    sizes = sizes.withColumn("_rank", F.row_number().over(rank) - 1)
    sizes = sizes.withColumn("_weight", F.get(F.array(*[F.lit(w).cast("long") for w in WEIGHTS]),
                                              F.col("_rank") % len(WEIGHTS)))
    by_cap = Window.orderBy((F.col("source_size") / F.col("_weight")), "_rank")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy("_rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cap = F.col("source_size") * MAX_REPEATS
    sizes = sizes.withColumn("_level", (
        (F.sum("source_size").over(everything) * BUDGET_PERCENT
         - F.coalesce(F.sum(cap).over(before), F.lit(0)) * 100).cast("double")
        / (F.sum("_weight").over(after) * 100).cast("double")))
    sizes = sizes.withColumn("_open", cap.cast("double") / F.col("_weight") > F.col("_level"))
    level = F.max(F.when(F.col("_open"), F.col("_level"))).over(everything)
    return sizes.withColumn("target", F.when(F.col("_open"), level * F.col("_weight"))
                            .otherwise(cap.cast("double"))).drop("_level", "_open")


def mix_plan(docs: DataFrame, seed: int = 0, rows_per_stretch: int = ROWS_PER_STRETCH) -> DataFrame:
    """One row per distinct (doc_id, source, size): ``n_rows`` such documents,
    the source's size and target, ``copies`` of each that the mix takes and
    their ``positions`` in training time."""
    units = docs.select("doc_id", "source", n_words_of(F.col("text")).alias("size"))
    units = units.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n_rows"))
    units = freeze(units.withColumns({
        "_s": F.coalesce("source", F.lit("")), "_null": F.col("source").isNull(),
        "_words": F.col("size") * F.col("n_rows"),
        "_hash": F.xxhash64(F.lit(seed), "doc_id", "size")}), "mix-units")
    stretches = max(MIN_STRETCHES, math.ceil(units.count() / rows_per_stretch))
    units = units.withColumn("_stretch", F.floor(unit_interval(F.col("_hash")) * stretches).cast("long"))

    keys = ["_s", "_null", "_stretch"]
    sums = units.groupBy(*keys).agg(F.sum("_words").alias("_sum"))
    starts = prefix_sums(sums, ["_s", "_null"], "_stretch", "_sum", "_start").drop("_sum")
    starts = starts.join(source_targets(units), ["_s", "_null"])

    within = (Window.partitionBy(*keys).orderBy("_hash", F.col("doc_id").asc_nulls_first(), "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    rows = (units.withColumn("_in", F.coalesce(F.sum("_words").over(within), F.lit(0)))
            .join(starts, keys)
            .withColumn("_middle", F.col("_start") + F.col("_in") + F.col("_words") / F.lit(2.0)))

    def position(epoch: Column) -> Column:
        share = (F.col("_middle") + epoch * F.col("source_size")) / F.col("target")
        out = demand_inverse(share, SCHEDULES[-1])
        for k, knots in enumerate(SCHEDULES[:-1]):
            out = F.when(F.col("_rank") % len(SCHEDULES) == k, demand_inverse(share, knots)).otherwise(out)
        return out

    epochs = [F.lit(float(e)) for e in range(MAX_REPEATS)]
    taken = [F.when(F.col("_middle") + e * F.col("source_size") < F.col("target"), position(e)) for e in epochs]
    rows = rows.withColumn("positions", F.array_compact(F.array(*taken)))
    return rows.select("doc_id", "source", "size", "n_rows", "source_size", "target",
                       F.size("positions").alias("copies"), "positions")


def mix_documents(docs: DataFrame, seed: int = 0) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as planned, in training order."""
    own = docs.withColumns({"_size": n_words_of(F.col("text"))})
    plan = mix_plan(docs, seed).where("copies > 0").select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_planned"),
        F.col("positions").alias("_positions"))
    taken = own.join(plan, own["doc_id"].eqNullSafe(plan["_id"]) & own["source"].eqNullSafe(plan["_source"])
                     & (own["_size"] == plan["_planned"]))
    return (taken.select(*docs.columns, F.explode("_positions").alias("_position"))
            .repartitionByRange("_position", "doc_id")
            .sortWithinPartitions("_position", "doc_id").drop("_position"))
