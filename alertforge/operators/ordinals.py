"""Global, gap-free row numbers without a single-task window.

Exact methods:

* ``ordinals_by_bucket`` - when a bucket column is monotone with the sort
  order (time windows for incidents). Row numbers are computed inside each
  bucket (one task per bucket, the bucket size is bounded by the bucket
  width), bucket offsets come from prefix sums over the per-bucket counts.
* ``ordinals_by_range`` - for any total order. The data is range-partitioned
  and sorted, cut from its lineage with a reliable checkpoint (so partition
  ids cannot move between counting and numbering), then each row gets the
  sum of the counts of earlier partitions plus its position in its partition.
* ``offsets_by_range`` - the same for rows that take several places each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertforge.session import ensure_checkpoint_dir


def _prefix_offsets(counts: DataFrame, key: str, group: Column) -> DataFrame:
    """Exclusive prefix sums of ``_n`` ordered by ``key``.

    Two levels: running sums inside each ``group`` (e.g. a day of windows),
    then running sums over the per-group totals. The last window runs over
    one row per group (one row per calendar day for time buckets), a table
    whose size is bounded by the calendar span, not by the data volume.
    """
    counts = counts.withColumn("_g", group)
    inner = Window.partitionBy("_g").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_inner", F.coalesce(F.sum("_n").over(inner), F.lit(0)))
    totals = counts.groupBy("_g").agg(F.sum("_n").alias("_gn"))
    outer = Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_outer", F.coalesce(F.sum("_gn").over(outer), F.lit(0)))
    return (counts.join(totals, "_g")
            .select(key, (F.col("_outer") + F.col("_inner")).alias("_offset")))


def ordinals_by_bucket(df: DataFrame, bucket: str, order_cols: list[str], out_col: str,
                       group: Column | None = None) -> DataFrame:
    """1-based row number in order ``(bucket, *order_cols)``.

    ``bucket`` must sort no later than any of ``order_cols`` would reorder it
    (every row of an earlier bucket sorts first). ``group`` coarsens buckets
    for the offset step (default: the calendar day of a timestamp bucket).
    """
    group = group if group is not None else F.to_date(F.col(bucket))
    part = Window.partitionBy(bucket)
    within = part.orderBy(*[F.col(c).asc_nulls_first() for c in order_cols])
    # one shuffle by bucket serves both the in-bucket numbers and the bucket sizes
    numbered = (df.withColumn("_rn", F.row_number().over(within))
                .withColumn("_n", F.count(F.lit(1)).over(part)))
    counts = numbered.where(F.col("_rn") == 1).select(bucket, "_n")
    offsets = _prefix_offsets(counts, bucket, group)
    return (numbered.join(offsets, bucket)
            .withColumn(out_col, (F.col("_offset") + F.col("_rn")).cast("long"))
            .drop("_rn", "_n", "_offset"))


def _ranged(df: DataFrame, order_cols: list[str], num_partitions: int | None) -> DataFrame:
    """Rows in range partitions, sorted, with their partition ``_pid`` and a rising ``_pos`` that stay as they are."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_first() for c in order_cols]
    ordered = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    # reliable checkpoint: a lost executor re-reads the same partitions
    frozen = ordered.checkpoint(eager=True)
    return (frozen.withColumn("_pid", F.spark_partition_id())
            .withColumn("_pos", F.monotonically_increasing_id()))


def _partition_offsets(tagged: DataFrame, size: Column) -> DataFrame:
    """Exclusive prefix sums of ``size`` by partition: one row per partition."""
    counts = tagged.groupBy("_pid").agg(F.sum(size).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_offset")))


def ordinals_by_range(df: DataFrame, order_cols: list[str], out_col: str,
                      num_partitions: int | None = None) -> DataFrame:
    """1-based row number for any total order ``order_cols`` (exact, distributed)."""
    tagged = _ranged(df, order_cols, num_partitions)
    local_pos = F.col("_pos") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return (tagged.join(_partition_offsets(tagged, F.lit(1)), "_pid")
            .withColumn(out_col, (F.col("_offset") + local_pos + 1).cast("long"))
            .drop("_pid", "_pos", "_offset"))


def offsets_by_range(df: DataFrame, order_cols: list[str], size_col: str, out_col: str,
                     num_partitions: int | None = None) -> DataFrame:
    """Sum of ``size_col`` over all rows before a row in the total order ``order_cols`` (exact, distributed)."""
    tagged = _ranged(df, order_cols, num_partitions)
    before = Window.partitionBy("_pid").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    return (tagged.withColumn("_local", F.coalesce(F.sum(size_col).over(before), F.lit(0)))
            .join(_partition_offsets(tagged, F.col(size_col)), "_pid")
            .withColumn(out_col, (F.col("_offset") + F.col("_local")).cast("long"))
            .drop("_pid", "_pos", "_offset", "_local"))
