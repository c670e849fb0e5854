"""Helpers shared by the pipeline operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from alertforge.session import ensure_checkpoint_dir, ship_package

# FIXED VALUES: the white space that separates words (space, tab to carriage return).
WORD_SPACE = " \t\n\x0b\x0c\r"
WORD_SPACE_CLASS = "[\\x20\\x09-\\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, by a path that only Spark has to understand."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """UTC session, package on the executors, reliable checkpoint folder."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # rows hold whole texts: keep the batches that go to Python small
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    ship_package(spark)
    ensure_checkpoint_dir(spark)


def work_path(spark: SparkSession, tag: str) -> str:
    """A new folder under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/llm-{tag}-{uuid.uuid4().hex}"


def freeze(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder once and read it back.

    A lost executor then re-reads files instead of re-running the job, and
    every later use sees the same rows.
    """
    path = work_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def freeze_counted(df: DataFrame, tag: str, counted: Column | None = None) -> tuple[DataFrame, int]:
    """``freeze``, and how many rows (or non-null values of ``counted``) were written, without another job."""
    seen = Observation()
    counted = F.lit(1) if counted is None else counted
    frozen = freeze(df.observe(seen, F.count(counted).alias("n")), tag)
    return frozen, seen.get["n"]


def text_of(column: str = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of a text (empty for null or blank)."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WORD_SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")) \
            .otherwise(F.split(trimmed, WORD_SPACE_CLASS + "+"))


def n_words_of(text: Column) -> Column:
    """Number of words, without building the array."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]++")).cast("long")


def prefix_sums(buckets: DataFrame, group: list[str], order: str, value: str, out: str) -> DataFrame:
    """Exclusive prefix sum of ``value`` over ``order`` inside ``group``.

    ``buckets`` holds one row per (group, bucket): its size follows the number
    of buckets, never the number of rows behind them.
    """
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return buckets.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)).cast("long"))


def unit_interval(hash64: Column) -> Column:
    """A 64-bit hash as a double in (0, 1): 53 high bits, centred."""
    bits = F.shiftrightunsigned(hash64, 11).cast("double")
    return (bits + F.lit(0.5)) * F.lit(2.0 ** -53)


def count_rows(df: DataFrame) -> int:
    """Row count (read from file footers where the input is plain Parquet)."""
    return df.count()
