"""Views over the driver's generated tables.

The test data has no alert feeds, so alert-shaped inputs are derived from
``events`` by fixed rules (documented in FIXTURES.md). Every view is a
projection of the whole table, so its work grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

# --------------------------------------------------------------------------
# FIXED VALUES: fixture rules over `events`
# --------------------------------------------------------------------------
SOURCES_BY_USER_MOD3 = ["meraki", "auvik", "ncentral"]
ENTITY_TYPES_BY_USER_MOD3 = ["device", "service", "interface"]
DESCRIPTION_BY_EVENT_TYPE = {
    "error": "Device unreachable",
    "click": "CPU above limit",
    "view": "Packet loss on link",
    "signup": "Login failed",
    "purchase": "Batch job note",
}
# value thresholds for severities (highest first)
SEVERITY_BY_VALUE = [(113, " Critical"), (60, "high"), (35, "medium"), (10, "low")]
VENDOR_LEVEL_BY_VALUE = [(113, "critical"), (60, "Warning"), (10, "Emergency")]
NCENTRAL_STATE_BY_VALUE = [(113, "Failed"), (60, "Warning"), (10, "Normal")]
EVENT_STATE_BY_MOD4 = ["OK", "triggered", "Cleared", None]
# question prefixes so keyword rules have something to find
QUESTION_PREFIXES = [
    "Why is the VPN down?",
    "Is the database failing?",
    "Why is CPU high?",
    "Is the disk full?",
    "Is the certificate expired?",
    "Summarize recent incidents.",
    "What are the resolution steps?",
    "Which device fails most?",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _by_thresholds(value: Column, rules: list[tuple[float, str]], default: Column) -> Column:
    expr = None
    for bound, label in rules:
        expr = F.when(value >= bound, F.lit(label)) if expr is None else expr.when(value >= bound, F.lit(label))
    return expr.otherwise(default)


def _pick(index: Column, values: list) -> Column:
    expr = None
    for i, v in enumerate(values[:-1]):
        expr = F.when(index == i, F.lit(v)) if expr is None else expr.when(index == i, F.lit(v))
    return expr.otherwise(F.lit(values[-1]))


def canonical_alert_view(events: DataFrame) -> DataFrame:
    """Canonical alert rows (11 columns) derived from ``events``."""
    uid, eid, val = F.col("user_id"), F.col("event_id"), F.col("value")
    description = None
    for etype, text in DESCRIPTION_BY_EVENT_TYPE.items():
        cond = F.col("event_type") == etype
        description = F.when(cond, F.lit(text)) if description is None else description.when(cond, F.lit(text))
    return events.select(
        eid.cast("string").alias("alert_id"),
        _pick(uid % 3, SOURCES_BY_USER_MOD3).alias("source"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.concat(F.lit("org-"), (uid % 4).cast("string")).alias("organization"),
        F.when(eid % 97 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("dev-"), (uid % 10).cast("string"))).alias("device"),
        _pick(uid % 3, ENTITY_TYPES_BY_USER_MOD3).alias("entity_type"),
        F.col("event_type").alias("alert_type"),
        _by_thresholds(val, SEVERITY_BY_VALUE,
                       F.when(eid % 11 == 0, F.lit(None).cast("string")).otherwise(F.lit("warning"))
                       ).alias("severity"),
        F.when(eid % 3 == 0, F.lit("resolved")).otherwise(F.lit("open")).alias("status"),
        description.alias("description"),
        F.when(eid % 7 == 0, F.lit(None).cast("string"))
        .when(eid % 2 == 0, F.lit("carrier")).otherwise(F.lit("config")).alias("cause"),
    )


def canonical_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_alert_view(table(spark, sf_dir, "events"))


def _vendor_common(events: DataFrame) -> DataFrame:
    uid, eid = F.col("user_id"), F.col("event_id")
    return events.select(
        "*",
        eid.cast("string").alias("_id"),
        F.when(eid % 5 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("c-"), (eid - eid % 4).cast("string"))).alias("_corr"),
        F.concat(F.lit("org-"), (uid % 4).cast("string")).alias("_org"),
        F.concat(F.lit(" Dev-"), (uid % 10).cast("string"), F.lit(" ")).alias("_dev"),
        F.concat(F.lit("SN"), uid.cast("string")).alias("_serial"),
        _pick(eid % 4, EVENT_STATE_BY_MOD4).alias("_state"),
        F.when(eid % 2 == 1, F.date_trunc("minute", F.col("ts").cast("timestamp")))
        .otherwise(F.date_trunc("day", F.col("ts").cast("timestamp"))).alias("_day"),
        (eid % 10 == 0).alias("_synthetic"),
        F.col("ts").cast("timestamp").alias("_ingest"),
    )


def _with_duplicates(df: DataFrame, id_col: str) -> DataFrame:
    """Add a copy of every tenth row under ``<id>_dup`` (same dedupe keys),
    generated in the same scan."""
    copies = F.when((F.col("event_id") % 10) == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    out = df.withColumn("_copy", F.explode(copies))
    return (out.withColumn(id_col, F.when(F.col("_copy") == 1, F.concat(F.col(id_col), F.lit("_dup")))
                           .otherwise(F.col(id_col)))
            .drop("_copy"))


def bronze_meraki(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bronze_meraki_view(table(spark, sf_dir, "events"))


def bronze_auvik(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bronze_auvik_view(table(spark, sf_dir, "events"))


def bronze_ncentral(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bronze_ncentral_view(table(spark, sf_dir, "events"))


def bronze_meraki_view(events: DataFrame) -> DataFrame:
    ev = _vendor_common(events.where(F.col("user_id") % 3 == 0))
    out = ev.select(
        "event_id",
        F.col("_id").alias("alert_id"),
        F.col("_corr").alias("correlation_id"),
        F.col("_org").alias("organization_name"),
        F.col("_dev").alias("device_name"),
        F.col("_serial").alias("device_serial"),
        F.col("event_type").alias("check_name"),
        F.col("event_type").alias("alert_type"),
        _by_thresholds(F.col("value"), VENDOR_LEVEL_BY_VALUE, F.lit(None).cast("string")).alias("alert_level"),
        F.col("_state").alias("event_state"),
        F.col("_day").alias("occurred_at"),
        F.col("_synthetic").alias("synthetic"),
        F.col("_ingest").alias("ingestion_time"),
    )
    return _with_duplicates(out, "alert_id").drop("event_id")


def bronze_auvik_view(events: DataFrame) -> DataFrame:
    ev = _vendor_common(events.where(F.col("user_id") % 3 == 1))
    out = ev.select(
        "event_id",
        F.col("_id").alias("alert_id"),
        F.col("_corr").alias("correlation_id"),
        F.col("_org").alias("company_name"),
        F.col("_dev").alias("entity_name"),
        F.col("_serial").alias("entity_id"),
        F.col("event_type").alias("entity_type"),
        F.col("event_type").alias("alert_name"),
        _by_thresholds(F.col("value"), VENDOR_LEVEL_BY_VALUE, F.lit(None).cast("string")).alias("alert_severity_string"),
        F.col("_state").alias("event_state"),
        F.col("_day").alias("event_time"),
        F.col("_synthetic").alias("synthetic"),
        F.col("_ingest").alias("ingestion_time"),
    )
    return _with_duplicates(out, "alert_id").drop("event_id")


def bronze_ncentral_view(events: DataFrame) -> DataFrame:
    ev = _vendor_common(events.where(F.col("user_id") % 3 == 2))
    out = ev.select(
        "event_id",
        F.col("_id").alias("active_notification_trigger_id"),
        F.col("_corr").alias("correlation_id"),
        F.col("_org").alias("customer_name"),
        F.col("_dev").alias("device_name"),
        F.col("_serial").alias("device_uri"),
        F.col("event_type").alias("affected_service"),
        _by_thresholds(F.col("value"), NCENTRAL_STATE_BY_VALUE, F.lit(None).cast("string")).alias("qualitative_new_state"),
        F.col("_state").alias("event_state"),
        F.col("_day").alias("time_of_state_change"),
        F.col("_synthetic").alias("synthetic"),
        F.col("_ingest").alias("ingestion_time"),
    )
    return _with_duplicates(out, "active_notification_trigger_id").drop("event_id")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns of ``conversations`` as a question table (qid, question)."""
    conv = table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    prefix = _pick(F.col("conv_id") % len(QUESTION_PREFIXES), QUESTION_PREFIXES)
    return conv.select(
        F.concat_ws(":", "conv_id", "turn").alias("qid"),
        F.concat_ws(" ", prefix, F.col("text")).alias("question"),
    )
