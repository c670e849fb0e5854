"""Statistics, failure patterns, pipeline metrics and summary sections.

Covers D9-D14, D16-D19, F2-F4. Top-n lists use ``orderBy(...).limit(n)``
(TakeOrderedAndProject: each task keeps n rows, the driver merges n per
task), with key columns as tie-breakers so results are deterministic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertforge import schemas as S
from alertforge.functions import alerts as AF

DEVICE_KEYS = ["organization", "device"]


def _critical_flag() -> F.Column:
    return (F.lower(F.coalesce(F.col("severity").cast("string"), F.lit("None"))) == "critical").cast("long")


def top_failing_devices(alerts: DataFrame, incidents: DataFrame) -> DataFrame:
    """D9 + C6: alert and critical counts per device with its incident count."""
    per_device = alerts.groupBy(*DEVICE_KEYS).agg(
        F.count("alert_id").alias("total_alerts"),
        F.sum(_critical_flag()).alias("critical_alerts"))
    inc = incidents.groupBy(*DEVICE_KEYS).agg(F.count_distinct("incident_id").alias("incidents_count"))
    return (per_device.join(inc, DEVICE_KEYS, "left")
            .withColumn("incidents_count", F.coalesce("incidents_count", F.lit(0)).cast("long")))


def most_frequent_alert_types(alerts: DataFrame) -> DataFrame:
    """D10."""
    return (alerts.where(F.col("alert_type").isNotNull()).groupBy("alert_type")
            .agg(F.count("alert_id").alias("total_count"),
                 F.count_distinct("device").alias("devices_affected")))


def severity_distribution(alerts: DataFrame) -> DataFrame:
    """Counts per lower-cased severity text; a null shows as ``none``."""
    sev = F.lower(F.coalesce(F.col("severity").cast("string"), F.lit("None")))
    return alerts.groupBy(sev.alias("severity")).agg(F.count(F.lit(1)).alias("count"))


def incident_frequency_trends(incidents: DataFrame) -> DataFrame:
    """Per day of start time."""
    return (incidents.groupBy(F.to_date("start_time").alias("date"))
            .agg(F.count_distinct("incident_id").alias("incidents_count"),
                 F.avg("severity_score").alias("avg_severity"),
                 AF.avg_minutes("start_time", "end_time").alias("avg_duration_minutes")))


def detect_failure_patterns(alerts: DataFrame, top_n: int = 10) -> DataFrame:
    """D13 + F2: top (organization, device, alert_type) by impact."""
    agg = (alerts.groupBy("organization", "device", "alert_type")
           .agg(F.count("alert_id").alias("total_alerts"),
                F.count_distinct("incident_id").alias("incidents_impacted"),
                F.avg("severity_weight").alias("avg_severity")))
    return agg.orderBy(F.desc("incidents_impacted"), F.desc("total_alerts"), F.desc("avg_severity"),
                       "organization", "device", "alert_type").limit(top_n)


def summarize_clusters(incidents: DataFrame) -> DataFrame:
    """Clusters without noise (-1)."""
    return (incidents.where(F.col("cluster_id") != -1).groupBy("cluster_id")
            .agg(F.count_distinct("incident_id").alias("incidents"),
                 F.avg("severity_score").alias("avg_severity_score"),
                 F.avg("alert_count").alias("avg_alert_count")))


def pipeline_metrics(alerts: DataFrame, incidents: DataFrame, clustered: DataFrame | None = None) -> DataFrame:
    """One row of totals and ratios."""
    # one aggregate per input, each read as a single scalar subquery
    a_fields = [F.count(F.lit(1)).cast("double").alias("n"), F.count("incident_id").cast("double").alias("covered")]
    if clustered is not None and "alert_cluster" in clustered.columns and clustered is alerts:
        a_fields.append(F.count(F.when(F.col("alert_cluster") != -1, F.lit(1))).cast("double").alias("clustered"))
    a = alerts.select(F.struct(*a_fields)).scalar()
    i = incidents.select(F.struct(
        F.count_distinct("incident_id").cast("double").alias("n"),
        F.coalesce(AF.avg_minutes("start_time", "end_time"), F.lit(0.0)).alias("avg_duration"))).scalar()
    total_alerts, covered, total_incidents = a["n"], a["covered"], i["n"]
    cols = [
        total_alerts.alias("total_alerts"),
        total_incidents.alias("total_incidents"),
        F.when(total_incidents > 0, total_alerts / total_incidents).otherwise(F.lit(0.0)).alias("alerts_per_incident"),
        F.when(total_alerts > 0, covered / total_alerts).otherwise(F.lit(0.0)).alias("incident_coverage_ratio"),
        i["avg_duration"].alias("avg_incident_duration_minutes"),
    ]
    if clustered is not None and "alert_cluster" in clustered.columns:
        non_noise = (a["clustered"] if clustered is alerts else
                     clustered.select(F.count(F.when(F.col("alert_cluster") != -1, F.lit(1))).cast("double")).scalar())
        cols.append(F.when(total_alerts > 0, non_noise / total_alerts).otherwise(F.lit(0.0))
                    .alias("clustered_alert_ratio"))
    spark = alerts.sparkSession
    return spark.range(1).select(*cols)


def summary_overview(incidents_gold: DataFrame, device_metrics: DataFrame) -> DataFrame:
    """The overview block of the summary."""
    inc = incidents_gold.select(F.count_distinct("incident_id").alias("total_incidents")).scalar()
    dev = device_metrics.agg(
        F.count_distinct("device").alias("total_devices"),
        F.coalesce(F.sum("total_alerts"), F.lit(0)).cast("long").alias("total_alerts"),
        # scores carry 2 decimals: summing whole cents is exact in any order
        F.coalesce(F.sum(F.round(F.col("reliability_score") * 100).cast("long")).cast("double")
                   / F.count("reliability_score") / F.lit(100.0), F.lit(0.0)).alias("avg_reliability_score"))
    return dev.select(inc.alias("total_incidents"), "total_devices", "total_alerts", "avg_reliability_score")


def value_counts(df: DataFrame, col: str, label: str, top_n: int = 5) -> DataFrame:
    """Most frequent values (as text), ties by value."""
    v = F.coalesce(F.col(col).cast("string"), F.lit("None"))
    return (df.groupBy(v.alias(label)).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), label).limit(top_n))


def alert_contexts(alerts: DataFrame) -> DataFrame:
    """Group sizes by (alert_type, description, cause), null keys kept."""
    return alerts.groupBy("alert_type", "description", "cause").agg(F.count(F.lit(1)).alias("count"))


def recent_alerts(alerts: DataFrame, top_n: int = 5) -> DataFrame:
    """newest alerts with their context columns."""
    cols = [c for c in S.RECENT_ALERT_COLUMNS if c in alerts.columns]
    return alerts.orderBy(F.desc("timestamp"), F.desc("alert_id")).limit(top_n).select(*cols)


def recent_incidents(incidents_gold: DataFrame, top_n: int = 5) -> DataFrame:
    return incidents_gold.orderBy(F.desc("start_time"), F.desc("incident_id")).limit(top_n)


def timeline_tail(timeline: DataFrame, top_n: int = 5) -> DataFrame:
    """last n buckets (sorted descending, limited, in ascending order at the sink)."""
    return timeline.orderBy(F.desc("timestamp")).limit(top_n)


def top_devices_by_failure(device_metrics: DataFrame, top_n: int = 5) -> DataFrame:
    """F2 for the summary: devices by incidents, then critical, then total alerts."""
    return device_metrics.orderBy(F.desc("incidents_count"), F.desc("critical_alerts"), F.desc("total_alerts"),
                                  "organization", "device").limit(top_n)
