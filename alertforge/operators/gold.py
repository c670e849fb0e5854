"""Gold tables: device metrics with reliability, alert-type stats, timeline.

Covers C5, C7, D5-D8, D22, I5, F1. All per-key work is hash aggregation
(partial + final), so a hot device is absorbed by the map-side combine.
Global maxima are scalar subqueries (one value), never a window over
everything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertforge import schemas as S
from alertforge.functions import alerts as AF

DEVICE_KEYS = ["organization", "device"]


def _critical_flag() -> F.Column:
    return (F.lower(F.coalesce(F.col("severity").cast("string"), F.lit("None"))) == "critical").cast("long")


def build_device_feature_table(alerts: DataFrame, incidents: DataFrame) -> DataFrame:
    """Per-device alert and incident metrics, missing -> 0."""
    freq = F.col("alert_frequency") if "alert_frequency" in alerts.columns else F.lit(0.0)
    alert_metrics = alerts.groupBy(*DEVICE_KEYS).agg(
        F.count("alert_id").alias("total_alerts"),
        F.sum(_critical_flag()).alias("critical_alerts"),
        F.avg("severity_weight").alias("avg_severity"),
        F.avg(freq).alias("alert_frequency"),
    )
    incident_metrics = incidents.groupBy(*DEVICE_KEYS).agg(
        F.count_distinct("incident_id").alias("incidents_count"),
        AF.avg_minutes("start_time", "end_time").alias("avg_incident_duration"),
        F.avg("severity_score").alias("avg_incident_severity"),
    )
    joined = alert_metrics.join(incident_metrics, DEVICE_KEYS, "left")
    return joined.fillna(0, subset=["incidents_count", "avg_incident_duration", "avg_incident_severity",
                                    "avg_severity", "alert_frequency"])


def compute_reliability_scores(metrics: DataFrame) -> DataFrame:
    """I5 + D22: 100 * (1 - weighted share of the maxima), clipped, 2 decimals."""
    # all maxima in one aggregate, read as one scalar subquery (floored at 1)
    tops = metrics.select(F.struct(*[F.greatest(F.max(F.col(c).cast("double")), F.lit(1.0)).alias(c)
                                     for c in S.RELIABILITY_WEIGHTS])).scalar()
    penalty = None
    for col, weight in S.RELIABILITY_WEIGHTS.items():
        term = F.lit(weight) * (F.col(col) / tops[col])
        penalty = term if penalty is None else penalty + term
    score = F.least(F.greatest(F.lit(100.0) * (F.lit(1.0) - penalty), F.lit(0.0)), F.lit(100.0))
    return metrics.withColumn("reliability_score", F.bround(score, 2))


def build_device_metrics_gold(alerts: DataFrame, incidents: DataFrame) -> DataFrame:
    scored = compute_reliability_scores(build_device_feature_table(alerts, incidents))
    return scored.select(*[c for c in S.DEVICE_COLUMNS if c in scored.columns])


def build_alert_stats_gold(alerts: DataFrame) -> DataFrame:
    """Per alert type (null type dropped)."""
    return (alerts.where(F.col("alert_type").isNotNull())
            .groupBy("alert_type").agg(
                F.count("alert_id").alias("total_count"),
                F.count_distinct("device").alias("devices_affected"),
                F.avg("severity_weight").alias("avg_severity"))
            .select(*S.ALERT_STATS_COLUMNS))


def build_incident_timeline_gold(alerts: DataFrame, incidents: DataFrame, freq: str | int = "5min") -> DataFrame:
    """D8 + C7: alerts and incidents per time bucket, full outer join, gaps -> 0."""
    from alertforge.operators.incidents import window_seconds
    secs = window_seconds(freq)
    alert_tl = (alerts.groupBy(AF.floor_time("timestamp", secs).alias("timestamp"))
                .agg(F.count("alert_id").alias("alerts_count")))
    incident_tl = (incidents.groupBy(AF.floor_time("start_time", secs).alias("timestamp"))
                   .agg(F.count_distinct("incident_id").alias("incidents_count"),
                        F.count(F.when(F.col("critical_alert_count") > 0, F.lit(1))).alias("critical_incidents")))
    return (alert_tl.join(incident_tl, "timestamp", "full_outer")
            .select("timestamp",
                    F.coalesce("alerts_count", F.lit(0)).cast("long").alias("alerts_count"),
                    F.coalesce("incidents_count", F.lit(0)).cast("long").alias("incidents_count"),
                    F.coalesce("critical_incidents", F.lit(0)).cast("long").alias("critical_incidents")))
