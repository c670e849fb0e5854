"""End-to-end analytics job: silver alerts -> gold tables, statistics, summary.

One lazy plan per output over a shared alerts-with-incident table that is
persisted once (six outputs read it). Actions happen only at the sinks,
inside DBSCAN rounds and when the forest is grown.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertforge import schemas as S
from alertforge.operators import gold as GOLD
from alertforge.operators import iforest as IF
from alertforge.operators import incidents as INC
from alertforge.operators import ml as ML
from alertforge.operators import reports as REP
from alertforge.operators.ordinals import ordinals_by_range
from alertforge.sources import files as FILES


def _rows_struct(df: DataFrame, order: list, cols: list[str], n: int) -> F.Column:
    """Top-n rows of ``df`` as an ordered array of structs (a bounded scalar)."""
    ranked = df.orderBy(*order).limit(n)
    with_rank = ranked.select(F.monotonically_increasing_id().alias("_r"), *cols)
    arr = with_rank.select(F.sort_array(F.collect_list(F.struct("_r", *cols))).alias("a"))
    return arr.select(F.transform("a", lambda x: x.dropFields("_r"))).scalar()


def create_incident_summary(spark: SparkSession, incidents_gold: DataFrame, device_metrics: DataFrame,
                            alert_stats: DataFrame, timeline: DataFrame, alerts: DataFrame | None = None,
                            top_n: int = 5, generated_at: str | None = None) -> DataFrame:
    """D17-D19, F2-F4 as one nested row (``overview`` + eight lists)."""
    gen = F.lit(generated_at) if generated_at is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    ov = REP.summary_overview(incidents_gold, device_metrics)
    overview = ov.select(F.struct(*ov.columns)).scalar()
    causes = REP.value_counts(incidents_gold, "incident_cause", "incident_cause", top_n)
    descs = REP.value_counts(incidents_gold, "description", "incident_description", top_n)
    cols = [gen.alias("generated_at"), overview.alias("overview"),
            _rows_struct(device_metrics, [F.desc("incidents_count"), F.desc("critical_alerts"),
                                          F.desc("total_alerts"), "organization", "device"],
                         device_metrics.columns, top_n).alias("top_failing_devices"),
            _rows_struct(alert_stats, [F.desc("total_count"), "alert_type"], alert_stats.columns, top_n)
            .alias("most_frequent_alert_types"),
            _rows_struct(causes, [F.desc("count"), "incident_cause"], causes.columns, top_n)
            .alias("top_incident_causes"),
            _rows_struct(descs, [F.desc("count"), "incident_description"], descs.columns, top_n)
            .alias("top_incident_descriptions")]
    if alerts is not None:
        ctx = REP.alert_contexts(alerts)
        cols.append(_rows_struct(ctx, [F.desc("count"), F.asc_nulls_first("alert_type"),
                                       F.asc_nulls_first("description"), F.asc_nulls_first("cause")],
                                 ctx.columns, top_n).alias("top_alert_contexts"))
        rc = [c for c in S.RECENT_ALERT_COLUMNS if c in alerts.columns]
        cols.append(_rows_struct(alerts, [F.desc("timestamp"), F.desc("alert_id")], rc, top_n)
                    .alias("recent_alerts_with_context"))
    cols.append(_rows_struct(incidents_gold, [F.desc("start_time"), F.desc("incident_id")],
                             incidents_gold.columns, top_n).alias("recent_incidents"))
    tail = REP.timeline_tail(timeline, top_n)
    cols.append(_rows_struct(tail, [F.asc("timestamp")], tail.columns, top_n).alias("timeline_snapshot"))
    return spark.range(1).select(*cols)


def run_analytics(spark: SparkSession, alerts: DataFrame, output_dir: str | None = None,
                  window: str = "5min", cluster: bool = True, anomalies: bool = True) -> dict[str, DataFrame]:
    """The whole analytics batch over canonical alerts; writes gold outputs when
    ``output_dir`` is given. Returns every output as a DataFrame."""
    features = INC.engineer_alert_features(alerts)
    incidents, mapping = INC.detect_incident_groups(INC.normalize_alerts(alerts), window)
    if cluster:
        incidents = ML.cluster_incidents(incidents)
        mapping = mapping.join(incidents.select("incident_id", "cluster_id", "incident_type"), "incident_id", "left")
        ordered = ordinals_by_range(mapping, ["timestamp", "alert_id"], "_order")
        mapping = ML.cluster_alerts(ordered, "_order").drop("_order", *[c for c in ML.ALERT_FEATURES
                                                                         if c != "severity_weight"])
    shared = mapping.persist(StorageLevel.MEMORY_AND_DISK)
    enriched = INC.engineer_incident_features(incidents, shared)
    incidents_gold = INC.build_incidents_gold(enriched)
    device_metrics = GOLD.build_device_metrics_gold(shared, enriched)
    if anomalies:
        keyed = device_metrics.withColumn("_key", F.concat_ws("|", "organization", "device"))
        device_metrics = IF.isolation_forest(keyed, "_key", S.ANOMALY_FEATURES).drop("_key")
    alert_stats = GOLD.build_alert_stats_gold(shared)
    timeline = GOLD.build_incident_timeline_gold(shared, enriched, window)
    summary = create_incident_summary(spark, incidents_gold, device_metrics, alert_stats, timeline, shared)
    out = {
        "alert_features": features,
        "alerts_with_incident": shared,
        "incidents": incidents_gold,
        "incidents_enriched": enriched,
        "device_metrics": device_metrics,
        "alert_stats": alert_stats,
        "incident_timeline": timeline,
        "top_failing_devices": REP.top_failing_devices(shared, enriched),
        "most_frequent_alert_types": REP.most_frequent_alert_types(shared),
        "severity_distribution": REP.severity_distribution(shared),
        "incident_frequency_trends": REP.incident_frequency_trends(enriched),
        "failure_patterns": REP.detect_failure_patterns(shared),
        "pipeline_metrics": REP.pipeline_metrics(shared, enriched, shared if cluster else None),
        "incident_summary": summary,
    }
    if cluster:
        out["cluster_summary"] = REP.summarize_clusters(incidents)
    if output_dir:
        FILES.save_gold_outputs(output_dir, incidents_gold, device_metrics, alert_stats, timeline, summary)
    return out


def run_pipeline(spark: SparkSession, silver_path: str, output_dir: str | None = None,
                 window: str = "5min") -> dict[str, DataFrame]:
    """Read silver alerts (parquet, CSV or folder) and run the analytics batch."""
    return run_analytics(spark, FILES.load_silver_alerts(spark, silver_path), output_dir, window)
