"""Standardisation, category codes and the cluster models over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertforge.operators.dbscan import dbscan
from alertforge.operators.ordinals import ordinals_by_range
from alertforge.session import ensure_checkpoint_dir


# --------------------------------------------------------------------------
# I1 standardisation, E5 category codes
# --------------------------------------------------------------------------

def standardize(df: DataFrame, cols: list[str], suffix: str = "") -> DataFrame:
    """(x - mean) / population std; a zero (or undefined) std divides by 1."""
    # means and population stds of all columns in one aggregate (one scalar subquery)
    fields = []
    for c in cols:
        x = F.col(c).cast("double")
        s = F.stddev_pop(x)
        fields += [F.avg(x).alias(f"m_{c}"),
                   F.when(s.isNull() | (s == 0), F.lit(1.0)).otherwise(s).alias(f"s_{c}")]
    stats = df.select(F.struct(*fields)).scalar()
    out = df
    for c in cols:
        out = out.withColumn(c + suffix, (F.col(c).cast("double") - stats[f"m_{c}"]) / stats[f"s_{c}"])
    return out


def category_codes(df: DataFrame, cols: list[str], suffix: str = "_code") -> DataFrame:
    """0-based rank of the value among the sorted distinct values; null -> -1."""
    out = df
    for c in cols:
        values = df.select(F.col(c).cast("string").alias("_v")).where(F.col("_v").isNotNull()).distinct()
        coded = ordinals_by_range(values, ["_v"], "_code").select(
            F.col("_v").alias(f"_{c}_v"), (F.col("_code") - 1).alias(c + suffix))
        out = (out.join(coded, F.col(c).cast("string") == F.col(f"_{c}_v"), "left")
               .withColumn(c + suffix, F.coalesce(F.col(c + suffix), F.lit(-1)).cast("long"))
               .drop(f"_{c}_v"))
    return out


# --------------------------------------------------------------------------
# I2, I3 wrappers
# --------------------------------------------------------------------------

INCIDENT_FEATURES = ["alert_count", "severity_score", "duration_minutes"]
ALERT_CATEGORICALS = ["severity", "source", "alert_type", "entity_type"]
ALERT_FEATURES = ["severity_weight", "severity_code", "source_code", "alert_type_code", "entity_type_code",
                  "timestamp_epoch"]


def incident_scaled(incidents: DataFrame) -> DataFrame:
    """I1 for incidents: the three features, nulls -> 0, standardised."""
    filled = incidents.fillna(0.0, subset=INCIDENT_FEATURES)
    return standardize(filled, INCIDENT_FEATURES, suffix="_z")


def _frozen_scaled(df: DataFrame, order: F.Column, cols: list[str]) -> DataFrame:
    """(_order, scaled features): raw features frozen once, then standardised, so
    the statistics and the rows come from the same small checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    raw = df.select(order.cast("long").alias("_order"),
                    *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols]).checkpoint(eager=True)
    return standardize(raw, cols, suffix="_z")


def cluster_incidents(incidents: DataFrame, eps: float = 0.9, min_samples: int = 2) -> DataFrame:
    """DBSCAN over scaled incident features, in incident-id order."""
    order = F.regexp_extract("incident_id", r"(\d+)$", 1).cast("long")
    scaled = _frozen_scaled(incidents, order, INCIDENT_FEATURES)
    labels = dbscan(scaled, "_order", [c + "_z" for c in INCIDENT_FEATURES], eps, min_samples,
                    out_col="cluster_id").select("_order", "cluster_id")
    return (incidents.withColumn("_order", order).join(labels, "_order", "left").drop("_order")
            .withColumn("is_noise_cluster", (F.col("cluster_id") == -1).cast("int")))


def alert_cluster_features(alerts: DataFrame) -> DataFrame:
    """E5 + epoch seconds: the six alert clustering features."""
    coded = category_codes(alerts, ALERT_CATEGORICALS)
    return coded.withColumn("timestamp_epoch", F.floor(F.unix_micros("timestamp") / 1_000_000).cast("long"))


def cluster_alerts(alerts: DataFrame, order_col: str, eps: float = 0.8, min_samples: int = 3) -> DataFrame:
    """DBSCAN over the scaled six alert features (visiting order ``order_col``)."""
    feats = alert_cluster_features(alerts)
    scaled = _frozen_scaled(feats, F.col(order_col), ALERT_FEATURES)
    labels = dbscan(scaled, "_order", [c + "_z" for c in ALERT_FEATURES], eps, min_samples,
                    out_col="alert_cluster").select(F.col("_order").alias("_alert_order"), "alert_cluster")
    return (feats.join(labels, F.col(order_col).cast("long") == F.col("_alert_order"), "left")
            .drop("_alert_order"))
