"""Dashboard model and its queries.

Covers B19, B20, C9-C11, D20, D21, F5. All counts come from one cube, stored
when first asked for: alerts per organization, device, severity, alert type and
hour, with the incident windows that began in the hour as bits. It is built by
one scan and one shuffle of the alerts and is far smaller than they are; the
views roll it up, and the dimensions (severity, alert type, device, time) are
its distinct values. Only views that list alerts read the alerts. A device
selection is a filter on the cube and on the scan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertforge.functions import alerts as AF
from alertforge.operators.incidents import window_seconds
from alertforge.operators.ordinals import ordinals_by_range
from alertforge.session import store

HOUR = 3600
# windows of an hour that fit the bits of a long
MAX_BITS = 63


def alert_cube(alerts: DataFrame, window: str | int = "5min") -> DataFrame:
    """Counts per (organization, device, severity, alert_type, hour) of normalised alerts.

    ``windows`` has one bit per incident window of the cell that holds alerts,
    so distinct windows of any roll-up are counted exactly by OR. Windows that
    do not tile an hour become a key of the cube (``window_start``) instead.
    """
    secs = window_seconds(window)
    start = AF.floor_time("timestamp", secs)
    hour = F.date_trunc("hour", "timestamp")
    if HOUR % secs == 0 and HOUR // secs <= MAX_BITS:
        number = ((F.unix_seconds(start) - F.unix_seconds(hour)) / secs).cast("int")
        cell, bit = F.lit(None).cast("timestamp"), F.expr("1L").cast("long")
        bits = F.call_function("shiftleft", bit, number)
    else:
        cell, bits = start, F.lit(1).cast("long")
    return (alerts.groupBy("organization", "device", "severity", "alert_type", hour.alias("occurred_at"), cell.alias("window_start"))
            .agg(F.count(F.lit(1)).alias("alerts"), F.count("alert_id").alias("alert_ids"), F.bit_or(bits).alias("windows")))


def _windows(cube: DataFrame) -> DataFrame:
    """``(device, n)``: incident windows of each device, cell by cell (an hour of one organization and device)."""
    by_window = F.coalesce("window_start", "occurred_at")
    return (cube.groupBy("organization", "device", by_window.alias("_cell")).agg(F.bit_count(F.bit_or("windows")).alias("n"))
            .groupBy("device").agg(F.sum("n").alias("n")))


class DashboardModel(dict):
    """Tables by name, each built when first asked for: a view pays only for the tables it reads."""

    def __getitem__(self, name: str) -> DataFrame:
        table = super().__getitem__(name)
        if not isinstance(table, DataFrame):
            table = table()
            self[name] = table
        return table


def build_dashboard_model(alerts: DataFrame, incidents: Callable[[], DataFrame], window: str | int = "5min") -> DashboardModel:
    """From normalised alerts (and a function that gives the incidents) -> dashboard tables."""
    model = DashboardModel()

    def dim(col: str, key: str) -> DataFrame:
        values = model["cube"].select(col).where(F.col(col).isNotNull()).distinct()
        return ordinals_by_range(values, [col], key).select(key, col)

    def fact() -> DataFrame:
        rows = model["alerts"].withColumn("occurred_at", F.date_trunc("hour", "timestamp"))
        return (rows.join(model["dim_devices"].withColumnRenamed("device_name", "device"), "device", "left")
                .join(model["dim_severity"], "severity", "left")
                .join(model["dim_alert_types"], "alert_type", "left")
                .join(model["dim_time"], "occurred_at", "left")
                .select("alert_id", "device_id", "alert_type_id", "severity_id", "time_id",
                        F.col("description").alias("alert_message")))

    def summary() -> DataFrame:
        cube = model["selected"]
        counts = cube.groupBy("device").agg(
            F.sum("alert_ids").alias("total_alerts"),
            F.sum(F.when(F.col("severity") == "critical", F.col("alerts")).otherwise(0)).alias("critical_alerts"))
        return counts.join(_windows(cube), "device").select(
            F.col("device").alias("device_name"), "total_alerts", "critical_alerts", F.col("n").alias("incidents_count"))

    model.update({
        "alerts": alerts,
        "cube": lambda: store(alert_cube(alerts, window), "alert-cube"),
        "selected": lambda: model["cube"],
        "dim_devices": lambda: dim("device", "device_id").withColumnRenamed("device", "device_name"),
        "dim_severity": lambda: dim("severity", "severity_id"),
        "dim_alert_types": lambda: dim("alert_type", "alert_type_id"),
        "dim_time": lambda: dim("occurred_at", "time_id"),
        "fact_alerts": fact,
        "device_alert_summary": summary,
        "incidents": lambda: incidents().select(
            "incident_id", F.col("device").alias("device_name"), "organization", "alert_count", "severity_score",
            "start_time", "incident_type"),
    })
    return model


def apply_device_filter(model: DashboardModel, devices: list[str]) -> DashboardModel:
    """B19 + C10: keep rows of the selected devices in cube, alerts, summary and incidents; dimensions keep their ids."""
    if not devices:
        return model

    def chosen(column: str) -> Column:
        return F.col(column).isin(devices)  # user input, a handful of names

    out = DashboardModel(model)
    out.update({
        "alerts": lambda: model["alerts"].where(chosen("device")),
        "selected": lambda: model["cube"].where(chosen("device")),
        "incidents": lambda: model["incidents"].where(chosen("device_name")),
        "fact_alerts": lambda: model["fact_alerts"].join(
            model["dim_devices"].where(chosen("device_name")).select("device_id"), "device_id", "left_semi"),
        "device_alert_summary": lambda: model["device_alert_summary"].where(chosen("device_name")),
    })
    return out


def kpis(model: DashboardModel) -> DataFrame:
    """Four headline numbers, one row."""
    cube = model["selected"]
    incidents = _windows(cube).select(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    return cube.agg(F.coalesce(F.sum("alerts"), F.lit(0)).alias("total_alerts"),
                    F.count_distinct("device").alias("total_devices"),
                    F.count_distinct("alert_type").alias("unique_alert_types")).select(
        "total_alerts", "total_devices", incidents.alias("incidents"), "unique_alert_types")


def severity_counts(model: DashboardModel) -> DataFrame:
    """D21 + C11: alerts per severity id with its label."""
    counts = model["selected"].groupBy("severity").agg(F.sum("alerts").alias("count"))
    return counts.join(model["dim_severity"], "severity", "left").select("severity_id", "severity", "count")


def alert_type_counts(model: DashboardModel) -> DataFrame:
    counts = model["selected"].groupBy("alert_type").agg(F.sum("alerts").alias("count"))
    return counts.join(model["dim_alert_types"], "alert_type", "left").select("alert_type_id", "count")


def alerts_over_time(model: DashboardModel) -> DataFrame:
    """C9 + D21: alerts per hour of the time dimension."""
    return model["selected"].groupBy(F.col("occurred_at").alias("datetime")).agg(F.sum("alerts").alias("alerts"))


def top_devices(model: DashboardModel, n: int = 10) -> DataFrame:
    """devices generating most alerts."""
    counts = model["selected"].groupBy(F.col("device").alias("device_name")).agg(F.sum("alert_ids").alias("total_alerts"))
    return counts.orderBy(F.desc("total_alerts"), "device_name").limit(n)


def device_alerts(model: DashboardModel, device: str) -> DataFrame:
    """Messages and ids of one device's alerts."""
    return model["alerts"].where(F.col("device") == device).select(F.col("description").alias("alert_message"), "alert_id")
