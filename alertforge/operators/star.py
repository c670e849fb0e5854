"""Gold star schema from silver: dimensions, time keys, fact incidents, tickets.

Covers G3, C8, C12, C13, D15, E6. Lookups are joins (no per-row
queries); surrogate keys are exact global ordinals over the natural key
order, offset by the current maximum key on incremental loads.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertforge.operators.ordinals import ordinals_by_range

FACT_KEYS = ["correlation_id", "source_system", "organization_name", "device_name",
             "device_identifier", "alert_type", "severity"]


def _with_keys(df: DataFrame, order: list[str], key: str, existing: DataFrame | None,
               natural: list[str]) -> DataFrame:
    """C12 + E6: insert-if-absent with new surrogate keys after the current max."""
    if existing is not None:
        known = existing.select(*[F.col(c).alias(f"_{c}") for c in natural])
        # null-safe: a key with a null part is inserted once, too
        same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in natural])
        df = df.join(known, same, "left_anti")
        offset = existing.select(F.coalesce(F.max(key), F.lit(0)).cast("long")).scalar()
    else:
        offset = F.lit(0).cast("long")
    numbered = ordinals_by_range(df, order, "_ord")
    return numbered.select((F.col("_ord") + offset).alias(key), *df.columns)


def dim_device(silver: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Unique on (device_name, device_identifier); the smallest source wins."""
    rows = (silver.groupBy("device_name", "device_identifier")
            .agg(F.min("source_system").alias("source_system")))
    return _with_keys(rows, ["device_name", "device_identifier"], "device_key", existing,
                      ["device_name", "device_identifier"])


def dim_organization(silver: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    rows = silver.select("organization_name").distinct()
    return _with_keys(rows, ["organization_name"], "organization_key", existing, ["organization_name"])


def dim_alert_type(silver: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    rows = silver.select("alert_type", "service_name").distinct()
    return _with_keys(rows, ["alert_type", "service_name"], "alert_type_key", existing,
                      ["alert_type", "service_name"])


def fact_groups(silver: DataFrame) -> DataFrame:
    """One row per 7-key group (null keys kept, as in SQL GROUP BY)."""
    return silver.groupBy(*FACT_KEYS).agg(
        F.min("event_time").alias("start_time"),
        F.max("event_time").alias("end_time"),
        F.count(F.lit(1)).alias("alert_count"),
        F.bool_or("synthetic").alias("synthetic"))


def dim_time(facts: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """E6 get-or-insert: one key per distinct start/end time."""
    times = (facts.select(F.col("start_time").alias("event_time"))
             .union(facts.select(F.col("end_time").alias("event_time")))
             .where(F.col("event_time").isNotNull()).distinct())
    keyed = _with_keys(times, ["event_time"], "time_key", existing, ["event_time"])
    return keyed.select(
        "time_key", "event_time",
        F.to_date("event_time").alias("event_date"),
        F.hour("event_time").alias("hour"),
        F.dayofmonth("event_time").alias("day"),
        F.month("event_time").alias("month"),
        F.year("event_time").alias("year"))


def fact_incidents(silver: DataFrame, devices: DataFrame, orgs: DataFrame, types: DataFrame,
                   times: DataFrame) -> DataFrame:
    """C8 + D15: facts with dimension keys.

    Devices and alert types are looked up by name / type only, which may
    match several dimension rows: the smallest key is taken. Dimension
    lookups are aggregated to one row per lookup value first, so the joins
    never multiply fact rows.
    """
    facts = fact_groups(silver)
    dev = devices.groupBy("device_name").agg(F.min("device_key").alias("device_key"))
    org = orgs.groupBy("organization_name").agg(F.min("organization_key").alias("organization_key"))
    typ = types.groupBy("alert_type").agg(F.min("alert_type_key").alias("alert_type_key"))
    t_start = times.select(F.col("event_time").alias("start_time"), F.col("time_key").alias("start_time_key"))
    t_end = times.select(F.col("event_time").alias("end_time"), F.col("time_key").alias("end_time_key"))
    joined = (facts.join(dev, "device_name", "left")
              .join(org, "organization_name", "left")
              .join(typ, "alert_type", "left")
              .join(t_start, "start_time", "left")
              .join(t_end, "end_time", "left"))
    numbered = ordinals_by_range(joined, FACT_KEYS, "incident_key")
    return numbered.select(
        "incident_key", "correlation_id", "device_key", "organization_key", "alert_type_key",
        "start_time_key", "end_time_key",
        (F.unix_micros("end_time") - F.unix_micros("start_time")).alias("incident_duration"),
        "alert_count", "severity", "synthetic",
        F.lit("OPEN").alias("incident_status"))


def create_tickets(incidents: DataFrame, existing: DataFrame | None = None,
                   min_severity: str | None = None) -> DataFrame:
    """One OPEN ticket per incident that has none yet.

    ``min_severity`` is the gate that exists but never runs in the source
    behaviour; off by default.
    """
    cand = incidents
    if min_severity is not None:
        prio = {"LOW": 1, "MEDIUM": 2, "HIGH": 3}
        rank = F.coalesce(*[F.when(F.col("severity") == k, F.lit(v)) for k, v in prio.items()], F.lit(0))
        cand = cand.where(rank >= prio[min_severity])
    if existing is not None:
        cand = cand.join(existing.select(F.col("incident_id").alias("incident_key")), "incident_key", "left_anti")
    offset = (existing.select(F.coalesce(F.max("ticket_id"), F.lit(0)).cast("long")).scalar()
              if existing is not None else F.lit(0).cast("long"))
    numbered = ordinals_by_range(cand.select("incident_key", "device_key", "alert_type_key"),
                                 ["incident_key"], "_ord")
    return numbered.select(
        (F.col("_ord") + offset).alias("ticket_id"),
        F.col("incident_key").alias("incident_id"),
        F.col("device_key").cast("string").alias("device_name"),
        F.col("alert_type_key").cast("string").alias("issue"),
        F.lit("OPEN").alias("status"))
