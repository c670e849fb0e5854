"""Bronze -> silver: vendor mappings, cleaning, union and keep-first dedupe.

Covers B1-B6, G1, G2, G4, E4. Keep-first is an aggregation
(``min_by`` over an explicit input order) rather than a window, so a key
with millions of identical alerts is reduced map-side instead of landing
in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertforge import schemas as S
from alertforge.functions import alerts as AF

# --------------------------------------------------------------------------
# FIXED VALUES: vendor column -> silver column
# --------------------------------------------------------------------------
VENDOR_MAPPINGS = {
    "meraki": {
        "alert_id": "alert_id",
        "correlation_id": "correlation_id",
        "organization_name": "organization_name",
        "device_name": "device_name",
        "device_identifier": "device_serial",
        "service_name": "check_name",
        "alert_type": "alert_type",
        "severity": "alert_level",
        "event_state": "event_state",
        "event_time": "occurred_at",
    },
    "auvik": {
        "alert_id": "alert_id",
        "correlation_id": "correlation_id",
        "organization_name": "company_name",
        "device_name": "entity_name",
        "device_identifier": "entity_id",
        "service_name": "entity_type",
        "alert_type": "alert_name",
        "severity": "alert_severity_string",
        "event_state": "event_state",
        "event_time": "event_time",
    },
    "ncentral": {
        "alert_id": "active_notification_trigger_id",
        "correlation_id": "correlation_id",
        "organization_name": "customer_name",
        "device_name": "device_name",
        "device_identifier": "device_uri",
        "service_name": "affected_service",
        "alert_type": "affected_service",
        "severity": "qualitative_new_state",
        "event_state": "event_state",
        "event_time": "time_of_state_change",
    },
}
# concatenation order of the vendors (defines "first" for keep-first)
SOURCE_ORDER = ["meraki", "auvik", "ncentral"]


def _opt(df: DataFrame, name: str, dtype: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype)


def map_vendor(df: DataFrame, vendor: str, clean: bool) -> DataFrame:
    """B1 (``clean=False``: raw values) or B2-B5 (``clean=True``)."""
    m = VENDOR_MAPPINGS[vendor]
    alert_id = _opt(df, m["alert_id"]).cast("string")
    corr = _opt(df, m["correlation_id"])
    device = _opt(df, m["device_name"])
    severity = _opt(df, m["severity"])
    state = _opt(df, m["event_state"])
    if clean:
        corr = F.coalesce(corr, alert_id)
        device = AF.strip_ws(F.lower(device))
        severity = AF.silver_severity(severity)
        state = AF.silver_event_state(state)
    return df.select(
        F.lit(vendor).alias("source_system"),
        alert_id.alias("alert_id"),
        corr.alias("correlation_id"),
        _opt(df, m["organization_name"]).alias("organization_name"),
        device.alias("device_name"),
        _opt(df, m["device_identifier"]).cast("string").alias("device_identifier"),
        _opt(df, m["service_name"]).alias("service_name"),
        _opt(df, m["alert_type"]).alias("alert_type"),
        severity.alias("severity"),
        state.alias("event_state"),
        _opt(df, m["event_time"], "timestamp").cast("timestamp").alias("event_time"),
        _opt(df, "synthetic", "boolean").cast("boolean").alias("synthetic"),
        _opt(df, "ingestion_time", "timestamp").cast("timestamp").alias("ingestion_time"),
    )


def union_vendors(frames: dict[str, DataFrame], clean: bool) -> DataFrame:
    """G1: one silver frame from the three vendors (missing vendors skipped)."""
    out = None
    for vendor in SOURCE_ORDER:
        if vendor in frames and frames[vendor] is not None:
            mapped = map_vendor(frames[vendor], vendor, clean)
            out = mapped if out is None else out.unionByName(mapped)
    if out is None:
        raise ValueError("no vendor frames given")
    return out


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key (nulls equal), the first by ``order``.

    ``min_by(struct(row), struct(order))`` is a plain aggregate: partial
    aggregation collapses duplicate storms before the shuffle.
    """
    cols = df.columns
    ranked = df.withColumn("_order", F.struct(*order))
    picked = ranked.groupBy(*[F.col(k) for k in keys]).agg(
        F.min_by(F.struct(*[F.col(c) for c in cols]), F.col("_order")).alias("_row"))
    return picked.select(*[F.col("_row")[c].alias(c) for c in cols])


def source_rank(col: str = "source_system") -> Column:
    expr = None
    for i, s in enumerate(SOURCE_ORDER):
        expr = F.when(F.col(col) == s, F.lit(i)) if expr is None else expr.when(F.col(col) == s, F.lit(i))
    return expr.otherwise(F.lit(len(SOURCE_ORDER)))


def silver_clean(frames: dict[str, DataFrame]) -> DataFrame:
    """B2-B5 + G1 + G4: cleaned silver rows, deduplicated on the five keys."""
    union = union_vendors(frames, clean=True)
    order = [source_rank(), F.col("ingestion_time"), F.col("alert_id")]
    return keep_first(union, S.SILVER_DEDUPE_KEYS, order)


def normalize_silver_schema(df: DataFrame, bridge: bool = True, extra: list[str] | None = None) -> DataFrame:
    """Any silver-like frame -> the 11 canonical alert columns.

    Renames silver names (and the ETL's ``event_time``/``event_state``),
    picks the cause and entity type from the first present candidate and
    fills defaults. Raises ``ValueError`` when required columns are missing.
    With ``bridge`` the ETL's silver table (no message column) is accepted:
    its description is null.
    """
    cols = set(df.columns)
    renames = {}
    mapping = {**S.SILVER_RENAMES, **S.SILVER_BRIDGE_RENAMES} if bridge else dict(S.SILVER_RENAMES)
    for src, dst in mapping.items():
        if src in cols and dst not in cols and dst not in renames.values():
            renames[src] = dst
    for src, dst in renames.items():
        df = df.withColumnRenamed(src, dst)
    cols = set(df.columns)
    if bridge and "description" not in cols:
        df = df.withColumn("description", F.lit(None).cast("string"))
        cols.add("description")

    if "cause" in cols:
        cause = F.col("cause")
    else:
        cand = next((c for c in S.CAUSE_CANDIDATES if c in cols), None)
        cause = F.col(cand) if cand else (F.col("description") if "description" in cols else F.lit(S.UNKNOWN))
    if "entity_type" in cols:
        entity = F.col("entity_type")
    else:
        cand = next((c for c in S.ENTITY_TYPE_CANDIDATES if c in cols), None)
        entity = F.col(cand) if cand else F.lit(S.UNKNOWN)
    status = F.col("status") if "status" in cols else F.lit("open")
    source = F.col("source") if "source" in cols else F.lit(S.UNKNOWN)
    desc_fill = F.col("description") if "description" in cols else F.lit(S.UNKNOWN)

    missing = [c for c in S.CANONICAL_ALERT_COLUMNS
               if c not in cols and c not in ("cause", "entity_type", "status", "source")]
    if missing:
        raise ValueError(f"silver alerts lack the columns {missing}")

    exprs = {
        "alert_id": F.col("alert_id").cast("string"),
        "source": source.cast("string"),
        "timestamp": F.col("timestamp"),
        "organization": F.col("organization").cast("string"),
        "device": F.col("device").cast("string"),
        "entity_type": entity.cast("string"),
        "alert_type": F.col("alert_type").cast("string"),
        "severity": F.col("severity").cast("string"),
        "status": status.cast("string"),
        "description": F.col("description").cast("string"),
        "cause": F.coalesce(cause.cast("string"), desc_fill.cast("string"), F.lit("None")),
    }
    return df.select(*[exprs[c].alias(c) for c in S.CANONICAL_ALERT_COLUMNS], *(extra or []))
