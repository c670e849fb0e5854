"""Medallion ETL as three DataFrame jobs: bronze, silver, gold (star schema).

Each step is a function from DataFrames to DataFrames plus an optional
sink; the lookups of the row-wise original become joins, the surrogate
keys exact ordinals, and "insert if absent" an anti-join against the
current table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from alertforge.operators import silver as SIL
from alertforge.operators import star as STAR
from alertforge.sources import files as FILES


def bronze(spark: SparkSession, auvik_json: str | None = None, meraki_json: str | None = None,
           ncentral_xml: str | None = None) -> dict[str, DataFrame]:
    """Vendor files -> bronze tables."""
    return FILES.bronze_tables(
        auvik=FILES.read_auvik_json(spark, auvik_json) if auvik_json else None,
        meraki=FILES.read_meraki_json(spark, meraki_json) if meraki_json else None,
        ncentral=FILES.read_ncentral_xml(spark, ncentral_xml) if ncentral_xml else None)


def silver(frames: dict[str, DataFrame], raw: bool = False) -> DataFrame:
    """Bronze tables -> silver rows (``raw``: values as sent; else cleaned and deduped)."""
    return SIL.union_vendors(frames, clean=False) if raw else SIL.silver_clean(frames)


def gold(silver_rows: DataFrame, existing: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Silver -> dimensions (insert-if-absent) and fact incidents."""
    existing = existing or {}
    devices = STAR.dim_device(silver_rows, existing.get("dim_device"))
    orgs = STAR.dim_organization(silver_rows, existing.get("dim_organization"))
    types = STAR.dim_alert_type(silver_rows, existing.get("dim_alert_type"))
    if existing.get("dim_device") is not None:
        devices = existing["dim_device"].unionByName(devices)
    if existing.get("dim_organization") is not None:
        orgs = existing["dim_organization"].unionByName(orgs)
    if existing.get("dim_alert_type") is not None:
        types = existing["dim_alert_type"].unionByName(types)
    facts_groups = STAR.fact_groups(silver_rows)
    times = STAR.dim_time(facts_groups, existing.get("dim_time"))
    if existing.get("dim_time") is not None:
        times = existing["dim_time"].unionByName(times)
    facts = STAR.fact_incidents(silver_rows, devices, orgs, types, times)
    return {"dim_device": devices, "dim_organization": orgs, "dim_alert_type": types,
            "dim_time": times, "fact_incidents": facts}
