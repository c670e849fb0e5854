"""Incident rows and summary sections -> text documents.

Covers B15-B18 and F6. Documents are built as native string columns
(``concat_ws`` of label lines); a document table keeps an id column so
later vector and retrieval jobs can join back to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertforge import schemas as S
from alertforge.functions.text import label_line, na_line


def normalize_columns(df: DataFrame, aliases: dict[str, str] | None = None,
                      keep: list[str] | None = None) -> DataFrame:
    """Rename alias columns to canonical document fields.

    An alias is used only when its target is absent; several aliases of one
    target are merged with ``coalesce`` in column order. Columns in ``keep``
    pass through untouched (ids).
    """
    alias_map = aliases if aliases is not None else S.COLUMN_ALIASES
    canonical = set(S.FIELD_LABELS)
    keep = keep or []
    targets: dict[str, list[str]] = {}
    for c in df.columns:
        if c in keep:
            continue
        if c in alias_map and c not in canonical and alias_map[c] not in df.columns:
            targets.setdefault(alias_map[c], []).append(c)
    renamed = set(c for cols in targets.values() for c in cols)
    out = [F.col(c) for c in df.columns if c not in renamed]
    for target, cols in targets.items():
        expr = F.col(cols[0]) if len(cols) == 1 else F.coalesce(*[F.col(c) for c in cols])
        out.append(expr.alias(target))
    return df.select(*out)


def build_incident_documents(df: DataFrame, id_col: str | None = None,
                             field_labels: dict[str, str] | None = None) -> DataFrame:
    """B16 + B17: one "Label: value" document per row; empty documents dropped.

    Returns ``(id_col, document)`` (or just ``document``).
    """
    labels = field_labels if field_labels is not None else S.FIELD_LABELS
    norm = normalize_columns(df, keep=[id_col] if id_col else None)
    dtypes = dict(norm.dtypes)
    lines = [label_line(label, F.col(col), dtypes[col]) for col, label in labels.items() if col in dtypes]
    doc = F.concat_ws("\n", *lines) if lines else F.lit("")
    cols = ([F.col(id_col)] if id_col else []) + [doc.alias("document")]
    return norm.select(*cols).where(F.length(F.trim(F.col("document"))) > 0)


def _section(df: DataFrame, kind: str, generated_at: str, fields: list[tuple[str, str]],
             order: int) -> DataFrame:
    dtypes = dict(df.dtypes)
    lines = [F.lit(f"Document Type: {kind}"), F.lit(f"Generated At: {generated_at}")]
    for key, label in fields:
        lines.append(na_line(label, F.col(key) if key in dtypes else None, dtypes.get(key, "string")))
    return df.select(F.lit(order).alias("section"), F.concat_ws("\n", *lines).alias("document"))


def build_summary_documents(overview: DataFrame, top_devices: DataFrame, alert_types: DataFrame,
                            recent_incidents: DataFrame, timeline_tail: DataFrame,
                            generated_at: str = "") -> DataFrame:
    """Typed documents from the summary sections (missing fields -> N/A)."""
    parts = [
        _section(overview, "Incident Summary Overview", generated_at, [
            ("total_incidents", "Total Incidents"), ("total_devices", "Total Devices"),
            ("total_alerts", "Total Alerts"), ("avg_reliability_score", "Average Reliability Score")], 0),
        _section(top_devices, "Top Failing Device", generated_at, [
            ("device", "Device"), ("organization", "Organization"), ("total_alerts", "Total Alerts"),
            ("critical_alerts", "Critical Alerts"), ("incidents_count", "Incidents Count"),
            ("reliability_score", "Reliability Score"), ("anomaly_score", "Anomaly Score"),
            ("is_anomalous", "Is Anomalous")], 1),
        _section(alert_types, "Frequent Alert Type", generated_at, [
            ("alert_type", "Alert Type"), ("total_count", "Total Count"),
            ("devices_affected", "Devices Affected"), ("avg_severity", "Average Severity")], 2),
        _section(recent_incidents, "Recent Incident", generated_at, [
            ("incident_id", "Incident ID"), ("device", "Device"), ("organization", "Organization"),
            ("alert_count", "Alert Count"), ("severity_score", "Severity Score"), ("start_time", "Start Time"),
            ("end_time", "End Time"), ("duration_minutes", "Duration Minutes"),
            ("root_cause_candidate", "Root Cause Candidate"), ("incident_type", "Incident Type")], 3),
        _section(timeline_tail, "Incident Timeline Snapshot", generated_at, [
            ("timestamp", "Timestamp"), ("alerts_count", "Alerts Count"), ("incidents_count", "Incidents Count"),
            ("critical_incidents", "Critical Incidents")], 4),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.length(F.trim("document")) > 0)


def recent_incidents_from_context(contexts: DataFrame, id_col: str, context_col: str,
                                  max_items: int = 3) -> DataFrame:
    """per context text, the newest ``max_items`` incident blocks as a summary.

    Blocks are the pieces between context separators; each line ``Key: value``
    sets a field (the last one wins). Blocks sort by their ``Timestamp``
    (newest first, unparseable or missing last, then block order). Returns
    ``(id_col, recent_incidents)`` with the numbered summary text.
    """
    if max_items <= 0:
        raise ValueError(f"max_items is {max_items}; it has to be 1 or more")
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")  # noqa: E731 - str.strip()
    blocks = (contexts.select(F.col(id_col), F.posexplode(F.split(F.col(context_col), S.CONTEXT_SEPARATOR, -1))
                              .alias("block_no", "block"))
              .withColumn("block", strip(F.col("block"))).where(F.length("block") > 0))
    lines = (blocks.select(id_col, "block_no",
                           F.posexplode(F.split("block", r"\r\n|\r|\n")).alias("line_no", "line"))
             .withColumn("line", strip(F.col("line")))
             .where(F.contains(F.col("line"), F.lit(":"))))
    kv = lines.select(id_col, "block_no", "line_no",
                      strip(F.split_part("line", F.lit(":"), F.lit(1))).alias("k"),
                      strip(F.regexp_extract("line", r"^[^:]*:(.*)$", 1)).alias("v"))
    last = kv.groupBy(id_col, "block_no", "k").agg(F.max_by("v", "line_no").alias("v"))
    fields = last.groupBy(id_col, "block_no").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("f"))
    # blocks without any "key: value" line still count (all fields N/A)
    fields = blocks.select(id_col, "block_no").join(fields, [id_col, "block_no"], "left")
    ts_text = F.col("f")["Timestamp"]
    fields = fields.withColumn("when", F.try_to_timestamp(F.regexp_replace(ts_text, "Z$", "+00:00")))
    w = Window.partitionBy(id_col).orderBy(F.desc_nulls_last("when"), "block_no")
    ranked = fields.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max_items)

    def get(key):
        return F.coalesce(F.col("f")[key], F.lit("N/A"))

    line = F.concat(F.col("rank").cast("string"), F.lit(". Incident ID: "), get("Incident ID"),
                    F.lit(" | Device: "), get("Device"), F.lit(" | Alert: "), get("Alert Type"),
                    F.lit(" | Severity: "), get("Severity"), F.lit(" | Timestamp: "), get("Timestamp"))
    per_ctx = ranked.groupBy(id_col).agg(
        F.count(F.lit(1)).alias("n"),
        F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))).alias("items"))
    text = F.concat(F.lit("Recent Incidents (top "), F.col("n").cast("string"), F.lit("):\n"),
                    F.array_join(F.transform("items", lambda x: x["line"]), "\n"))
    return per_ctx.select(id_col, text.alias("recent_incidents"))
