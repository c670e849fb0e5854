"""Schemas, column lists and fixed values.

Everything under "FIXED VALUES" must equal the behaviour being reproduced
(maps, keyword lists, labels, texts); it is stated plainly and in order.
"""

from __future__ import annotations

# --------------------------------------------------------------------------
# FIXED VALUES: alert normalisation
# --------------------------------------------------------------------------

# severity text -> weight; anything else (including "none") weighs 1
SEVERITY_WEIGHTS = {
    "critical": 4,
    "high": 3,
    "medium": 2,
    "low": 1,
    "info": 1,
}
DEFAULT_SEVERITY_WEIGHT = 1.0

# columns an alert frame must carry before incident grouping
REQUIRED_ALERT_COLUMNS = [
    "alert_id",
    "source",
    "timestamp",
    "organization",
    "device",
    "entity_type",
    "alert_type",
    "severity",
    "status",
    "description",
]

# canonical alert columns (required + cause)
CANONICAL_ALERT_COLUMNS = REQUIRED_ALERT_COLUMNS + ["cause"]

# silver column -> canonical column
SILVER_RENAMES = {
    "source_system": "source",
    "occurred_at": "timestamp",
    "organization_name": "organization",
    "device_name": "device",
    "alert_message": "description",
}
# the silver table written by the ETL uses these names instead
SILVER_BRIDGE_RENAMES = {
    "event_time": "timestamp",
    "event_state": "status",
}

# first present column wins as the cause
CAUSE_CANDIDATES = [
    "cause",
    "root_cause",
    "root_cause_candidate",
    "probable_cause",
    "failure_cause",
    "reason",
]
# first present column wins as the entity type
ENTITY_TYPE_CANDIDATES = ["alert_category", "network_name"]

# ordered substring rules; the first rule with a hit names the incident type
INCIDENT_TYPE_RULES = [
    ("resource", ["cpu", "memory", "disk", "resource"]),
    ("availability", ["offline", "down", "disconnect", "unreachable"]),
    ("network", ["latency", "packet", "link", "interface", "network"]),
    ("security", ["auth", "login", "certificate", "security"]),
]
OTHER_INCIDENT_TYPE = "other"

# reliability = clip(100 * (1 - penalty), 0, 100), penalty weights below
RELIABILITY_WEIGHTS = {
    "total_alerts": 0.45,
    "critical_alerts": 0.35,
    "incidents_count": 0.20,
}

INCIDENT_ID_FORMAT = "INC-%06d"
UNKNOWN = "unknown"

# --------------------------------------------------------------------------
# FIXED VALUES: silver (vendor) normalisation
# --------------------------------------------------------------------------

# severity text containing one of these -> HIGH; containing "warning" -> MEDIUM; else LOW
SILVER_HIGH_MARKERS = ["critical", "failed"]
SILVER_MEDIUM_MARKERS = ["warning"]
# event states meaning "resolved"; everything else (and null) is "triggered"
RESOLVED_STATES = ["ok", "normal", "cleared", "resolved"]

SILVER_DEDUPE_KEYS = ["correlation_id", "device_name", "alert_type", "event_state", "event_time"]
CANONICAL_DEDUPE_KEYS = ["alert_id", "timestamp", "device"]

# --------------------------------------------------------------------------
# FIXED VALUES: gold column orders
# --------------------------------------------------------------------------

INCIDENT_COLUMNS = [
    "incident_id",
    "device",
    "organization",
    "alert_count",
    "severity_score",
    "start_time",
    "end_time",
    "duration_minutes",
    "root_cause_candidate",
    "incident_cause",
    "description",
    "incident_type",
]
DEVICE_COLUMNS = [
    "device",
    "organization",
    "total_alerts",
    "critical_alerts",
    "incidents_count",
    "reliability_score",
]
ALERT_STATS_COLUMNS = ["alert_type", "total_count", "devices_affected", "avg_severity"]
RECENT_ALERT_COLUMNS = [
    "alert_id",
    "timestamp",
    "source",
    "organization",
    "device",
    "alert_type",
    "severity",
    "description",
    "cause",
    "incident_id",
]
ANOMALY_FEATURES = ["total_alerts", "critical_alerts", "incidents_count", "reliability_score"]

# --------------------------------------------------------------------------
# FIXED VALUES: incident documents
# --------------------------------------------------------------------------

# column -> label, in document line order
FIELD_LABELS = {
    "incident_id": "Incident ID",
    "device": "Device",
    "alert_type": "Alert Type",
    "severity": "Severity",
    "timestamp": "Timestamp",
    "service": "Affected Service",
    "description": "Description",
    "duration": "Duration",
    "root_cause": "Possible Root Cause",
}

# source column -> canonical document column
COLUMN_ALIASES = {
    "alert_name": "alert_type",
    "alertName": "alert_type",
    "alertname": "alert_type",
    "check": "alert_type",
    "alertType": "alert_type",
    "alertId": "incident_id",
    "alert_id": "incident_id",
    "id": "incident_id",
    "entityName": "device",
    "entity_name": "device",
    "host": "device",
    "deviceName": "device",
    "device_name": "device",
    "alertSeverityString": "severity",
    "alert_severity_string": "severity",
    "alertLevel": "severity",
    "alert_level": "severity",
    "status": "severity",
    "date": "timestamp",
    "occurredAt": "timestamp",
    "occurred_at": "timestamp",
    "sentAt": "timestamp",
    "sent_at": "timestamp",
    "alertDescription": "description",
    "alert_description": "description",
    "message": "description",
    "entityType": "service",
    "entity_type": "service",
    "companyName": "service",
    "company_name": "service",
}

SUMMARY_KEYS = [
    "overview",
    "top_failing_devices",
    "most_frequent_alert_types",
    "recent_incidents",
    "timeline_snapshot",
]

# --------------------------------------------------------------------------
# FIXED VALUES: retrieval and answers
# --------------------------------------------------------------------------

DEFAULT_TOP_K = 5
CONTEXT_SEPARATOR = "\n\n---\n\n"
QUERY_INSTRUCTION = "Represent this sentence for searching relevant passages: "
CONTEXT_TOKEN = "{context}"
QUESTION_TOKEN = "{question}"
EMPTY_CONTEXT_FALLBACK = (
    "No relevant incident records were retrieved from the knowledge base "
    "for this query. Please base your response on general infrastructure "
    "best practices and state clearly that no specific incident data was found."
)
MISSING_INFO_BULLET = "- The available incident context does not contain this information."
MAX_PROMPT_CHARS = 12000
SMALL_MODEL_MARKER = "━━━ STEP 5"

# question keywords -> issue type, first hit wins
ISSUE_TYPE_RULES = [
    (["vpn"], "VPN Downtime / Connectivity Failure"),
    (["database", "postgres", "mysql", "sql"], "Database Failure / Database Service Outage"),
    (["cpu"], "High CPU Utilization"),
    (["disk", "storage"], "Disk Capacity / Disk I/O Saturation"),
    (["ssl", "tls", "certificate"], "TLS/SSL Certificate or Handshake Failure"),
]
DEFAULT_ISSUE_TYPE = "Infrastructure Service Degradation"
