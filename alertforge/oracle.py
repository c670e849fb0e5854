"""Independent DuckDB SQL for every registered query (the correctness oracle).

Written from the rules, not from the Spark plans. Tables are the driver's
parquet views (``events``, ``embeddings``, ...). Shared CTEs are composed as
text so each query stays one self-contained SQL string.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# shared CTE bodies
# ---------------------------------------------------------------------------

RAW_ALERTS = """
raw_alerts AS (
  SELECT CAST(event_id AS VARCHAR) AS alert_id,
         CASE user_id % 3 WHEN 0 THEN 'meraki' WHEN 1 THEN 'auvik' ELSE 'ncentral' END AS source,
         CAST(ts AS TIMESTAMP) AS "timestamp",
         'org-' || CAST(user_id % 4 AS VARCHAR) AS organization,
         CASE WHEN event_id % 97 = 0 THEN NULL ELSE 'dev-' || CAST(user_id % 10 AS VARCHAR) END AS device,
         CASE user_id % 3 WHEN 0 THEN 'device' WHEN 1 THEN 'service' ELSE 'interface' END AS entity_type,
         event_type AS alert_type,
         CASE WHEN value >= 113 THEN ' Critical' WHEN value >= 60 THEN 'high'
              WHEN value >= 35 THEN 'medium' WHEN value >= 10 THEN 'low'
              WHEN event_id % 11 = 0 THEN NULL ELSE 'warning' END AS severity,
         CASE WHEN event_id % 3 = 0 THEN 'resolved' ELSE 'open' END AS status,
         CASE event_type WHEN 'error' THEN 'Device unreachable' WHEN 'click' THEN 'CPU above limit'
              WHEN 'view' THEN 'Packet loss on link' WHEN 'signup' THEN 'Login failed'
              WHEN 'purchase' THEN 'Batch job note' END AS description,
         CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 'carrier' ELSE 'config' END AS cause
  FROM events
)"""

ALERTS = RAW_ALERTS + """,
alerts AS (
  SELECT alert_id, source, "timestamp", organization, device, entity_type, alert_type,
         sev AS severity, status, description,
         coalesce(cause, description, 'None') AS cause,
         CAST(CASE sev WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2
                       WHEN 'low' THEN 1 WHEN 'info' THEN 1 ELSE 1 END AS DOUBLE) AS severity_weight,
         CASE WHEN sev = 'critical' THEN 1 ELSE 0 END AS is_critical
  FROM (SELECT *, coalesce(trim(lower(severity)), 'none') AS sev FROM raw_alerts) s
  WHERE "timestamp" IS NOT NULL AND device IS NOT NULL AND organization IS NOT NULL
)"""


def _bucket(expr: str, seconds: int) -> str:
    us = seconds * 1_000_000
    return f"make_timestamp(epoch_us({expr}) - (epoch_us({expr}) % {us}))"


def _mode_cte(name: str, col: str, keys: list[str], source: str) -> str:
    k = ", ".join(keys)
    return f"""
{name} AS (
  SELECT {k}, {col} AS mode_value FROM (
    SELECT {k}, {col}, row_number() OVER (PARTITION BY {k} ORDER BY cnt DESC, {col} ASC) AS rk
    FROM (SELECT {k}, {col}, count(*) AS cnt FROM {source} WHERE {col} IS NOT NULL GROUP BY {k}, {col}) c
  ) r WHERE rk = 1
)"""


def incidents_ctes(window_seconds: int = 300) -> str:
    """CTEs ``alerts``, ``framed``, ``incidents`` (with ids), ``alert_map``."""
    keys = ["organization", "device", "time_window"]
    kj = " AND ".join(f"g.{k} = m_{{m}}.{k}" for k in keys)
    modes = ",".join([
        _mode_cte("m_type", "alert_type", keys, "framed"),
        _mode_cte("m_cause", "cause", keys, "framed"),
        _mode_cte("m_desc", "description", keys, "framed"),
    ])
    return "WITH " + ALERTS + f""",
framed AS (SELECT *, {_bucket('"timestamp"', window_seconds)} AS time_window FROM alerts),
{modes},
grouped AS (
  SELECT organization, device, time_window,
         count(alert_id) AS alert_count,
         CAST(sum(severity_weight) AS DOUBLE) AS severity_score,
         CAST(sum(is_critical) AS BIGINT) AS critical_alert_count,
         min("timestamp") AS start_time, max("timestamp") AS end_time
  FROM framed GROUP BY organization, device, time_window
),
incidents_raw AS (
  SELECT g.*,
         coalesce(m_type.mode_value, 'unknown') AS root_cause_candidate,
         coalesce(m_cause.mode_value, 'unknown') AS incident_cause,
         coalesce(m_desc.mode_value, 'unknown') AS description
  FROM grouped g
  LEFT JOIN m_type ON {kj.format(m='type')}
  LEFT JOIN m_cause ON {kj.format(m='cause')}
  LEFT JOIN m_desc ON {kj.format(m='desc')}
),
incidents AS (
  SELECT printf('INC-%06d', row_number() OVER (ORDER BY start_time, organization, device)) AS incident_id,
         organization, device, time_window, alert_count, severity_score, critical_alert_count,
         start_time, end_time,
         greatest((epoch_us(end_time) - epoch_us(start_time)) / CAST(60000000 AS DOUBLE), CAST(0 AS DOUBLE)) AS duration_minutes,
         root_cause_candidate, incident_cause, description,
         CASE
           WHEN sig LIKE '%cpu%' OR sig LIKE '%memory%' OR sig LIKE '%disk%' OR sig LIKE '%resource%' THEN 'resource'
           WHEN sig LIKE '%offline%' OR sig LIKE '%down%' OR sig LIKE '%disconnect%' OR sig LIKE '%unreachable%' THEN 'availability'
           WHEN sig LIKE '%latency%' OR sig LIKE '%packet%' OR sig LIKE '%link%' OR sig LIKE '%interface%' OR sig LIKE '%network%' THEN 'network'
           WHEN sig LIKE '%auth%' OR sig LIKE '%login%' OR sig LIKE '%certificate%' OR sig LIKE '%security%' THEN 'security'
           ELSE 'other' END AS incident_type
  FROM (SELECT *, lower(root_cause_candidate || ' ' || description) AS sig FROM incidents_raw) x
),
alert_map AS (
  SELECT f.*, i.incident_id
  FROM framed f LEFT JOIN incidents i
    ON f.organization = i.organization AND f.device = i.device AND f.time_window = i.time_window
)"""


VENDOR_EVENTS = """
ev AS (
  SELECT *, CAST(event_id AS VARCHAR) AS _id,
         CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'c-' || CAST(event_id - event_id % 4 AS VARCHAR) END AS _corr,
         'org-' || CAST(user_id % 4 AS VARCHAR) AS _org,
         ' Dev-' || CAST(user_id % 10 AS VARCHAR) || ' ' AS _dev,
         'SN' || CAST(user_id AS VARCHAR) AS _serial,
         CASE event_id % 4 WHEN 0 THEN 'OK' WHEN 1 THEN 'triggered' WHEN 2 THEN 'Cleared' ELSE NULL END AS _state,
         CASE WHEN event_id % 2 = 1 THEN date_trunc('minute', CAST(ts AS TIMESTAMP))
              ELSE CAST(date_trunc('day', CAST(ts AS TIMESTAMP)) AS TIMESTAMP) END AS _day,
         event_id % 10 = 0 AS _synthetic,
         CAST(ts AS TIMESTAMP) AS _ingest,
         CASE WHEN value >= 113 THEN 'critical' WHEN value >= 60 THEN 'Warning'
              WHEN value >= 10 THEN 'Emergency' END AS _level,
         CASE WHEN value >= 113 THEN 'Failed' WHEN value >= 60 THEN 'Warning'
              WHEN value >= 10 THEN 'Normal' END AS _nstate
  FROM events
),
evd AS (
  SELECT * FROM ev
  UNION ALL SELECT * REPLACE (_id || '_dup' AS _id) FROM ev WHERE event_id % 10 = 1
),
silver_raw AS (
  SELECT 'meraki' AS source_system, _id AS alert_id, _corr AS correlation_id, _org AS organization_name,
         _dev AS device_name, _serial AS device_identifier, event_type AS service_name, event_type AS alert_type,
         _level AS severity, _state AS event_state, _day AS event_time, _synthetic AS synthetic,
         _ingest AS ingestion_time, 0 AS src_rank
  FROM evd WHERE user_id % 3 = 0
  UNION ALL
  SELECT 'auvik', _id, _corr, _org, _dev, _serial, event_type, event_type, _level, _state, _day, _synthetic, _ingest, 1
  FROM evd WHERE user_id % 3 = 1
  UNION ALL
  SELECT 'ncentral', _id, _corr, _org, _dev, _serial, event_type, event_type, _nstate, _state, _day, _synthetic,
         _ingest, 2
  FROM evd WHERE user_id % 3 = 2
),
silver_cleaned AS (
  SELECT source_system, alert_id, coalesce(correlation_id, alert_id) AS correlation_id, organization_name,
         trim(lower(device_name)) AS device_name, device_identifier, service_name, alert_type,
         CASE WHEN lower(severity) LIKE '%critical%' OR lower(severity) LIKE '%failed%' THEN 'HIGH'
              WHEN lower(severity) LIKE '%warning%' THEN 'MEDIUM' ELSE 'LOW' END AS severity,
         CASE WHEN lower(event_state) IN ('ok', 'normal', 'cleared', 'resolved') THEN 'resolved'
              ELSE 'triggered' END AS event_state,
         event_time, synthetic, ingestion_time, src_rank
  FROM silver_raw
),
silver AS (
  SELECT source_system, alert_id, correlation_id, organization_name, device_name, device_identifier,
         service_name, alert_type, severity, event_state, event_time, synthetic, ingestion_time
  FROM (SELECT *, row_number() OVER (
          PARTITION BY correlation_id, device_name, alert_type, event_state, event_time
          ORDER BY src_rank, ingestion_time, alert_id) AS rn FROM silver_cleaned) d
  WHERE rn = 1
)"""

STAR_CTES = VENDOR_EVENTS + """,
dim_device AS (
  SELECT row_number() OVER (ORDER BY device_name NULLS FIRST, device_identifier NULLS FIRST) AS device_key,
         device_name, device_identifier, source_system
  FROM (SELECT device_name, device_identifier, min(source_system) AS source_system
        FROM silver GROUP BY device_name, device_identifier) d
),
dim_organization AS (
  SELECT row_number() OVER (ORDER BY organization_name NULLS FIRST) AS organization_key, organization_name
  FROM (SELECT DISTINCT organization_name FROM silver) o
),
dim_alert_type AS (
  SELECT row_number() OVER (ORDER BY alert_type NULLS FIRST, service_name NULLS FIRST) AS alert_type_key,
         alert_type, service_name
  FROM (SELECT DISTINCT alert_type, service_name FROM silver) t
),
fact_groups AS (
  SELECT correlation_id, source_system, organization_name, device_name, device_identifier, alert_type, severity,
         min(event_time) AS start_time, max(event_time) AS end_time, count(*) AS alert_count,
         bool_or(synthetic) AS synthetic
  FROM silver
  GROUP BY correlation_id, source_system, organization_name, device_name, device_identifier, alert_type, severity
),
dim_time AS (
  SELECT row_number() OVER (ORDER BY event_time) AS time_key, event_time,
         CAST(event_time AS DATE) AS event_date, CAST(hour(event_time) AS INTEGER) AS hour,
         CAST(day(event_time) AS INTEGER) AS day, CAST(month(event_time) AS INTEGER) AS month,
         CAST(year(event_time) AS INTEGER) AS year
  FROM (SELECT start_time AS event_time FROM fact_groups UNION SELECT end_time FROM fact_groups) t
  WHERE event_time IS NOT NULL
),
fact_incidents AS (
  SELECT row_number() OVER (ORDER BY f.correlation_id NULLS FIRST, f.source_system NULLS FIRST,
           f.organization_name NULLS FIRST, f.device_name NULLS FIRST, f.device_identifier NULLS FIRST,
           f.alert_type NULLS FIRST, f.severity NULLS FIRST) AS incident_key,
         f.correlation_id, d.device_key, o.organization_key, t.alert_type_key,
         ts.time_key AS start_time_key, te.time_key AS end_time_key,
         epoch_us(f.end_time) - epoch_us(f.start_time) AS incident_duration, f.alert_count, f.severity, f.synthetic,
         'OPEN' AS incident_status
  FROM fact_groups f
  LEFT JOIN (SELECT device_name, min(device_key) AS device_key FROM dim_device GROUP BY 1) d
         ON f.device_name = d.device_name
  LEFT JOIN (SELECT organization_name, min(organization_key) AS organization_key FROM dim_organization GROUP BY 1) o
         ON f.organization_name = o.organization_name
  LEFT JOIN (SELECT alert_type, min(alert_type_key) AS alert_type_key FROM dim_alert_type GROUP BY 1) t
         ON f.alert_type = t.alert_type
  LEFT JOIN dim_time ts ON f.start_time = ts.event_time
  LEFT JOIN dim_time te ON f.end_time = te.event_time
)"""

def _sql_title(v: str) -> str:
    """Python str.title() in DuckDB: upper after a non-letter, lower elsewhere."""
    return (f"array_to_string(list_transform(range(1, length({v}) + 1), lambda i: CASE WHEN i = 1 OR NOT "
            f"regexp_matches(substr({v}, i - 1, 1), '\\p{{L}}') THEN upper(substr({v}, i, 1)) "
            f"ELSE lower(substr({v}, i, 1)) END), '')")


def _sql_ts_text(v: str) -> str:
    return (f"(strftime({v}, '%Y-%m-%d %H:%M:%S') || CASE WHEN epoch_us({v}) % 1000000 = 0 THEN '' "
            f"ELSE '.' || lpad(CAST(epoch_us({v}) % 1000000 AS VARCHAR), 6, '0') END || '+00:00')")


def _sql_label_line(label: str, v: str) -> str:
    t = f"trim({v})"
    body = f"CASE WHEN contains({t}, '_') THEN {_sql_title(f'replace({t}, {chr(39)}_{chr(39)}, {chr(39)} {chr(39)})')} ELSE {t} END"
    return (f"CASE WHEN {v} IS NULL OR {t} = '' OR lower({t}) = 'nan' THEN NULL "
            f"ELSE '{label}: ' || {body} END")


def _sql_na(label: str, v: str | None) -> str:
    if v is None:
        return f"'{label}: N/A'"
    return f"'{label}: ' || coalesce({v}, 'None')"


INCIDENT_GOLD_COLS = ("incident_id, device, organization, alert_count, severity_score, start_time, end_time, "
                      "duration_minutes, root_cause_candidate, incident_cause, description, incident_type")


ALERT_F = ["f1", "f2", "f3", "f4", "f5", "f6"]
def alert_dbscan_sql() -> str:
    """DBSCAN (eps 0.8, min_samples 3) over the six standardised alert features."""
    I = incidents_ctes(300)
    z = ",\n".join(f"(p.{f} - s.m_{f}) / CASE WHEN s.s_{f} IS NULL OR s.s_{f} = 0 THEN 1 ELSE s.s_{f} END AS {f}" for f in ALERT_F)
    stats = ", ".join(f"avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}" for f in ALERT_F)
    eq = " AND ".join(f"pts.{f} = lab.{f}" for f in ALERT_F)
    dist = " + ".join(f"(a.{f} - b.{f}) * (a.{f} - b.{f})" for f in ALERT_F)
    cols = ", ".join(ALERT_F)
    code = lambda c: f"CAST(CASE WHEN {c} IS NULL THEN -1 ELSE dense_rank() OVER (ORDER BY {c}) - 1 END AS DOUBLE)"
    return "WITH RECURSIVE " + I[len("WITH "):] + f""",
raw AS (
  SELECT alert_id, row_number() OVER (ORDER BY "timestamp", alert_id) AS o,
         severity_weight AS f1, {code('severity')} AS f2, {code('source')} AS f3, {code('alert_type')} AS f4,
         {code('entity_type')} AS f5, CAST(floor(epoch_us("timestamp") / 1000000) AS DOUBLE) AS f6
  FROM alert_map
),
st AS (SELECT {stats} FROM raw),
pts AS (SELECT p.alert_id, p.o, {z} FROM raw p, st s),
dp AS (SELECT {cols}, min(o) AS pid, count(*) AS w FROM pts GROUP BY {cols}),
nb AS (SELECT a.pid AS p, b.pid AS q, b.w FROM dp a JOIN dp b ON {dist} <= 0.8 * 0.8),
core AS (SELECT p FROM nb GROUP BY p HAVING sum(w) >= 3),
ce AS (SELECT p, q FROM nb WHERE p IN (SELECT p FROM core) AND q IN (SELECT p FROM core)),
walk(node, label) AS (
  SELECT p, p FROM core
  UNION
  SELECT ce.q, walk.label FROM walk JOIN ce ON walk.node = ce.p WHERE walk.label < ce.q
),
comp AS (SELECT node, min(label) AS label FROM walk GROUP BY node),
num AS (SELECT label, dense_rank() OVER (ORDER BY label) - 1 AS cid FROM (SELECT DISTINCT label FROM comp) l),
core_c AS (SELECT comp.node AS pid, num.cid FROM comp JOIN num ON comp.label = num.label),
border AS (
  SELECT nb.p AS pid, min(core_c.cid) AS cid FROM nb JOIN core_c ON nb.q = core_c.pid
  WHERE nb.p NOT IN (SELECT p FROM core) GROUP BY nb.p
),
lab AS (
  SELECT dp.*, CAST(coalesce(core_c.cid, border.cid, -1) AS BIGINT) AS alert_cluster
  FROM dp LEFT JOIN core_c ON dp.pid = core_c.pid LEFT JOIN border ON dp.pid = border.pid
)
SELECT pts.alert_id, lab.alert_cluster FROM pts JOIN lab ON {eq}"""


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}

    q["scan_alerts"] = "WITH " + RAW_ALERTS + " SELECT * FROM raw_alerts"

    q["canonical_alerts"] = "WITH " + ALERTS + """
SELECT alert_id, source, "timestamp", organization, device, entity_type, alert_type, severity,
       status, description, cause, severity_weight, is_critical FROM alerts"""

    q["incidents"] = incidents_ctes(300) + f" SELECT {INCIDENT_GOLD_COLS} FROM incidents"
    q["incidents_6h"] = incidents_ctes(6 * 3600) + f" SELECT {INCIDENT_GOLD_COLS} FROM incidents"

    I = incidents_ctes(300)

    q["alert_incident_map"] = I + """
SELECT m.alert_id, m.source, m."timestamp", m.organization, m.device, m.entity_type, m.alert_type, m.severity,
       m.status, m.description, m.cause, m.severity_weight, m.is_critical, m.time_window, m.incident_id,
       i.incident_type
FROM alert_map m LEFT JOIN incidents i ON m.incident_id = i.incident_id"""

    q["alert_features"] = "WITH " + RAW_ALERTS + """,
a AS (
  SELECT alert_id, source, "timestamp", organization, device, entity_type, alert_type,
         coalesce(trim(lower(severity)), 'none') AS severity, status, description, cause
  FROM raw_alerts WHERE "timestamp" IS NOT NULL AND device IS NOT NULL AND organization IS NOT NULL
),
d AS (
  SELECT organization, device, count(alert_id) AS n, min("timestamp") AS f, max("timestamp") AS l
  FROM a GROUP BY organization, device
)
SELECT a.*,
       CAST(CASE a.severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS DOUBLE)
         AS severity_weight,
       d.n AS alerts_per_device,
       d.n / greatest((epoch_us(d.l) - epoch_us(d.f)) / CAST(3600000000 AS DOUBLE), CAST(1 AS DOUBLE) / 60)
         AS alert_frequency,
       coalesce((epoch_us(a."timestamp") - epoch_us(lag(a."timestamp") OVER (
                   PARTITION BY a.organization, a.device ORDER BY a."timestamp", a.alert_id)))
                / CAST(60000000 AS DOUBLE), CAST(0 AS DOUBLE)) AS time_since_prev_alert_min
FROM a JOIN d ON a.organization = d.organization AND a.device = d.device"""

    q["incident_features"] = I + """
SELECT i.incident_id, i.organization, i.device, i.alert_count, i.severity_score, i.critical_alert_count,
       i.start_time, i.end_time, i.duration_minutes, i.root_cause_candidate, i.incident_cause, i.description,
       i.incident_type,
       greatest(i.duration_minutes, CAST(0 AS DOUBLE)) AS incident_duration,
       i.severity_score / (SELECT greatest(max(severity_score), CAST(1 AS DOUBLE)) FROM incidents)
         AS normalized_severity_score,
       i.alert_count / greatest(greatest(i.duration_minutes, CAST(0 AS DOUBLE)), CAST(1 AS DOUBLE))
         AS alerts_per_minute,
       coalesce(r.ratio, CAST(0 AS DOUBLE)) AS open_alert_ratio
FROM incidents i LEFT JOIN (
  SELECT incident_id,
         avg(CASE WHEN lower(coalesce(status, 'None')) <> 'resolved' THEN 1.0 ELSE 0.0 END)::DOUBLE AS ratio
  FROM alert_map GROUP BY incident_id) r ON i.incident_id = r.incident_id"""

    device_base = """,
am AS (
  SELECT organization, device, count(alert_id) AS total_alerts,
         CAST(sum(CASE WHEN lower(severity) = 'critical' THEN 1 ELSE 0 END) AS BIGINT) AS critical_alerts,
         avg(severity_weight) AS avg_severity, CAST(0 AS DOUBLE) AS alert_frequency
  FROM alert_map GROUP BY organization, device
),
im AS (
  SELECT organization, device, count(DISTINCT incident_id) AS incidents_count,
         CAST(sum(epoch_us(end_time) - epoch_us(start_time)) AS DOUBLE) / count(*) / 60000000.0 AS avg_incident_duration, avg(severity_score) AS avg_incident_severity
  FROM incidents GROUP BY organization, device
),
dm AS (
  SELECT am.*, coalesce(im.incidents_count, 0) AS incidents_count,
         coalesce(im.avg_incident_duration, 0) AS avg_incident_duration,
         coalesce(im.avg_incident_severity, 0) AS avg_incident_severity
  FROM am LEFT JOIN im ON am.organization = im.organization AND am.device = im.device
),
mx AS (
  SELECT greatest(CAST(max(total_alerts) AS DOUBLE), 1.0) AS ma,
         greatest(CAST(max(critical_alerts) AS DOUBLE), 1.0) AS mc,
         greatest(CAST(max(incidents_count) AS DOUBLE), 1.0) AS mi FROM dm
),
scored AS (
  SELECT dm.*, round_even(least(greatest(100.0::DOUBLE * (1.0::DOUBLE - (
            0.45::DOUBLE * (total_alerts / ma) + 0.35::DOUBLE * (critical_alerts / mc)
            + 0.2::DOUBLE * (incidents_count / mi))), 0.0::DOUBLE), 100.0::DOUBLE), 2) AS reliability_score
  FROM dm, mx
)"""
    DM = I + device_base

    q["device_features"] = DM + """
SELECT organization, device, total_alerts, critical_alerts, avg_severity, alert_frequency, incidents_count,
       avg_incident_duration, avg_incident_severity FROM dm"""

    q["device_metrics"] = DM + """
SELECT device, organization, total_alerts, critical_alerts, incidents_count, reliability_score FROM scored"""

    q["alert_stats"] = I + """
SELECT alert_type, count(alert_id) AS total_count, count(DISTINCT device) AS devices_affected,
       avg(severity_weight) AS avg_severity
FROM alert_map WHERE alert_type IS NOT NULL GROUP BY alert_type"""

    timeline = f""",
atl AS (SELECT {_bucket('"timestamp"', 300)} AS ts, count(alert_id) AS alerts_count FROM alert_map GROUP BY 1),
itl AS (SELECT {_bucket('start_time', 300)} AS ts, count(DISTINCT incident_id) AS incidents_count,
               count(CASE WHEN critical_alert_count > 0 THEN 1 END) AS critical_incidents
        FROM incidents GROUP BY 1),
tl AS (
  SELECT coalesce(atl.ts, itl.ts) AS "timestamp",
         CAST(coalesce(alerts_count, 0) AS BIGINT) AS alerts_count,
         CAST(coalesce(incidents_count, 0) AS BIGINT) AS incidents_count,
         CAST(coalesce(critical_incidents, 0) AS BIGINT) AS critical_incidents
  FROM atl FULL OUTER JOIN itl ON atl.ts = itl.ts
)"""
    q["timeline"] = I + timeline + " SELECT * FROM tl"
    q["timeline_tail"] = I + timeline + ' SELECT * FROM tl ORDER BY "timestamp" DESC LIMIT 5'

    q["top_failing_devices"] = I + """,
am AS (
  SELECT organization, device, count(alert_id) AS total_alerts,
         CAST(sum(CASE WHEN lower(severity) = 'critical' THEN 1 ELSE 0 END) AS BIGINT) AS critical_alerts
  FROM alert_map GROUP BY organization, device
),
im AS (SELECT organization, device, count(DISTINCT incident_id) AS n FROM incidents GROUP BY organization, device)
SELECT am.organization, am.device, total_alerts, critical_alerts, CAST(coalesce(n, 0) AS BIGINT) AS incidents_count
FROM am LEFT JOIN im ON am.organization = im.organization AND am.device = im.device"""

    q["alert_types_freq"] = I + """
SELECT alert_type, count(alert_id) AS total_count, count(DISTINCT device) AS devices_affected
FROM alert_map WHERE alert_type IS NOT NULL GROUP BY alert_type"""

    q["severity_distribution"] = I + """
SELECT lower(coalesce(severity, 'None')) AS severity, count(*) AS count FROM alert_map GROUP BY 1"""

    q["incident_trends"] = I + """
SELECT CAST(start_time AS DATE) AS date, count(DISTINCT incident_id) AS incidents_count,
       avg(severity_score) AS avg_severity, CAST(sum(epoch_us(end_time) - epoch_us(start_time)) AS DOUBLE) / count(*) / 60000000.0 AS avg_duration_minutes
FROM incidents GROUP BY 1"""

    q["failure_patterns"] = I + """
SELECT organization, device, alert_type, count(alert_id) AS total_alerts,
       count(DISTINCT incident_id) AS incidents_impacted, avg(severity_weight) AS avg_severity
FROM alert_map GROUP BY organization, device, alert_type
ORDER BY incidents_impacted DESC, total_alerts DESC, avg_severity DESC, organization, device, alert_type
LIMIT 10"""

    q["pipeline_metrics"] = I + """
SELECT CAST(a.n AS DOUBLE) AS total_alerts, CAST(i.n AS DOUBLE) AS total_incidents,
       CASE WHEN i.n > 0 THEN CAST(a.n AS DOUBLE) / i.n ELSE 0.0 END AS alerts_per_incident,
       CASE WHEN a.n > 0 THEN CAST(a.covered AS DOUBLE) / a.n ELSE 0.0 END AS incident_coverage_ratio,
       coalesce(i.d, 0.0) AS avg_incident_duration_minutes
FROM (SELECT count(*) AS n, count(incident_id) AS covered FROM alert_map) a,
     (SELECT count(DISTINCT incident_id) AS n, CAST(sum(epoch_us(end_time) - epoch_us(start_time)) AS DOUBLE) / count(*) / 60000000.0 AS d FROM incidents) i"""

    q["summary_overview"] = DM + """
SELECT (SELECT count(DISTINCT incident_id) FROM incidents) AS total_incidents,
       count(DISTINCT device) AS total_devices, CAST(coalesce(sum(total_alerts), 0) AS BIGINT) AS total_alerts,
       coalesce(CAST(sum(CAST(round(reliability_score * 100) AS BIGINT)) AS DOUBLE) / count(reliability_score) / 100.0, 0.0) AS avg_reliability_score
FROM scored"""

    q["summary_top_devices"] = DM + """
SELECT device, organization, total_alerts, critical_alerts, incidents_count, reliability_score FROM scored
ORDER BY incidents_count DESC, critical_alerts DESC, total_alerts DESC, organization, device LIMIT 5"""

    q["top_causes"] = I + """
SELECT coalesce(incident_cause, 'None') AS incident_cause, count(*) AS count FROM incidents
GROUP BY 1 ORDER BY count DESC, incident_cause LIMIT 5"""

    q["top_descriptions"] = I + """
SELECT coalesce(description, 'None') AS incident_description, count(*) AS count FROM incidents
GROUP BY 1 ORDER BY count DESC, incident_description LIMIT 5"""

    q["alert_contexts"] = I + """
SELECT alert_type, description, cause, count(*) AS count FROM alert_map GROUP BY alert_type, description, cause"""

    q["recent_alerts"] = I + """
SELECT alert_id, "timestamp", source, organization, device, alert_type, severity, description, cause, incident_id
FROM alert_map ORDER BY "timestamp" DESC, alert_id DESC LIMIT 5"""

    q["recent_incidents"] = I + f"""
SELECT {INCIDENT_GOLD_COLS} FROM incidents ORDER BY start_time DESC, incident_id DESC LIMIT 5"""

    q["silver_union"] = "WITH " + VENDOR_EVENTS + """
SELECT source_system, alert_id, correlation_id, organization_name, device_name, device_identifier, service_name,
       alert_type, severity, event_state, event_time, synthetic, ingestion_time FROM silver_raw"""
    q["silver_clean"] = "WITH " + VENDOR_EVENTS + " SELECT * FROM silver"
    q["silver_canonical"] = "WITH " + VENDOR_EVENTS + """
SELECT alert_id, source_system AS source, event_time AS "timestamp", organization_name AS organization,
       device_name AS device, 'unknown' AS entity_type, alert_type, severity, event_state AS status,
       NULL::VARCHAR AS description, 'None' AS cause
FROM silver"""
    q["dim_device"] = "WITH " + STAR_CTES + " SELECT * FROM dim_device"
    q["dim_device_incremental"] = "WITH " + STAR_CTES + """,
old AS (
  SELECT row_number() OVER (ORDER BY device_name NULLS FIRST, device_identifier NULLS FIRST) AS device_key,
         device_name, device_identifier, source_system
  FROM (SELECT device_name, device_identifier, min(source_system) AS source_system
        FROM silver WHERE day(event_time) <= 3 GROUP BY device_name, device_identifier) d
),
fresh AS (
  SELECT * FROM dim_device d WHERE NOT EXISTS (
    SELECT 1 FROM old o WHERE o.device_name IS NOT DISTINCT FROM d.device_name
                          AND o.device_identifier IS NOT DISTINCT FROM d.device_identifier)
)
SELECT * FROM old UNION ALL
SELECT (SELECT coalesce(max(device_key), 0) FROM old)
         + row_number() OVER (ORDER BY device_name NULLS FIRST, device_identifier NULLS FIRST),
       device_name, device_identifier, source_system
FROM fresh"""
    q["dim_organization"] = "WITH " + STAR_CTES + " SELECT * FROM dim_organization"
    q["dim_alert_type"] = "WITH " + STAR_CTES + " SELECT * FROM dim_alert_type"
    q["dim_time"] = "WITH " + STAR_CTES + " SELECT * FROM dim_time"
    q["fact_incidents"] = "WITH " + STAR_CTES + " SELECT * FROM fact_incidents"
    q["tickets"] = "WITH " + STAR_CTES + """
SELECT row_number() OVER (ORDER BY incident_key) AS ticket_id, incident_key AS incident_id,
       CAST(device_key AS VARCHAR) AS device_name, CAST(alert_type_key AS VARCHAR) AS issue, 'OPEN' AS status
FROM fact_incidents"""

    D = I + """,
dd AS (SELECT row_number() OVER (ORDER BY device) AS device_id, device AS device_name
       FROM (SELECT DISTINCT device FROM alert_map WHERE device IS NOT NULL) x),
ds AS (SELECT row_number() OVER (ORDER BY severity) AS severity_id, severity
       FROM (SELECT DISTINCT severity FROM alert_map WHERE severity IS NOT NULL) x),
dt_ AS (SELECT row_number() OVER (ORDER BY alert_type) AS alert_type_id, alert_type
        FROM (SELECT DISTINCT alert_type FROM alert_map WHERE alert_type IS NOT NULL) x),
dtime AS (SELECT row_number() OVER (ORDER BY occurred_at) AS time_id, occurred_at
          FROM (SELECT DISTINCT date_trunc('hour', "timestamp") AS occurred_at FROM alert_map) x),
fact AS (
  SELECT m.alert_id, dd.device_id, dt_.alert_type_id, ds.severity_id, dtime.time_id, m.description AS alert_message
  FROM alert_map m
  LEFT JOIN dd ON m.device = dd.device_name
  LEFT JOIN ds ON m.severity = ds.severity
  LEFT JOIN dt_ ON m.alert_type = dt_.alert_type
  LEFT JOIN dtime ON date_trunc('hour', m."timestamp") = dtime.occurred_at
),
summ AS (
  SELECT device AS device_name, count(alert_id) AS total_alerts,
         CAST(sum(CASE WHEN severity = 'critical' THEN 1 ELSE 0 END) AS BIGINT) AS critical_alerts,
         count(DISTINCT incident_id) AS incidents_count
  FROM alert_map GROUP BY device
)"""
    sel = "('dev-1', 'dev-3')"
    q["dash_kpis"] = D + """
SELECT (SELECT count(*) FROM fact) AS total_alerts, (SELECT count(*) FROM summ) AS total_devices,
       (SELECT count(*) FROM incidents) AS incidents,
       (SELECT count(DISTINCT alert_type_id) FROM fact) AS unique_alert_types"""
    q["dash_kpis_filtered"] = D + f"""
SELECT (SELECT count(*) FROM fact WHERE device_id IN (SELECT device_id FROM dd WHERE device_name IN {sel}))
         AS total_alerts,
       (SELECT count(*) FROM summ WHERE device_name IN {sel}) AS total_devices,
       (SELECT count(*) FROM incidents WHERE device IN {sel}) AS incidents,
       (SELECT count(DISTINCT alert_type_id) FROM fact
         WHERE device_id IN (SELECT device_id FROM dd WHERE device_name IN {sel})) AS unique_alert_types"""
    q["dash_severity_counts"] = D + """
SELECT f.severity_id, ds.severity, f.count
FROM (SELECT severity_id, count(*) AS count FROM fact GROUP BY severity_id) f
LEFT JOIN ds ON f.severity_id = ds.severity_id"""
    q["dash_alert_type_counts"] = D + " SELECT alert_type_id, count(*) AS count FROM fact GROUP BY alert_type_id"
    q["dash_alerts_over_time"] = D + """
SELECT dtime.occurred_at AS datetime, count(*) AS alerts
FROM fact LEFT JOIN dtime ON fact.time_id = dtime.time_id GROUP BY dtime.occurred_at"""
    q["dash_top_devices"] = D + """
SELECT device_name, total_alerts FROM summ ORDER BY total_alerts DESC, device_name LIMIT 10"""
    q["dash_device_filter"] = D + f"""
SELECT * FROM fact WHERE device_id IN (SELECT device_id FROM dd WHERE device_name IN {sel})"""
    q["dash_device_alerts"] = D + """
SELECT alert_message, alert_id FROM fact WHERE device_id IN (SELECT device_id FROM dd WHERE device_name = 'dev-1')"""

    doc_lines = ", ".join([
        _sql_label_line("Incident ID", "incident_id"),
        _sql_label_line("Device", "device"),
        _sql_label_line("Alert Type", "alert_type"),
        _sql_label_line("Severity", "severity"),
        _sql_label_line("Timestamp", _sql_ts_text('"timestamp"')),
        _sql_label_line("Affected Service", "entity_type"),
        _sql_label_line("Description", "description"),
    ])
    q["incident_documents"] = I + f"""
SELECT alert_id, document FROM (SELECT alert_id, concat_ws(chr(10), {doc_lines}) AS document FROM alert_map) d
WHERE length(trim(document)) > 0"""

    def sect(kind, fields, src, section):
        parts = [f"'Document Type: {kind}'", "'Generated At: '"] + [_sql_na(lbl, expr) for lbl, expr in fields]
        return f"SELECT {section} AS section, concat_ws(chr(10), {', '.join(parts)}) AS document FROM {src}"

    def c(x):
        return f"CAST({x} AS VARCHAR)"

    q["summary_documents"] = DM + timeline + """,
ov AS (
  SELECT (SELECT count(DISTINCT incident_id) FROM incidents) AS total_incidents,
         count(DISTINCT device) AS total_devices, CAST(coalesce(sum(total_alerts), 0) AS BIGINT) AS total_alerts,
         coalesce(CAST(sum(CAST(round(reliability_score * 100) AS BIGINT)) AS DOUBLE) / count(reliability_score) / 100.0, 0.0) AS avg_reliability_score FROM scored),
td AS (SELECT * FROM scored
       ORDER BY incidents_count DESC, critical_alerts DESC, total_alerts DESC, organization, device LIMIT 5),
st AS (SELECT alert_type, count(alert_id) AS total_count, count(DISTINCT device) AS devices_affected,
              avg(severity_weight) AS avg_severity
       FROM alert_map WHERE alert_type IS NOT NULL GROUP BY alert_type ORDER BY total_count DESC, alert_type LIMIT 5),
ri AS (SELECT * FROM incidents ORDER BY start_time DESC, incident_id DESC LIMIT 5),
tt AS (SELECT * FROM tl ORDER BY "timestamp" DESC LIMIT 5)
""" + " UNION ALL ".join([
        sect("Incident Summary Overview", [("Total Incidents", c("total_incidents")),
             ("Total Devices", c("total_devices")), ("Total Alerts", c("total_alerts")),
             ("Average Reliability Score", c("avg_reliability_score"))], "ov", 0),
        sect("Top Failing Device", [("Device", "device"), ("Organization", "organization"),
             ("Total Alerts", c("total_alerts")), ("Critical Alerts", c("critical_alerts")),
             ("Incidents Count", c("incidents_count")), ("Reliability Score", c("reliability_score")),
             ("Anomaly Score", None), ("Is Anomalous", None)], "td", 1),
        sect("Frequent Alert Type", [("Alert Type", "alert_type"), ("Total Count", c("total_count")),
             ("Devices Affected", c("devices_affected")), ("Average Severity", c("avg_severity"))], "st", 2),
        sect("Recent Incident", [("Incident ID", "incident_id"), ("Device", "device"),
             ("Organization", "organization"), ("Alert Count", c("alert_count")),
             ("Severity Score", c("severity_score")), ("Start Time", _sql_ts_text("start_time")),
             ("End Time", _sql_ts_text("end_time")), ("Duration Minutes", c("duration_minutes")),
             ("Root Cause Candidate", "root_cause_candidate"), ("Incident Type", "incident_type")], "ri", 3),
        sect("Incident Timeline Snapshot", [("Timestamp", _sql_ts_text('"timestamp"')),
             ("Alerts Count", c("alerts_count")), ("Incidents Count", c("incidents_count")),
             ("Critical Incidents", c("critical_incidents"))], "tt", 4),
    ])

    V = """WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e,
         sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS n,
         'Embedding ' || CAST(vec_id AS VARCHAR) || ' with label ' || CAST(label AS VARCHAR) AS document
  FROM embeddings
),
pairs AS (
  SELECT a.vec_id AS qid, b.vec_id AS id,
         round(list_dot_product(a.e, b.e) / ((CASE WHEN a.n = 0 THEN 1 ELSE a.n END)
                                             * (CASE WHEN b.n = 0 THEN 1 ELSE b.n END)), 6) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id
),
hits AS (
  SELECT qid, rank, id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM pairs) r
  WHERE rank <= 5
)"""
    q["vec_normalize"] = """
SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: round(x / CASE WHEN n = 0 THEN 1 ELSE n END, 6))
         AS unit_vector
FROM (SELECT *, sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS n FROM embeddings) e"""
    q["vec_topk"] = V + " SELECT * FROM hits"
    q["retrieve_scored"] = V + """
SELECT h.qid, h.rank, h.id, h.score, v.document FROM hits h LEFT JOIN v ON h.id = v.vec_id"""
    q["build_context"] = V + """
SELECT h.qid, string_agg(v.document, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY h.rank) AS context
FROM hits h JOIN v ON h.id = v.vec_id WHERE length(trim(v.document)) > 0 GROUP BY h.qid"""
    q["vec_info"] = "SELECT count(*) AS points_count, max(len(embedding)) AS vector_size FROM embeddings"
    q["vec_upsert"] = """
WITH e AS (SELECT *, sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS n FROM embeddings),
store AS (
  SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vector,
         'Embedding ' || CAST(vec_id AS VARCHAR) || ' with label ' || CAST(label AS VARCHAR) AS document,
         0 AS version FROM e
),
incoming AS (
  SELECT CAST((SELECT count(*) FROM embeddings) / 2 AS BIGINT) + row_number() OVER (ORDER BY vec_id) - 1 AS id,
         list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / CASE WHEN n = 0 THEN 1 ELSE n END) AS vector,
         'Updated label ' || CAST(label AS VARCHAR) AS document, 1 AS version FROM e
),
merged AS (SELECT * FROM store UNION ALL SELECT * FROM incoming)
SELECT id, list_transform(vector, lambda x: round(x, 6)) AS vector, document, version FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC) AS rn FROM merged) m WHERE rn = 1"""

    q["incident_scaled"] = I + """,
st AS (SELECT avg(alert_count) ma, stddev_pop(alert_count) sa, avg(severity_score) ms, stddev_pop(severity_score) ss,
              avg(duration_minutes) md, stddev_pop(duration_minutes) sd FROM incidents)
SELECT incident_id,
       round((alert_count - ma) / CASE WHEN sa IS NULL OR sa = 0 THEN 1 ELSE sa END, 6) AS alert_count_z,
       round((severity_score - ms) / CASE WHEN ss IS NULL OR ss = 0 THEN 1 ELSE ss END, 6) AS severity_score_z,
       round((duration_minutes - md) / CASE WHEN sd IS NULL OR sd = 0 THEN 1 ELSE sd END, 6) AS duration_minutes_z
FROM incidents, st"""
    q["alert_cluster_features"] = I + """
SELECT alert_id, severity_weight,
       CAST(CASE WHEN severity IS NULL THEN -1 ELSE dense_rank() OVER (ORDER BY severity) - 1 END AS BIGINT)
         AS severity_code,
       CAST(CASE WHEN source IS NULL THEN -1 ELSE dense_rank() OVER (ORDER BY source) - 1 END AS BIGINT) AS source_code,
       CAST(CASE WHEN alert_type IS NULL THEN -1 ELSE dense_rank() OVER (ORDER BY alert_type) - 1 END AS BIGINT)
         AS alert_type_code,
       CAST(CASE WHEN entity_type IS NULL THEN -1 ELSE dense_rank() OVER (ORDER BY entity_type) - 1 END AS BIGINT)
         AS entity_type_code,
       CAST(floor(epoch_us("timestamp") / 1000000) AS BIGINT) AS timestamp_epoch
FROM alert_map"""

    q["stream_silver"] = "WITH " + VENDOR_EVENTS + """
SELECT source_system, alert_id, correlation_id, organization_name, device_name, device_identifier, service_name,
       alert_type, severity, event_state, event_time, synthetic, ingestion_time FROM silver_cleaned"""
    q["stream_dedupe"] = "WITH " + VENDOR_EVENTS + """
SELECT DISTINCT correlation_id, device_name, alert_type, event_state, event_time FROM silver_cleaned"""
    closed = """(SELECT max("timestamp") - INTERVAL 10 MINUTE FROM alerts)"""
    q["stream_incidents"] = I + f"""
SELECT organization || '|' || device || '|' || CAST(epoch_us(time_window) AS VARCHAR) AS incident_key,
       organization, device, time_window, alert_count, severity_score, critical_alert_count, start_time, end_time,
       duration_minutes, root_cause_candidate, incident_cause, description, incident_type
FROM incidents WHERE time_window + INTERVAL 5 MINUTE <= {closed}"""
    q["stream_keep_first"] = "WITH " + VENDOR_EVENTS + " SELECT * FROM silver"
    q["stream_incidents_complete"] = I + """
SELECT organization || '|' || device || '|' || CAST(epoch_us(time_window) AS VARCHAR) AS incident_key,
       organization, device, time_window, alert_count, severity_score, critical_alert_count, start_time, end_time,
       duration_minutes, root_cause_candidate, incident_cause, description, incident_type
FROM incidents"""
    q["stream_timeline_complete"] = I + """
SELECT time_window AS "timestamp", count(alert_id) AS alerts_count FROM alert_map GROUP BY time_window"""
    q["stream_escalation"] = I + """,
esc AS (
  SELECT organization || '|' || device || '|' || CAST(epoch_us(time_window) AS VARCHAR) AS incident_key,
         epoch_us(start_time) AS opened_us
  FROM incidents
)
SELECT incident_key, make_timestamp(opened_us) AS opened_at,
       make_timestamp(opened_us + 60000000) AS escalated_at
FROM esc
-- the stream engine's own clock (watermark and timers) runs in milliseconds
WHERE opened_us // 1000 + 60000 < (SELECT epoch_us(max("timestamp")) // 1000 - 600000 FROM alerts)"""
    q["stream_timeline"] = I + f"""
SELECT time_window AS "timestamp", count(alert_id) AS alerts_count FROM alert_map
WHERE time_window + INTERVAL 5 MINUTE <= {closed} GROUP BY time_window"""
    q["stream_tickets"] = I + """
SELECT row_number() OVER (ORDER BY k) AS ticket_id, k AS incident_key, device AS device_name,
       root_cause_candidate AS issue, 'OPEN' AS status
FROM (SELECT *, organization || '|' || device || '|' || CAST(epoch_us(time_window) AS VARCHAR) AS k FROM incidents) x"""

    # DBSCAN (eps 0.9, min_samples 2) over standardised incident features, written
    # the textbook way: neighbour pairs, core points, components, borders
    q["incident_clusters"] = I + """,
st AS (SELECT avg(alert_count) ma, stddev_pop(alert_count) sa, avg(severity_score) ms, stddev_pop(severity_score) ss,
              avg(duration_minutes) md, stddev_pop(duration_minutes) sd FROM incidents),
pts AS (
  SELECT incident_id, CAST(substr(incident_id, 5) AS BIGINT) AS o,
         (alert_count - ma) / CASE WHEN sa IS NULL OR sa = 0 THEN 1 ELSE sa END AS x,
         (severity_score - ms) / CASE WHEN ss IS NULL OR ss = 0 THEN 1 ELSE ss END AS y,
         (duration_minutes - md) / CASE WHEN sd IS NULL OR sd = 0 THEN 1 ELSE sd END AS z
  FROM incidents, st
),
dp AS (SELECT x, y, z, min(o) AS pid, count(*) AS w FROM pts GROUP BY x, y, z),
nb AS (
  SELECT a.pid AS p, b.pid AS q, b.w
  FROM dp a JOIN dp b
    ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 0.9 * 0.9
),
core AS (SELECT p FROM nb GROUP BY p HAVING sum(w) >= 2),
ce AS (SELECT p, q FROM nb WHERE p IN (SELECT p FROM core) AND q IN (SELECT p FROM core)),
walk(node, label) AS (
  SELECT p, p FROM core
  UNION
  SELECT ce.q, walk.label FROM walk JOIN ce ON walk.node = ce.p WHERE walk.label < ce.q
),
comp AS (SELECT node, min(label) AS label FROM walk GROUP BY node),
num AS (SELECT label, dense_rank() OVER (ORDER BY label) - 1 AS cid FROM (SELECT DISTINCT label FROM comp) l),
core_c AS (SELECT comp.node AS pid, num.cid FROM comp JOIN num ON comp.label = num.label),
border AS (
  SELECT nb.p AS pid, min(core_c.cid) AS cid FROM nb JOIN core_c ON nb.q = core_c.pid
  WHERE nb.p NOT IN (SELECT p FROM core) GROUP BY nb.p
),
lab AS (
  SELECT dp.x, dp.y, dp.z, CAST(coalesce(core_c.cid, border.cid, -1) AS BIGINT) AS cluster_id
  FROM dp LEFT JOIN core_c ON dp.pid = core_c.pid LEFT JOIN border ON dp.pid = border.pid
)
SELECT pts.incident_id, lab.cluster_id, CAST(CASE WHEN lab.cluster_id = -1 THEN 1 ELSE 0 END AS INTEGER)
       AS is_noise_cluster
FROM pts JOIN lab ON pts.x = lab.x AND pts.y = lab.y AND pts.z = lab.z"""
    q["cluster_summary"] = q["incident_clusters"].replace(
        "SELECT pts.incident_id, lab.cluster_id, CAST(CASE WHEN lab.cluster_id = -1 THEN 1 ELSE 0 END AS INTEGER)\n"
        "       AS is_noise_cluster\nFROM pts JOIN lab ON pts.x = lab.x AND pts.y = lab.y AND pts.z = lab.z",
        "SELECT lab.cluster_id, count(DISTINCT i.incident_id) AS incidents, avg(i.severity_score) AS avg_severity_score,\n"
        "       avg(i.alert_count) AS avg_alert_count\n"
        "FROM pts JOIN lab ON pts.x = lab.x AND pts.y = lab.y AND pts.z = lab.z\n"
        "JOIN incidents i ON pts.incident_id = i.incident_id WHERE lab.cluster_id <> -1 GROUP BY lab.cluster_id")

    q["alert_map_clustered"] = q["incident_clusters"].replace(
        "SELECT pts.incident_id, lab.cluster_id, CAST(CASE WHEN lab.cluster_id = -1 THEN 1 ELSE 0 END AS INTEGER)\n"
        "       AS is_noise_cluster\nFROM pts JOIN lab ON pts.x = lab.x AND pts.y = lab.y AND pts.z = lab.z",
        "SELECT m.*, i.incident_type, lab.cluster_id FROM alert_map m LEFT JOIN incidents i ON m.incident_id = i.incident_id\n"
        "LEFT JOIN pts ON m.incident_id = pts.incident_id\n"
        "LEFT JOIN lab ON pts.x = lab.x AND pts.y = lab.y AND pts.z = lab.z")
    q["alert_clusters"] = alert_dbscan_sql()
    q["pipeline_metrics_clustered"] = f"""
SELECT p.*, CASE WHEN p.total_alerts > 0 THEN c.n / p.total_alerts ELSE 0.0 END AS clustered_alert_ratio
FROM ({q["pipeline_metrics"]}) p,
     (SELECT CAST(count(*) FILTER (alert_cluster <> -1) AS DOUBLE) AS n FROM ({q["alert_clusters"]}) a) c"""
    for key in ("incident_clusters", "cluster_summary", "alert_map_clustered"):
        q[key] = "WITH RECURSIVE " + q[key][len("WITH "):]

    from alertforge.operators.answers import DEFAULT_TEMPLATE, INTENT_KEYWORDS, INTENT_PRECEDENCE
    from alertforge.schemas import EMPTY_CONTEXT_FALLBACK, ISSUE_TYPE_RULES, DEFAULT_ISSUE_TYPE

    def lit(text):
        return "'" + text.replace("'", "''") + "'"

    def strip(x):
        return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"

    def any_of(x, words):
        return " OR ".join(f"contains({x}, {lit(w)})" for w in words)

    intent_case = "CASE " + " ".join(
        f"WHEN {any_of('lower(question)', INTENT_KEYWORDS[i])} THEN {lit(i)}" for i in INTENT_PRECEDENCE
    ) + " ELSE 'INCIDENT_SUMMARY' END"
    issue_case = "CASE " + " ".join(
        f"WHEN {any_of('lower(question)', words)} THEN {lit(label)}" for words, label in ISSUE_TYPE_RULES
    ) + f" ELSE {lit(DEFAULT_ISSUE_TYPE)} END"
    prefixes = ["Why is the VPN down?", "Is the database failing?", "Why is CPU high?", "Is the disk full?",
                "Is the certificate expired?", "Summarize recent incidents.", "What are the resolution steps?",
                "Which device fails most?"]
    prefix_case = "CASE conv_id % 8 " + " ".join(
        f"WHEN {i} THEN {lit(p)}" for i, p in enumerate(prefixes[:-1])) + f" ELSE {lit(prefixes[-1])} END"
    QS = f"""WITH questions AS (
  SELECT conv_id || ':' || turn AS qid, concat_ws(' ', {prefix_case}, text) AS question
  FROM conversations WHERE role = 'user'
),
pairs AS (
  SELECT q.qid, q.question, r.text AS context FROM questions q
  LEFT JOIN (SELECT conv_id || ':' || (turn - 1) AS qid, text FROM conversations WHERE role = 'assistant') r
    ON q.qid = r.qid
)"""
    q["issue_type"] = QS + f" SELECT qid, {issue_case} AS issue_type FROM questions"
    q["question_intent"] = QS + f" SELECT qid, {intent_case} AS intent FROM questions"

    ctx = f"CASE WHEN context IS NULL OR length({strip('context')}) = 0 THEN {lit(EMPTY_CONTEXT_FALLBACK)} ELSE context END"
    filled = f"replace(replace({lit(DEFAULT_TEMPLATE)}, '{{context}}', {strip(ctx)}), '{{question}}', {strip('question')})"
    q["build_prompts"] = QS + f""",
filled AS (SELECT qid, {filled} AS p FROM pairs WHERE question IS NOT NULL AND length({strip('question')}) > 0)
SELECT qid, p AS prompt FROM filled"""

    def norm(x):
        return strip(f"regexp_replace(replace(lower({x}), ',', ''), '\\s+', ' ', 'g')")

    q["grounding_check"] = f"""
WITH ctx AS (
  SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS context
  FROM conversations WHERE role = 'assistant' GROUP BY conv_id
),
vals AS (
  SELECT conv_id, turn, unnest(range(0, len(string_split(text, chr(10))))) AS line_no,
         unnest(string_split(text, chr(10))) AS value
  FROM conversations WHERE role = 'user'
),
j AS (
  SELECT v.conv_id, v.turn, v.line_no, v.value, c.context,
         regexp_extract_all(replace(v.value, ',', ''), '\\d+') AS vn,
         regexp_extract_all(replace(c.context, ',', ''), '\\d+') AS cn
  FROM vals v LEFT JOIN ctx c ON v.conv_id = c.conv_id
)
SELECT conv_id, turn, line_no,
       CASE WHEN value IS NULL OR value = '' OR context IS NULL OR context = '' THEN false
            ELSE contains({norm('context')}, {norm('value')})
                 OR (len(vn) > 0 AND len(list_filter(vn, lambda x: NOT list_contains(cn, x))) = 0) END AS grounded
FROM j"""

    q["grounding_excerpts"] = f"""
WITH ctx AS (
  SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS context
  FROM conversations WHERE role = 'assistant' GROUP BY conv_id
),
lines AS (
  SELECT conv_id, turn, unnest(range(0, len(string_split(text, chr(10))))) AS line_no,
         unnest(string_split(text, chr(10))) AS line
  FROM conversations WHERE role = 'assistant'
),
cut AS (SELECT *, substr(line, length(line) // 4 + 1, length(line) // 2) AS middle FROM lines),
vals AS (
  SELECT conv_id, turn, line_no, 'middle' AS kind, middle AS value FROM cut
  UNION ALL SELECT conv_id, turn, line_no, 'changed', replace(middle, 'e', 'x') FROM cut
  UNION ALL SELECT conv_id, turn, line_no, 'short', substr(line, 2, 6) FROM cut
  UNION ALL SELECT a.conv_id, a.turn, 0, 'across', concat(right(a.text, 12), ' ', left(b.text, 12))
            FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 2
            WHERE a.role = 'assistant' AND b.role = 'assistant'
),
j AS (
  SELECT v.*, c.context, regexp_extract_all(replace(v.value, ',', ''), '\\d+') AS vn,
         regexp_extract_all(replace(c.context, ',', ''), '\\d+') AS cn
  FROM vals v LEFT JOIN ctx c ON v.conv_id = c.conv_id
)
SELECT conv_id, turn, line_no, kind,
       CASE WHEN value IS NULL OR value = '' OR context IS NULL OR context = '' THEN false
            ELSE contains({norm('context')}, {norm('value')})
                 OR (len(vn) > 0 AND len(list_filter(vn, lambda x: NOT list_contains(cn, x))) = 0) END AS grounded
FROM j"""

    def embed_ctes(name, src, id_col, text_expr):
        """CTEs ending in ``name`` (id_col, vector): the hashed term-frequency encoder."""
        return f"""
{name}_toks AS (SELECT {id_col} AS id, unnest(regexp_extract_all(lower({text_expr}), '[\\p{{L}}\\p{{N}}]+')) AS t
               FROM {src}),
{name}_bk AS (SELECT id, ('0x' || substr(md5(t), 1, 8))::BIGINT % 384 AS b, CAST(count(*) AS DOUBLE) AS c
             FROM {name}_toks GROUP BY 1, 2),
{name}_agg AS (SELECT id, list(struct_pack(b := b, c := c)) AS e, sqrt(sum(c * c)) AS n FROM {name}_bk GROUP BY id),
{name} AS (
  SELECT id AS {id_col},
         list_transform(range(0, 384), lambda i: coalesce(list_sum(list_transform(
             list_filter(e, lambda x: x.b = i), lambda x: x.c)), 0) / n) AS vector
  FROM {name}_agg
)"""

    def rounded(name, id_col):
        return f" SELECT {id_col}, list_transform(vector, lambda x: round(x, 6)) AS vector FROM {name}"

    instr = "Represent this sentence for searching relevant passages: "
    q["embed_documents"] = "WITH " + embed_ctes("dvec", "documents", "doc_id", "text") + rounded("dvec", "doc_id")
    q["embed_questions"] = (QS + "," + embed_ctes("qvec", "questions", "qid", f"{lit(instr)} || question")
                            + rounded("qvec", "qid"))

    q["copilot_prompts"] = (QS + "," + embed_ctes("dvec", "documents", "doc_id", "text") + ","
                            + embed_ctes("qvec", "questions", "qid", f"{lit(instr)} || question") + f""",
cn AS (SELECT doc_id, vector, sqrt(list_sum(list_transform(vector, lambda x: x * x))) AS n FROM dvec),
qn AS (SELECT qid, vector, sqrt(list_sum(list_transform(vector, lambda x: x * x))) AS n FROM qvec),
sc AS (
  SELECT qn.qid, cn.doc_id,
         round(list_dot_product(qn.vector, cn.vector) / ((CASE WHEN qn.n = 0 THEN 1 ELSE qn.n END)
                                                         * (CASE WHEN cn.n = 0 THEN 1 ELSE cn.n END)), 6) AS score
  FROM qn, cn
),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rk FROM sc) r
        WHERE rk <= 5),
ctx AS (
  SELECT t.qid, string_agg(d.text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY t.rk) AS context
  FROM top t JOIN documents d ON t.doc_id = d.doc_id WHERE length(trim(d.text)) > 0 GROUP BY t.qid
),
pairs2 AS (SELECT q.qid, q.question, ctx.context FROM questions q LEFT JOIN ctx ON q.qid = ctx.qid),
cf AS (SELECT qid, {filled} AS p FROM pairs2 WHERE question IS NOT NULL AND length({strip('question')}) > 0)
SELECT qid, p AS prompt FROM cf""")

    sep_sql = "chr(10) || chr(10) || '---' || chr(10) || chr(10)"

    def sstrip(x):
        return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"

    q["context_recent"] = ("WITH " + ALERTS[len(""):] if False else incidents_ctes(300)) + "," + QS[len("WITH "):] + f""",
incdocs AS (
  SELECT CAST(alert_id AS BIGINT) AS doc_id, document
  FROM (SELECT alert_id, concat_ws(chr(10), {doc_lines}) AS document FROM alert_map) d
  WHERE length(trim(document)) > 0
),""" + embed_ctes("dvec", "incdocs", "doc_id", "document") + "," + embed_ctes(
        "qvec", "questions", "qid", f"{lit(instr)} || question") + f""",
cn AS (SELECT doc_id, vector, sqrt(list_sum(list_transform(vector, lambda x: x * x))) AS n FROM dvec),
qn AS (SELECT qid, vector, sqrt(list_sum(list_transform(vector, lambda x: x * x))) AS n FROM qvec),
sc AS (
  SELECT qn.qid, cn.doc_id,
         round(list_dot_product(qn.vector, cn.vector) / ((CASE WHEN qn.n = 0 THEN 1 ELSE qn.n END)
                                                         * (CASE WHEN cn.n = 0 THEN 1 ELSE cn.n END)), 6) AS score
  FROM qn, cn
),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rk FROM sc) r
        WHERE rk <= 5),
ctx AS (
  SELECT t.qid, string_agg(d.document, {sep_sql} ORDER BY t.rk) AS context
  FROM top t JOIN incdocs d ON t.doc_id = d.doc_id WHERE length(trim(d.document)) > 0 GROUP BY t.qid
),
blk0 AS (
  SELECT qid, unnest(string_split(context, {sep_sql})) AS b,
         generate_subscripts(string_split(context, {sep_sql}), 1) AS block_no
  FROM ctx
),
blk AS (SELECT qid, block_no, {sstrip('b')} AS block FROM blk0 WHERE length({sstrip('b')}) > 0),
ln0 AS (
  SELECT qid, block_no, unnest(regexp_split_to_array(block, '\r\n|\r|\n')) AS l,
         generate_subscripts(regexp_split_to_array(block, '\r\n|\r|\n'), 1) AS line_no
  FROM blk
),
ln AS (SELECT qid, block_no, line_no, {sstrip('l')} AS line FROM ln0 WHERE contains({sstrip('l')}, ':')),
kv AS (
  SELECT qid, block_no, {sstrip("split_part(line, ':', 1)")} AS k,
         arg_max({sstrip("substr(line, strpos(line, ':') + 1)")}, line_no) AS v
  FROM ln GROUP BY qid, block_no, k
),
fields AS (
  SELECT blk.qid, blk.block_no,
         max(CASE WHEN k = 'Incident ID' THEN v END) AS f_id, max(CASE WHEN k = 'Device' THEN v END) AS f_dev,
         max(CASE WHEN k = 'Alert Type' THEN v END) AS f_type, max(CASE WHEN k = 'Severity' THEN v END) AS f_sev,
         max(CASE WHEN k = 'Timestamp' THEN v END) AS f_ts
  FROM blk LEFT JOIN kv ON blk.qid = kv.qid AND blk.block_no = kv.block_no
  GROUP BY blk.qid, blk.block_no
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY
              TRY_CAST(regexp_replace(f_ts, 'Z$', '+00:00') AS TIMESTAMPTZ) DESC NULLS LAST, block_no) AS rnk
  FROM fields
)
SELECT qid, 'Recent Incidents (top ' || CAST(count(*) AS VARCHAR) || '):' || chr(10) ||
       string_agg(CAST(rnk AS VARCHAR) || '. Incident ID: ' || coalesce(f_id, 'N/A') || ' | Device: ' ||
                  coalesce(f_dev, 'N/A') || ' | Alert: ' || coalesce(f_type, 'N/A') || ' | Severity: ' ||
                  coalesce(f_sev, 'N/A') || ' | Timestamp: ' || coalesce(f_ts, 'N/A'), chr(10) ORDER BY rnk)
         AS recent_incidents
FROM ranked WHERE rnk <= 3 GROUP BY qid"""

    q["answer_intent"] = QS + f"""
SELECT qid, {intent_case} AS intent FROM pairs"""

    return q
