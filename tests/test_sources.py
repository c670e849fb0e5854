"""File sources and sinks on small files written to a temp folder."""
import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from alertforge.plans import etl
from alertforge.sources import files as FILES

AUVIK = [
    {"entityId": "E1", "subject": "s", "alertStatusString": "Triggered", "alertId": "A1", "alertName": "cpu_high",
     "entityName": " Router-1 ", "companyName": "Acme", "entityType": "device", "date": "2025-01-01T10:00:00.123Z",
     "link": "http://x", "alertStatus": 0, "correlationId": "C1", "alertDescription": "line1\r\nline2",
     "alertSeverityString": "Critical", "alertSeverity": 1, "companyId": "9"},
    {"entityId": "E2", "alertId": "A2", "alertName": "link_down", "entityName": "sw-2", "companyName": "Acme",
     "date": "2025-01-01T10:01:00Z", "alertSeverityString": "warning", "alertSeverity": 2},
]
MERAKI = [
    {"app_key": "k", "status": "ok", "check": "uplink", "version": "1", "sharedSecret": "", "sentAt": "2025-01-01T10:00:00Z",
     "organizationId": "1", "organizationName": "Org", "organizationUrl": "u", "networkId": "n", "networkName": " Net",
     "networkUrl": "u", "deviceSerial": "Q1", "deviceMac": "m", "deviceName": "AP-1", "deviceUrl": "u",
     "deviceModel": "MR", "alertId": "M1", "alertType": "offline", "alertTypeId": "t", "alertLevel": "critical",
     "occurredAt": "2025-01-01T09:59:00Z", "host": "h"},
]
XML_DOC = """<?xml version="1.0" encoding="UTF-8"?>
<notification>
  <ActiveNotificationTriggerID>{tid}</ActiveNotificationTriggerID>
  <CustomerName>Ocean &amp; Co</CustomerName>
  <DeviceURI>10.0.0.1</DeviceURI>
  <DeviceName>{dev}</DeviceName>
  <ExternalCustomerID/>
  <AffectedService>Disk</AffectedService>
  <TaskIdent></TaskIdent>
  <QualitativeNewState>Failed</QualitativeNewState>
  <TimeOfStateChange>2025-11-23 08:19:01</TimeOfStateChange>
  <QuantitativeNewState>line a
line b</QuantitativeNewState>
</notification>
"""


def write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def test_vendor_json_and_xml_to_silver(spark, tmp_dir):
    a = write(os.path.join(tmp_dir, "auvik.json"), json.dumps(AUVIK))
    m = write(os.path.join(tmp_dir, "meraki.json"), json.dumps(MERAKI))
    x = write(os.path.join(tmp_dir, "ncentral.xml"),
              XML_DOC.format(tid="1", dev="LB01") + "\n" + XML_DOC.format(tid="", dev="LB02"))
    auvik = FILES.read_auvik_json(spark, a).collect()
    assert len(auvik) == 2 and auvik[1]["link"] is None and auvik[0]["alert_description"] == "line1\r\nline2"
    nc = FILES.read_ncentral_xml(spark, x).orderBy("device_name").collect()
    assert [r["device_name"] for r in nc] == ["LB01", "LB02"]
    assert nc[0]["customer_name"] == "Ocean & Co" and nc[0]["task_ident"] == "" and nc[0]["probe_uri"] is None
    assert nc[0]["quantitative_new_state"] == "line a\nline b"
    frames = etl.bronze(spark, a, m, x)
    silver = etl.silver(frames).orderBy("alert_id").collect()
    assert {r["source_system"] for r in silver} == {"auvik", "meraki", "ncentral"}
    by_id = {r["alert_id"]: r for r in silver}
    assert by_id["A1"]["device_name"] == "router-1" and by_id["A1"]["severity"] == "HIGH"
    assert by_id["A2"]["severity"] == "MEDIUM" and by_id["M1"]["event_state"] == "triggered"
    g = etl.gold(etl.silver(frames))
    assert g["fact_incidents"].count() == len(silver)


def test_silver_directory_scan(spark, tmp_dir):
    d = os.path.join(tmp_dir, "silver")
    os.makedirs(d)
    canon = pd.DataFrame({"alert_id": ["1", "2"], "source": ["x", "x"],
                          "timestamp": pd.to_datetime(["2024-01-01 00:00:00", "2024-01-01 00:01:00"]),
                          "organization": ["o", "o"], "device": ["d", "d"], "entity_type": ["e", "e"],
                          "alert_type": ["t", "t"], "severity": ["low", "high"], "status": ["open", "open"],
                          "description": ["a", "b"], "cause": [None, "c"]})
    aliased = pd.DataFrame({"alert_id": ["1", "3"], "source_system": ["y", "y"],
                            "occurred_at": pd.to_datetime(["2024-01-01 00:00:00", "2024-01-01 00:02:00"]),
                            "organization_name": ["o", "o"], "device_name": ["d", "d"], "alert_type": ["t", "t"],
                            "severity": ["low", "low"], "alert_message": ["dup", "c"], "reason": ["r", "r"]})
    canon.to_parquet(os.path.join(d, "a.parquet"), coerce_timestamps="us")
    aliased.to_parquet(os.path.join(d, "b.parquet"), coerce_timestamps="us")
    pd.DataFrame({"x": [1]}).to_parquet(os.path.join(d, "c.parquet"))
    got = {r["alert_id"]: r for r in FILES.load_silver_alerts(spark, d).collect()}
    assert sorted(got) == ["1", "2", "3"]
    assert got["1"]["description"] == "a" and got["1"]["cause"] == "a"  # first file wins, cause from description
    assert got["3"]["cause"] == "r" and got["3"]["status"] == "open" and got["3"]["entity_type"] == "unknown"


def test_csv_bad_timestamp_dropped(spark, tmp_dir):
    p = os.path.join(tmp_dir, "alerts.csv")
    write(p, "alert_id,source,timestamp,organization,device,entity_type,alert_type,severity,status,description,cause\n"
             "1,s,2024-01-01 00:00:00,o,d,e,t,low,open,x,c\n2,s,not a time,o,d,e,t,low,open,x,c\n")
    from alertforge.operators import incidents as INC
    norm = INC.normalize_alerts(FILES.load_silver_alerts(spark, p))
    assert [r["alert_id"] for r in norm.collect()] == ["1"]
    with pytest.raises(ValueError):
        FILES.load_silver_alerts(spark, os.path.join(tmp_dir, "alerts.txt"))


def test_incident_json_variants(spark, tmp_dir):
    recs = [{"incident_id": 1, "device": "r1", "alert_name": "cpu_high", "severity": "critical",
             "description": "x", "timestamp": "2025-01-01"},
            {"incident_id": 2, "device": None, "alert_name": "disk", "severity": "nan"}]
    p1 = write(os.path.join(tmp_dir, "list.json"), json.dumps(recs))
    p2 = write(os.path.join(tmp_dir, "wrapped.json"), json.dumps({"records": recs}))
    p3 = write(os.path.join(tmp_dir, "flat.json"), json.dumps(recs[0]))
    for p, n in ((p1, 2), (p2, 2), (p3, 1)):
        docs = [r["document"] for r in FILES.load_incident_documents(spark, p).collect()]
        assert len(docs) == n
        assert "Alert Type: Cpu High" in docs[0] or "Alert Type: Cpu High" in docs[-1]
    summary = {"generated_at": "g", "overview": {"total_incidents": 3, "total_devices": 2, "total_alerts": 5,
                                                 "avg_reliability_score": 88.5},
               "top_failing_devices": [{"device": "d", "organization": "o"}],
               "most_frequent_alert_types": [{"alert_type": "t", "total_count": 2}],
               "recent_incidents": [{"incident_id": "INC-000001", "device": "d"}],
               "timeline_snapshot": [{"timestamp": "2024-01-01", "alerts_count": 1}]}
    p4 = write(os.path.join(tmp_dir, "summary.json"), json.dumps(summary))
    docs = [r["document"] for r in FILES.load_incident_documents(spark, p4).collect()]
    assert len(docs) == 5
    assert any("Anomaly Score: N/A" in d for d in docs)


def test_gold_sinks(spark, tmp_dir):
    from alertforge.plans.analytics import run_analytics
    from alertforge.sources import testdata as TD
    out = run_analytics(spark, TD.canonical_alerts(spark, "/root/testdata/sf0.001"), os.path.join(tmp_dir, "gold"),
                        cluster=False, anomalies=False)
    inc = spark.read.parquet(os.path.join(tmp_dir, "gold", "incidents.parquet"))
    assert inc.count() == out["incidents"].count() > 0
    summ = spark.read.json(os.path.join(tmp_dir, "gold", "incident_summary.json")).collect()[0]
    assert summ["overview"]["total_incidents"] == inc.count()
    assert len(summ["recent_incidents"]) == 5


def test_catalog_tables_are_appended_and_scanned(spark, tmp_dir):
    """Rows appended to a catalog table and to a folder are read back; a missing table is an error."""
    name = f"alerts_{os.path.basename(tmp_dir).replace('-', '_')}"
    spark.sql(f"CREATE TABLE {name} (alert_id STRING, n LONG) USING parquet LOCATION '{tmp_dir}/table'")
    try:
        for i in range(2):
            FILES.append_to(spark.createDataFrame([(f"a{i}", i), (None, None)], "alert_id string, n long"), name)
        got = FILES.read_table(spark, name)
        assert sorted(map(str, got.collect())) == sorted(
            ["Row(alert_id='a0', n=0)", "Row(alert_id='a1', n=1)"] + ["Row(alert_id=None, n=None)"] * 2)
        assert FILES.read_table(spark, name).where("n = 1").select("alert_id").first()[0] == "a1"
        with pytest.raises(Exception):  # another shape does not slip in
            FILES.append_to(spark.createDataFrame([("x",)], "other string"), name)
    finally:
        spark.sql(f"DROP TABLE {name}")
    for _ in range(2):
        FILES.append_to(spark.range(3).withColumnRenamed("id", "n"), f"{tmp_dir}/folder")
    assert spark.read.parquet(f"{tmp_dir}/folder").count() == 6
    with pytest.raises(Exception):
        FILES.read_table(spark, name)
