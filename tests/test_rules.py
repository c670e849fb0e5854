"""Literal-row checks of the single rules (FIXTURES.md section 4)."""
import datetime as dt

from pyspark.sql import functions as F

from alertforge.functions import alerts as AF
from alertforge.functions.text import py_title
from alertforge.operators import answers as ANS
from alertforge.operators import gold as GOLD
from alertforge.operators import incidents as INC
from alertforge.operators import vectors as VEC

ALERT_SCHEMA = ("alert_id string, source string, timestamp timestamp, organization string, device string, "
                "entity_type string, alert_type string, severity string, status string, description string, "
                "cause string")


def alerts(spark, rows):
    return spark.createDataFrame(rows, ALERT_SCHEMA)


def ts(s):
    return dt.datetime.fromisoformat(s)


def test_mode_tie_takes_smallest_and_all_null_is_unknown(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (1, "b"), (2, None), (2, None)], "k int, v string")
    got = dict((r[0], r[1]) for r in df.groupBy("k").agg(AF.mode_or_unknown("v")).collect())
    assert got == {1: "a", 2: "unknown"}


def test_window_edge_splits(spark):
    a = alerts(spark, [
        ("1", "s", ts("2024-01-01 00:04:59.999"), "o", "d", "e", "t", "low", "open", "x", None),
        ("2", "s", ts("2024-01-01 00:05:00"), "o", "d", "e", "t", "low", "open", "x", None)])
    incidents, mapping = INC.build_incidents(a, "5min")
    assert incidents.count() == 2
    assert sorted(r[0] for r in incidents.select("incident_id").collect()) == ["INC-000001", "INC-000002"]


def test_severity_weights(spark):
    df = spark.createDataFrame([(" CRITICAL ",), ("info",), ("emergency",), (None,)], "severity string")
    got = [r[0] for r in df.select(AF.severity_weight(AF.clean_severity("severity"))).collect()]
    assert got == [4.0, 1.0, 1.0, 1.0]
    assert [r[0] for r in df.select(AF.clean_severity("severity")).collect()][3] == "none"


def test_silver_severity_and_state(spark):
    df = spark.createDataFrame([("Failed", "OK"), ("warning", "Cleared"), ("Emergency", "down"), (None, None)],
                               "sev string, st string")
    got = [(r[0], r[1]) for r in df.select(AF.silver_severity("sev"), AF.silver_event_state("st")).collect()]
    assert got == [("HIGH", "resolved"), ("MEDIUM", "resolved"), ("LOW", "triggered"), ("LOW", "triggered")]


def test_incident_type_first_rule_wins(spark):
    df = spark.createDataFrame([("disk", "down"), ("download", "x"), ("a", "b")], "t string, d string")
    got = [r[0] for r in df.select(AF.incident_type("t", "d")).collect()]
    assert got == ["resource", "availability", "other"]


def test_frequency_of_single_alert(spark):
    a = alerts(spark, [("1", "s", ts("2024-01-01 00:00:00"), "o", "d", "e", "t", "low", "open", "x", "c")])
    r = INC.engineer_alert_features(a).collect()[0]
    assert r["alert_frequency"] == 60.0 and r["time_since_prev_alert_min"] == 0.0 and r["alerts_per_device"] == 1


def test_time_since_previous_crosses_buckets(spark):
    a = alerts(spark, [
        ("1", "s", ts("2024-01-01 23:59:00"), "o", "d", "e", "t", "low", "open", "x", "c"),
        ("2", "s", ts("2024-01-02 00:01:00"), "o", "d", "e", "t", "low", "open", "x", "c"),
        ("3", "s", ts("2024-01-05 00:01:00"), "o", "d", "e", "t", "low", "open", "x", "c")])
    got = {r["alert_id"]: r["time_since_prev_alert_min"] for r in INC.engineer_alert_features(a).collect()}
    assert got == {"1": 0.0, "2": 2.0, "3": 3 * 24 * 60.0}


def test_reliability_extremes(spark):
    m = spark.createDataFrame([("a", "o", 10, 5, 3), ("b", "o", 0, 0, 0)],
                              "device string, organization string, total_alerts long, critical_alerts long, "
                              "incidents_count long")
    got = {r["device"]: r["reliability_score"] for r in GOLD.compute_reliability_scores(m).collect()}
    assert got == {"a": 0.0, "b": 100.0}
    z = spark.createDataFrame([("z", "o", 0, 0, 0)], m.schema)
    assert GOLD.compute_reliability_scores(z).collect()[0]["reliability_score"] == 100.0


def test_timeline_outer_join_fills_zero(spark):
    a = alerts(spark, [("1", "s", ts("2024-01-01 00:00:00"), "o", "d", "e", "t", "low", "open", "x", "c")])
    inc = spark.createDataFrame([("INC-1", ts("2024-01-01 01:00:00"), 1)],
                                "incident_id string, start_time timestamp, critical_alert_count long")
    got = sorted(GOLD.build_incident_timeline_gold(a, inc, "5min").collect())
    assert [tuple(r) for r in got] == [(ts("2024-01-01 00:00:00"), 1, 0, 0), (ts("2024-01-01 01:00:00"), 0, 1, 1)]


def test_null_alert_type_dropped_in_stats(spark):
    df = spark.createDataFrame([("1", None, "d", 1.0), ("2", "x", "d", 2.0)],
                               "alert_id string, alert_type string, device string, severity_weight double")
    assert [r[0] for r in GOLD.build_alert_stats_gold(df).collect()] == ["x"]


def test_title_case_like_python(spark):
    words = ["o'neil_x", "abc-def_x", "a1b_c2d", "élan_vital"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = [r[0] for r in df.select(py_title(F.regexp_replace("w", "_", " "))).collect()]
    assert got == [w.replace("_", " ").title() for w in words]


def test_grounding(spark):
    df = spark.createDataFrame([("1,348", "1348 alerts"), ("router down", "The Router  DOWN now"),
                                ("42 items", "nothing"), ("", "x")], "v string, c string")
    got = [r[0] for r in df.select(ANS.is_grounded(F.col("v"), F.col("c"))).collect()]
    assert got == [True, True, False, False]


def test_zero_vector_unchanged(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<double>")
    got = [r[0] for r in VEC.with_unit_vector(df, "v", "u").select("u").collect()]
    assert got == [[0.0, 0.0], [0.6, 0.8]]


def test_missing_required_columns(spark):
    import pytest
    df = spark.createDataFrame([("1",)], "alert_id string")
    with pytest.raises(ValueError):
        INC.normalize_alerts(df)
