"""Plan checks: no row-wise Python, no cartesian products, hot keys split."""
import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from alertforge.operators import incidents as INC
from alertforge.operators import silver as SIL

SF = "/root/testdata/sf0.001"
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython")
NATIVE = ["incidents", "alert_features", "device_metrics", "timeline", "silver_clean", "fact_incidents",
          "incident_documents", "summary_documents", "build_prompts", "grounding_check", "embed_documents",
          "dash_kpis", "failure_patterns", "vec_upsert"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NATIVE)
def test_native_queries_stay_in_the_jvm(spark, name):
    p = plan(E.queries()[name](spark, SF))
    for bad in FORBIDDEN:
        assert bad not in p, f"{name} plan has {bad}"
    assert "MapInPandas" not in p and "FlatMapGroupsInPandas" not in p


def test_python_only_where_intended(spark):
    p = plan(E.queries()["vec_topk"](spark, SF))
    assert "MapInArrow" in p and "FlatMapCoGroupsInPandas" not in p  # few queries: points stay where they lie
    for bad in FORBIDDEN:
        assert bad not in p


def test_documents_are_embedded_once(spark, monkeypatch):
    from alertforge.operators import vectors as VEC
    seen = []
    monkeypatch.setattr(VEC, "store", lambda df, name, keep=VEC.store: seen.append(plan(df)) or keep(df, name))
    p = plan(E.queries()["copilot_prompts"](spark, SF))
    assert "regexp_extract_all" not in p.lower()  # the search reads stored points and checkpointed queries
    assert len(seen) == 1 and seen[0].lower().count("generate explode(regexp_extract_all") == 1
    # retrieval reads the documents only, not the vectors
    assert "ReadSchema: struct<id:bigint,document:string>" in p


@pytest.mark.parametrize("k,exclude_self", [(1, False), (7, True), (50, False)])
def test_topk_by_stream_and_by_blocks_equals_brute_force(spark, k, exclude_self):
    import numpy as np

    from alertforge.operators import vectors as VEC
    rng = np.random.default_rng(k)
    m = np.vstack([rng.normal(size=(60, 6)).round(1), np.zeros((2, 6)), np.ones((30, 6))])  # ties and zero vectors
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, vector array<double>").repartition(5)
    queries = points.where("id % 4 = 0").withColumnRenamed("id", "qid")
    unit = np.linalg.norm(m, axis=1)
    unit[unit == 0] = 1.0
    scores = np.round((m @ m.T) / np.outer(unit, unit), 6)
    want = []
    for i in range(0, len(m), 4):
        order = sorted((j for j in range(len(m)) if not (exclude_self and i == j)), key=lambda j: (-scores[i, j], j))[:k]
        want += [(i, r, j, scores[i, j]) for r, j in enumerate(order, 1)]
    for size in (VEC.BROADCAST_BYTES, 0):
        got = VEC.cosine_topk(queries, points, k, exclude_self=exclude_self, block_rows=7, broadcast_bytes=size)
        assert sorted(map(tuple, got.collect())) == sorted(want)
    assert VEC.cosine_topk(queries.limit(0), points, k).count() == 0


def test_many_queries_shuffle_no_vectors(spark):
    import numpy as np

    from alertforge.operators import vectors as VEC
    rng = np.random.default_rng(3)
    m = rng.normal(size=(9000, 8))
    m[4000:4400] = m[0]  # equal scores
    m[17] = np.inf  # takes part in no result
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, vector array<double>").coalesce(1)
    queries = points.where("id < 40").withColumnRenamed("id", "qid")
    got = VEC.cosine_topk(queries, points, 6, block_rows=20, broadcast_bytes=0)
    p = plan(got)
    assert "CartesianProduct" in p and "FlatMapCoGroupsInPandas" not in p
    assert p.count("Exchange") == 1  # the winners, once
    ok = np.delete(np.arange(9000), 17)
    want = []
    for i in [i for i in range(40) if i != 17]:
        scores = np.round((m[ok] @ m[i]) / (np.linalg.norm(m[ok], axis=1) * np.linalg.norm(m[i])), 6)
        want += [(i, r, int(ok[j]), scores[j]) for r, j in enumerate(np.lexsort((ok, -scores))[:6], 1)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_embedding_shuffles_counts_once(spark):
    import hashlib
    import re

    import numpy as np

    from alertforge.operators import vectors as VEC
    rows = [(1, "a b a"), (None, "Straße x"), (2, None), (1, "b c 1"), (3, " ,"), (None, "x y")] + [(9, "w%d w1" % i) for i in range(5000)]
    out = VEC.hashed_tf_embed(spark.createDataFrame(rows, "id long, text string").repartition(6), "id", "text", dim=16)
    assert plan(out).count("Exchange hashpartitioning") == 1
    want = {}
    for i, t in rows:
        for w in re.findall(r"[a-zß0-9]+", (t or "").lower()):
            want.setdefault(i, np.zeros(16))[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 16] += 1
    got = {r.id: r.vector for r in out.collect()}
    assert set(got) == set(want)
    for i, v in want.items():
        assert got[i] == (v / np.sqrt((v * v).sum())).tolist()


def test_filters_and_columns_reach_the_scan(spark):
    df = E.queries()["dash_device_alerts"](spark, SF)
    scan = [line for line in df._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in line]
    assert scan and all("props" not in s for s in scan)  # unused column pruned


def test_keep_first_is_an_aggregate(spark):
    spark.catalog.clearCache()
    p = plan(E.queries()["silver_clean"](spark, SF))
    ops = [line.strip(" :+-") for line in p.split("\n")]
    assert not any(op.startswith("Window ") for op in ops)
    assert any(op.startswith(("HashAggregate", "ObjectHashAggregate", "SortAggregate")) for op in ops)


def test_device_lag_window_is_bucketed(spark):
    p = plan(E.queries()["alert_features"](spark, SF))
    windows = [line for line in p.split("\n") if line.strip().startswith(("Window", "+- Window", ":- Window"))
               or " Window [" in line]
    assert windows and all("_bucket" in w for w in windows if "lag(" in w)


def _skewed_alerts(spark, n=3000):
    base = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        dev = "hot" if i % 3 == 0 else f"d{i % 50}"
        rows.append((str(i), "s", base + dt.timedelta(seconds=37 * i), "o", dev, "e",
                     ["cpu", "disk", "link"][i % 3], ["critical", "low", None][i % 3],
                     "open" if i % 2 else "resolved", "x", None if i % 5 == 0 else "c"))
    schema = ("alert_id string, source string, timestamp timestamp, organization string, device string, "
              "entity_type string, alert_type string, severity string, status string, description string, cause string")
    return spark.createDataFrame(rows, schema), pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])


def test_hot_device_results_match_pandas(spark):
    df, pdf = _skewed_alerts(spark)
    feats = {r["alert_id"]: r for r in INC.engineer_alert_features(df, bucket="1 hour").collect()}
    pdf = pdf.sort_values(["timestamp", "alert_id"])
    prev = pdf.groupby(["organization", "device"])["timestamp"].diff().dt.total_seconds().div(60).fillna(0)
    for aid, expected in zip(pdf["alert_id"], prev):
        assert abs(feats[aid]["time_since_prev_alert_min"] - expected) < 1e-9
    counts = pdf.groupby("device")["alert_id"].count()
    assert feats["0"]["alerts_per_device"] == counts["hot"] == 1000
    incidents, mapping = INC.build_incidents(df, "5min")
    assert mapping.where(F.col("incident_id").isNull()).count() == 0
    assert incidents.agg(F.sum("alert_count")).first()[0] == len(pdf)
    ids = sorted(r[0] for r in incidents.select("incident_id").collect())
    assert ids == [f"INC-{i:06d}" for i in range(1, len(ids) + 1)]


@pytest.mark.parametrize("split_rows", [1, 40, 500])
def test_lag_of_a_hot_device_over_many_tasks(spark, split_rows):
    df, pdf = _skewed_alerts(spark)
    df = df.unionByName(df.where("alert_id % 100 = 0").withColumn("alert_id", F.concat("alert_id", F.lit("x"))))  # ties
    got = {r["alert_id"]: r["time_since_prev_alert_min"]
           for r in INC.engineer_alert_features(df, bucket="1 day", split_rows=split_rows).collect()}
    rows = df.toPandas().sort_values(["timestamp", "alert_id"])
    want = rows.groupby(["organization", "device"])["timestamp"].diff().dt.total_seconds().div(60).fillna(0)
    assert len(got) == len(rows)
    for aid, expected in zip(rows["alert_id"], want):
        assert abs(got[aid] - expected) < 1e-9


def test_hot_bucket_is_spread_over_ranges(spark):
    """A device with a third of all rows fills about a third of the ranges, none holds it whole."""
    df, _ = _skewed_alerts(spark)
    rows = INC.normalize_alerts(df).withColumn("_bucket", F.lit(0))
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        ranged = rows.repartitionByRange(12, "organization", "device", "_bucket", "timestamp", "alert_id")
        per_range = ranged.where("device = 'hot'").groupBy(F.spark_partition_id()).count().collect()
        lagged = INC._lag_over_tasks(rows, ["organization", "device", "_bucket"])
        assert lagged.where("device = 'hot' and _prev is null").count() == 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert len(per_range) >= 4 and max(r["count"] for r in per_range) <= 400


DASH_VIEWS = ["dash_kpis", "dash_severity_counts", "dash_alert_type_counts", "dash_alerts_over_time", "dash_top_devices"]


@pytest.mark.parametrize("name", DASH_VIEWS)
def test_dashboard_views_read_the_cube_only(spark, monkeypatch, name):
    """Counts never touch the alerts; the cube is one scan and one shuffle of them, whatever the view."""
    from alertforge.operators import dashboard as DASH
    stored = []
    monkeypatch.setattr(DASH, "store", lambda df, what, keep=DASH.store: stored.append(plan(df)) or keep(df, what))
    p = plan(E.queries()[name](spark, SF))
    assert "events.parquet" not in p
    assert len(stored) == 1 and stored[0].count("FileScan") == 1 and stored[0].count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("window", ["5min", "1 hour", "6 hours", "7min"])
def test_cube_counts_incidents_of_any_window(spark, window):
    from alertforge.operators import dashboard as DASH
    df, _ = _skewed_alerts(spark)
    incidents, mapping = INC.build_incidents(df, window)
    model = DASH.build_dashboard_model(INC.normalize_alerts(df), lambda: incidents, window)
    got = DASH.kpis(model).first()
    assert (got["total_alerts"], got["incidents"]) == (mapping.count(), incidents.count())
    summary = {r["device_name"]: r["incidents_count"] for r in model["device_alert_summary"].collect()}
    assert summary == {r["device"]: r["count"] for r in incidents.groupBy("device").count().collect()}
    few = DASH.apply_device_filter(model, ["hot", "d1"])
    assert DASH.kpis(few).first()["total_devices"] == 2
    assert few["fact_alerts"].count() == mapping.where("device in ('hot', 'd1')").count()
    assert few["incidents"].count() == incidents.where("device in ('hot', 'd1')").count()
    assert DASH.device_alerts(few, "d2").count() == 0


def test_duplicate_storm_keep_first(spark):
    rows = [("meraki", f"a{i:05d}", "c", "o", "dev", "id", "svc", "t", "LOW", "triggered",
             dt.datetime(2024, 1, 1), False, dt.datetime(2024, 1, 1, 0, 0, i % 60)) for i in range(5000)]
    df = spark.createDataFrame(rows, "source_system string, alert_id string, correlation_id string, "
                                     "organization_name string, device_name string, device_identifier string, "
                                     "service_name string, alert_type string, severity string, event_state string, "
                                     "event_time timestamp, synthetic boolean, ingestion_time timestamp")
    out = SIL.keep_first(df, ["correlation_id", "device_name", "alert_type", "event_state", "event_time"],
                         [SIL.source_rank(), F.col("ingestion_time"), F.col("alert_id")]).collect()
    assert len(out) == 1 and out[0]["alert_id"] == "a00000"


def test_context_recent_searches_once_and_builds_documents_once(spark, monkeypatch):
    from alertforge.operators import vectors as VEC
    from alertforge.plans import registry as R
    seen = []
    for module in (R, VEC):
        monkeypatch.setattr(module, "store", lambda df, name, keep=VEC.store: seen.append((name, plan(df))) or keep(df, name))
    p = plan(E.queries()["context_recent"](spark, SF))
    assert "MapInArrow" not in p and "CartesianProduct" not in p  # the summaries read stored contexts, they do not search again
    names = [name for name, _ in seen]
    assert names == ["incident-documents", "points", "contexts"]
    assert "Incident ID: " not in seen[1][1]  # tokens and points read stored documents
    assert dict(seen)["contexts"].count("MapInArrow") == 1


def _meets(queries, own, k, parts):
    from alertforge.operators import vectors as VEC
    heap = VEC._Heap(queries, own, k)
    for ids, points, counts in parts:
        heap.add(ids, points, counts)
    q, ids, scores = heap.best()
    return sorted(zip(q.tolist(), ids.tolist(), scores.tolist()))


def _brute_force(queries, own, k, ids, points):
    import numpy as np
    norm = lambda m: np.where((n := np.linalg.norm(m, axis=1)) == 0, 1.0, n)
    scores = np.round((queries @ points.T) / np.outer(norm(queries), norm(points)), 6)
    want = []
    for i, row in enumerate(scores):
        order = [j for j in np.lexsort((ids, -row)) if own is None or ids[j] != own[i]][:k]
        want += [(i, int(ids[j]), float(row[j])) for j in order]
    return sorted(want)


@pytest.mark.parametrize("most,as_counts,exclude_self", [(3, True, False), (3, False, True), (40, True, True), (5000, False, False)])
def test_search_by_whole_numbers_equals_brute_force(monkeypatch, most, as_counts, exclude_self):
    """Points of all sizes and shapes: terms that all share, ties, copies, rows that are no counts."""
    import numpy as np

    from alertforge.operators import vectors as VEC
    monkeypatch.setattr(VEC, "QUERY_TILE", 64)
    monkeypatch.setattr(VEC, "POINT_TILE", 300)
    monkeypatch.setattr(VEC, "LIKE", 40)
    used = []
    found = VEC._Heap._by_whole_numbers
    monkeypatch.setattr(VEC._Heap, "_by_whole_numbers", lambda self, q, t: used.append(r := found(self, q, t)) or r)
    rng = np.random.default_rng(most)
    dim = 24
    counts = np.where(rng.random((3000, dim)) < 0.3, rng.integers(1, most + 1, (3000, dim)), 0).astype(np.float32)
    counts[:, 0] += 2  # a term of all
    counts[500:900] = counts[:400]  # ties
    counts[900:950] *= 7
    points = VEC._unit_counts(counts)
    asked = VEC._unit_counts(np.where(rng.random((150, dim)) < 0.4, rng.integers(1, 4, (150, dim)), 0) + np.eye(150, dim))
    if not as_counts:
        points[1000:1100] = rng.normal(size=(100, dim))
        points[1100:1110] = 0
        asked[:20] = rng.random((20, dim))
    ids = rng.permutation(3000).astype(np.int64)
    own = ids[:150].copy() if exclude_self else None
    if exclude_self:
        asked[50:100] = points[50:100]
    cuts = [slice(0, 7), slice(7, 1200), slice(1200, 3000)]
    got = _meets(asked, own, 5, [(ids[c], None, counts[c]) if as_counts else (ids[c], points[c], None) for c in cuts])
    want = _brute_force(asked, own, 5, ids, points)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert np.allclose([x[2] for x in got], [x[2] for x in want], atol=1.5e-6, rtol=0)
    assert any(x is not None for x in used)


def test_products_of_whole_numbers_at_the_ends_of_their_fields():
    """The largest product of all, which no field may lose, against bars just at it and just below."""
    import numpy as np

    from alertforge.operators import vectors as VEC
    for size in (1, 2, 3, 7, 8, 31, 100):
        counts = np.ones((600, 4), np.float32)
        counts[:, 1] = np.arange(600) % 5 == 0
        counts[::3] *= size
        asked = VEC._unit_counts(np.array([[1, 1, 1, 1], [size, 0, 1, 0], [0, 1, 0, 0]]))
        ids = np.arange(600)[::-1].copy()
        got = _meets(asked, None, 3, [(ids, None, counts)])
        want = _brute_force(asked, None, 3, ids, VEC._unit_counts(counts))
        assert [x[:2] for x in got] == [x[:2] for x in want]
