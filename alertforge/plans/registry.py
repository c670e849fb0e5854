"""Named queries over the driver's tables: ``name -> (spark, sf_dir) -> DataFrame``.

Each entry wires library operators to the test-data views; all of them read
whole tables. The matching DuckDB SQL lives in ``alertforge.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertforge.operators import answers as ANS
from alertforge.operators import dashboard as DASH
from alertforge.operators import documents as DOC
from alertforge.operators import gold as GOLD
from alertforge.operators import grounding as GROUND
from alertforge.operators import iforest as IF
from alertforge.operators import incidents as INC
from alertforge.operators import ml as ML
from alertforge.operators import ordinals as ORD
from alertforge.operators import reports as REP
from alertforge.operators import silver as SIL
from alertforge.operators import star as STAR
from alertforge.operators import vectors as VEC
from alertforge import schemas as S
from alertforge.session import ensure_checkpoint_dir, store
from alertforge.sources import testdata as TD
from alertforge.streaming import jobs as STREAM

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, QueryFn] = {}


def register(name: str):
    def deco(fn: QueryFn) -> QueryFn:
        REGISTRY[name] = fn
        return fn
    return deco


# --------------------------------------------------------------------------
# alerts and incidents
# --------------------------------------------------------------------------

@register("scan_alerts")
def q_scan_alerts(spark, sf):
    return TD.canonical_alerts(spark, sf)


@register("canonical_alerts")
def q_canonical_alerts(spark, sf):
    return INC.normalize_alerts(TD.canonical_alerts(spark, sf))


@register("incidents")
def q_incidents(spark, sf):
    incidents, _ = INC.build_incidents(TD.canonical_alerts(spark, sf), "5min")
    return INC.build_incidents_gold(incidents)


@register("incidents_6h")
def q_incidents_6h(spark, sf):
    incidents, _ = INC.build_incidents(TD.canonical_alerts(spark, sf), "6 hours")
    return INC.build_incidents_gold(incidents)


# --------------------------------------------------------------------------
# shared analytics core: normalised alerts -> incidents + alert map
# --------------------------------------------------------------------------

def core(spark: SparkSession, sf: str, window: str = "5min"):
    """(incidents, alerts_with_incident) over the whole alert view."""
    return INC.build_incidents(TD.canonical_alerts(spark, sf), window)


def normalized(spark: SparkSession, sf: str):
    """Alerts for counts that use no incident column: no grouping, no join."""
    return INC.normalize_alerts(TD.canonical_alerts(spark, sf))


INCIDENT_FEATURE_COLS = [
    "incident_id", "organization", "device", "alert_count", "severity_score", "critical_alert_count",
    "start_time", "end_time", "duration_minutes", "root_cause_candidate", "incident_cause", "description",
    "incident_type", "incident_duration", "normalized_severity_score", "alerts_per_minute", "open_alert_ratio",
]


@register("alert_incident_map")
def q_alert_incident_map(spark, sf):
    incidents, mapping = core(spark, sf)
    return mapping.join(incidents.select("incident_id", "incident_type"), "incident_id", "left")


@register("alert_features")
def q_alert_features(spark, sf):
    return INC.engineer_alert_features(TD.canonical_alerts(spark, sf))


@register("incident_features")
def q_incident_features(spark, sf):
    incidents, mapping = core(spark, sf)
    return INC.engineer_incident_features(incidents, mapping).select(*INCIDENT_FEATURE_COLS)


@register("device_metrics")
def q_device_metrics(spark, sf):
    incidents, mapping = core(spark, sf)
    return GOLD.build_device_metrics_gold(mapping, incidents)


@register("device_features")
def q_device_features(spark, sf):
    incidents, mapping = core(spark, sf)
    return GOLD.build_device_feature_table(mapping, incidents)


@register("alert_stats")
def q_alert_stats(spark, sf):
    return GOLD.build_alert_stats_gold(normalized(spark, sf))


@register("timeline")
def q_timeline(spark, sf):
    incidents, mapping = core(spark, sf)
    return GOLD.build_incident_timeline_gold(mapping, incidents, "5min")


@register("top_failing_devices")
def q_top_failing_devices(spark, sf):
    incidents, mapping = core(spark, sf)
    return REP.top_failing_devices(mapping, incidents)


@register("alert_types_freq")
def q_alert_types_freq(spark, sf):
    return REP.most_frequent_alert_types(normalized(spark, sf))


@register("severity_distribution")
def q_severity_distribution(spark, sf):
    return REP.severity_distribution(normalized(spark, sf))


@register("incident_trends")
def q_incident_trends(spark, sf):
    incidents, _ = core(spark, sf)
    return REP.incident_frequency_trends(incidents)


@register("failure_patterns")
def q_failure_patterns(spark, sf):
    _, mapping = core(spark, sf)
    return REP.detect_failure_patterns(mapping, 10)


@register("pipeline_metrics")
def q_pipeline_metrics(spark, sf):
    incidents, mapping = core(spark, sf)
    return REP.pipeline_metrics(mapping, incidents)


@register("summary_overview")
def q_summary_overview(spark, sf):
    incidents, mapping = core(spark, sf)
    return REP.summary_overview(INC.build_incidents_gold(incidents),
                                GOLD.build_device_metrics_gold(mapping, incidents))


@register("top_causes")
def q_top_causes(spark, sf):
    incidents, _ = core(spark, sf)
    return REP.value_counts(incidents, "incident_cause", "incident_cause", 5)


@register("top_descriptions")
def q_top_descriptions(spark, sf):
    incidents, _ = core(spark, sf)
    return REP.value_counts(incidents, "description", "incident_description", 5)


@register("alert_contexts")
def q_alert_contexts(spark, sf):
    return REP.alert_contexts(normalized(spark, sf))


@register("recent_alerts")
def q_recent_alerts(spark, sf):
    _, mapping = core(spark, sf)
    return REP.recent_alerts(mapping, 5)


@register("recent_incidents")
def q_recent_incidents(spark, sf):
    incidents, _ = core(spark, sf)
    return REP.recent_incidents(INC.build_incidents_gold(incidents), 5)


@register("timeline_tail")
def q_timeline_tail(spark, sf):
    incidents, mapping = core(spark, sf)
    return REP.timeline_tail(GOLD.build_incident_timeline_gold(mapping, incidents, "5min"), 5)


@register("summary_top_devices")
def q_summary_top_devices(spark, sf):
    incidents, mapping = core(spark, sf)
    return REP.top_devices_by_failure(GOLD.build_device_metrics_gold(mapping, incidents), 5)


# --------------------------------------------------------------------------
# vendor ETL: bronze -> silver -> star schema
# --------------------------------------------------------------------------

def bronze_frames(spark, sf):
    return {
        "meraki": TD.bronze_meraki(spark, sf),
        "auvik": TD.bronze_auvik(spark, sf),
        "ncentral": TD.bronze_ncentral(spark, sf),
    }


def silver(spark, sf):
    return SIL.silver_clean(bronze_frames(spark, sf))


@register("silver_union")
def q_silver_union(spark, sf):
    return SIL.union_vendors(bronze_frames(spark, sf), clean=False)


@register("silver_clean")
def q_silver_clean(spark, sf):
    return silver(spark, sf)


@register("silver_canonical")
def q_silver_canonical(spark, sf):
    return SIL.normalize_silver_schema(silver(spark, sf))


FIRST_LOAD_DAYS = 3


@register("dim_device")
def q_dim_device(spark, sf):
    return STAR.dim_device(silver(spark, sf))


@register("dim_device_incremental")
def q_dim_device_incremental(spark, sf):
    """Two loads: the first days of each month, then everything; keys of the first load stay."""
    ensure_checkpoint_dir(spark)
    s = silver(spark, sf).checkpoint()
    first = STAR.dim_device(s.where(F.dayofmonth("event_time") <= FIRST_LOAD_DAYS)).checkpoint()
    return first.unionByName(STAR.dim_device(s, existing=first))


@register("dim_organization")
def q_dim_organization(spark, sf):
    return STAR.dim_organization(silver(spark, sf))


@register("dim_alert_type")
def q_dim_alert_type(spark, sf):
    return STAR.dim_alert_type(silver(spark, sf))


@register("dim_time")
def q_dim_time(spark, sf):
    return STAR.dim_time(STAR.fact_groups(silver(spark, sf)))


def star(spark, sf):
    ensure_checkpoint_dir(spark)
    s = silver(spark, sf).checkpoint()  # every dimension reads it; nothing stays cached
    devices, orgs, types = STAR.dim_device(s), STAR.dim_organization(s), STAR.dim_alert_type(s)
    times = STAR.dim_time(STAR.fact_groups(s))
    return STAR.fact_incidents(s, devices, orgs, types, times)


@register("fact_incidents")
def q_fact_incidents(spark, sf):
    return star(spark, sf)


@register("tickets")
def q_tickets(spark, sf):
    return STAR.create_tickets(star(spark, sf))


# --------------------------------------------------------------------------
# dashboard
# --------------------------------------------------------------------------
DASH_SELECTED_DEVICES = ["dev-1", "dev-3"]
DASH_FOCUS_DEVICE = "dev-1"


def dashboard(spark, sf):
    return DASH.build_dashboard_model(normalized(spark, sf), lambda: core(spark, sf)[0])


@register("dash_kpis")
def q_dash_kpis(spark, sf):
    return DASH.kpis(dashboard(spark, sf))


@register("dash_kpis_filtered")
def q_dash_kpis_filtered(spark, sf):
    return DASH.kpis(DASH.apply_device_filter(dashboard(spark, sf), DASH_SELECTED_DEVICES))


@register("dash_severity_counts")
def q_dash_severity_counts(spark, sf):
    return DASH.severity_counts(dashboard(spark, sf))


@register("dash_alert_type_counts")
def q_dash_alert_type_counts(spark, sf):
    return DASH.alert_type_counts(dashboard(spark, sf))


@register("dash_alerts_over_time")
def q_dash_alerts_over_time(spark, sf):
    return DASH.alerts_over_time(dashboard(spark, sf))


@register("dash_top_devices")
def q_dash_top_devices(spark, sf):
    return DASH.top_devices(dashboard(spark, sf), 10)


@register("dash_device_filter")
def q_dash_device_filter(spark, sf):
    return DASH.apply_device_filter(dashboard(spark, sf), DASH_SELECTED_DEVICES)["fact_alerts"]


@register("dash_device_alerts")
def q_dash_device_alerts(spark, sf):
    return DASH.device_alerts(dashboard(spark, sf), DASH_FOCUS_DEVICE)


# --------------------------------------------------------------------------
# documents
# --------------------------------------------------------------------------

@register("incident_documents")
def q_incident_documents(spark, sf):
    _, mapping = core(spark, sf)
    return DOC.build_incident_documents(mapping, id_col="alert_id")


def summary_sections(spark, sf):
    incidents, mapping = core(spark, sf)
    gold_inc = INC.build_incidents_gold(incidents)
    devices = GOLD.build_device_metrics_gold(mapping, incidents)
    timeline = GOLD.build_incident_timeline_gold(mapping, incidents, "5min")
    stats = GOLD.build_alert_stats_gold(mapping)
    return {
        "overview": REP.summary_overview(gold_inc, devices),
        "top_devices": REP.top_devices_by_failure(devices, 5),
        "alert_types": stats.orderBy(F.desc("total_count"), "alert_type").limit(5),
        "recent_incidents": REP.recent_incidents(gold_inc, 5),
        "timeline_tail": REP.timeline_tail(timeline, 5),
    }


@register("summary_documents")
def q_summary_documents(spark, sf):
    s = summary_sections(spark, sf)
    return DOC.build_summary_documents(s["overview"], s["top_devices"], s["alert_types"],
                                       s["recent_incidents"], s["timeline_tail"], generated_at="")


# --------------------------------------------------------------------------
# vectors and retrieval
# --------------------------------------------------------------------------

def embedding_points(spark, sf):
    e = TD.table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").cast(VEC.VECTOR).alias("vector"),
                    F.concat(F.lit("Embedding "), F.col("vec_id").cast("string"), F.lit(" with label "),
                             F.col("label").cast("string")).alias("document"),
                    F.lit(0).alias("version"))


def embedding_hits(spark, sf, k=5):
    pts = embedding_points(spark, sf)
    return VEC.cosine_topk(pts.select(F.col("id").alias("qid"), "vector"), pts, k=k, exclude_self=True), pts


@register("vec_normalize")
def q_vec_normalize(spark, sf):
    e = VEC.with_unit_vector(TD.table(spark, sf, "embeddings"), "embedding", "_unit")
    return e.select("vec_id", F.transform("_unit", lambda x: F.round(x, 6)).alias("unit_vector"))


@register("vec_topk")
def q_vec_topk(spark, sf):
    hits, _ = embedding_hits(spark, sf)
    return hits


@register("retrieve_scored")
def q_retrieve_scored(spark, sf):
    hits, pts = embedding_hits(spark, sf)
    return VEC.retrieve_with_scores(hits, pts)


@register("build_context")
def q_build_context(spark, sf):
    hits, pts = embedding_hits(spark, sf)
    return VEC.build_context(VEC.retrieve_with_scores(hits, pts))


@register("vec_info")
def q_vec_info(spark, sf):
    return VEC.collection_info(embedding_points(spark, sf))


@register("vec_upsert")
def q_vec_upsert(spark, sf):
    store = embedding_points(spark, sf)
    e = TD.table(spark, sf, "embeddings")
    incoming_src = VEC.with_unit_vector(e, "embedding", "vector").select(
        "vec_id", "vector", F.concat(F.lit("Updated label "), F.col("label").cast("string")).alias("document"))
    half = e.select((F.count(F.lit(1)) / 2).cast("long")).scalar()
    incoming = VEC.points_from(incoming_src, "vec_id", "vector", "document", start_id=half, version=1)
    merged = VEC.upsert_points(store, incoming)
    return merged.select("id", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"), "document", "version")


def _rounded(df, col="vector"):
    return df.withColumn(col, F.transform(col, lambda x: F.round(x, 6)))


@register("embed_documents")
def q_embed_documents(spark, sf):
    return _rounded(VEC.hashed_tf_embed(TD.table(spark, sf, "documents"), "doc_id", "text", dim=384))


# --------------------------------------------------------------------------
# questions, prompts and answers
# --------------------------------------------------------------------------

def question_pairs(spark, sf):
    """User questions with the next assistant turn of the same conversation as context."""
    conv = TD.table(spark, sf, "conversations")
    q = TD.questions(spark, sf)
    replies = conv.where(F.col("role") == "assistant").select(
        F.concat_ws(":", F.col("conv_id"), F.col("turn") - 1).alias("qid"), F.col("text").alias("context"))
    return q.join(replies, "qid", "left")


def synthetic_answers(spark, sf):
    """Answers in bullet form built from the replies (intent + a count + listed lines)."""
    p = question_pairs(spark, sf)
    reply = F.coalesce(F.col("context"), F.lit(""))
    listed = F.array_join(F.transform(F.split(reply, "\n"), lambda x: F.concat(F.lit("- "), x)), "\n")
    answer = F.concat_ws("\n", F.concat(F.lit("- Intent: "), ANS.question_intent(F.col("question"))),
                         F.concat(F.lit("- Total Alerts: "), F.length(reply).cast("string")),
                         F.lit("- Devices:"), listed)
    return p.withColumn("answer", answer)


@register("build_prompts")
def q_build_prompts(spark, sf):
    p = ANS.build_prompts(question_pairs(spark, sf), "context", "question", )
    return p.select("qid", "prompt")


@register("issue_type")
def q_issue_type(spark, sf):
    return TD.questions(spark, sf).select("qid", ANS.infer_issue_type(F.col("question")).alias("issue_type"))


@register("question_intent")
def q_question_intent(spark, sf):
    return TD.questions(spark, sf).select("qid", ANS.question_intent(F.col("question")).alias("intent"))


def replies(spark, sf):
    return TD.table(spark, sf, "conversations").where(F.col("role") == "assistant").select("conv_id", "turn", "text")


@register("grounding_check")
def q_grounding_check(spark, sf):
    """Lines of the users' turns against all replies of their conversation."""
    values = TD.table(spark, sf, "conversations").where(F.col("role") == "user").select(
        "conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("line_no", "value"))
    return GROUND.grounded_in_turns(values, replies(spark, sf), ["conv_id"], ["turn"]).drop("value")


@register("grounding_excerpts")
def q_grounding_excerpts(spark, sf):
    """Excerpts of the replies, cut inside lines and over the end of a turn, as they are and with a letter changed."""
    turns = replies(spark, sf)
    line, n = F.col("line"), F.length("line")
    lines = turns.select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    middle = F.substring(line, F.floor(n / 4).cast("int") + 1, F.floor(n / 2).cast("int"))
    inside = lines.select("conv_id", "turn", "line_no", F.explode(F.array(
        F.struct(F.lit("middle").alias("kind"), middle.alias("value")),
        F.struct(F.lit("changed").alias("kind"), F.replace(middle, F.lit("e"), F.lit("x")).alias("value")),
        F.struct(F.lit("short").alias("kind"), F.substring(line, 2, 6).alias("value")))).alias("v")).select(
            "conv_id", "turn", "line_no", "v.*")
    following = turns.select("conv_id", (F.col("turn") - 2).alias("turn"), F.substring("text", 1, 12).alias("_opens"))
    across = turns.join(following, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.lit(0).alias("line_no"), F.lit("across").alias("kind"),
        F.concat_ws(" ", F.substring(F.col("text"), -12, 12), F.col("_opens")).alias("value"))
    return GROUND.grounded_in_turns(inside.unionByName(across), turns, ["conv_id"], ["turn"]).drop("value")


@register("answer_intent")
def q_answer_intent(spark, sf):
    return synthetic_answers(spark, sf).select("qid", ANS.extract_intent(F.col("answer")).alias("intent"))


@register("answer_audit")
def q_answer_audit(spark, sf):
    return ANS.audit_answers(synthetic_answers(spark, sf), "qid", "answer", "context", "question")


@register("context_recent")
def q_context_recent(spark, sf):
    """Questions -> top-5 incident documents -> newest incidents named in the context."""
    _, mapping = core(spark, sf)
    # stored: tokens, points and the summaries' joins read them again, nothing is built or searched twice
    docs = store(DOC.build_incident_documents(mapping.withColumn("_doc_id", F.col("alert_id").cast("long")),
                                              id_col="_doc_id"), "incident-documents")
    points = VEC.embedded_points(docs, "_doc_id", "document", dim=384)
    q_vecs = VEC.embed_queries(TD.questions(spark, sf), "qid", "question", dim=384)
    contexts = VEC.build_context(VEC.retrieve_with_scores(VEC.cosine_topk(q_vecs, points, k=5, points_stored=True), points))
    return DOC.recent_incidents_from_context(store(contexts, "contexts"), "qid", "context", 3)


# --------------------------------------------------------------------------
# models: scaling, category codes, DBSCAN, isolation forest
# --------------------------------------------------------------------------

@register("incident_scaled")
def q_incident_scaled(spark, sf):
    incidents, _ = core(spark, sf)
    z = ML.incident_scaled(incidents)
    return z.select("incident_id", *[F.round(c + "_z", 6).alias(c + "_z") for c in ML.INCIDENT_FEATURES])


@register("alert_cluster_features")
def q_alert_cluster_features(spark, sf):
    _, mapping = core(spark, sf)
    return ML.alert_cluster_features(mapping).select("alert_id", *ML.ALERT_FEATURES)


@register("incident_clusters")
def q_incident_clusters(spark, sf):
    incidents, _ = core(spark, sf)
    return ML.cluster_incidents(INC.build_incidents_gold(incidents)).select(
        "incident_id", "cluster_id", "is_noise_cluster")


@register("alert_map_clustered")
def q_alert_map_clustered(spark, sf):
    """Every alert with its incident's type and cluster."""
    incidents, mapping = core(spark, sf)
    clustered = ML.cluster_incidents(INC.build_incidents_gold(incidents))
    return mapping.join(clustered.select("incident_id", "incident_type", "cluster_id"), "incident_id", "left")


@register("pipeline_metrics_clustered")
def q_pipeline_metrics_clustered(spark, sf):
    """D16 with the share of alerts that lie in a cluster."""
    incidents, mapping = core(spark, sf)
    ordered = ORD.ordinals_by_range(mapping, ["timestamp", "alert_id"], "_order")
    return REP.pipeline_metrics(mapping, incidents, ML.cluster_alerts(ordered, "_order"))


@register("cluster_summary")
def q_cluster_summary(spark, sf):
    incidents, _ = core(spark, sf)
    return REP.summarize_clusters(ML.cluster_incidents(INC.build_incidents_gold(incidents)))


@register("alert_clusters")
def q_alert_clusters(spark, sf):
    _, mapping = core(spark, sf)
    ordered = ORD.ordinals_by_range(mapping, ["timestamp", "alert_id"], "_order")
    return ML.cluster_alerts(ordered, "_order").select("alert_id", "alert_cluster")


@register("device_anomalies")
def q_device_anomalies(spark, sf):
    incidents, mapping = core(spark, sf)
    devices = GOLD.build_device_metrics_gold(mapping, incidents)
    keyed = devices.withColumn("_key", F.concat_ws("|", "organization", "device"))
    return IF.isolation_forest(keyed, "_key", S.ANOMALY_FEATURES, contamination=0.1, seed=42).drop("_key")


# --------------------------------------------------------------------------
# streaming (run with availableNow over the whole table; sinks read back)
# --------------------------------------------------------------------------

def alert_stream(spark, sf):
    return TD.canonical_alert_view(STREAM.read_table_stream(spark, sf, "events"))


@register("stream_silver")
def q_stream_silver(spark, sf):
    return STREAM.run_available(STREAM.silver_stream(STREAM.read_table_stream(spark, sf, "events")), "silver")


@register("stream_dedupe")
def q_stream_dedupe(spark, sf):
    silver = STREAM.silver_stream(STREAM.read_table_stream(spark, sf, "events"))
    out = STREAM.run_available(STREAM.dedupe_stream(silver), "dedupe")
    return out.select(*S.SILVER_DEDUPE_KEYS)


@register("stream_keep_first")
def q_stream_keep_first(spark, sf):
    """K2 by the batch rule: whole rows, equal to ``silver_clean``."""
    silver = STREAM.silver_stream(STREAM.read_table_stream(spark, sf, "events"))
    return STREAM.run_to_end(silver, "event_time", STREAM.keep_first_stream, "keep-first")


@register("stream_incidents_complete")
def q_stream_incidents_complete(spark, sf):
    """K3 with late rows kept aside and open windows flushed: every incident."""
    return STREAM.run_windows(alert_stream(spark, sf), STREAM.incidents_of, name="incidents-all")[0]


@register("stream_timeline_complete")
def q_stream_timeline_complete(spark, sf):
    """K4 to the last bucket."""
    return STREAM.run_windows(alert_stream(spark, sf), STREAM.timeline_of, name="timeline-all")[0]


@register("stream_incidents")
def q_stream_incidents(spark, sf):
    return STREAM.run_available(STREAM.incidents_stream(alert_stream(spark, sf)), "incidents")


@register("stream_timeline")
def q_stream_timeline(spark, sf):
    return STREAM.run_available(STREAM.timeline_stream(alert_stream(spark, sf)), "timeline")


@register("stream_escalation")
def q_stream_escalation(spark, sf):
    return STREAM.run_available(STREAM.escalation_stream(alert_stream(spark, sf)), "escalation")


@register("stream_tickets")
def q_stream_tickets(spark, sf):
    return STREAM.run_ticket_sink(alert_stream(spark, sf))


# --------------------------------------------------------------------------
# copilot chain over whole tables: questions -> embed -> top-k -> context -> prompt
# --------------------------------------------------------------------------

def copilot(spark, sf, k=5, dim=384):
    docs = TD.table(spark, sf, "documents")
    points = VEC.embedded_points(docs, "doc_id", "text", dim=dim)
    q = TD.questions(spark, sf)
    q_vecs = VEC.embed_queries(q, "qid", "question", dim=dim)
    hits = VEC.cosine_topk(q_vecs, points, k=k, points_stored=True)
    contexts = VEC.build_context(VEC.retrieve_with_scores(hits, points))
    return q.join(contexts, "qid", "left")


@register("embed_questions")
def q_embed_questions(spark, sf):
    return _rounded(VEC.embed_queries(TD.questions(spark, sf), "qid", "question", dim=384))


@register("copilot_prompts")
def q_copilot_prompts(spark, sf):
    return ANS.build_prompts(copilot(spark, sf), "context", "question").select("qid", "prompt")
