"""Answer audit, resolution completion, prompts."""
from pyspark.sql import functions as F

from alertforge import schemas as S
from alertforge.operators import answers as ANS

MISS = S.MISSING_INFO_BULLET


def audit(spark, answer, context, question="q"):
    df = spark.createDataFrame([(1, answer, context, question)], "id int, a string, c string, q string")
    return ANS.audit_answers(df, "id", "a", "c", "q").collect()[0]["audited"]


def test_context_only_intent_grounding(spark):
    ans = "preamble\n- Total Alerts: 1,348\n- Intent: alert_count\n- Devices:\n- router-9\n- router-1\n- Organization: Nowhere\n- stray"
    out = audit(spark, ans, "1348 alerts on router-1")
    assert out.split("\n") == ["- Intent: alert_count", "- Total Alerts: 1,348", "- Devices:", MISS, "- router-1", MISS]


def test_blank_and_no_bullets(spark):
    assert audit(spark, "   ", "ctx") == MISS
    assert audit(spark, "no bullets here", "ctx") == MISS


def test_resolution_steps_completed(spark):
    ans = "- Intent: RESOLUTION_STEPS\n- Short-Term Actions (30 min-4 hrs):\n- restart the vpn gateway"
    out = audit(spark, ans, "", question="vpn is down").split("\n")
    assert out[0] == "- Intent: RESOLUTION_STEPS"
    assert out[1] == "- Issue Type: VPN Downtime / Connectivity Failure"
    assert out[2] == "- Immediate Actions (0-30 min):"
    assert out[3:7] == ANS.TRIAGE_FIRST
    i = out.index("- Short-Term Actions (30 min-4 hrs):")
    assert out[i + 1] == "- restart the vpn gateway" and out[i + 2:i + 4] == ANS.DEFAULT_SHORT[:2]
    assert out[-3] == "- Verification & Validation:"


def test_prompt_fallback_and_cut(spark):
    df = spark.createDataFrame([(1, None, "why?"), (2, "ctx", "  "), (3, "x" * 20000, "q")],
                               "id int, c string, q string")
    whole = {r["id"]: r for r in ANS.build_prompts(df, "c", "q").collect()}
    assert 2 not in whole
    assert S.EMPTY_CONTEXT_FALLBACK in whole[1]["prompt"] and "STEP 5" in whole[1]["prompt"]
    assert "x" * 20000 in whole[3]["prompt"] and not whole[3]["prompt_cut"]
    cut = {r["id"]: r for r in ANS.build_prompts(df, "c", "q", drop_examples=True,
                                                 max_chars=S.MAX_PROMPT_CHARS).collect()}
    assert "STEP 5" not in cut[1]["prompt"]
    assert len(cut[3]["prompt"]) <= S.MAX_PROMPT_CHARS and cut[3]["prompt_cut"]


def test_intents(spark):
    df = spark.createDataFrame([("Why did it fail and how to fix?",), ("How many alerts today",), ("hello",)], "q string")
    got = [r[0] for r in df.select(ANS.question_intent(F.col("q"))).collect()]
    assert got == ["ROOT_CAUSE", "ALERT_COUNT", "INCIDENT_SUMMARY"]


def test_recent_incidents_from_context(spark):
    from alertforge.operators.documents import recent_incidents_from_context
    sep = S.CONTEXT_SEPARATOR
    ctx = sep.join([
        "Incident ID: A\nDevice: d1\nTimestamp: 2024-01-01T10:00:00Z",
        "Incident ID: B\nDevice: d2\nAlert Type: cpu\nTimestamp: not a time",
        "Incident ID: C\nTimestamp: 2024-01-02 09:00:00\nSeverity: high",
        "Device: d4",
    ])
    df = spark.createDataFrame([(1, ctx)], "id int, ctx string")
    out = recent_incidents_from_context(df, "id", "ctx", 3).collect()[0]["recent_incidents"]
    assert out.split("\n") == [
        "Recent Incidents (top 3):",
        "1. Incident ID: C | Device: N/A | Alert: N/A | Severity: high | Timestamp: 2024-01-02 09:00:00",
        "2. Incident ID: A | Device: d1 | Alert: N/A | Severity: N/A | Timestamp: 2024-01-01T10:00:00Z",
        "3. Incident ID: B | Device: d2 | Alert: cpu | Severity: N/A | Timestamp: not a time",
    ]


def test_pluggable_encoder(spark):
    import numpy as np
    from alertforge.operators.vectors import pandas_encoder_embed

    def factory():
        return lambda texts: np.array([[len(t), t.count("a")] for t in texts], dtype=float)

    df = spark.createDataFrame([(1, "aaa"), (2, "   "), (3, "bcd")], "id long, text string")
    got = {r["id"]: r["vector"] for r in pandas_encoder_embed(df, "id", "text", factory, batch_size=1).collect()}
    assert sorted(got) == [1, 3]
    assert np.allclose(got[1], [3 / np.sqrt(18), 3 / np.sqrt(18)]) and np.allclose(got[3], [1.0, 0.0])


def test_question_ids_keep_every_turn_apart(spark, tmp_dir):
    from alertforge.plans.registry import question_pairs
    rows = [(1, 1, "user", "q1"), (1, 2, "assistant", "r1"), (1, 1001, "user", "q2"), (1, 1002, "assistant", "r2"),
            (2, 1, "user", "q3"), (2, 2, "assistant", "r3")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(
        f"{tmp_dir}/conversations.parquet")
    got = {r["qid"]: r["context"] for r in question_pairs(spark, tmp_dir).collect()}
    assert got == {"1:1": "r1", "1:1001": "r2", "2:1": "r3"}
