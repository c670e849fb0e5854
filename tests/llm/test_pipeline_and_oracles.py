"""Registered queries against their SQL, and the pipeline against its parts."""
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.join(ROOT, "tools"))
sys.path.insert(0, ROOT)

import corpus_pipeline  # noqa: E402
from alertforge.llm.oracles import LLM_ORACLES  # noqa: E402
from alertforge.llm.queries import LLM_QUERIES  # noqa: E402
from compare import compare, duck  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_query_matches_sql(spark, name):
    ok, msg = compare(spark, name, SF, duck(SF))
    assert ok, msg


def test_every_operator_is_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in LLM_QUERIES if k != "pipeline") == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "personal_data", "mix_sources", "pack"]


def test_pipeline_stage_by_stage(spark, tmp_dir):
    from alertforge.llm import mixing, neardup, quality
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, before, SF).write.parquet(f"{tmp_dir}/{name}")
        after = spark.read.parquet(f"{tmp_dir}/{name}")
        if name != "pack":
            assert after.columns == columns
        if name == "quality_rules":
            want = quality.quality_columns(before).where("kept").count()
        elif name == "near_dedup":
            want = neardup.near_duplicate_classes(before).select("class_id").distinct().count()
        elif name == "personal_data":
            want = before.count()
            assert after.where("text rlike '[a-z0-9]@[a-z0-9]+[.][a-z]'").count() == 0
        elif name == "mix_sources":
            want = mixing.mix_plan(before).selectExpr("sum(copies * n_rows)").first()[0]
        else:
            want = None
            tokens = {r.doc_id: r for r in after.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "first"}).collect()}
            times = {r.doc_id: r["count"] for r in before.groupBy("doc_id").count().collect()}
            assert set(tokens) == set(times)
            assert all(r["sum(length)"] == r["first(doc_tokens)"] * times[d] for d, r in tokens.items())
        assert want is None or after.count() == want, name
        before = after


def test_mix_targets_match_sql(spark):
    from alertforge.llm.oracles import OP5_TARGETS
    got = sorted(tuple(r)[:4] for r in LLM_QUERIES["op5_curriculum_mix"](spark, SF).collect())
    want = sorted(duck(SF).execute(OP5_TARGETS).fetchall())
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(g[3] == pytest.approx(w[3]) for g, w in zip(got, want))
