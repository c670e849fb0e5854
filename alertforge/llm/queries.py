"""One query per operator, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from alertforge.llm.common import prepare, table

Query = Callable[[SparkSession, str], DataFrame]
LLM_QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    """Register ``fn`` under its own name."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return fn(spark, sf_dir)
    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    LLM_QUERIES[fn.__name__] = run
    return run


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality counts and verdict of every document."""
    from alertforge.llm.quality import BASE_METRICS, quality_columns
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_columns(docs).select("doc_id", *BASE_METRICS, "base_failed", "kept")


@query
def op10_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents dealt uniformly to 40 shards of exact size; ``stretch``-wise slots."""
    from alertforge.llm.common import text_of
    from alertforge.llm.sharding import hypergeometric_shuffle
    text = text_of("text")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return hypergeometric_shuffle(rows, n_shards=40, seed=20).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query
def op5_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words each document gives to the mix, in order of first training position."""
    from alertforge.llm.mixing import mix_plan
    plan = mix_plan(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    rows = plan.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"),
        "positions", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows"))).alias("_copy")).drop("_copy")
    first = F.coalesce(F.get("positions", F.lit(0)), F.lit(2.0))
    return (rows.withColumn("_first", first).repartitionByRange("_first", "doc_id")
            .sortWithinPartitions("_first", "doc_id").drop("_first"))


@query
def op8_elias_fano_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, written and read back."""
    from alertforge.llm.common import work_path
    from alertforge.llm.tokenfiles import read_documents, write_token_files
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return read_documents(write_token_files(docs, work_path(spark, "token-files")))


@query
def op3_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document, with its sequence."""
    from alertforge.llm.packing import pack_documents
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack_documents(docs).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


@query
def op4_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, from archives written and read back.

    Responses are read with payload, which checks the stored digest against it;
    revisits are found by a pushed filter and read by their headers.
    """
    from alertforge.llm.common import work_path
    from alertforge.llm.warc import archive_pages, read_archives
    path = work_path(spark, "warc")
    archive_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)

    def page(column: str):
        return F.regexp_extract(column, ":(-?[0-9]+)>$", 1)

    def records(kind: str, payload: bool) -> DataFrame:
        return read_archives(spark, path, payload).where(F.col("record_type") == kind)

    both = (records("response", True).withColumn("payload_bytes", F.octet_length("payload").cast("long")).drop("payload")
            .unionByName(records("revisit", False).drop("payload")))
    return both.select(
        F.when(page("record_id") != "", page("record_id")).cast("long").alias("page_id"),
        "payload_bytes", "payload_digest", "record_type",
        F.when(F.col("refers_to").isNotNull(), page("refers_to")).cast("long").alias("refers_to"), "target_uri")


@query
def op1_probminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    from alertforge.llm.neardup import near_duplicate_classes
    classes = near_duplicate_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return classes.select("doc_id", "class_id")


@query
def op6_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; rows with remainder 2 are never fitted on."""
    from alertforge.llm.toxicity import fit_on, score_documents

    def remainder():
        return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_on(docs, table(spark, sf_dir, "labels").where(remainder() != 2))
    return score_documents(docs, model).select(
        "doc_id", F.coalesce(remainder() == 2, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"), "spans")


@query
def op7_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts and digest of the base spans, all spans."""
    from alertforge.llm.pii import KINDS, fit_searched, searched, span_list, spans_of
    rows = searched(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "base", "_pii_candidates")
    found = spans_of(rows, fit_searched(rows)).select("doc_id", "base", "spans")

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(k) for k in KINDS[:4]],
                        F.sha2(span_list(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        span_list(F.col("spans")).alias("spans"))


@query
def op2_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best inner products of every 50th vector against all others."""
    from alertforge.llm.topk import quantised, top_k
    vectors = quantised(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


@query
def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines found in at least 10 documents go from every document; digests of what stays."""
    from alertforge.llm.common import text_of
    from alertforge.llm.linededup import kept_text, line_keep_bitmaps
    docs = table(spark, sf_dir, "documents").select("doc_id", text_of("text").alias("text"))
    kept = kept_text(F.col("text"), F.col("keep"))
    return line_keep_bitmaps(docs, min_docs=10, min_chars=1).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(kept.cast("binary"), 256).alias("kept_sha256"))


@query
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents, drawn towards the benchmark's word use."""
    from alertforge.llm.importance import resample
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    drawn = resample(docs, table(spark, sf_dir, "benchmark").select("text"), percent=10, min_words=20, seed=2024)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


@query
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far sources of a language differ, and the terms that mark each."""
    from alertforge.llm.divergence import divergence
    return divergence(table(spark, sf_dir, "documents").select("lang", "source", "text"), min_docs=30, top_terms=50)


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline over the documents table."""
    return corpus_pipeline.run(spark, sf_dir)
