"""Importance resampling of documents towards a target distribution.

Hashed word n-grams of all documents and of all target texts give two bucket
histograms; a document's weight is the mean log ratio of the two over its own
features, and documents are drawn without replacement by weight plus Gumbel
noise from a hash of their id (the top of a noisy score is such a draw).

Everything per word is an Arrow kernel or a numpy segment operation:
``ascii_lower``, ``split_pattern_regex``, ``list_flatten`` and
``dictionary_encode`` turn a slice of texts into dictionary indices; an n-gram
is the index of its first n-1 words paired with the index shifted by n-1, and
CRC-32 runs once per distinct pair, continuing from the CRC of the shorter
n-gram; gains are taken by bucket and summed over each document's segment.

One pass counts buckets (a task returns at most one row per bucket), one pass
scores. Gains are one number per bucket, a table bounded by the parameter
``n_buckets``. Scores are whole numbers within a range that the logarithms
bound, so the cut comes from a histogram; only rows at or above it are
range-sorted to get their rank.

Defined results: null text has no words; a document without features weighs 0.
A null doc_id draws its noise from the empty id and comes last among ties; rows
equal in score and doc_id take neighbouring ranks in any order. Empty documents
or an empty target give gains from the smoothing alone. Extra columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertforge.llm.arrowwords import byte_slices, coded_words
from alertforge.llm.common import freeze
from alertforge.operators.ordinals import ordinals_by_range

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
N_BUCKETS = 10_000
SCALE = 1000


def feature_buckets(text: pa.Array, n_gram: int, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket) of every feature of a slice of texts, and the words per row."""
    row, word, dictionary = coded_words(text, SEPARATORS)
    raw = [w.encode() for w in dictionary.to_pylist()]
    crc = np.array([zlib.crc32(w) for w in raw], dtype=np.int64)
    rows, buckets = [row], [crc[word] % n_buckets if len(word) else word]
    gram, gram_crc = word, crc
    for k in range(1, n_gram):
        if len(row) <= k:
            break
        inside = row[k:] == row[:len(row) - k]
        pairs, gram = np.unique(gram[:len(row) - k] * len(raw) + word[k:], return_inverse=True)
        head, last = np.divmod(pairs, len(raw))
        gram_crc = np.array([zlib.crc32(b" " + raw[b], a) for a, b in zip(gram_crc[head].tolist(), last.tolist())], dtype=np.int64)
        rows.append(row[k:][inside])
        buckets.append(gram_crc[gram[inside]] % n_buckets)
    return np.concatenate(rows), np.concatenate(buckets), np.bincount(row, minlength=len(text))


def _count(n_gram: int, n_buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, dtype=np.int64)
        for batch in batches:
            for part in byte_slices(batch, "text"):
                _, bucket, _ = feature_buckets(part.column("text"), n_gram, n_buckets)
                total += np.bincount(bucket, minlength=n_buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["bucket", "n"])
    return run


def bucket_counts(texts: DataFrame, n_gram: int = 1, n_buckets: int = N_BUCKETS) -> DataFrame:
    """``(bucket, n)``: features of all texts per bucket; buckets without any are absent."""
    return (texts.select(F.col("text").cast("string").alias("text"))
            .mapInArrow(_count(n_gram, n_buckets), "bucket long, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")))


def bucket_gains(docs: DataFrame, target: DataFrame, n_gram: int = 1, n_buckets: int = N_BUCKETS) -> np.ndarray:
    """Gain of each bucket: ``floor(1000 ln(((t+1)(S+B)) / ((s+1)(T+B))))``; ``n_buckets`` numbers, whatever the data."""
    def of(texts: DataFrame, name: str) -> DataFrame:
        return bucket_counts(texts, n_gram, n_buckets).withColumnRenamed("n", name)

    counts = (docs.sparkSession.range(n_buckets).withColumnRenamed("id", "bucket")
              .join(of(docs, "s"), "bucket", "left").join(of(target, "t"), "bucket", "left").fillna(0))
    # one row per bucket: a window over all of them is bounded by the parameter
    whole = Window.partitionBy()
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    ratio = ((t + 1) * (F.sum("s").over(whole) + n_buckets)) / ((s + 1) * (F.sum("t").over(whole) + n_buckets))
    rows = counts.select("bucket", F.floor(SCALE * F.log(ratio)).cast("long").alias("gain")).collect()
    gains = np.zeros(n_buckets, dtype=np.int64)
    for r in rows:
        gains[r["bucket"]] = r["gain"]
    return gains


def _weigh(gains: np.ndarray, n_gram: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text"):
                row, bucket, n_words = feature_buckets(part.column("text"), n_gram, len(gains))
                by_row = np.argsort(row, kind="stable")
                ends = np.cumsum(np.bincount(row, minlength=part.num_rows))
                sums = np.concatenate([[0], np.cumsum(gains[bucket[by_row]])])[np.concatenate([[0], ends])]
                n = np.diff(np.concatenate([[0], ends]))
                weight = np.where(n > 0, np.diff(sums) // np.maximum(n, 1), 0)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n_words.astype(np.int64)), pa.array(n.astype(np.int64)),
                     pa.array(weight.astype(np.int64))], names=["doc_id", "n_words", "n_features", "weight"])
    return run


def importance_weights(docs: DataFrame, target: DataFrame, n_gram: int = 1, n_buckets: int = N_BUCKETS) -> DataFrame:
    """``(doc_id, n_words, n_features, weight)`` per row of ``docs``."""
    gains = bucket_gains(docs, target, n_gram, n_buckets)
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(_weigh(gains, n_gram), "doc_id long, n_words long, n_features long, weight long"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, seed: int = 2024,
             n_gram: int = 1, n_buckets: int = N_BUCKETS) -> DataFrame:
    """``(doc_id, n_words, n_features, weight, score, rank)`` per row; rank is null for rows not drawn.

    Of the N rows with at least ``min_words`` words, floor(percent * N / 100) are drawn.
    """
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-SCALE * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    scored = freeze(importance_weights(docs, target, n_gram, n_buckets)
                    .withColumns({"score": F.col("weight") + noise, "_row": F.monotonically_increasing_id()}), "scored")
    eligible = F.col("n_words") >= min_words
    # scores are whole numbers between bounds set by the logarithms: this table does not grow with the rows
    per_score = scored.where(eligible).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    above = Window.orderBy(F.col("score").desc())
    reach = per_score.select("score", F.sum("n").over(above).alias("_upto"),
                             F.floor(F.sum("n").over(Window.partitionBy()) * percent / F.lit(100)).alias("_drawn"))
    cut = reach.where("_upto >= _drawn").orderBy(F.col("score").desc()).first()
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    if cut is None or not cut["_drawn"]:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    near = eligible & (F.col("score") >= cut["score"])
    order = {"_low": -F.col("score"), "_unnamed": F.col("doc_id").isNull()}
    ranked = ordinals_by_range(scored.where(near).withColumns(order), ["_low", "_unnamed", "doc_id", "_row"], "_place")
    drawn = ranked.select(*columns, F.when(F.col("_place") <= cut["_drawn"], F.col("_place")).alias("rank"))
    return drawn.unionByName(scored.where(~near).select(*columns, F.lit(None).cast("long").alias("rank")))
