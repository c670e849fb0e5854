"""Exact top-k inner products by a pivot-distance index.

Vectors are quantised to integers. Appending ``sqrt(M - |v|^2)`` to each, with
M the largest squared norm, makes the inner product a falling function of the
Euclidean distance to the query (with 0 appended), so triangle-inequality
bounds apply.

*Index*. Each vector is keyed by its nearest pivot and its distance to it;
pivots are a bounded sample (``PIVOTS`` vectors by a hash of the id), every
vector is indexed. Vectors sorted by (pivot, distance, id) are cut into blocks
of at most ``BLOCK`` rows, so an annulus that holds a third of all rows spans
many blocks. A block is summarised by pivot, distance range and rows.

*Search*. Queries are sorted by their own key and cut into blocks. First every
query searches the index block nearest to its own block, which gives it a
bound: its k-th best score so far. Then each pair of query block and index block is kept only
if for some query the triangle inequality lets the block hold a score as good
as the query's bound; inside a kept pair the block's rows are taken in annuli
of growing distance from the query's own, and the search stops where the bound
rules out all that is left. Results per block meet in a top-k per query.

Pairs of blocks, not of rows, are shuffled, each with bounded contents, and
the exact integer scores decide; bounds carry a slack for rounding.

Defined results: vectors that are null, empty, or hold null or non-finite
components take no part; a query meets vectors of its own length only. Null
ids take no part. Rows that repeat an id are candidates each, but for those
with the query's own id. Ties go to the smaller id. Fewer candidates than k
give fewer rows. An empty table gives none. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertforge.llm.common import freeze

PIVOTS = 32
BLOCK = 2048
QUERY_BLOCK = 512
ANNULUS = 256
SLACK = 1e-6


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding",
              scale: int = 256) -> DataFrame:
    """``(vec_id, v)``: floor(scale * component) of the vectors that take part."""
    e = F.col(embedding).cast("array<double>")
    usable = (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (vectors.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & usable)
            .select(F.col(vec_id).cast("long").alias("vec_id"),
                    F.transform(e, lambda x: F.floor(x * scale).cast("long")).alias("v")))


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of rows: in doubles where they cannot round."""
    peak = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if peak < 2.0 ** 52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _matrix(column) -> np.ndarray:
    return np.array([np.asarray(x, dtype=np.int64) for x in column], dtype=np.int64)


def _lift(v: np.ndarray, top: float) -> np.ndarray:
    """The coordinate that brings every vector to squared norm ``top``."""
    return np.sqrt(np.maximum(top - (v.astype(np.float64) ** 2).sum(axis=1), 0.0))


def keyed(vectors: DataFrame, pivots: dict[int, list[list[int]]], top: dict[int, float]) -> DataFrame:
    """Vectors with ``dims, pivot, dist`` (indexed key) and ``gaps`` (distance of the query form to each pivot)."""
    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dims, part in batch.groupby(batch["v"].map(len)):
                v, p = _matrix(part["v"]), np.array(pivots[dims], dtype=np.int64)
                lp, lv = _lift(p, top[dims]), _lift(v, top[dims])
                dot = _dot(v, p).astype(np.float64)
                apart = np.sqrt(np.maximum(2 * (top[dims] - dot - lv[:, None] * lp[None, :]), 0.0))
                norms = (v.astype(np.float64) ** 2).sum(axis=1)
                gaps = np.sqrt(np.maximum(norms[:, None] + top[dims] - 2 * dot, 0.0))
                best = apart.argmin(axis=1)
                yield pd.DataFrame({"vec_id": part["vec_id"].to_numpy(), "qkey": part["qkey"].to_numpy(), "v": list(v), "dims": dims,
                                    "pivot": best, "dist": apart[np.arange(len(v)), best], "gaps": list(gaps)})

    return vectors.mapInPandas(
        assign, "vec_id long, qkey long, v array<long>, dims int, pivot int, dist double, gaps array<double>")


def _blocks(rows: DataFrame, size: int, out: str) -> DataFrame:
    """Number runs of ``size`` rows in order of (dims, pivot, dist, vec_id).

    The range partition and sort are written once; a block is a run inside one
    sorted partition, so no number depends on another task.
    """
    keys = ["dims", "pivot", "dist", "vec_id"]
    parts = max(1, math.ceil(rows.count() / (8 * size)))
    ordered = freeze(rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
                     .withColumn("_row", F.monotonically_increasing_id()), "topk-sorted")
    # the row id holds partition and position; blocks never mix dims or pivots
    run = F.floor(F.col("_row") / size)
    return ordered.withColumn(out, F.concat_ws(":", run, "dims", "pivot")).drop("_row")


def _slack(x: Column) -> Column:
    return x * (1 + SLACK) + SLACK


def _search(scores_of: int):
    """Search one (query block, index block) pair; ``scores_of`` is k."""
    def run(key, q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        out = {"qkey": [], "query_id": [], "vec_id": [], "score": []}
        if len(q) and len(x):
            x = x.sort_values(["dist", "vec_id"], kind="stable")
            qv, xv = _matrix(q["v"]), _matrix(x["v"])
            qid, xid, dist = q["vec_id"].to_numpy(), x["vec_id"].to_numpy(), x["dist"].to_numpy()
            pivot, norm = int(x["pivot"].iloc[0]), (qv.astype(np.float64) ** 2).sum(axis=1)
            gap = np.array([g[pivot] for g in q["gaps"]])
            bound = q["bound"].to_numpy(dtype=np.float64, na_value=-np.inf)
            top = x["top"].iloc[0]
            best_s = np.full((len(q), scores_of), np.iinfo(np.int64).min)
            best_i = np.full((len(q), scores_of), np.iinfo(np.int64).max)
            annuli = [(a, min(a + ANNULUS, len(x))) for a in range(0, len(x), ANNULUS)]
            near = np.array([np.maximum(0.0, np.maximum(dist[a] - gap, gap - dist[b - 1])).min() for a, b in annuli])
            for k in np.argsort(near, kind="stable"):  # nearest annulus first
                a, b = annuli[k]
                low = np.maximum(0.0, np.maximum(dist[a] - gap, gap - dist[b - 1]))
                reach = (norm + top - (low * (1 - SLACK)) ** 2) / 2 * (1 + SLACK) + SLACK + np.abs(norm + top) * SLACK
                need = np.maximum(bound, best_s[:, -1].astype(np.float64))
                live = np.flatnonzero(reach >= need)
                if not len(live):
                    continue
                s = _dot(qv[live], xv[a:b])
                own = qid[live][:, None] == xid[a:b][None, :]
                s = np.where(own, np.iinfo(np.int64).min, s)
                ids = np.where(own, np.iinfo(np.int64).max, np.broadcast_to(xid[a:b], s.shape))
                all_s, all_i = np.hstack([best_s[live], s]), np.hstack([best_i[live], ids])
                # ascending by score, then by falling id: the best are last
                order = np.lexsort((-all_i, all_s), axis=1)[:, ::-1][:, :scores_of]
                best_s[live] = np.take_along_axis(all_s, order, axis=1)
                best_i[live] = np.take_along_axis(all_i, order, axis=1)
            found = best_i != np.iinfo(np.int64).max
            out = {"qkey": np.repeat(q["qkey"].to_numpy(), scores_of)[found.ravel()],
                   "query_id": np.repeat(qid, scores_of)[found.ravel()], "vec_id": best_i[found], "score": best_s[found]}
        return pd.DataFrame(out).astype("int64")

    return run


def _best(hits: DataFrame, k: int) -> DataFrame:
    """The k best per query row: an aggregate over at most k rows per (query row, block)."""
    ranked = F.row_number().over(Window.partitionBy("qkey").orderBy(F.col("score").desc(), "vec_id"))
    return hits.withColumn("rank", ranked.cast("int")).where(F.col("rank") <= k)


def _meet(asked: DataFrame, index: DataFrame, pairs: DataFrame):
    """Queries (with qblock, block) and index rows, co-grouped by pair of blocks."""
    wanted = pairs.select(F.col("qblock").alias("_q"), F.col("block").alias("_x"))
    rows = (index.join(wanted, F.col("block") == F.col("_x"))
            .select("_q", "_x", *[F.col(c).alias(c) for c in ("vec_id", "v", "pivot", "dist", "top")]))
    left = asked.select(F.col("qblock").alias("_qq"), F.col("block").alias("_qx"),
                        *[F.col(c).alias(c) for c in ("vec_id", "qkey", "v", "gaps", "bound")])
    return left.groupBy("_qq", "_qx").cogroup(rows.groupBy("_q", "_x"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score`` for quantised ``vectors`` and ``queries`` (vec_id, v)."""
    hits = "qkey long, query_id long, vec_id long, score long"
    vectors = freeze(vectors.withColumn("dims", F.size("v")), "topk-vectors")
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    top = {r["dims"]: float(r["top"]) for r in vectors.groupBy("dims").agg(F.max(norm).alias("top")).collect()}
    pivots: dict[int, list[list[int]]] = {}
    for dims in top:  # one bounded sample per vector length
        sample = (vectors.where(F.col("dims") == dims).select("v").distinct()
                  .orderBy(F.xxhash64(F.lit(3), "v")).limit(PIVOTS).collect())
        pivots[dims] = [list(r["v"]) for r in sample]
    if not top:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    tops = F.create_map(*[F.lit(x) for d, t in top.items() for x in (d, t)])

    index = freeze(_blocks(keyed(vectors.select("vec_id", F.lit(0).cast("long").alias("qkey"), "v"), pivots, top)
                           .drop("gaps", "qkey"), block, "block")
                   .withColumn("top", tops[F.col("dims")]), "topk-index")
    # rows that share a vec_id are queries of their own
    asked = freeze(queries.where(F.size("v").isin(list(top))).select("vec_id", F.monotonically_increasing_id().alias("qkey"), "v"),
                   "topk-asked")
    q = freeze(_blocks(keyed(asked, pivots, top), QUERY_BLOCK, "qblock"), "topk-queries")

    rings = index.groupBy("block", "dims", "pivot").agg(F.min("dist").alias("lo"), F.max("dist").alias("hi"))
    # home of a query block: the block of its own pivot whose ring is nearest to its middle
    middle = q.groupBy("qblock", "dims", "pivot").agg(F.avg("dist").alias("dist"))
    miss = F.greatest(F.lit(0.0), F.col("lo") - F.col("dist"), F.col("dist") - F.col("hi"))
    home = (middle.join(rings, ["dims", "pivot"]).groupBy("qblock")
            .agg(F.min_by("block", F.struct(miss, "block")).alias("block")))
    home = freeze(home, "topk-home")
    first = q.join(home, "qblock").withColumn("bound", F.lit(None).cast("double"))
    seed = freeze(_meet(first, index, home).applyInPandas(_search(k), hits), "topk-seed")
    bound = (_best(seed, k).groupBy("qkey").agg(F.min("score").alias("_s"), F.count(F.lit(1)).alias("_n"))
             .select("qkey", F.when(F.col("_n") >= k, F.col("_s")).cast("double").alias("bound")))
    q = freeze(q.join(bound, "qkey", "left"), "topk-bounded")

    # a query block's reach per pivot: the range of its queries' distances and its weakest bound
    reach = (q.select("qblock", "dims", F.posexplode("gaps").alias("pivot", "gap"), "bound",
                      F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")).alias("n"))
             .withColumn("far", F.sqrt(F.greatest(F.lit(0.0), _slack(
                 F.col("n") + tops[F.col("dims")] - 2 * F.coalesce("bound", F.lit(-1e300))) + SLACK)))
             .groupBy("qblock", "dims", "pivot")
             .agg(F.min(F.col("gap") - F.col("far")).alias("least"), F.max(F.col("gap") + F.col("far")).alias("most")))
    pairs = (reach.join(rings, ["dims", "pivot"])
             .where((_slack(F.col("hi")) >= F.col("least") - SLACK) & (F.col("lo") <= _slack(F.col("most"))))
             .select("qblock", "block"))
    pairs = freeze(pairs, "topk-pairs")
    rest = _meet(q.join(pairs, "qblock"), index, pairs).applyInPandas(_search(k), hits)
    return _best(rest, k).select("query_id", "rank", "vec_id", "score")
