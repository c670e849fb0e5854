"""Isolation forest (Liu, Ting, Zhou 2008) as Spark jobs (I4).

* sampling: row r belongs to tree t's sample when its hash rank for t is
  among the ``max_samples`` smallest; candidates are pre-filtered by a hash
  threshold, so rows are not replicated per tree;
* growing: ``groupBy(tree).applyInPandas`` builds each tree from its sample
  (at most ``max_samples`` rows per task) with a per-tree seeded generator;
* scoring: the forest (trees x at most 2*max_samples nodes, a bound that
  does not grow with the data) is broadcast and rows are scored in
  ``mapInPandas``; the threshold is the exact ``percentile`` of the scores.

Results are deterministic for a seed and independent of partitioning.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertforge.operators.ordinals import ordinals_by_range
from alertforge.session import ensure_checkpoint_dir

EULER_GAMMA = 0.5772156649015329


def _c(n: np.ndarray | float) -> np.ndarray:
    """Average path length of an unsuccessful BST search over n points."""
    n = np.asarray(n, dtype=np.float64)
    out = np.zeros_like(n)
    big = n > 2
    out[n == 2] = 1.0
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER_GAMMA) - 2.0 * (n[big] - 1.0) / n[big]
    return out


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> dict:
    """Array-encoded tree: feature, threshold, left, right, size (leaf: feature -1)."""
    feat, thr, left, right, size = [], [], [], [], []

    def node(idx: np.ndarray, depth: int) -> int:
        me = len(feat)
        feat.append(-1)
        thr.append(0.0)
        left.append(-1)
        right.append(-1)
        size.append(int(len(idx)))
        if depth >= limit or len(idx) <= 1:
            return me
        sub = x[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        usable = np.nonzero(hi > lo)[0]
        if len(usable) == 0:
            return me
        f = int(rng.choice(usable))
        t = float(rng.uniform(lo[f], hi[f]))
        mask = sub[:, f] < t
        feat[me] = f
        thr[me] = t
        left[me] = node(idx[mask], depth + 1)
        right[me] = node(idx[~mask], depth + 1)
        return me

    node(np.arange(len(x)), 0)
    return {"f": feat, "t": thr, "l": left, "r": right, "n": size}


def _path_lengths(tree: dict, x: np.ndarray) -> np.ndarray:
    f = np.asarray(tree["f"])
    t = np.asarray(tree["t"])
    lft = np.asarray(tree["l"])
    rgt = np.asarray(tree["r"])
    n = np.asarray(tree["n"])
    cur = np.zeros(len(x), dtype=np.int64)
    depth = np.zeros(len(x), dtype=np.float64)
    active = f[cur] >= 0
    while active.any():
        idx = np.nonzero(active)[0]
        go_left = x[idx, f[cur[idx]]] < t[cur[idx]]
        cur[idx] = np.where(go_left, lft[cur[idx]], rgt[cur[idx]])
        depth[idx] += 1.0
        active = f[cur] >= 0
    return depth + _c(n[cur])


def isolation_forest(df: DataFrame, key_col: str, feature_cols: list[str], n_trees: int = 100,
                     max_samples: int = 256, contamination: float = 0.1, seed: int = 42) -> DataFrame:
    """Adds ``anomaly_score`` (higher = more normal; 0 at the threshold) and
    ``is_anomalous`` (1 for the ``contamination`` share with the lowest scores)."""
    spark = df.sparkSession
    feats = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in feature_cols])
    ensure_checkpoint_dir(spark)
    # sampled, checked and scored: the input must not be computed each time
    data = df.withColumn("_x", feats).checkpoint(eager=True)
    n = data.count()
    if n == 0:
        return df.withColumn("anomaly_score", F.lit(None).cast("double")).withColumn("is_anomalous", F.lit(None).cast("int"))
    psi = min(max_samples, n)
    limit = int(math.ceil(math.log2(max(psi, 2))))
    # hash u in [0, 1) per (row, tree); keep u below a generous threshold, then the psi smallest
    frac = min(1.0, 4.0 * psi / n + 64.0 / n)
    u = lambda t: F.pmod(F.xxhash64(F.col(key_col).cast("string"), t, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    w = Window.partitionBy("tree").orderBy("_u", key_col)
    while True:
        cand = data.select(
            key_col, "_x",
            F.explode(F.filter(F.sequence(F.lit(0), F.lit(n_trees - 1)), lambda t: u(t) < frac)).alias("tree"))
        cand = cand.withColumn("_u", u(F.col("tree")))
        sample = cand.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= psi)
        # a tree whose hash threshold let fewer than psi rows through: widen and redo
        short = sample.groupBy("tree").count().where(F.col("count") < psi).limit(1).count()
        trees = sample.select("tree").distinct().count()
        if (not short and trees == n_trees) or frac >= 1.0:
            break
        frac = min(1.0, frac * 2.0)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree_id = int(pdf["tree"].iloc[0])
        pdf = pdf.sort_values("_rk")
        x = np.vstack(pdf["_x"].to_numpy()).astype(np.float64)
        rng = np.random.default_rng([seed, tree_id])
        return pd.DataFrame({"tree": [tree_id], "model": [json.dumps(_grow(x, rng, limit))]})

    models = sample.groupBy("tree").applyInPandas(grow, "tree long, model string").collect()
    forest = [json.loads(r["model"]) for r in sorted(models, key=lambda r: r["tree"])]
    bc = spark.sparkContext.broadcast(forest)
    denom = float(_c(np.array([psi]))[0]) or 1.0

    def score(batches):
        trees = bc.value
        for pdf in batches:
            if pdf.empty:
                yield pdf.assign(_score=pd.Series(dtype="float64"))
                continue
            x = np.vstack(pdf["_x"].to_numpy()).astype(np.float64)
            mean_len = np.mean([_path_lengths(t, x) for t in trees], axis=0)
            yield pdf.assign(_score=-np.power(2.0, -mean_len / denom))

    schema = T.StructType(list(data.schema.fields) + [T.StructField("_score", T.DoubleType())])
    # scores are read twice (threshold, output): keep them instead of re-scoring
    scored = data.mapInPandas(score, schema).checkpoint(eager=True)
    # the interpolated percentile from the two scores around it, found by exact rank
    place = (n - 1) * float(contamination)
    low, high = math.floor(place) + 1, math.ceil(place) + 1
    ranked = ordinals_by_range(scored.select("_score"), ["_score"], "_rank")
    at = {r["_rank"]: r["_score"] for r in ranked.where(F.col("_rank").isin(low, high)).collect()}
    threshold = F.lit(at[low] + (at[high] - at[low]) * (place - math.floor(place)))
    return (scored.withColumn("anomaly_score", F.col("_score") - threshold)
            .withColumn("is_anomalous", (F.col("anomaly_score") < 0).cast("int"))
            .drop("_x", "_score"))
