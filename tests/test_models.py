"""DBSCAN against a sequential brute force; isolation forest properties."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from alertforge.operators import dbscan, ml
from alertforge.operators.graph import connected_components
from alertforge.operators.iforest import isolation_forest


def brute_force_dbscan(points, eps, min_samples):
    """Sequential DBSCAN (visiting order = row order)."""
    d2 = ((points[:, None, :] - points[None, :, :]) ** 2).sum(-1)
    neigh = [np.nonzero(d2[i] <= eps * eps)[0] for i in range(len(points))]
    core = np.array([len(x) >= min_samples for x in neigh])
    labels = np.full(len(points), -1)
    label = 0
    for i in range(len(points)):
        if labels[i] != -1 or not core[i]:
            continue
        stack = [i]
        labels[i] = label
        while stack:
            p = stack.pop()
            if not core[p]:
                continue
            for q in neigh[p]:
                if labels[q] == -1:
                    labels[q] = label
                    stack.append(q)
        label += 1
    return labels


def run_dbscan(spark, pts, eps, min_samples, **options):
    pdf = pd.DataFrame({"o": np.arange(len(pts), dtype=np.int64)})
    for j in range(pts.shape[1]):
        pdf[f"f{j}"] = pts[:, j]
    df = spark.createDataFrame(pdf)
    out = ml.dbscan(df, "o", [f"f{j}" for j in range(pts.shape[1])], eps, min_samples, **options)
    got = out.select("o", "cluster").toPandas().sort_values("o")
    return got["cluster"].to_numpy()


def test_two_groups_and_noise(spark):
    pts = np.array([[0, 0], [0, 0.1], [0.1, 0], [5, 5], [5, 5.1], [5.1, 5], [20, 20]], dtype=float)
    assert list(run_dbscan(spark, pts, 0.5, 2)) == [0, 0, 0, 1, 1, 1, -1]


def test_border_takes_lower_cluster(spark):
    # cores at both ends, a border point (not core at min_samples=3) reachable from both
    pts = np.array([[0.0], [0.1], [0.2], [1.0], [1.8], [1.9], [2.0]])
    bf = brute_force_dbscan(pts, 0.8, 3)
    assert list(run_dbscan(spark, pts, 0.8, 3)) == list(bf)
    assert bf[3] == 0


def test_matches_brute_force_with_ties_and_blocks(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(150, 3)).round(1)
    pts = np.vstack([base, base[:40]])  # exact duplicates
    pts = pts[rng.permutation(len(pts))]
    bf = brute_force_dbscan(pts, 0.5, 3)
    assert list(run_dbscan(spark, pts, 0.5, 3, block_rows=17)) == list(bf)


@pytest.mark.parametrize("dims,n,scale,eps,min_samples", [
    (1, 300, 30.0, 0.2, 4), (2, 400, 3.0, 0.3, 5), (3, 400, 1.5, 0.5, 6), (4, 250, 1.0, 0.7, 3), (6, 250, 0.6, 0.8, 3)])
def test_matches_brute_force_in_any_dimension(spark, dims, n, scale, eps, min_samples):
    rng = np.random.default_rng(dims)
    pts = np.vstack([rng.normal(0, scale, (n, dims)), rng.normal(3, 0.1, (60, dims)), np.full((20, dims), 1.0), -np.zeros((2, dims))])
    pts = pts[rng.permutation(len(pts))]
    want = brute_force_dbscan(pts, eps, min_samples)
    assert len(set(want)) > 2
    assert list(run_dbscan(spark, pts, eps, min_samples, block_rows=13, small_pair=1)) == list(want)


def test_dense_cells_that_only_nearly_touch(spark, monkeypatch):
    """Facing sheets a hair above and below eps apart: boxes and extremes decide neither, sub-cells must."""
    monkeypatch.setattr(dbscan, "_directions", lambda dims: [[1] + [0] * (dims - 1)])
    rng = np.random.default_rng(2)
    eps = 1.0
    for gap, clusters in ((1.0005, 2), (0.9995, 1)):
        y = rng.uniform(0, 0.6, (400, 2))
        # bent sheets: their boxes overlap in reach, only few of their points face each other closely
        left = np.column_stack([-0.3 * (y[:, 0] - 0.3) ** 2, y])
        right = np.column_stack([gap + 0.3 * (y[:, 0] - 0.3) ** 2, y])
        pts = np.vstack([left, right])
        want = brute_force_dbscan(pts, eps, 3)
        assert len(set(want)) == clusters
        assert list(run_dbscan(spark, pts, eps, 3, small_pair=50)) == list(want)


def test_one_ball_of_many_points_makes_few_pairs(spark):
    """200,000 points in one ball: probes and compared pairs grow with the points, not with their square."""
    ball = spark.range(200_000).select(
        F.col("id").alias("o"), *[(F.rand(7 + i) * 0.9).alias(f"f{i}") for i in range(3)]).checkpoint()
    out = ml.dbscan(ball, "o", ["f0", "f1", "f2"], 0.9, 3)
    assert [tuple(r) for r in out.groupBy("cluster").count().collect()] == [(0, 200_000)]
    x = [f"x{i}" for i in range(3)]
    side = 0.9 / 3 ** 0.5 * dbscan.SHRINK
    pts = ball.select(F.col("o").alias("pid"), F.lit(1).alias("w"), *[F.col(f"f{i}").alias(f"x{i}") for i in range(3)],
                      F.array(*[F.floor(F.col(f"f{i}") / side) for i in range(3)]).alias("cell"))
    cells = pts.groupBy("cell").agg(F.min("pid").alias("cid"), F.count(F.lit(1)).alias("n"), *dbscan._boxes(3)) \
        .withColumns({"dense": F.col("n") >= 3, "chunks": F.lit(1).cast("long")}).drop("n")
    pts = pts.join(cells.select("cell", "cid", "dense"), "cell").withColumn("chunk", F.lit(0).cast("long"))
    near = dbscan._neighbours(cells, 3, 0.9)
    assert near.count() <= 8 * 27 and dbscan._probe(pts, cells, near, 3, 0.9).count() == 0
    assert not [c for c in x if c not in pts.columns]


def test_components_of_chains_and_stars(spark):
    rng = np.random.default_rng(4)
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    rest = [(int(a), int(b)) for a, b in rng.integers(2000, 2200, (120, 2))] + [(5000, 5000)]
    links = chain + star + rest + chain[:5]
    got = dict(map(tuple, connected_components(spark.createDataFrame(links, "a long, b long")).collect()))
    parent = {v: v for e in links for v in e}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {v: find(v) for v in parent}


def test_label_invariant_to_row_shuffle(spark):
    rng = np.random.default_rng(3)
    pts = rng.normal(size=(120, 2))
    a = run_dbscan(spark, pts, 0.3, 3)
    perm = rng.permutation(len(pts))
    b = run_dbscan(spark, pts[perm], 0.3, 3)
    # same partition of points into clusters (labels may be renumbered)
    pa = {tuple(sorted(np.nonzero(a == k)[0])) for k in set(a) if k != -1}
    inv = np.argsort(perm)
    b_orig = b[inv]
    pb = {tuple(sorted(np.nonzero(b_orig == k)[0])) for k in set(b_orig) if k != -1}
    assert pa == pb


def test_isolation_forest_properties(spark):
    rng = np.random.default_rng(1)
    rows = [(f"d{i}", float(x), float(y)) for i, (x, y) in enumerate(rng.normal(10, 1, size=(99, 2)))]
    rows.append(("outlier", 100.0, -100.0))
    df = spark.createDataFrame(rows, "k string, a double, b double")
    out = isolation_forest(df, "k", ["a", "b"], contamination=0.1, seed=42).toPandas()
    assert out.sort_values("anomaly_score").iloc[0]["k"] == "outlier"
    assert 8 <= out["is_anomalous"].sum() <= 12
    again = isolation_forest(df, "k", ["a", "b"], contamination=0.1, seed=42).toPandas()
    assert np.allclose(out.sort_values("k")["anomaly_score"], again.sort_values("k")["anomaly_score"])


def test_category_codes(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",), ("a",)], "s string")
    got = [r[0] for r in ml.category_codes(df, ["s"]).orderBy(F.asc_nulls_first("s")).select("s_code").collect()]
    assert got == [-1, 0, 0, 1, 2]


def test_scaled_inputs_keep_every_label(spark):
    """Scaled features come from aggregates; labels must still reach every row."""
    from alertforge.operators import incidents as INC
    from alertforge.sources import testdata as TD
    inc, _ = INC.build_incidents(TD.canonical_alerts(spark, "/root/testdata/sf0.001"), "5min")
    out = ml.cluster_incidents(inc)
    assert out.where(F.col("cluster_id").isNull()).count() == 0
    assert out.count() == inc.count()
