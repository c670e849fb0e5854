"""Exact distributed DBSCAN on cells whose points are all neighbours of each other.

Same labels as the sequential algorithm with points visited in ``order``:
clusters are numbered by their first core point, a border point joins the
lowest-numbered cluster it touches, the rest is noise (-1).

Equal vectors collapse into one weighted point, and points fall into cells of
side ``eps / sqrt(d)``: two points of a cell are never more than ``eps`` apart.

* A cell of weight ``min_samples`` or more (*dense*) needs no distance: all its
  points are core, all in one cluster. It is one node.
* Any other cell (*sparse*) holds fewer than ``min_samples`` points. Those
  points alone are probed, each against the points of the occupied cells around
  it. A dense cell has a bounded number of sparse points around it, so all
  probes together grow with the points, not with the square of a dense region.
  They tell which sparse points are core, and every link of a sparse cell.
* Two dense cells are linked if any pair of their points lies within ``eps``.
  Bounding boxes decide most pairs (all near, or none), then a fixed number of
  extreme points per cell. Only pairs that still lie in different components
  are examined further: their points are cut into ever smaller sub-cells, whose
  boxes decide again, until what is left of a pair is small enough to compare.

Everything is a join or an aggregate on scalar columns (no Python workers).
Large cells are salted into chunks, so no task holds a whole cell. Tables that
are used twice are cut with reliable checkpoints.
"""

from __future__ import annotations

import itertools
import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertforge.operators.graph import connected_components
from alertforge.operators.ordinals import ordinals_by_range
from alertforge.session import ensure_checkpoint_dir

# dimensions whose coarse cells are enumerated around a cell; the others are filtered by boxes
JOINED_DIMENSIONS = 3
# cells are a trifle smaller than eps / sqrt(d): rounding cannot push two of their points beyond eps
SHRINK = 1.0 - 1e-6
SLACK = 1.0 + 1e-9


def _total(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def _squared(p: str, q: str, dims: int) -> Column:
    return _total([(F.col(f"{p}{i}") - F.col(f"{q}{i}")) * (F.col(f"{p}{i}") - F.col(f"{q}{i}")) for i in range(dims)])


def _gap(dims: int, a: str = "a_", b: str = "b_") -> Column:
    """Squared distance of the boxes ``lo``/``hi`` of two sides."""
    gaps = [F.greatest(F.col(f"{a}lo{i}") - F.col(f"{b}hi{i}"), F.col(f"{b}lo{i}") - F.col(f"{a}hi{i}"), F.lit(0.0))
            for i in range(dims)]
    return _total([g * g for g in gaps])


def _span(dims: int, a: str = "a_", b: str = "b_") -> Column:
    """Squared distance of the farthest corners of the boxes of two sides."""
    spans = [F.greatest(F.col(f"{a}hi{i}") - F.col(f"{b}lo{i}"), F.col(f"{b}hi{i}") - F.col(f"{a}lo{i}")) for i in range(dims)]
    return _total([s * s for s in spans])


def _renamed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])


def _boxes(dims: int) -> list[Column]:
    return ([F.min(f"x{i}").alias(f"lo{i}") for i in range(dims)] + [F.max(f"x{i}").alias(f"hi{i}") for i in range(dims)])


def _neighbours(cells: DataFrame, dims: int, eps: float) -> DataFrame:
    """``(a_*, b_*)`` of occupied cells whose boxes lie within ``eps``, each unordered pair once, a cell with itself too.

    Cells meet by the coarse cells (side at least ``eps``) of the dimensions
    that tell most cells apart.
    """
    reach = math.ceil(math.sqrt(dims) / SHRINK)
    coarse = cells.withColumns({f"_k{i}": F.floor(F.col("cell")[i] / reach) for i in range(dims)})
    spread = coarse.agg(*[F.approx_count_distinct(f"_k{i}").alias(str(i)) for i in range(dims)]).first()
    used = sorted(range(dims), key=lambda i: -spread[str(i)])[:JOINED_DIMENSIONS]
    around = F.array(*[F.struct(*[F.lit(o).alias(f"o{i}") for i, o in zip(used, offsets)])
                       for offsets in itertools.product((-1, 0, 1), repeat=len(used))])
    left = _renamed(coarse, "a_").withColumn("_o", F.explode(around))
    for i in used:
        left = left.withColumn(f"b__k{i}", F.col(f"a__k{i}") + F.col(f"_o.o{i}"))
    right = _renamed(coarse, "b_")
    pairs = left.drop("_o").join(right, [f"b__k{i}" for i in used])
    keep = [f"{s}{c}" for s in ("a_", "b_") for c in cells.columns if c != "cell"]
    return pairs.where((F.col("a_cid") <= F.col("b_cid")) & (_gap(dims) <= eps * eps * SLACK)).select(*keep)


def _probe(points: DataFrame, cells: DataFrame, near: DataFrame, dims: int, eps: float) -> DataFrame:
    """Sparse points against the cells around them: ``(p, p_cid, cid, q, n)``.

    ``q`` is the other point where it lies in a sparse cell; a dense cell gives
    one row with the weight ``n`` of all its points in reach.
    """
    both = near.select("a_cid", "b_cid", "a_dense", "b_dense", "a_chunks", "b_chunks")
    turned = both.where("a_cid <> b_cid").select(
        F.col("b_cid").alias("a_cid"), F.col("a_cid").alias("b_cid"), F.col("b_dense").alias("a_dense"),
        F.col("a_dense").alias("b_dense"), F.col("b_chunks").alias("a_chunks"), F.col("a_chunks").alias("b_chunks"))
    around = both.unionByName(turned).where("not a_dense").select(
        F.col("a_cid").alias("p_cid"), F.col("b_cid").alias("cid"), "b_dense",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("b_chunks") - 1)).alias("chunk"))
    probes = (points.where("not dense").select(F.col("pid").alias("p"), F.col("cid").alias("p_cid"),
                                               *[F.col(f"x{i}").alias(f"p{i}") for i in range(dims)])
              .join(around, "p_cid"))
    hits = points.join(probes, ["cid", "chunk"]).where(_squared("p", "x", dims) <= eps * eps)
    return (hits.groupBy("p", "p_cid", "cid", F.when(~F.col("b_dense"), F.col("pid")).alias("q"))
            .agg(F.sum("w").alias("n")))


def _directions(dims: int) -> list[list[int]]:
    """Both ways along every axis, and up to eight diagonals."""
    axes = [[s if i == j else 0 for j in range(dims)] for i in range(dims) for s in (1, -1)]
    corners = [[1 if (k >> (i % 3)) & 1 else -1 for i in range(dims)] for k in range(8)]
    return axes + [list(c) for c in dict.fromkeys(map(tuple, corners))]


def _extremes(points: DataFrame, dims: int) -> DataFrame:
    """``(cid, x...)``: the outermost points of every dense cell, at most one per direction."""
    def along(u: list[int]) -> Column:
        return _total([F.col(f"x{i}") * float(s) for i, s in enumerate(u) if s])

    ends = points.where("dense").groupBy("cid").agg(*[F.max_by("pid", along(u)).alias(f"_{k}")
                                                     for k, u in enumerate(_directions(dims))])
    chosen = ends.select(F.explode(F.array_distinct(F.array(*[c for c in ends.columns if c != "cid"]))).alias("pid"))
    return points.join(chosen, "pid", "left_semi").select("cid", *[f"x{i}" for i in range(dims)])


def _components(points: DataFrame, near: DataFrame, known: DataFrame, dims: int, eps: float, side: float,
                small_pair: int) -> DataFrame:
    """``(node, label)`` of the components made by ``known`` links and by dense cells with points in reach of each other."""
    pairs = near.where("a_dense and b_dense and a_cid < b_cid")
    ends = [F.col("a_cid").alias("a"), F.col("b_cid").alias("b")]
    settled = pairs.where(_span(dims) <= eps * eps).select(*ends)
    far = _extremes(points, dims).checkpoint()
    met = (pairs.where(_span(dims) > eps * eps).select(*ends)
           .join(far.select(F.col("cid").alias("a"), *[F.col(f"x{i}").alias(f"p{i}") for i in range(dims)]), "a")
           .join(far.select(F.col("cid").alias("b"), *[F.col(f"x{i}").alias(f"q{i}") for i in range(dims)]), "b")
           .where(_squared("p", "q", dims) <= eps * eps).select("a", "b").distinct())
    labels = connected_components(settled.unionByName(met).unionByName(known))
    la, lb = (labels.select(F.col("node").alias(c), F.col("label").alias(f"_{c}")) for c in ("a", "b"))
    # cells that a chain of links joins already need no link of their own
    left = (pairs.select(*ends).join(la, "a").join(lb, "b").where("_a <> _b")
            .withColumn("pair", F.monotonically_increasing_id()).checkpoint())
    if left.isEmpty():
        return labels
    found = _by_refinement(points, near, left.select("pair", "a", "b"), dims, eps, side, small_pair)
    joined = connected_components(found.join(left, "pair").select(F.col("_a").alias("a"), F.col("_b").alias("b")))
    return labels.join(joined.select(F.col("node").alias("label"), F.col("label").alias("_root")), "label", "left").select(
        "node", F.coalesce("_root", "label").alias("label"))


def _by_refinement(points: DataFrame, near: DataFrame, pairs: DataFrame, dims: int, eps: float, side: float,
                   small_pair: int) -> DataFrame:
    """``(pair)`` of the ``pairs (pair, a, b)`` of dense cells that hold two points within ``eps``."""
    boxes = near.select(F.col("a_cid").alias("a"), F.col("b_cid").alias("b"),
                        *[f"{s}{c}{i}" for s in ("a_", "b_") for c in ("lo", "hi") for i in range(dims)])
    known = pairs.join(boxes, ["a", "b"])

    def facing(own: str, other: str) -> DataFrame:
        """Points of one side that lie within ``eps`` of the other side's box."""
        gaps = [F.greatest(F.col(f"x{i}") - F.col(f"{other}_hi{i}"), F.col(f"{other}_lo{i}") - F.col(f"x{i}"), F.lit(0.0))
                for i in range(dims)]
        return (points.join(known.withColumnRenamed(own, "cid"), "cid")
                .where(_total([g * g for g in gaps]) <= eps * eps * SLACK)
                .select("pair", *[f"x{i}" for i in range(dims)]).checkpoint())

    sides = {"a_": facing("a", "b"), "b_": facing("b", "a")}
    found = []
    work, level = pairs.select("pair"), 0
    while True:
        def key(at: int) -> Column:
            return F.array(*[F.floor(F.col(f"x{i}") / (side / 2 ** at)) for i in range(dims)])

        on = {s: ["pair"] + ([f"{s}up"] if level else []) for s in sides}
        for s, rows in sides.items():
            parts = (rows.groupBy("pair", key(level).alias("key"), *([key(level - 1).alias("up")] if level else []))
                     .agg(F.count(F.lit(1)).alias("n"), *_boxes(dims)))
            work = work.join(_renamed(parts, s).withColumnRenamed(f"{s}pair", "pair"), on[s])
        work = work.where(_gap(dims) <= eps * eps * SLACK).checkpoint()
        sure = work.where(_span(dims) <= eps * eps).select("pair").distinct()
        open_ = work.where(_span(dims) > eps * eps).join(sure, "pair", "left_anti")
        small = open_.where(F.col("a_n") * F.col("b_n") <= small_pair).select("pair", "a_key", "b_key")

        def members(s: str, name: str) -> DataFrame:
            return sides[s].select("pair", key(level).alias(f"{s}key"), *[F.col(f"x{i}").alias(f"{name}{i}") for i in range(dims)])

        near_by = (small.join(members("a_", "p"), ["pair", "a_key"]).join(members("b_", "q"), ["pair", "b_key"])
                   .where(_squared("p", "q", dims) <= eps * eps).select("pair").distinct())
        hit = sure.unionByName(near_by).distinct().checkpoint()
        found.append(hit)
        work = (open_.where(F.col("a_n") * F.col("b_n") > small_pair).join(hit, "pair", "left_anti")
                .select("pair", F.col("a_key").alias("a_up"), F.col("b_key").alias("b_up")).checkpoint())
        level += 1
        if work.isEmpty():
            return reduce(DataFrame.unionByName, found)


def dbscan(df: DataFrame, order_col: str, feature_cols: list[str], eps: float, min_samples: int,
           out_col: str = "cluster", block_rows: int = 20_000, small_pair: int = 4_000_000) -> DataFrame:
    """``df`` with ``out_col``: the DBSCAN label over ``feature_cols`` (already scaled), -1 for noise.

    ``order_col`` is a unique long giving the visiting order. Cells of more than
    ``block_rows`` points are salted; two sets of points are compared one by one
    only if they make at most ``small_pair`` pairs.
    """
    dims = len(feature_cols)
    ensure_checkpoint_dir(df.sparkSession)
    side = eps / math.sqrt(dims) * SHRINK
    x = [f"x{i}" for i in range(dims)]
    cell = F.array(*[F.floor(F.col(c) / side) for c in x])
    # scaled features come from aggregates whose last bits may differ between runs: frozen once, + 0.0 makes -0.0 one of 0.0
    rows = df.select(F.col(order_col).cast("long").alias("_ord"),
                     *[(F.col(c).cast("double") + F.lit(0.0)).alias(a) for c, a in zip(feature_cols, x)]).checkpoint()
    distinct = rows.groupBy(*x).agg(F.count(F.lit(1)).alias("w"), F.min("_ord").alias("pid")).withColumn("cell", cell).checkpoint()
    cells = (distinct.groupBy("cell").agg(F.min("pid").alias("cid"), F.sum("w").alias("weight"), F.count(F.lit(1)).alias("_n"),
                                          *_boxes(dims))
             .withColumns({"dense": F.col("weight") >= min_samples, "chunks": F.ceil(F.col("_n") / block_rows).cast("long")})
             .drop("weight", "_n").checkpoint())
    points = (distinct.join(cells.select("cell", "cid", "dense", "chunks"), "cell")
              .select("pid", "w", "cid", "dense", *x, F.pmod(F.xxhash64("pid"), F.col("chunks")).alias("chunk")).checkpoint())
    near = _neighbours(cells, dims, eps).checkpoint()

    hits = _probe(points, cells, near, dims, eps).checkpoint()
    core = (hits.groupBy("p", "p_cid").agg(F.sum("n").alias("_n")).where(F.col("_n") >= min_samples)
            .select(F.col("p"), F.col("p_cid")))
    # a sparse cell's node is its first core point, a dense cell's node its first point
    nodes = core.groupBy("p_cid").agg(F.min("p").alias("node")).checkpoint()
    core = core.join(nodes, "p_cid").select("p", "node").checkpoint()
    of_core = hits.join(core, "p")
    to_dense = of_core.where("q is null").select(F.col("node").alias("a"), F.col("cid").alias("b"))
    to_core = (of_core.where("q is not null").join(core.select(F.col("p").alias("q"), F.col("node").alias("_q")), "q")
               .select(F.col("node").alias("a"), F.col("_q").alias("b")))
    alone = cells.where("dense").select(F.col("cid").alias("a"), F.col("cid").alias("b")).unionByName(
        nodes.select(F.col("node").alias("a"), F.col("node").alias("b")))
    known = to_dense.unionByName(to_core).distinct().unionByName(alone)
    members = _components(points, near, known, dims, eps, side, small_pair)
    numbers = ordinals_by_range(members.select("label").distinct(), ["label"], "_k")
    cluster = members.join(numbers, "label").select("node", (F.col("_k") - 1).alias("_c")).checkpoint()

    own = core.join(cluster, "node").select(F.col("p").alias("pid"), "_c")
    touched = (hits.where("q is null").select("p", F.col("cid").alias("node"))
               .unionByName(hits.where("q is not null").join(core.select(F.col("p").alias("q"), "node"), "q").select("p", "node")))
    border = (touched.join(core.select("p"), "p", "left_anti").join(cluster, "node")
              .groupBy(F.col("p").alias("pid")).agg(F.min("_c").alias("_c")))
    sparse = (points.where("not dense").join(own.unionByName(border), "pid", "left")
              .select(*[F.col(c).alias(f"_{c}") for c in x], F.coalesce("_c", F.lit(-1)).alias("_sparse")))
    dense = (cells.where("dense").select("cell", F.col("cid").alias("node")).join(cluster, "node")
             .select("cell", F.col("_c").alias("_dense")))
    # a dense cell labels its rows by the cell; only rows of sparse cells are looked up by vector
    labels = (rows.withColumn("cell", cell).join(dense, "cell", "left")
              .join(sparse, reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_{c}") for c in x]), "left")
              .select(F.col("_ord").alias("_dbscan_ord"), F.coalesce("_dense", "_sparse").cast("long").alias(out_col)))
    return df.join(labels, F.col(order_col).cast("long") == F.col("_dbscan_ord"), "left").drop("_dbscan_ord")
