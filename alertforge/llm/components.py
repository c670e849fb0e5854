"""Connected components of a link table, by contraction towards the smallest id."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertforge.llm.common import freeze, freeze_counted

# up to so many links (two longs each, 8 MB) are contracted inside one task
FEW_LINKS = 500_000


def smallest_reached(u: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ends of the links ``(u, w)`` and the smallest id that each reaches."""
    ids, at = np.unique(np.concatenate([u, w]), return_inverse=True)
    x, y = at[:len(u)], at[len(u):]
    c = np.arange(len(ids))
    while True:
        low, high = np.minimum(c[x], c[y]), np.maximum(c[x], c[y])
        if (low == high).all():
            return ids, ids[c]
        np.minimum.at(c, high, low)
        while (c[c] != c).any():
            c = c[c]


def _reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if table:
        u, w = (np.concatenate(side) for side in zip(*table))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in smallest_reached(u, w)], names=["v", "c"])


def _roots(parents: DataFrame) -> DataFrame:
    """Follow ``v -> c`` (c <= v) to the end by pointer doubling."""
    while True:
        up = parents.select(F.col("v").alias("_v"), F.col("c").alias("_c"))
        parents, moved = freeze_counted(
            parents.join(up, F.col("c") == F.col("_v"), "left")
            .select("v", F.coalesce("_c", "c").alias("c"), F.when(F.col("_c") < F.col("c"), 1).alias("_moved")),
            "cc-jump", F.col("_moved"))
        parents = parents.select("v", "c")
        if not moved:
            return parents


def connected_components(links: DataFrame) -> DataFrame:
    """``(v, c)`` for every end of a link ``(a, b)``: c is the smallest id it reaches.

    Each round points every vertex at its smallest neighbour, follows the
    pointers to their roots and contracts the links onto the roots; rounds end
    when no link is left, whatever their number. All tables are narrow, and a
    vertex with a third of all links is pre-aggregated before the shuffle. No
    more than ``FEW_LINKS`` links, counted as they are written, are contracted in
    one task instead of a dozen small jobs.
    """
    links, n_links = freeze_counted(links.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("w"))
                                    .where("u <> w"), "cc-links")
    if n_links <= FEW_LINKS:
        return freeze(links.coalesce(1).mapInArrow(_reached, "v long, c long"), "cc-labels")
    edges = freeze(links.select(F.explode(F.array(F.struct("u", "w"), F.struct(F.col("w").alias("u"), F.col("u").alias("w")))).alias("e"))
                   .select("e.*").distinct(), "cc-edges")
    labels = None
    while True:
        parents = (edges.groupBy("u").agg(F.min("w").alias("_w"))
                   .select(F.col("u").alias("v"), F.least("u", "_w").alias("c")))
        roots = _roots(parents)
        if labels is None:
            labels = roots
        else:
            step = roots.select(F.col("v").alias("_v"), F.col("c").alias("_c"))
            labels = freeze(labels.join(step, F.col("c") == F.col("_v"), "left")
                            .select("v", F.coalesce("_c", "c").alias("c")), "cc-labels")
        left = roots.select(F.col("v").alias("u"), F.col("c").alias("_ru"))
        right = roots.select(F.col("v").alias("w"), F.col("c").alias("_rw"))
        edges, n_edges = freeze_counted(
            edges.join(left, "u").join(right, "w").where("_ru <> _rw")
            .select(F.col("_ru").alias("u"), F.col("_rw").alias("w")).distinct(), "cc-edges")
        if not n_edges:
            return labels
