"""Connected components of a link table by contraction, in plain joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertforge.session import ensure_checkpoint_dir


def _to_roots(parents: DataFrame) -> DataFrame:
    """Follow ``node -> label`` to the end; every round doubles the distance covered."""
    while True:
        above = parents.select(F.col("node").alias("label"), F.col("label").alias("_above"))
        step = parents.join(above, "label", "left").select(
            "node", F.coalesce("_above", "label").alias("label"), (F.col("_above") < F.col("label")).alias("_moved"))
        step = step.checkpoint()
        parents = step.select("node", "label")
        if step.where("_moved").isEmpty():
            return parents


def connected_components(links: DataFrame) -> DataFrame:
    """``(node, label)`` for both ends of every link ``(a, b)``: label is the smallest node it reaches.

    A round points every node at its smallest neighbour, follows the pointers
    and contracts the links onto the roots, so links and nodes at least halve
    and only what is left goes through the next round.
    """
    ensure_checkpoint_dir(links.sparkSession)
    ways = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("w")), F.struct(F.col("b").alias("u"), F.col("a").alias("w")))
    edges = links.select(F.explode(ways).alias("_e")).select("_e.*").distinct().checkpoint()
    labels = None
    while True:
        parents = edges.groupBy("u").agg(F.min("w").alias("_w")).select(
            F.col("u").alias("node"), F.least("u", "_w").alias("label"))
        roots = _to_roots(parents.checkpoint())
        if labels is None:
            labels = roots
        else:
            labels = labels.join(roots.select(F.col("node").alias("label"), F.col("label").alias("_root")), "label", "left") \
                .select("node", F.coalesce("_root", "label").alias("label")).checkpoint()
        edges = (edges.join(roots.select(F.col("node").alias("u"), F.col("label").alias("_u")), "u")
                 .join(roots.select(F.col("node").alias("w"), F.col("label").alias("_w")), "w")
                 .where("_u <> _w").select(F.col("_u").alias("u"), F.col("_w").alias("w")).distinct().checkpoint())
        if edges.isEmpty():
            return labels
