"""Connected components by contraction, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of edges (u, v): comp is the smallest node reachable.

    Each round every node points to the smallest of its neighbours and itself,
    pointers are followed to their roots by doubling, and the edges between
    roots go on.  Intermediate tables are written, so lineage stays short.
    """
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct()
    live = keep(both, "edges")
    labels: DataFrame | None = None
    while not live.isEmpty():
        point = keep(live.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("p")), "pointers")
        while True:
            target = point.select(F.col("u").alias("p"), F.col("p").alias("q"))
            jumped = keep(point.join(target, "p").select("u", F.col("q").alias("p"), (F.col("p") != F.col("q")).alias("moved")), "pointers")
            point = jumped.select("u", "p")
            if jumped.where("moved").isEmpty():
                break
        if labels is None:
            labels = point.select(F.col("u").alias("node"), F.col("p").alias("comp"))
        else:
            labels = labels.join(point.select(F.col("u").alias("comp"), "p"), "comp", "left").select("node", F.coalesce("p", "comp").alias("comp"))
        labels = keep(labels, "labels")
        a = point.select("u", F.col("p").alias("pu"))
        b = point.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        live = keep(live.join(a, "u").join(b, "v").where("pu <> pv").select(F.col("pu").alias("u"), F.col("pv").alias("v")).distinct(), "edges")
    if labels is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).limit(0)
    return labels
