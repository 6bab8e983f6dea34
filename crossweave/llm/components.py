"""Connected components of an edge table by contraction, in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossweave.workspace import Workspace


def components(edges: DataFrame, ws: Workspace) -> DataFrame:
    """(node, component): for each node of ``edges(a, b)``, the name of its component, one of its nodes.

    Each round every node points to its least neighbour or itself, pointers are followed to
    their ends, and edges are redrawn between these ends; the rest is what remains to join.
    Edges at least halve their nodes each round; every round is a written table.
    """
    left = ws.save(
        edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    names: DataFrame | None = None
    while left.rows:
        ends = left.df
        both = ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b")))
        pointers = both.groupBy("a").agg(F.min("b").alias("to"))
        roots = ws.save(
            pointers.select(F.col("a").alias("node"), F.least("a", "to").alias("to")), "pointers"
        ).df
        while True:
            further = roots.select(F.col("node").alias("to"), F.col("to").alias("end"))
            jumped = roots.join(further, "to").select("node", F.col("end"), F.col("to"))
            saved = ws.save(
                jumped.select("node", F.col("end").alias("to"), (F.col("end") != F.col("to")).alias("moved")),
                "pointers",
            ).df
            roots = saved.select("node", "to")
            if saved.where("moved").isEmpty():
                break
        if names is None:
            names = roots.select("node", F.col("to").alias("component"))
        else:
            on = roots.select(F.col("node").alias("component"), "to")
            names = ws.save(
                names.join(on, "component", "left").select(
                    "node", F.coalesce("to", "component").alias("component")
                ),
                "names",
            ).df
        one = roots.select(F.col("node").alias("a"), F.col("to").alias("ra"))
        other = roots.select(F.col("node").alias("b"), F.col("to").alias("rb"))
        redrawn = ends.join(one, "a").join(other, "b").where("ra != rb")
        left = ws.save(
            redrawn.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(),
            "edges",
        )
    if names is None:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    return names
