"""Nested form of the page table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossweave.plans.graph import LinkGraph


def nested_universe(graph: LinkGraph) -> DataFrame:
    """Pages with their repaired cross-net as ``map<lang, array<sid>>``.

    A page has at most one counterpart per language after repair, so a map has no
    more entries than there are languages.
    """
    entries = graph.cross.repaired.df.groupBy(F.col("v").alias("sid")).agg(
        F.map_from_entries(F.collect_list(F.struct("lang", F.array("member")))).alias("crossNet")
    )
    empty = F.map_from_entries(F.array().cast("array<struct<k:string,v:array<bigint>>>"))
    return graph.pages.df.join(entries, "sid", "left").withColumn(
        "crossNet", F.coalesce("crossNet", empty)
    )
