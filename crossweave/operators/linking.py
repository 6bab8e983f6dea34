"""Link resolution and the valid graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossweave.operators.skew import hot_join
from crossweave.workspace import Stored, Workspace


def resolve_language_links(
    dump: DataFrame, pages: DataFrame, *, dump_rows: int, page_rows: int
) -> DataFrame:
    """Find the page each ``(title, toLang)`` names; unresolved links are dropped.

    A title several pages of one edition share gives a link to each of them.
    """
    named = dump.select(F.col("sid").alias("from"), F.col("lang").alias("fromLang"), "title", "toLang")
    targets = pages.select(F.col("sid").alias("to"), "title", F.col("lang").alias("toLang"))
    joined = hot_join(
        named, targets, ["title", "toLang"], left_rows=dump_rows, right_rows=page_rows
    )
    return joined.select("from", "to", "fromLang", "toLang")


def unique_pages(pages: DataFrame) -> DataFrame:
    """One page per key: the smallest id, title and language among duplicates."""
    best = F.min(F.struct("id", "title", "lang")).alias("_page")
    return pages.groupBy("sid").agg(best).select("sid", "_page.*")


def valid_links(links: DataFrame, vertices: Stored, *, link_rows: int) -> DataFrame:
    """Links whose two ends are ``vertices(sid)``; parallel links are kept."""
    keys, given = vertices.df.select("sid"), links
    for end in ("from", "to"):
        links = hot_join(
            links,
            keys.withColumnRenamed("sid", end),
            end,
            "left_semi",
            left_rows=link_rows,
            left_profile=given,
        )
    return links


def edge_table(
    ws: Workspace, links: DataFrame, vertices: Stored, *, link_rows: int
) -> Stored:
    """Valid links as ``(from, to, n)``, where ``n`` counts parallel links."""
    valid = valid_links(links.select("from", "to"), vertices, link_rows=link_rows)
    return ws.save(valid.groupBy("from", "to").agg(F.count(F.lit(1)).alias("n")), "edges")
