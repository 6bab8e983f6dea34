"""Recommendation, ranking and relatedness for many queries at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossweave.operators.candidates import (
    QUERY_ROWS,
    candidates,
    find_articles,
    homologous,
    reachable,
    reachable_candidates,
)
from crossweave.operators.centrality import UNIT_WEIGHTS, vectors
from crossweave.operators.similarity import pair_similarity, scored_pairs
from crossweave.operators.skew import has_hot, hot_join
from crossweave.plans.graph import LinkGraph, Nets
from crossweave.workspace import Stored


@dataclass
class Recommendations:
    """``found(query_id, from, to)`` and the neighbourhoods it came from.

    ``by_title`` says that each query's pages are the counterparts of one page, and so
    at most one per language.  ``distinct`` says that no page takes part in two queries, so
    that no two rows name the same pages.
    """

    graph: LinkGraph
    nets: Nets
    found: Stored
    by_title: bool = True
    distinct: bool = False


def title_scope(graph: LinkGraph, titles: DataFrame, pivot: str) -> Stored:
    """The pages taking part in each query ``titles(query_id, title)``."""
    articles = graph.ws.save(find_articles(titles, graph.pages.df, pivot), "articles")
    return graph.ws.save(homologous(articles, graph.cross.repaired), "scope")


def whole_scope(graph: LinkGraph) -> Stored:
    """One query, numbered 0, in which every page takes part."""
    pages = graph.cross.universe
    return pages.view(
        pages.df.select(F.lit(0).cast("bigint").alias("query_id"), F.col("sid").alias("ego"))
    )


def _recommend(
    graph: LinkGraph, scope: Stored, nets: Nets, by_title: bool = True, distinct: bool = True
) -> Recommendations:
    found = candidates(graph.ws, scope, nets.table, graph.edges, graph.cross.repaired)
    return Recommendations(graph, nets, found, by_title, distinct)


def recommend(graph: LinkGraph, titles: DataFrame, step: int, pivot: str = "en") -> Recommendations:
    """Links recommended to the counterparts of each query's page."""
    scope = title_scope(graph, titles, pivot)
    egos = graph.ws.save(scope.df.select("ego").distinct(), "egos")
    return _recommend(graph, scope, Nets.of(graph, step, egos), distinct=egos.rows == scope.rows)


def recommend_everywhere(graph: LinkGraph, step: int) -> Recommendations:
    """Links recommended to any page by any of its counterparts."""
    return _recommend(graph, whole_scope(graph), Nets.of(graph, step), by_title=False)


def resume(graph: LinkGraph, found: Stored, step: int) -> Recommendations:
    """Recommendations read back from a table, ready for ranking."""
    egos = graph.ws.save(found.df.select(F.col("from").alias("ego")).distinct(), "egos")
    return Recommendations(graph, Nets.of(graph, step, egos), found)


def rank(recommended: Recommendations, centrality: str) -> Stored:
    """``(query_id, from, to, score)``: similarity of each page to its candidates.

    Candidates which can't be expanded within their query drop out; a page none of
    whose candidates can be expanded keeps them all with score 0.
    """
    graph, found = recommended.graph, recommended.found
    ws = graph.ws
    targets = found.df.select("query_id", F.col("to").alias("ego"))
    # One receiver per language means that a query has each target once.
    scope = found.view(targets if recommended.by_title else targets.distinct())
    nets = recommended.nets.extended(scope.df.select("ego").distinct())
    repaired = graph.cross.repaired
    if recommended.by_title and not has_hot(found.df, "query_id", rows=found.rows, hot_rows=QUERY_ROWS):
        kept = reachable_candidates(ws, found, nets.table, graph.edges, repaired)
        rankable, unplaced = (
            kept.view(kept.df.where(which).drop("alive")) for which in (F.col("alive"), ~F.col("alive"))
        )
    else:
        rankable, unplaced = _apart_by_joins(ws, found, scope, nets, graph)
    weights = vectors(ws, nets.table, graph.edges, centrality)
    ranked = scored_pairs(
        ws, rankable, weights, unit=centrality in UNIT_WEIGHTS, distinct=recommended.distinct
    )
    columns = ["query_id", "from", "to", "score"]
    everything = ranked.df.select(*columns).unionByName(
        unplaced.df.select(*columns[:3], F.lit(0.0).alias("score"))
    )
    # What is in written tables already isn't written once more.
    return found.view(everything) if ranked.written else ws.save(everything, "ranked")


def _apart_by_joins(
    ws: Workspace, found: Stored, scope: Stored, nets: Nets, graph: LinkGraph
) -> tuple[Stored, Stored]:
    """The candidates which can be expanded within their query, and those of pages that have none of these."""
    # Written by itself: its shuffle files, the larger ones here, are gone before the candidates are dealt out.
    alive = ws.save(reachable(ws, scope, nets.table, graph.edges, graph.cross.repaired), "alive")
    rankable = ws.save(
        hot_join(
            found.df,
            alive.df.withColumnRenamed("ego", "to"),
            ["query_id", "to"],
            "left_semi",
            left_rows=found.rows,
        ),
        "rankable",
    )
    # Pages none of whose candidates can be expanded are few: the candidates come to them, not they to all candidates.
    ends = ["query_id", "from"]
    asked, placed = (t.df.select(*ends).distinct() for t in (found, rankable))
    alone = ws.save(asked.join(placed, ends, "left_anti"), "alone")
    unplaced = hot_join(found.df, alone.df, ends, "left_semi", left_rows=found.rows)
    return rankable, ws.save(unplaced, "unplaced")


def relate(
    graph: LinkGraph, pairs: DataFrame, step: int, centrality: str, pivot: str = "en"
) -> DataFrame:
    """Similarity of the two titles of ``pairs(pair_id, title_a, title_b)`` in each shared language.

    A counterpart counts only if it has out-links and receives something from its
    own side's other counterparts.
    """
    ws = graph.ws
    asked = ws.save(pairs.select("pair_id", "title_a", "title_b").distinct(), "asked")
    titles = asked.df.select(F.explode(F.array("title_a", "title_b")).alias("title")).distinct()
    scope = title_scope(graph, titles.select(F.col("title").alias("query_id"), "title"), pivot)
    nets = Nets.of(graph, step, ws.save(scope.df.select("ego").distinct(), "egos"))
    alive = reachable(ws, scope, nets.table, graph.edges, graph.cross.repaired)
    alive = hot_join(scope.df, alive, ["query_id", "ego"], "left_semi", left_rows=scope.rows)
    named = graph.pages.df.select(F.col("sid").alias("ego"), "title", "lang")
    sides = ws.save(
        alive.join(named, "ego").select(F.col("query_id").alias("query"), "ego", "title", "lang"),
        "sides",
    )

    def side(letter: str, end: str) -> DataFrame:
        return sides.df.select(
            F.col("query").alias(f"title_{letter}"),
            F.col("ego").alias(end),
            F.col("title").alias(f"{end}Title"),
            F.col("lang").alias(f"lang_{letter}"),
        )

    # A title has at most one page per language here, so each join adds few rows.
    first = hot_join(asked.df, side("a", "from"), "title_a", left_rows=asked.rows)
    both = hot_join(
        first.withColumnRenamed("lang_a", "lang"),
        side("b", "to").withColumnRenamed("lang_b", "lang"),
        ["title_b", "lang"],
        left_rows=asked.rows,
        hot_on=["title_b"],
        left_profile=asked.df,
    )
    both = ws.save(
        both.select("pair_id", "from", "fromTitle", "to", "toTitle", "lang"), "both"
    )
    weights = vectors(ws, nets.table, graph.edges, centrality)
    scored = pair_similarity(ws, both, weights, unit=centrality in UNIT_WEIGHTS)
    return scored.select(
        "pair_id", "from", "fromTitle", "to", "toTitle", "lang", F.col("score").alias("jaccard")
    ).orderBy("pair_id", "lang", "from", "to")
