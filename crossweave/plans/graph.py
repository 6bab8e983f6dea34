"""The link graph all analyses start from."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from crossweave.operators.crossnet import CrossNet, consistent_links, summarise_cross_net
from crossweave.operators.linking import edge_table, resolve_language_links, unique_pages
from crossweave.operators.neighborhood import ego_net
from crossweave.operators.skew import hot_join
from crossweave.workspace import Stored, Workspace


@dataclass
class LinkGraph:
    """Pages with counterparts, their repaired cross-net and the links among them."""

    ws: Workspace
    pages: Stored
    cross: CrossNet
    edges: Stored


def universe_pages(pages: Stored, cross: CrossNet) -> DataFrame:
    """``(sid, id, title, lang)`` of the pages which have a cross-net."""
    wanted = pages.df.select("sid", "id", "title", "lang")
    keys = cross.universe.df.select("sid")
    return unique_pages(hot_join(wanted, keys, "sid", "left_semi", left_rows=pages.rows))


def cross_links(ws: Workspace, pages: Stored, language_links: Stored, resolved: bool) -> CrossNet:
    valid = consistent_links(
        pages, language_links.df, link_rows=language_links.rows, resolved=resolved
    )
    return summarise_cross_net(ws, valid)


def resolve(ws: Workspace, dump: Stored, pages: Stored) -> Stored:
    resolved = resolve_language_links(
        dump.df, pages.df, dump_rows=dump.rows, page_rows=pages.rows
    )
    return ws.save(resolved, "langlinks")


def link_graph(
    ws: Workspace, pages: Stored, language_links: Stored, links: Stored, resolved: bool = False
) -> LinkGraph:
    """``resolved`` says the language links were resolved against just these pages."""
    cross = cross_links(ws, pages, language_links, resolved)
    known = ws.save(universe_pages(pages, cross), "universe")
    edges = edge_table(ws, links.df, cross.universe, link_rows=links.rows)
    return LinkGraph(ws, known, cross, edges)


@dataclass
class Nets:
    """Neighbourhoods of some egos (``None``: of every page), extended as needed."""

    graph: LinkGraph
    step: int
    table: Stored
    egos: Stored | None

    @classmethod
    def of(cls, graph: LinkGraph, step: int, egos: Stored | None = None) -> "Nets":
        return cls(graph, step, ego_net(graph.ws, graph.edges, step, egos), egos)

    def extended(self, egos: DataFrame) -> "Nets":
        """Also covering ``egos(ego)``; only the missing ones are computed."""
        if self.egos is None:
            return self
        ws = self.graph.ws
        missing = ws.save(egos.join(self.egos.df, "ego", "left_anti"), "missing")
        if missing.rows == 0:
            return self
        more = ego_net(ws, self.graph.edges, self.step, missing)
        table = Stored(self.table.df.unionByName(more.df))
        return Nets(self.graph, self.step, table, Stored(self.egos.df.unionByName(missing.df)))
