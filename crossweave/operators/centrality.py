"""Centralities of the members inside each ego's neighbourhood.

All neighbourhoods are computed together.  Those of ordinary size are dealt to
tasks in groups and solved there in memory; a neighbourhood too large for that is
solved by joins over its links, spread over the cluster.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crossweave.operators.skew import hot_join
from crossweave.workspace import Stored, Workspace, has_rows

# Ship the solvers with their jobs, so that workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values of the measures.
RESET = 0.15
DAMPING = 1 - RESET
TOLERANCE = 0.01
HUB_ROUNDS = 10
SCORE = ("score",)
HUB_AUTHORITY = ("hub", "authority")

# A neighbourhood with more rows (members and links, also those that leave it) is solved by joins.
LOCAL_ROWS = 500_000
# Links of one page that travel in one row.
LIST_LINKS = 1024
# Rows of neighbourhoods a task holds at a time, on average.
GROUP_ROWS = 200_000


def induced_links(net: Stored, edges: Stored) -> DataFrame:
    """``(ego, src, dst, n)``: the links between members of each neighbourhood."""
    members = net.df.select("ego", F.col("member").alias("src"))
    onward = edges.df.select(F.col("from").alias("src"), F.col("to").alias("dst"), "n")
    outgoing = hot_join(
        members, onward, "src", left_rows=net.rows, right_rows=edges.rows
    ).select("ego", "src", "dst", "n")
    inside = net.df.select("ego", F.col("member").alias("dst"))
    return outgoing.join(inside, ["ego", "dst"], "left_semi").select("ego", "src", "dst", "n")


def neighbourhood_graphs(ws: Workspace, net: Stored, edges: Stored) -> Stored:
    """All neighbourhoods as ``(ego, src, dst, n)``; each member also has a row to itself with n = 0."""
    members = net.df.select(
        "ego", F.col("member").alias("src"), F.col("member").alias("dst"), F.lit(0).cast("bigint").alias("n")
    )
    return ws.save(members.unionByName(induced_links(net, edges)), "graphs")


def link_lists(ws: Workspace, edges: Stored) -> Stored:
    """``(src, first, dsts, ns, degree)``: each page's links in lists of at most ``LIST_LINKS``; ``first``
    marks one list per page and ``degree`` counts all its links."""
    page = Window.partitionBy("from")
    placed = edges.df.withColumn(
        "part", F.floor((F.row_number().over(page.orderBy("to")) - 1) / LIST_LINKS)
    )
    lists = placed.groupBy(F.col("from").alias("src"), "part").agg(
        F.collect_list(F.struct("to", "n")).alias("links"), F.count(F.lit(1)).alias("own")
    )
    degree = F.sum("own").over(Window.partitionBy("src"))
    return ws.save(
        lists.select(
            "src",
            (F.col("part") == 0).alias("first"),
            F.col("links.to").alias("dsts"),
            F.col("links.n").alias("ns"),
            degree.alias("degree"),
        ),
        "lists",
    )


@dataclass(frozen=True)
class Graphs:
    """Several neighbourhoods as index arrays: ``links`` run between member positions."""

    group: np.ndarray
    src: np.ndarray
    dst: np.ndarray
    n: np.ndarray

    @property
    def size(self) -> int:
        return len(self.group)

    def into(self, values: np.ndarray, ends: np.ndarray) -> np.ndarray:
        # Without any values numpy counts in integers.
        return np.bincount(ends, weights=values, minlength=self.size).astype(float)


def _page_rank(g: Graphs) -> np.ndarray:
    degree = g.into(g.n, g.src)
    share = DAMPING * g.n / degree[g.src]
    rank = np.full(g.size, RESET)
    delta = rank.copy()
    while (delta > TOLERANCE).any():
        moving = np.where(delta > TOLERANCE, delta, 0.0)
        delta = g.into(moving[g.src] * share, g.dst)
        rank += delta
    total = np.bincount(g.group, weights=rank)
    return rank * (np.bincount(g.group) / total)[g.group]


def _hub_score(g: Graphs) -> np.ndarray:
    hub = np.ones(g.size)
    for _ in range(HUB_ROUNDS):
        hub = g.into(hub[g.src] * g.n, g.dst) + g.into(hub[g.dst] * g.n, g.src)
        hub[hub == 0.0] = 1.0
    return hub


def _unit_length(g: Graphs, values: np.ndarray) -> np.ndarray:
    """Values scaled to length 1 within each neighbourhood; nothing but zeros stays so."""
    length = np.sqrt(np.bincount(g.group, weights=values * values))
    return values / np.where(length == 0, 1.0, length)[g.group]


def _hub_authority(g: Graphs) -> tuple[np.ndarray, np.ndarray]:
    hub, authority = np.ones(g.size), np.zeros(g.size)
    for _ in range(HUB_ROUNDS):
        authority = _unit_length(g, g.into(hub[g.src] * g.n, g.dst))
        hub = _unit_length(g, g.into(authority[g.dst] * g.n, g.src))
    return hub, authority


Measure = Callable[[Graphs], np.ndarray | tuple[np.ndarray, ...]]


def _solve_local(
    lists: DataFrame, rows: int, measure: Measure, names: tuple[str, ...] = SCORE
) -> DataFrame:
    """Solve groups of whole neighbourhoods ``(ego, src, first, dsts, ns)``, each group in one task.

    The lists hold all links of a member; those that leave the neighbourhood are dropped here.
    """

    def solve(table: pa.Table) -> pa.Table:
        ego, src = (table.column(c).to_numpy() for c in ("ego", "src"))
        first = table.column("first").to_numpy(zero_copy_only=False)
        dsts, ns = (table.column(c).combine_chunks() for c in ("dsts", "ns"))
        sizes = pc.fill_null(pc.list_value_length(dsts), 0).to_numpy(zero_copy_only=False)
        dst, n = (pc.list_flatten(c).to_numpy(zero_copy_only=False) for c in (dsts, ns))
        egos, group = np.unique(ego, return_inverse=True)
        ids, place = np.unique(src, return_inverse=True)
        # (ego, page) as one number, to find each link's ends among the members.
        source = group * len(ids) + place
        members = np.sort(source[first])
        known = np.minimum(np.searchsorted(ids, dst), len(ids) - 1)
        target = np.repeat(group, sizes) * len(ids) + known
        end = np.minimum(np.searchsorted(members, target), len(members) - 1)
        link = (ids[known] == dst) & (members[end] == target)
        owner = members // len(ids)
        start = np.searchsorted(members, np.repeat(source, sizes)[link])
        graph = Graphs(owner, start, end[link], n[link].astype(float))
        found = measure(graph)
        found = found if isinstance(found, tuple) else (found,)
        keys = {"ego": egos[owner], "member": ids[members % len(ids)]}
        return pa.table(keys | dict(zip(names, found, strict=True)))

    session = lists.sparkSession
    groups = max(-(-rows // GROUP_ROWS), session.sparkContext.defaultParallelism)
    grouped = lists.withColumn("_group", F.pmod(F.xxhash64("ego"), F.lit(groups)))
    return grouped.groupBy("_group").applyInArrow(
        solve, "ego bigint, member bigint, " + ", ".join(f"{n} double" for n in names)
    )


def _page_rank_by_joins(ws: Workspace, graphs: DataFrame) -> DataFrame:
    """The same ranks by one join per round; every round's increments are written."""
    links = graphs.where(F.col("n") > 0)
    degree = links.groupBy("ego", "src").agg(F.sum("n").alias("degree"))
    share = ws.save(
        links.join(degree, ["ego", "src"]).select(
            "ego", "src", "dst", (F.col("n") * DAMPING / F.col("degree")).alias("share")
        ),
        "shares",
    )
    start = graphs.where(F.col("n") == 0).select("ego", F.col("src").alias("v"))
    delta = ws.save(start.withColumn("delta", F.lit(RESET)), "delta")
    written = [delta.path]
    while has_rows(delta.df.where(F.col("delta") > TOLERANCE)):
        moving = delta.df.where(F.col("delta") > TOLERANCE).withColumnRenamed("v", "src")
        received = (
            share.df.join(moving, ["ego", "src"])
            .groupBy("ego", F.col("dst").alias("v"))
            .agg(F.sum(F.col("share") * F.col("delta")).alias("delta"))
        )
        delta = ws.save(received, "delta")
        written.append(delta.path)
    spark = graphs.sparkSession
    increments = spark.read.schema(delta.df.schema).parquet(*written)
    rank = ws.save(increments.groupBy("ego", "v").agg(F.sum("delta").alias("rank")), "ranks").df
    scale = rank.groupBy("ego").agg((F.count(F.lit(1)) / F.sum("rank")).alias("scale"))
    return rank.join(scale, "ego").select(
        "ego", F.col("v").alias("member"), (F.col("rank") * F.col("scale")).alias("score")
    )


def _hub_score_by_joins(ws: Workspace, graphs: DataFrame) -> DataFrame:
    links = graphs.where(F.col("n") > 0)
    both = ws.save(
        links.select("ego", F.col("src").alias("v"), F.col("dst").alias("u"), "n").union(
            links.select("ego", F.col("dst").alias("v"), F.col("src").alias("u"), "n")
        ),
        "both",
    )
    members = graphs.where(F.col("n") == 0).select("ego", F.col("src").alias("v"))
    hub = ws.save(members.withColumn("score", F.lit(1.0)), "hub")
    for _ in range(HUB_ROUNDS):
        neighbour = hub.df.select("ego", F.col("v").alias("u"), "score")
        sums = (
            both.df.join(neighbour, ["ego", "u"])
            .groupBy("ego", "v")
            .agg(F.sum(F.col("n") * F.col("score")).alias("score"))
        )
        kept = members.join(sums, ["ego", "v"], "left")
        hub = ws.save(kept.select("ego", "v", F.coalesce("score", F.lit(1.0)).alias("score")), "hub")
    return hub.df.withColumnRenamed("v", "member")


def _hub_authority_by_joins(ws: Workspace, graphs: DataFrame) -> DataFrame:
    """The same scores by two joins per round, each round written; zeros have no rows meanwhile."""
    links = graphs.where(F.col("n") > 0)
    members = graphs.where(F.col("n") == 0).select("ego", F.col("src").alias("v"))

    def turn(scores: Stored, of: str, to: str, name: str) -> Stored:
        known = scores.df.select("ego", F.col("v").alias(of), "score")
        sums = (
            links.join(known, ["ego", of])
            .groupBy("ego", F.col(to).alias("v"))
            .agg(F.sum(F.col("n") * F.col("score")).alias("sum"))
        )
        summed = ws.save(sums, f"{name}sums").df
        length = summed.groupBy("ego").agg(F.sqrt(F.sum(F.col("sum") * F.col("sum"))).alias("length"))
        scaled = summed.join(length, "ego")
        return ws.save(scaled.select("ego", "v", (F.col("sum") / F.col("length")).alias("score")), name)

    hub = ws.save(members.withColumn("score", F.lit(1.0)), "hub")
    for _ in range(HUB_ROUNDS):
        authority = turn(hub, "src", "dst", "authority")
        hub = turn(authority, "dst", "src", "hub")
    found = members
    for name, scores in zip(HUB_AUTHORITY, (hub, authority), strict=True):
        own = scores.df.withColumnRenamed("score", name)
        found = found.join(own, ["ego", "v"], "left").fillna(0.0, [name])
    return found.withColumnRenamed("v", "member")


def _scores(
    ws: Workspace,
    net: Stored,
    edges: Stored,
    local: Measure,
    by_joins: Callable[[Workspace, DataFrame], DataFrame],
    local_rows: int | None,
    names: tuple[str, ...] = SCORE,
) -> DataFrame:
    """Solve every neighbourhood, in groups or, if it has more than ``local_rows`` rows, by joins.

    Members travel with the lists of their links to the task that solves their neighbourhood; which
    links stay inside is found there.  Where these lists alone are too long, the links inside are
    found by a join first.
    """
    local_rows = LOCAL_ROWS if local_rows is None else local_rows
    links = link_lists(ws, edges)
    members = net.df.select("ego", F.col("member").alias("src"))

    def listed(members: DataFrame, lists: DataFrame) -> DataFrame:
        return hot_join(members, lists, "src", "left", left_rows=net.rows, left_profile=members)

    degrees = links.df.where("first").select("src", "degree")
    degree = degrees.agg(F.max("degree").alias("most"), F.avg("degree").alias("mean")).first()
    widest = net.df.groupBy("ego").count().agg(F.max("count")).first()[0] or 0
    large = None
    # Where even the widest net of the longest lists isn't large, rows need not be counted by neighbourhood.
    if widest * (1 + (degree.most or 0)) <= local_rows:
        total = int(net.rows * (1 + (degree.mean or 0)))
    else:
        sizes = ws.save(
            listed(members, degrees)
            .groupBy("ego")
            .agg(F.sum(1 + F.coalesce("degree", F.lit(0))).alias("rows")),
            "sizes",
        )
        total = sizes.df.agg(F.sum("rows")).first()[0] or 0
        large = ws.save(sizes.df.where(F.col("rows") > local_rows).select("ego"), "large")
        if large.rows:
            members = hot_join(members, large.df, "ego", "left_anti", left_rows=net.rows)
    lists = listed(members, links.df.drop("degree")).withColumn("first", F.coalesce("first", F.lit(True)))
    solved = _solve_local(lists, total, local, names)
    if large is None or not large.rows:
        return solved
    rest = net.view(hot_join(net.df, large.df, "ego", "left_semi", left_rows=net.rows))
    return solved.unionByName(_solve_large(ws, rest, edges, local, by_joins, local_rows, names))


def _solve_large(
    ws: Workspace,
    net: Stored,
    edges: Stored,
    local: Measure,
    by_joins: Callable[[Workspace, DataFrame], DataFrame],
    local_rows: int,
    names: tuple[str, ...],
) -> DataFrame:
    """The same where the links inside have to be found by a join."""
    graphs = neighbourhood_graphs(ws, net, edges)
    sizes = graphs.df.groupBy("ego").agg(F.count(F.lit(1)).alias("rows"))
    large = ws.save(sizes.where(F.col("rows") > local_rows).select("ego"), "largest")
    apart = {
        how: hot_join(graphs.df, large.df, "ego", how, left_rows=graphs.rows)
        for how in ("left_anti", "left_semi")
    }
    link = F.col("n") > 0
    single = apart["left_anti"].select(
        "ego",
        "src",
        (~link).alias("first"),
        F.when(link, F.array("dst")).alias("dsts"),
        F.when(link, F.array("n")).alias("ns"),
    )
    small = _solve_local(single, graphs.rows, local, names)
    if large.rows == 0:
        return small
    return small.unionByName(by_joins(ws, ws.save(apart["left_semi"], "largegraphs").df))


def page_rank(
    ws: Workspace, net: Stored, edges: Stored, local_rows: int | None = None
) -> DataFrame:
    """``(ego, member, score)``: PageRank inside each neighbourhood.

    Increments at or below the tolerance aren't passed on; the ranks of a
    neighbourhood add up to its size.
    """
    return _scores(ws, net, edges, _page_rank, _page_rank_by_joins, local_rows)


def hub_score(
    ws: Workspace, net: Stored, edges: Stored, local_rows: int | None = None
) -> DataFrame:
    """``(ego, member, score)``: ten rounds of sums over in- and out-neighbours, not normalised.

    A member without links keeps 1.
    """
    return _scores(ws, net, edges, _hub_score, _hub_score_by_joins, local_rows)


def hub_authority(
    ws: Workspace, net: Stored, edges: Stored, local_rows: int | None = None
) -> DataFrame:
    """``(ego, member, hub, authority)``: hubs and authorities of each neighbourhood, by ten rounds of mutual sums.

    A member's authority is the sum of the hub scores that link to it, its hub score the sum of the
    authorities it links to; after each sum a neighbourhood's scores are scaled to length 1.  Without links
    all are 0.
    """
    return _scores(
        ws, net, edges, _hub_authority, _hub_authority_by_joins, local_rows, HUB_AUTHORITY
    )


def kleinberg_authority(ws: Workspace, net: Stored, edges: Stored) -> DataFrame:
    """``(ego, member, weight)`` with the scaled authority scores."""
    return hub_authority(ws, net, edges).select("ego", "member", F.col("authority").alias("weight"))


def reciprocal_page_rank(ws: Workspace, net: Stored, edges: Stored) -> DataFrame:
    """``(ego, member, weight)`` with the reciprocal of each member's PageRank."""
    return page_rank(ws, net, edges).select("ego", "member", (1 / F.col("score")).alias("weight"))


def authority_vectors(ws: Workspace, net: Stored, edges: Stored) -> DataFrame:
    """``(ego, member, weight)`` with authority scores, which are 1 for every member."""
    return net.df.select("ego", "member", F.lit(1.0).alias("weight"))


# Callers may add measures of their own under further names.
CENTRALITIES: dict[str, Callable[[Workspace, Stored, Stored], DataFrame]] = {
    "RPR": reciprocal_page_rank,
    "HITS": authority_vectors,
    "KLEINBERG": kleinberg_authority,
}
# Measures that give every member the weight 1.
UNIT_WEIGHTS = {"HITS"}


def vectors(ws: Workspace, net: Stored, edges: Stored, centrality: str) -> Stored:
    """The weights of each neighbourhood's members under a named centrality."""
    if centrality not in CENTRALITIES:
        raise ValueError(f"unknown centrality {centrality!r}, not in {sorted(CENTRALITIES)}")
    weights = CENTRALITIES[centrality](ws, net, edges)
    # Unit weights are a mere projection of the written neighbourhoods.
    return net.view(weights) if centrality in UNIT_WEIGHTS else ws.save(weights, "vectors")
