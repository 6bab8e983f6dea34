"""Link candidates: what counterparts link to and a page doesn't.

A *scope* ``(query_id, ego)`` lists the pages that take part in one query.
Pages deliver only to counterparts within their query.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from crossweave.operators.neighborhood import name_lists
from crossweave.operators.skew import hot_join
from crossweave.workspace import Stored, Workspace

# Ship what tasks run with their jobs, so that workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Candidates a task looks through at a time, on average; a query with as many is too large for that.
QUERY_ROWS = 200_000


def find_articles(titles: DataFrame, pages: DataFrame, pivot: str) -> DataFrame:
    """``(query_id, sid)`` of the pages called ``titles(query_id, title)`` in the pivot language.

    Among pages of equal title the smallest key counts.
    """
    named = pages.where(F.col("lang") == pivot).groupBy("title").agg(F.min("sid").alias("sid"))
    return titles.join(named, "title").select("query_id", "sid")


def homologous(articles: Stored, repaired: Stored) -> DataFrame:
    """The scope of each article: all its counterparts, itself included."""
    members = repaired.df.select(F.col("v").alias("sid"), F.col("member").alias("ego"))
    found = hot_join(articles.df, members, "sid", left_rows=articles.rows)
    return found.select("query_id", "ego").distinct()


def _foreign_names(repaired: Stored) -> DataFrame:
    """``(member, lang, to)``: each page's counterparts in the other editions."""
    return repaired.df.where(F.col("lang") != F.col("v_lang")).select(
        F.col("v").alias("member"), "lang", F.col("member").alias("to")
    )


def _linking(edges: Stored) -> DataFrame:
    return edges.df.select(F.col("from").alias("ego")).distinct()


def _routes(ws: Workspace, scope: Stored, edges: Stored, repaired: Stored) -> Stored:
    """``(query_id, ego, lang, dst)``: where each ego delivers to.

    Receivers are counterparts in scope which have out-links themselves.
    """
    foreign = _foreign_names(repaired).withColumnsRenamed({"member": "ego", "to": "dst"})
    sent = ws.save(hot_join(scope.df, foreign, "ego", left_rows=scope.rows), "routes")
    linking = hot_join(scope.df, _linking(edges), "ego", "left_semi", left_rows=scope.rows)
    receivers = linking.select("query_id", F.col("ego").alias("dst"))
    return sent.view(
        hot_join(sent.df, receivers, ["query_id", "dst"], "left_semi", left_rows=sent.rows)
    )


def deliveries(
    ws: Workspace, scope: Stored, net: Stored, edges: Stored, repaired: Stored
) -> DataFrame:
    """``(query_id, from, to)``: translated members each page receives; rows repeat."""
    routes = _routes(ws, scope, edges, repaired)
    # A member's names in all languages travel as one row, and are told apart only where they are delivered.
    names = name_lists(_foreign_names(repaired), "member", "lang", "to")
    translated = hot_join(net.df.select("ego", "member"), names, "member", left_rows=net.rows)
    received = hot_join(
        translated.select("ego", "langs", "names"),
        routes.df,
        "ego",
        left_rows=net.rows,
        right_rows=routes.rows,
        left_profile=net.df,
        right_profile=routes.parent.df,
    )
    own = F.filter("names", lambda _, i: F.get("langs", i) == F.col("lang"))
    return received.select("query_id", F.col("dst").alias("from"), F.explode(own).alias("to"))


def candidates(
    ws: Workspace, scope: Stored, net: Stored, edges: Stored, repaired: Stored
) -> Stored:
    """``(query_id, from, to)``: received pages which the receiver doesn't link to."""
    received = deliveries(ws, scope, net, edges, repaired)
    # Partitioned by (from, to) for the check, the rows need no shuffle to become distinct.
    fresh = received.join(edges.df.select("from", "to"), ["from", "to"], "left_anti")
    return ws.save(fresh.select("query_id", "from", "to").distinct(), "candidates")


def _useful(
    ws: Workspace, net: Stored, edges: Stored, repaired: Stored, foreign: DataFrame
) -> DataFrame:
    """``(ego, dst)``: which page delivers something to which page with out-links."""
    names = _foreign_names(repaired).select("member", "lang")
    speaks = (
        hot_join(net.df.select("ego", "member"), names, "member", left_rows=net.rows)
        .select("ego", "lang")
        .distinct()
    )
    linking = _linking(edges).withColumnRenamed("ego", "dst")
    useful = foreign.join(speaks, ["ego", "lang"], "left_semi")
    useful = hot_join(
        useful, linking, "dst", "left_semi", left_rows=repaired.rows, left_profile=foreign
    )
    return ws.save(useful.select("ego", "dst"), "useful").df


def reachable(
    ws: Workspace, scope: Stored, net: Stored, edges: Stored, repaired: Stored
) -> DataFrame:
    """``(query_id, ego)``: pages with out-links that a page in scope delivers something to.

    The reached pages themselves need not be in scope.  Which page delivers to which is written, so that the
    shuffle files of that are gone when the queries come in.
    """
    foreign = _foreign_names(repaired).withColumnsRenamed({"member": "ego", "to": "dst"})
    useful = _useful(ws, net, edges, repaired, foreign)
    reached = hot_join(scope.df, useful, "ego", left_rows=scope.rows)
    return reached.select("query_id", F.col("dst").alias("ego")).distinct()


def _looked_through(table: pa.Table) -> pa.Table:
    """Which candidates of some whole queries another candidate of their query delivers to; without the others, but
    for those of pages that have no such candidate."""
    query = table.column("query_id").combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
    source, target = (table.column(c).to_numpy() for c in ("from", "to"))
    dsts = table.column("dsts").combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(dsts), 0).to_numpy(zero_copy_only=False)
    dst = pc.list_flatten(dsts).to_numpy(zero_copy_only=False)
    ids, place = np.unique(target, return_inverse=True)
    known = np.minimum(np.searchsorted(ids, dst), len(ids) - 1)
    # (query, page) as one number.
    reached = np.repeat(query, sizes) * len(ids) + known
    alive = np.isin(query * len(ids) + place, reached[ids[known] == dst])
    sources, origin = np.unique(source, return_inverse=True)
    page = query * len(sources) + origin
    rows = np.flatnonzero(alive | ~np.isin(page, page[alive]))
    # What rows share lies side by side and compresses.
    rows = rows[np.lexsort((target[rows], source[rows]))]
    own = table.select(["query_id", "from", "to"]).take(pa.array(rows))
    return own.append_column("alive", pa.array(alive[rows]))


def reachable_candidates(
    ws: Workspace, found: Stored, net: Stored, edges: Stored, repaired: Stored
) -> Stored:
    """``(query_id, from, to, alive)``: the candidates that are reachable from their query's candidates, and all
    candidates, not alive, of pages that have none of these.

    Each candidate travels once, with the few pages it delivers to, to the task that looks through its query; no
    query may have more than a task's rows.
    """
    foreign = _foreign_names(repaired).withColumnsRenamed({"member": "ego", "to": "dst"})
    useful = _useful(ws, net, edges, repaired, foreign)
    # At most one page per language.
    lists = useful.groupBy(F.col("ego").alias("to")).agg(F.collect_list("dst").alias("dsts"))
    own = found.df.where(F.col("query_id").isNotNull()).select("query_id", "from", "to")
    sent = hot_join(own, lists, "to", "left", left_rows=found.rows, left_profile=found.df)
    groups = max(-(-found.rows // QUERY_ROWS), ws.spark.sparkContext.defaultParallelism)
    grouped = sent.withColumn("_group", F.pmod(F.xxhash64("query_id"), F.lit(groups)))
    schema = StructType([*own.schema, StructField("alive", BooleanType())])
    return ws.save(grouped.groupBy("_group").applyInArrow(_looked_through, schema), "alive")
