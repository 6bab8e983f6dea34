"""k-step out-neighbourhoods and their translations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossweave.operators.skew import has_hot, hot_join
from crossweave.workspace import Stored, Workspace


def ego_net(ws: Workspace, edges: Stored, step: int, egos: Stored | None = None) -> Stored:
    """``(ego, member, step)``: pages within ``step`` links and the step first reached.

    ``egos(ego)`` restricts the start pages.  An ego is its own member only where
    a path leads back to it; pages without out-links have no rows.  Each round
    expands just the members the last round added.
    """
    links = edges.df.select(F.col("from").alias("ego"), F.col("to").alias("member"))
    if egos is not None:
        links = hot_join(links, egos.df, "ego", "left_semi", left_rows=edges.rows)
    first = links.withColumn("step", F.lit(1))
    net = edges.view(first) if egos is None else ws.save(first, "net1")

    onward = edges.df.select(F.col("from").alias("member"), F.col("to").alias("next"))
    for reached in range(2, step + 1):
        frontier = net.df.where(F.col("step") == reached - 1).select("ego", "member")
        grown = hot_join(
            frontier, onward, "member", left_rows=net.rows, right_rows=edges.rows
        ).select("ego", F.col("next").alias("member"), F.lit(reached).alias("step"))
        merged = net.df.union(grown).groupBy("ego", "member").agg(F.min("step").alias("step"))
        net = ws.save(merged, f"net{reached}")
    return net


def name_lists(names: DataFrame, page: str, lang: str, name: str) -> DataFrame:
    """``(page, langs, names)``: one row per page with as many names as it has languages, in plain arrays,
    which take less room than structs when rows are dealt out."""
    both = F.collect_list(F.struct(lang, name)).alias("_both")
    # Dealt out first, as lists begun on the map side would only be longer rows.
    listed = names.repartition(page).groupBy(page).agg(both)
    return listed.select(page, F.col(f"_both.{lang}").alias("langs"), F.col(f"_both.{name}").alias("names"))


def translated_net(net: Stored, repaired: Stored) -> DataFrame:
    """``(ego, lang, member)``: the counterparts, by language, of an ego's members."""
    names = name_lists(
        repaired.df.select(F.col("v").alias("member"), "lang", F.col("member").alias("to")), "member", "lang", "to"
    )
    translated = hot_join(
        net.df.select("ego", "member"), names, "member", left_rows=net.rows
    ).select("ego", "langs", "names")
    # A member's names travel as one row to where its ego's rows become distinct; rows of an ego with
    # too many for one task are dealt out by name instead.
    if not has_hot(net.df, "ego", rows=net.rows):
        translated = translated.repartition("ego")
    named = translated.select("ego", F.explode(F.arrays_zip("langs", "names")).alias("_name"))
    return named.select(
        "ego", F.col("_name.langs").alias("lang"), F.col("_name.names").alias("member")
    ).distinct()
