"""Counterparts of pages in other editions: building, checking, repairing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossweave.operators.skew import hot_join
from crossweave.workspace import Stored, Workspace


def consistent_links(
    pages: Stored, links: DataFrame, *, link_rows: int, resolved: bool = False
) -> DataFrame:
    """Language links whose ends are pages of the languages the link states.

    Links just resolved against these pages have valid targets; ``resolved`` then
    saves the second check.
    """
    ends = [("from", "fromLang")] if resolved else [("from", "fromLang"), ("to", "toLang")]
    given = links
    for end, lang in ends:
        known = pages.df.select(F.col("sid").alias(end), F.col("lang").alias(lang))
        links = hot_join(
            links, known, [end, lang], "left_semi", left_rows=link_rows, left_profile=given
        )
    return links


def counterpart_rows(links: DataFrame) -> DataFrame:
    """``(v, v_lang, lang, member)``: each end's counterparts, itself among them.

    One hop in both directions: a link tells both of its ends about both of them.
    Rows repeat.
    """

    def row(v, v_lang, lang, member):
        return F.struct(
            F.col(v).alias("v"),
            F.col(v_lang).alias("v_lang"),
            F.col(lang).alias("lang"),
            F.col(member).alias("member"),
        )

    rows = F.array(
        row("from", "fromLang", "toLang", "to"),
        row("from", "fromLang", "fromLang", "from"),
        row("to", "toLang", "toLang", "to"),
        row("to", "toLang", "fromLang", "from"),
    )
    return links.select(F.explode(rows).alias("_row")).select("_row.*")


def cross_net(links: DataFrame) -> DataFrame:
    """``(v, lang, member)``, the set of counterparts in long form."""
    return counterpart_rows(links).select("v", "lang", "member").distinct()


@dataclass
class CrossNet:
    """Summary of the counterpart sets: one row per page and language.

    ``(v, v_lang, lang, lo, hi)`` with the smallest and the largest counterpart.
    They are equal exactly where the set has one member, so checking and repair
    need no more than this one map-side combined aggregate.  Every page with a
    counterpart also has its row for its own language.
    """

    table: Stored

    @property
    def universe(self) -> Stored:
        """``(sid, lang)`` of the pages with a cross-net; repair doesn't shrink it."""
        own = self.table.df.where(F.col("lang") == F.col("v_lang"))
        return self.table.view(own.select(F.col("v").alias("sid"), F.col("v_lang").alias("lang")))

    @property
    def repaired(self) -> Stored:
        """``(v, v_lang, lang, member)`` without the ambiguous entries."""
        single = self.table.df.where(F.col("lo") == F.col("hi"))
        return self.table.view(single.select("v", "v_lang", "lang", F.col("lo").alias("member")))

    @property
    def ambiguous(self) -> Stored:
        """``(v, v_lang, lang)`` of the entries with several members."""
        several = self.table.df.where(F.col("lo") < F.col("hi"))
        return self.table.view(several.select("v", "v_lang", "lang"))

    @property
    def anomalous_pages(self) -> DataFrame:
        """Keys of the pages with an ambiguous entry."""
        return self.ambiguous.df.select(F.col("v").alias("sid")).distinct()


def cross_net_summary(links: DataFrame) -> DataFrame:
    """The rows of ``CrossNet``."""
    return (
        counterpart_rows(links)
        .groupBy("v", "v_lang", "lang")
        .agg(F.min("member").alias("lo"), F.max("member").alias("hi"))
    )


def summarise_cross_net(ws: Workspace, links: DataFrame) -> CrossNet:
    return CrossNet(ws.save(cross_net_summary(links), "crossnet"))


def _other_ends(links: DataFrame) -> DataFrame:
    """``(v, lang, member)``: the other end of each link, for both of its ends.  Rows repeat."""
    ends = F.array(
        F.struct(F.col("from").alias("v"), F.col("toLang").alias("lang"), F.col("to").alias("member")),
        F.struct(F.col("to").alias("v"), F.col("fromLang").alias("lang"), F.col("from").alias("member")),
    )
    return links.select(F.explode(ends).alias("_row")).select("_row.*")


def anomalies(net: CrossNet, links: DataFrame, *, link_rows: int) -> DataFrame:
    """``(from, lang, to)``: the members of every ambiguous entry, from the links of which ``net`` was made."""
    # Dealt out by (v, lang) for the check, the rows need no further shuffle to become distinct.
    linked = hot_join(
        _other_ends(links),
        net.ambiguous.df.select("v", "lang"),
        ["v", "lang"],
        "left_semi",
        left_rows=2 * link_rows,
    )
    # A page is a member of the entry for its own language, without a row per link to say so.
    own = net.universe.df.select(F.col("sid").alias("v"), "lang", F.col("sid").alias("member"))
    own = own.join(net.ambiguous.df.select("v", "lang"), ["v", "lang"], "left_semi")
    others = linked.where(~F.col("v").eqNullSafe(F.col("member"))).select("v", "lang", "member").distinct()
    members = others.unionByName(own)
    return members.select(F.col("v").alias("from"), "lang", F.col("member").alias("to"))


def anomaly_report(found: Stored, pages: DataFrame) -> DataFrame:
    """Both titles and languages of each conflict, sorted."""
    source = pages.select(
        F.col("sid").alias("from"),
        F.col("title").alias("from_title"),
        F.col("lang").alias("from_lang"),
    )
    target = pages.select(
        F.col("sid").alias("to"), F.col("title").alias("to_title"), F.col("lang").alias("to_lang")
    )
    named = hot_join(found.df.select("from", "to"), source, "from", left_rows=found.rows)
    named = hot_join(named, target, "to", left_rows=found.rows, left_profile=found.df)
    return named.select(
        "from", "from_title", "from_lang", "to_lang", "to", "to_title"
    ).orderBy("from_lang", "from", "to_lang", "to")
