"""A link graph in several editions, derived from order tables.

Parts ordered by customers of a region are the pages of that region's edition;
consecutive lines of one order are page links; parts of equal title in different
regions are counterparts.  Shared titles make some counterparts ambiguous.
Brands are the categories.

What dumps get wrong is there too, so that every filter has something to drop: pages that no other
edition has, links to pages that aren't there, language links from absent pages, in the name
of another edition, to titles nobody has, to titles of a namespace and to an edition that isn't loaded,
and lines without the expected fields.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossweave.functions.keys import packed_key
from crossweave.workspace import Stored, Workspace

LANGUAGES = ["r0", "r1", "r2", "r3", "r4"]
PIVOT = "r0"
# Category ids start here, above all part keys.
CATEGORY_BASE = 1_000_000_000_000
# Added to an id, it gives one that no page has.
ABSENT = 1_000_000_000
# An edition that is linked to but not loaded.
ELSEWHERE = "r9"


def _title(part: str):
    p = F.col(part)
    name = F.concat(F.lit("part_"), F.when(p % 10 == 1, p - 1).otherwise(p).cast("string"))
    # Titles that only one edition has.
    return F.when(p % 7 == 3, F.concat_ws("_", name, "lang")).otherwise(name)


def _another(lang):
    """An edition other than ``lang``."""
    return F.when(lang == LANGUAGES[0], LANGUAGES[1]).otherwise(LANGUAGES[0])


class DerivedGraph:
    """The graph's tables; each is planned on demand from the stored order lines."""

    def __init__(self, ws: Workspace, sf_dir: str):
        self.ws = ws
        self.sf_dir = sf_dir

    def _table(self, name: str, *columns: str) -> DataFrame:
        return self.ws.spark.read.parquet(f"{self.sf_dir}/{name}.parquet").select(*columns)

    def _key(self, part: str):
        return packed_key(F.col(part), F.col("lang"), LANGUAGES)

    @property
    def lines(self) -> Stored:
        """Distinct (order, line, part, lang)."""
        if not hasattr(self, "_lines"):
            items = self._table("lineitem", "l_orderkey", "l_linenumber", "l_partkey")
            orders = self._table("orders", "o_orderkey", "o_custkey")
            customers = self._table("customer", "c_custkey", "c_nationkey")
            nations = self._table("nation", "n_nationkey", "n_regionkey")
            placed = (
                orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
                .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
                .select("o_orderkey", F.concat(F.lit("r"), F.col("n_regionkey")).alias("lang"))
            )
            lines = items.join(placed, F.col("l_orderkey") == F.col("o_orderkey")).select(
                F.col("l_orderkey").alias("order"),
                F.col("l_linenumber").alias("line"),
                F.col("l_partkey").alias("part"),
                "lang",
            )
            self._lines = self.ws.save(lines.distinct(), "lines")
        return self._lines

    def pages(self) -> DataFrame:
        return (
            self.lines.df.select("part", "lang")
            .distinct()
            .select(
                self._key("part").alias("sid"),
                F.col("part").alias("id"),
                _title("part").alias("title"),
                F.lit("normalpage").alias("kind"),
                "lang",
            )
        )

    def links(self) -> DataFrame:
        """One link per pair of consecutive lines; repeated pairs are parallel links.  The first line
        of some orders also links to a page that isn't there."""
        here = self.lines.df.select("order", "line", "lang", self._key("part").alias("from"))
        after = self.lines.df.select(
            "order", (F.col("line") - 1).alias("line"), self._key("part").alias("to")
        )
        dangling = self.lines.df.where("order % 11 = 0 AND line = 1").select(
            "lang",
            self._key("part").alias("from"),
            packed_key(F.col("part") + ABSENT, F.col("lang"), LANGUAGES).alias("to"),
        )
        found = here.join(after, ["order", "line"]).select("lang", "from", "to")
        return found.unionByName(dangling).select(
            "from",
            "to",
            F.col("lang").alias("fromLang"),
            F.col("lang").alias("toLang"),
            F.lit("interlink").alias("kind"),
        )

    def _brands(self) -> DataFrame:
        brand = F.regexp_extract("p_brand", r"(\d+)", 1).cast("bigint")
        parts = self._table("part", "p_partkey", "p_brand").select(
            F.col("p_partkey").alias("part"), (brand + CATEGORY_BASE).alias("category")
        )
        return self.lines.df.select("part", "lang").distinct().join(parts, "part")

    def category_pages(self) -> DataFrame:
        return (
            self._brands()
            .select("category", "lang")
            .distinct()
            .select(
                self._key("category").alias("sid"),
                F.col("category").alias("id"),
                F.concat(
                    F.lit("brand_"), (F.col("category") - CATEGORY_BASE).cast("string")
                ).alias("title"),
                F.lit("categorypage").alias("kind"),
                "lang",
            )
        )

    def category_links(self) -> DataFrame:
        return self._brands().select(
            self._key("part").alias("from"),
            self._key("category").alias("to"),
            F.col("lang").alias("fromLang"),
            F.col("lang").alias("toLang"),
            F.lit("categorylink").alias("kind"),
        )

    def language_link_dump(self, pages: DataFrame) -> DataFrame:
        """Each page and every other edition that has a page of its title, and links gone wrong."""
        offered = pages.select("title", F.col("lang").alias("toLang")).distinct()
        right = (
            pages.select("sid", "title", "lang")
            .join(offered, "title")
            .where(F.col("lang") != F.col("toLang"))
            .select("sid", "toLang", "title", "lang")
        )
        page_id, lang, title = F.col("id"), F.col("lang"), F.col("title")
        other = _another(lang)

        def link(when, sid, to, name, stated):
            return F.when(
                when,
                F.struct(
                    sid.alias("sid"), to.alias("toLang"), name.alias("title"), stated.alias("lang")
                ),
            )

        own = F.col("sid")
        wrong = F.array_compact(
            F.array(
                link(page_id % 19 == 2, own, other, F.concat(F.lit("lost_"), title), lang),
                link(
                    page_id % 23 == 4, packed_key(page_id + ABSENT, lang, LANGUAGES), lang, title, lang
                ),
                link(page_id % 29 == 6, own, lang, title, other),
                link(page_id % 31 == 8, own, other, F.concat(F.lit("Talk:"), title), lang),
                link(page_id % 37 == 1, own, F.lit(ELSEWHERE), title, lang),
            )
        )
        return right.unionByName(pages.select(F.explode(wrong).alias("_link")).select("_link.*"))

    # Dump text: the tables as lines, with the separators dumps are known to mix.

    def page_lines(self, pages: DataFrame) -> DataFrame:
        gap = F.when(F.col("id") % 3 == 0, "\t").when(F.col("id") % 3 == 1, "   ").otherwise(" ")
        lines = pages.select(
            F.concat(F.col("id").cast("string"), gap, "title", F.lit("  false false")).alias(
                "value"
            ),
            "lang",
        )
        # Too few fields, and no id.
        short = F.concat_ws(" ", F.col("id").cast("string"), "title")
        return self._with(lines, pages, F.col("id") % 13 == 5, short, F.lit("no page  here false"))

    def link_lines(self, links: DataFrame) -> DataFrame:
        source, target = F.col("from"), F.col("to")
        gap = F.when(source % 2 == 0, "\t").otherwise("   ")
        lines = links.select(
            F.concat(self._id(source), gap, self._id(target)).alias("value"),
            F.col("fromLang").alias("lang"),
        )
        named = links.withColumn("lang", F.col("fromLang"))
        arrow = F.concat_ws(" -> ", self._id(source), self._id(target))
        return self._with(lines, named, F.shiftright("from", 10) % 13 == 5, arrow, self._id(source))

    def category_link_lines(self, links: DataFrame) -> DataFrame:
        lines = links.select(
            F.concat(
                self._id(F.col("from")),
                F.lit(" page\t"),
                self._id(F.col("to")),
                F.lit("  category"),
            ).alias("value"),
            F.col("fromLang").alias("lang"),
        )
        named = links.withColumn("lang", F.col("fromLang"))
        short = F.concat(self._id(F.col("from")), F.lit(" page\tcategory"))
        return self._with(lines, named, F.shiftright("from", 10) % 13 == 5, short)

    def language_link_lines(self, dump: DataFrame) -> DataFrame:
        """The dump's rows; some also in the name of the edition that isn't loaded, some cut off."""
        row = lambda lang: F.concat(
            self._id(F.col("sid")), F.lit("\t"), "toLang", F.lit("  "), "title", F.lit(" \t"), lang
        )
        lines = dump.select(row(F.col("lang")).alias("value"), "lang")
        cut = F.concat(self._id(F.col("sid")), F.lit("\t"), "toLang")
        return self._with(
            lines, dump, F.shiftright("sid", 10) % 13 == 5, row(F.lit(ELSEWHERE)), cut
        )

    @staticmethod
    def _with(lines: DataFrame, rows: DataFrame, when, *more) -> DataFrame:
        added = rows.where(when).select(F.explode(F.array(*more)).alias("value"), "lang")
        return lines.unionByName(added)

    @staticmethod
    def _id(sid):
        return F.shiftright(sid, 10).cast("string")
