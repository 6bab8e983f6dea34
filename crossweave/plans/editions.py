"""The analyses over a folder of loaded dump tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossweave.operators import crossnet, reports
from crossweave.operators.candidates import find_articles
from crossweave.operators.linking import edge_table
from crossweave.plans import analyses, graph as graphs
from crossweave.plans.store import CANDIDATES, RANKED, ResultStore, TableSet
from crossweave.sources.tables import (
    get_or_build,
    load_id,
    read_language_links,
    read_links,
    read_pages,
    write_tsv,
)
from crossweave.workspace import Stored, Workspace


class Editions:
    """Some language editions of one collection, loaded by ``sources.dump.load_dump``.

    Tables shared by all analyses, and results, are written below ``analysis`` and the id of the load
    when first needed; after another load, a new object starts anew.
    """

    def __init__(
        self,
        ws: Workspace,
        table_dir: str,
        languages: Sequence[str],
        pivot: str = "en",
        fmt: str = "parquet",
    ):
        self.ws = ws
        self.spark: SparkSession = ws.spark
        self.table_dir = table_dir
        self.languages = sorted(set(languages))
        self.pivot = pivot
        self.fmt = fmt
        self.name = "_".join(self.languages)
        self.analysis = f"{table_dir}/analysis/{load_id(self.spark, table_dir)}"
        self.store = ResultStore(self.spark, f"{self.analysis}/results_{self.name}")
        self._graph: graphs.LinkGraph | None = None
        self._valid: Stored | None = None
        self._published: dict[str, DataFrame] | None = None

    def _table(self, name: str, build) -> Stored:
        path = f"{self.analysis}/{name}_{self.name}"
        return Stored(get_or_build(self.spark, path, build, self.fmt), path)

    def _pages(self) -> Stored:
        return Stored(read_pages(self.spark, self.table_dir, self.languages, fmt=self.fmt))

    def _language_links(self) -> Stored:
        return Stored(
            read_language_links(self.spark, self.table_dir, self.languages, fmt=self.fmt)
        )

    # Cross-links

    def _valid_links(self) -> Stored:
        """The consistent language links, which both the cross-net and its anomalies are made of."""
        if self._valid is None:
            links = self._language_links()
            valid = crossnet.consistent_links(self._pages(), links.df, link_rows=links.rows)
            self._valid = self.ws.save(valid, "validlinks")
        return self._valid

    def cross(self) -> crossnet.CrossNet:
        def build() -> DataFrame:
            return crossnet.cross_net_summary(self._valid_links().df)

        return crossnet.CrossNet(self._table("crossnet", build))

    def _cross_links(self) -> dict[str, DataFrame]:
        """The page universe and the anomalies, published together."""

        def build() -> dict[str, DataFrame]:
            cross, valid = self.cross(), self._valid_links()
            return {
                "universe": graphs.universe_pages(self._pages(), cross),
                "anomalies": crossnet.anomalies(cross, valid.df, link_rows=valid.rows),
            }

        if self._published is None:
            tables = TableSet(self.spark, f"{self.analysis}/crosslinks_{self.name}")
            self._published = tables.get_or_build(build)
        return self._published

    def pages(self) -> Stored:
        """The page universe."""
        return Stored(self._cross_links()["universe"])

    def anomalies(self) -> Stored:
        return Stored(self._cross_links()["anomalies"])

    def analyse_cross_links(self) -> None:
        """Write the cross-net, and the page universe with the anomalies, where missing."""
        self._cross_links()

    def anomaly_report(self) -> DataFrame:
        return crossnet.anomaly_report(self.anomalies(), self.pages().df)

    def graph(self) -> graphs.LinkGraph:
        if self._graph is None:
            cross = self.cross()
            links = Stored(read_links(self.spark, self.table_dir, self.languages, fmt=self.fmt))
            edges = edge_table(self.ws, links.df, cross.universe, link_rows=links.rows)
            self._graph = graphs.LinkGraph(self.ws, self.pages(), cross, edges)
        return self._graph

    # Queries by title.  The key of the article found is the number of its query.

    def _articles(self, titles: DataFrame) -> DataFrame:
        named = titles.select(F.col("title").alias("query_id"), "title").distinct()
        found = find_articles(named, self.pages().df, self.pivot)
        return self.ws.save(
            found.select(F.col("sid").alias("query_id"), F.col("query_id").alias("title")),
            "asked",
        ).df

    def _candidates(self, articles: DataFrame, step: int) -> Stored:
        pending = self.ws.save(self.store.pending(articles, CANDIDATES, step), "pending")
        if pending.rows:
            made = analyses.recommend(self.graph(), pending.df, step, self.pivot)
            self.store.append(pending.df, made.found.df, CANDIDATES, step)
        return self.store.load(self.ws, articles, CANDIDATES, step)

    def _ranked(self, articles: DataFrame, step: int, centrality: str) -> Stored:
        found = self._candidates(articles, step)
        pending = self.ws.save(self.store.pending(articles, RANKED, step, centrality), "pending")
        if pending.rows:
            mine = found.view(found.df.join(pending.df, "query_id", "left_semi"))
            ranked = analyses.rank(analyses.resume(self.graph(), mine, step), centrality)
            self.store.append(pending.df, ranked.df, RANKED, step, centrality)
        return self.store.load(self.ws, articles, RANKED, step, centrality)

    def recommend(self, titles: DataFrame, step: int) -> DataFrame:
        """The recommendation report for ``titles(title)`` of the pivot language."""
        found = self._candidates(self._articles(titles), step)
        return reports.recommendation_report(found, self.pages().df)

    def rank(
        self, titles: DataFrame, step: int, centrality: str, k: int = reports.TOP_K, exact: bool = False
    ) -> tuple[DataFrame, DataFrame]:
        """The top-k report and the statistics report for ``titles(title)``."""
        ranked = self._ranked(self._articles(titles), step, centrality)
        pages = self.pages().df
        return (
            reports.ranking_report(ranked, pages, k, exact),
            reports.ranking_statistics(self.ws, ranked, pages, k, exact),
        )

    def relatedness(self, pairs: DataFrame, step: int, centrality: str) -> DataFrame:
        """Similarity by language of ``pairs(pair_id, title_a, title_b)``."""
        return analyses.relate(self.graph(), pairs, step, centrality, self.pivot)

    # One title's reports as text files

    def _report_path(self, kind: str, title: str) -> str:
        place = title.replace("/", "%2F")
        return f"{self.analysis}/articles/{kind}_{place}_{self.name}"

    def _one(self, title: str) -> DataFrame:
        return self.spark.createDataFrame([(title,)], "title string")

    def write_recommendations(self, title: str, step: int) -> str:
        report = self.recommend(self._one(title), step).drop("query_id")
        path = self._report_path("recommendation", title)
        write_tsv(report, path, single_file=True)
        return path

    def write_ranking(
        self, title: str, step: int, centrality: str, k: int = reports.TOP_K
    ) -> tuple[str, str]:
        paths = []
        for kind, report in zip(
            (f"rank_top_{k}", "rank_stats"), self.rank(self._one(title), step, centrality, k)
        ):
            paths.append(self._report_path(kind, title))
            write_tsv(report.drop("query_id"), paths[-1], single_file=True)
        return paths[0], paths[1]
