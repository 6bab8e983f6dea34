"""The registered queries, over the whole graph derived from one folder of tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossweave.functions import maps
from crossweave.functions.keys import jvm_hash_key, key_builder
from crossweave.operators import crossnet, linking, neighborhood, reports
from crossweave.operators import centrality as measures
from crossweave.operators.skew import hot_join
from crossweave.plans import analyses, graph as graphs, store, views
from crossweave.plans.editions import Editions
from crossweave.sources import dump, tables
from crossweave.sources.derived import LANGUAGES, PIVOT, DerivedGraph
from crossweave.workspace import Stored, Workspace

STEP = 2
# Editions the scans select.
SCANNED = LANGUAGES[1:4]


class Corpus:
    """The loaded tables of one folder, each written the first time it is needed."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.ws = Workspace(spark)
        self.source = DerivedGraph(self.ws, sf_dir)

    def _save(self, df: DataFrame, name: str) -> Stored:
        return self.ws.save(df, name)

    @cached_property
    def pages(self) -> Stored:
        return self._save(self.source.pages(), "pages")

    @cached_property
    def category_pages(self) -> Stored:
        return self._save(self.source.category_pages(), "categories")

    @cached_property
    def links(self) -> Stored:
        return self._save(self.source.links(), "links")

    @cached_property
    def category_links(self) -> Stored:
        return self._save(self.source.category_links(), "categorylinks")

    @cached_property
    def dump(self) -> Stored:
        return self._save(self.source.language_link_dump(self.pages.df), "dump")

    @cached_property
    def language_links(self) -> Stored:
        return graphs.resolve(self.ws, self.dump, self.pages)

    def graph(self, ws: Workspace) -> graphs.LinkGraph:
        return graphs.link_graph(ws, self.pages, self.language_links, self.links, resolved=True)

    def cross(self, ws: Workspace) -> crossnet.CrossNet:
        return graphs.cross_links(ws, self.pages, self.language_links, resolved=True)


_corpora: dict[tuple, Corpus] = {}


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    """The corpus of a folder, loaded anew in a new session or when its files have changed."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/*.parquet")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    state = tuple((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files)
    key = (spark.sparkContext.applicationId, sf_dir, state)
    if key not in _corpora:
        _corpora[key] = Corpus(spark, sf_dir)
    return _corpora[key]


def _comparable(df: DataFrame, *columns: str) -> DataFrame:
    """Scores in single precision, where the order of additions no longer shows."""
    return df.withColumns({c: F.col(c).cast("float").cast("double") for c in columns})


Query = Callable[[Corpus, Workspace], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def load_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load everything from the order tables again and count the rows of each table."""
    fresh = Corpus(spark, sf_dir)
    names = ("pages", "category_pages", "links", "category_links", "dump", "language_links")
    counts = [
        getattr(fresh, n).df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("name"), "rows")
        for n in names
    ]
    result = counts[0]
    for count in counts[1:]:
        result = result.unionByName(count)
    return result


# Scans


@query
def scan_pages(c: Corpus, ws: Workspace) -> DataFrame:
    everything = c.pages.df.unionByName(c.category_pages.df)
    return tables.select_pages(everything, SCANNED, categories=True)


@query
def scan_links(c: Corpus, ws: Workspace) -> DataFrame:
    everything = c.links.df.unionByName(c.category_links.df)
    return tables.select_links(everything, SCANNED)


@query
def scan_language_links(c: Corpus, ws: Workspace) -> DataFrame:
    return tables.select_language_links(c.language_links.df, SCANNED)


# Parsers


def _key():
    return key_builder("packed", LANGUAGES)


@query
def parse_pages(c: Corpus, ws: Workspace) -> DataFrame:
    return dump.parse_lines(c.source.page_lines(c.pages.df), dump.NORMAL_PAGE, _key())


@query
def parse_category_pages(c: Corpus, ws: Workspace) -> DataFrame:
    lines = c.source.page_lines(c.category_pages.df)
    return dump.parse_lines(lines, dump.CATEGORY_PAGE, _key())


@query
def parse_pagelinks(c: Corpus, ws: Workspace) -> DataFrame:
    return dump.parse_lines(c.source.link_lines(c.links.df), dump.PAGE_LINK, _key())


@query
def parse_categorylinks(c: Corpus, ws: Workspace) -> DataFrame:
    lines = c.source.category_link_lines(c.category_links.df)
    return dump.parse_lines(lines, dump.CATEGORY_LINK, _key())


@query
def parse_langlinks(c: Corpus, ws: Workspace) -> DataFrame:
    lines = c.source.language_link_lines(c.dump.df)
    return dump.parse_lines(
        lines, dump.LANGUAGE_LINK, _key(), where=dump.article_filter(LANGUAGES)
    )


@query
def parse_raw_langlinks(c: Corpus, ws: Workspace) -> DataFrame:
    lines = c.source.language_link_lines(c.dump.df)
    return dump.parse_lines(lines, dump.RAW_LANGUAGE_LINK, _key())


# Dumps: lines written as files, loaded into tables, and read back.


def _loaded(c: Corpus, ws: Workspace) -> str:
    lines = {
        dump.NORMAL_PAGE: c.source.page_lines(c.pages.df),
        dump.PAGE_LINK: c.source.link_lines(c.links.df),
        dump.LANGUAGE_LINK: c.source.language_link_lines(c.dump.df),
    }
    for kind, of_all in lines.items():
        for lang in LANGUAGES:
            own = of_all.where(F.col("lang") == lang).select("value")
            own.write.text(f"{ws.root}/dump/{lang}/{dump.DUMP_FOLDERS[kind]}")
    dump.load_dump(ws.spark, f"{ws.root}/dump", f"{ws.root}/tables", LANGUAGES, list(lines))
    return f"{ws.root}/tables"


@query
def dump_links(c: Corpus, ws: Workspace) -> DataFrame:
    return tables.read_links(ws.spark, _loaded(c, ws), SCANNED).drop("kind")


@query
def dump_language_links(c: Corpus, ws: Workspace) -> DataFrame:
    return tables.read_language_links(ws.spark, _loaded(c, ws), LANGUAGES)


@query
def dump_unresolved(c: Corpus, ws: Workspace) -> DataFrame:
    return tables.read_language_link_dump(ws.spark, _loaded(c, ws), SCANNED).drop("kind")


@query
def plugin_lines(c: Corpus, ws: Workspace) -> DataFrame:
    """Lines of a format that a caller has added, ``id;title;flag``, parsed to pages with the flag."""
    dump.PARSERS["flaggedpage"] = dump.ParseSpec(
        r"^(\d+);([^;]*);(yes|no)$",
        lambda group, lang, key: {
            "sid": key(group(1), lang),
            "title": group(2),
            "flagged": group(3) == "yes",
            "lang": lang,
        },
    )
    flag = F.when(F.col("id") % 17 == 3, "maybe").when(F.col("id") % 2 == 0, "yes").otherwise("no")
    lines = c.pages.df.select(F.concat_ws(";", "id", "title", flag).alias("value"), "lang")
    return dump.parse_lines(lines, "flaggedpage", _key(), where=F.col("title") != "part_10")


@query
def jvm_keys(c: Corpus, ws: Workspace) -> DataFrame:
    return c.pages.df.select(
        "id", "lang", jvm_hash_key(F.col("id"), F.col("lang")).alias("jvm_key")
    )


# Cross-net


@query
def resolve_language_links(c: Corpus, ws: Workspace) -> DataFrame:
    return linking.resolve_language_links(
        c.dump.df, c.pages.df, dump_rows=c.dump.rows, page_rows=c.pages.rows
    )


@query
def cross_net(c: Corpus, ws: Workspace) -> DataFrame:
    links = crossnet.consistent_links(
        c.pages, c.language_links.df, link_rows=c.language_links.rows
    )
    return crossnet.cross_net(links)


@query
def cross_net_repaired(c: Corpus, ws: Workspace) -> DataFrame:
    return c.cross(ws).repaired.df.select("v", "lang", "member")


@query
def anomalous_pages(c: Corpus, ws: Workspace) -> DataFrame:
    return c.cross(ws).anomalous_pages


def _anomalies(c: Corpus, ws: Workspace, cross: crossnet.CrossNet) -> DataFrame:
    rows = c.language_links.rows
    links = crossnet.consistent_links(c.pages, c.language_links.df, link_rows=rows, resolved=True)
    return crossnet.anomalies(cross, links, link_rows=rows)


@query
def anomalies(c: Corpus, ws: Workspace) -> DataFrame:
    return _anomalies(c, ws, c.cross(ws))


@query
def anomaly_report(c: Corpus, ws: Workspace) -> DataFrame:
    cross = c.cross(ws)
    found = ws.save(_anomalies(c, ws, cross), "anomalies")
    pages = ws.save(graphs.universe_pages(c.pages, cross), "universe")
    return crossnet.anomaly_report(found, pages.df)


@query
def universe(c: Corpus, ws: Workspace) -> DataFrame:
    return graphs.universe_pages(c.pages, c.cross(ws))


@query
def universe_view(c: Corpus, ws: Workspace) -> DataFrame:
    nested = views.nested_universe(c.graph(ws))
    ids = F.array_sort(maps.all_ids(F.col("crossNet")))
    return nested.select(
        "sid",
        "title",
        "lang",
        F.array_join(F.array_sort(F.map_keys("crossNet")), ",").alias("languages"),
        F.array_join(F.transform(ids, lambda i: i.cast("string")), ",").alias("members"),
    )


@query
def valid_links(c: Corpus, ws: Workspace) -> DataFrame:
    return linking.valid_links(
        c.links.df.drop("kind"), c.cross(ws).universe, link_rows=c.links.rows
    )


@query
def edge_weights(c: Corpus, ws: Workspace) -> DataFrame:
    return c.graph(ws).edges.df


# Neighbourhoods


@query
def ego_net_1(c: Corpus, ws: Workspace) -> DataFrame:
    return neighborhood.ego_net(ws, c.graph(ws).edges, 1).df


@query
def ego_net_2(c: Corpus, ws: Workspace) -> DataFrame:
    return neighborhood.ego_net(ws, c.graph(ws).edges, 2).df


@query
def ego_net_3(c: Corpus, ws: Workspace) -> DataFrame:
    return neighborhood.ego_net(ws, c.graph(ws).edges, 3).df


@query
def translated_net(c: Corpus, ws: Workspace) -> DataFrame:
    graph = c.graph(ws)
    net = neighborhood.ego_net(ws, graph.edges, STEP)
    return neighborhood.translated_net(net, graph.cross.repaired)


@query
def map_functions(c: Corpus, ws: Workspace) -> DataFrame:
    """What the functions on maps of sets say of each page's counterparts before repair."""
    # The least and greatest counterpart of a language stand for its set, so that maps stay small.
    ends = F.array_distinct(F.array("lo", "hi"))
    nested = c.cross(ws).table.df.groupBy(F.col("v").alias("sid"), F.col("v_lang").alias("lang")).agg(
        F.map_from_entries(F.collect_list(F.struct("lang", ends))).alias("sets")
    )
    sets, sid = F.col("sets"), F.col("sid")
    zeros = maps.constant_map(maps.all_ids(sets), 0.5)
    other = F.when(F.col("lang") == PIVOT, F.lit(LANGUAGES[1])).otherwise(F.lit(PIVOT))
    merged = maps.merge_maps(sets, F.create_map(F.lit("r9"), F.array(sid)))
    return nested.select(
        "sid",
        F.size(maps.unambiguous(sets)).alias("single"),
        F.size(maps.ambiguous(sets)).alias("several"),
        maps.is_anomalous(sets).alias("anomalous"),
        maps.only_id(maps.ids_of(maps.unambiguous(sets), other)).alias("counterpart"),
        F.size(maps.ids_of(sets, F.lit("r9"))).alias("unknown"),
        maps.map_overlaps(sets, F.array(sid)).alias("has_itself"),
        maps.map_overlaps(sets, F.array(sid + 1)).alias("has_next"),
        F.size(maps.ids_of(merged, F.lit("r9"))).alias("merged"),
        F.aggregate(F.map_values(zeros), F.lit(0.0), lambda a, x: a + x).alias("halves"),
    )


# Recommendation: every page of the pivot edition is a query.


def _titles(graph: graphs.LinkGraph) -> DataFrame:
    pivot = graph.pages.df.where(F.col("lang") == PIVOT)
    return pivot.groupBy("title").agg(F.min("sid").alias("query_id"))


def _by_title(c: Corpus, ws: Workspace) -> analyses.Recommendations:
    graph = c.graph(ws)
    return analyses.recommend(graph, _titles(graph), STEP, PIVOT)


@query
def candidates_everywhere(c: Corpus, ws: Workspace) -> DataFrame:
    return analyses.recommend_everywhere(c.graph(ws), STEP).found.df


@query
def candidates_by_title(c: Corpus, ws: Workspace) -> DataFrame:
    return _by_title(c, ws).found.df


@query
def recommendation_report(c: Corpus, ws: Workspace) -> DataFrame:
    made = _by_title(c, ws)
    return reports.recommendation_report(made.found, made.graph.pages.df)


@query
def candidates_half_absent(c: Corpus, ws: Workspace) -> DataFrame:
    """As many titles again that no page has: they add no rows, and nothing in the plan asks for them first."""
    graph = c.graph(ws)
    titles = _titles(graph)
    absent = titles.select(F.concat(F.lit("lost_"), "title").alias("title"), (-F.col("query_id")).alias("query_id"))
    return analyses.recommend(graph, titles.unionByName(absent), STEP, PIVOT).found.df


REPORT = "query_id bigint, from bigint, from_title string, to bigint, to_title string, lang string"


@query
def report_text(c: Corpus, ws: Workspace) -> DataFrame:
    """The recommendation report written as one text file and read back, with titles that hold what
    text files trip over."""
    made = _by_title(c, ws)
    report = reports.recommendation_report(made.found, made.graph.pages.df)
    odd = (
        F.when(F.col("to") % 7 == 0, F.concat("to_title", F.lit("\ttab")))
        .when(F.col("to") % 7 == 1, F.concat(F.lit('"'), "to_title", F.lit("\\t\\N\n")))
        .when(F.col("to") % 7 == 2, F.lit(""))
        .when(F.col("to") % 7 == 3, F.lit(None))
        .otherwise(F.col("to_title"))
    )
    tables.write_report(report.withColumn("to_title", odd), f"{ws.root}/report", single_file=True)
    return tables.read_report(ws.spark, f"{ws.root}/report", REPORT)


# Results kept between runs


def _some(df: DataFrame, *rests: int) -> DataFrame:
    """Rows of the queries whose title number leaves one of the rests modulo 3."""
    return df.where((F.floor(F.col("query_id") / 1024) % 3).isin(*rests))


@query
def store_runs(c: Corpus, ws: Workspace) -> DataFrame:
    """Two runs answer overlapping titles, a third was never committed: each title is read once."""
    made = _by_title(c, ws)
    titles = ws.save(_titles(made.graph), "titles").df
    results = store.ResultStore(ws.spark, f"{ws.root}/store")
    for rests in ((0, 2), (1, 2)):
        results.append(_some(titles, *rests), _some(made.found.df, *rests), store.CANDIDATES, STEP)
    lost = made.found.df.select("query_id", F.col("to").alias("from"), F.col("from").alias("to"))
    results.write(lost, store.CANDIDATES, STEP)
    return results.load(ws, titles, store.CANDIDATES, STEP).df


@query
def store_pending(c: Corpus, ws: Workspace) -> DataFrame:
    """A second run computes only the titles without an answer at this step; ``second`` tells which."""
    graph = c.graph(ws)
    titles = ws.save(_titles(graph), "titles").df
    results = store.ResultStore(ws.spark, f"{ws.root}/store")
    first = _some(titles, 0)
    made = analyses.recommend(graph, first, STEP, PIVOT)
    results.append(first, made.found.df, store.CANDIDATES, STEP)
    # Answers of another step don't count.
    results.append(titles, made.found.df.limit(0), store.CANDIDATES, STEP + 1)
    pending = ws.save(results.pending(titles, store.CANDIDATES, STEP), "pending").df
    more = analyses.recommend(graph, pending, STEP, PIVOT)
    run = results.append(pending, more.found.df, store.CANDIDATES, STEP)
    answered = results.done(store.CANDIDATES, STEP).select("query_id", (F.col("run") == run).alias("second"))
    return results.load(ws, titles, store.CANDIDATES, STEP).df.join(answered, "query_id")


@query
def page_status(c: Corpus, ws: Workspace) -> DataFrame:
    """Every page with the step of its stored candidates and whether they are ranked."""
    made = _by_title(c, ws)
    titles = ws.save(_titles(made.graph), "titles").df
    results = store.ResultStore(ws.spark, f"{ws.root}/store")
    results.append(_some(titles, 0, 1), _some(made.found.df, 0, 1), store.CANDIDATES, STEP)
    mine = made.found.view(_some(made.found.df, 1))
    ranked = analyses.rank(replace(made, found=mine), "HITS")
    results.append(_some(titles, 1), ranked.df, store.RANKED, STEP, "HITS")
    return results.page_status(made.graph.pages.df, STEP, "HITS")


def _editions(c: Corpus, ws: Workspace) -> Editions:
    """The editions of the loaded dump, with what an earlier object has stored."""
    folder = _loaded(c, ws)
    Editions(ws, folder, LANGUAGES, PIVOT).analyse_cross_links()
    return Editions(ws, folder, LANGUAGES, PIVOT)


@query
def stored_universe(c: Corpus, ws: Workspace) -> DataFrame:
    return _editions(c, ws).pages().df


@query
def stored_anomalies(c: Corpus, ws: Workspace) -> DataFrame:
    return _editions(c, ws).anomalies().df


@query
def cross_link_job(c: Corpus, ws: Workspace) -> DataFrame:
    """The cross-link job's two tables, read back together; a run that was never published isn't seen."""
    cross = c.cross(ws)
    made = {"universe": graphs.universe_pages(c.pages, cross), "anomalies": _anomalies(c, ws, cross)}
    tables_of_job = store.TableSet(ws.spark, f"{ws.root}/crosslinks")
    tables_of_job.write({"universe": made["universe"].limit(1)})
    found = tables_of_job.get_or_build(lambda: made)
    none = F.lit(None).cast("bigint")
    return (
        found["universe"]
        .select(F.lit("universe").alias("name"), "sid", "lang", none.alias("to"))
        .unionByName(found["anomalies"].select(F.lit("anomalies").alias("name"), F.col("from").alias("sid"), "lang", "to"))
    )


# Centralities


def _net(c: Corpus, ws: Workspace) -> tuple[Stored, Stored]:
    edges = c.graph(ws).edges
    return neighborhood.ego_net(ws, edges, STEP), edges


@query
def pagerank_ego(c: Corpus, ws: Workspace) -> DataFrame:
    return _comparable(measures.page_rank(ws, *_net(c, ws)), "score")


@query
def reciprocal_vectors(c: Corpus, ws: Workspace) -> DataFrame:
    return _comparable(measures.reciprocal_page_rank(ws, *_net(c, ws)), "weight")


@query
def hits_unit(c: Corpus, ws: Workspace) -> DataFrame:
    return measures.authority_vectors(ws, *_net(c, ws))


@query
def hits_hub(c: Corpus, ws: Workspace) -> DataFrame:
    return measures.hub_score(ws, *_net(c, ws))


@query
def hits_kleinberg(c: Corpus, ws: Workspace) -> DataFrame:
    return _comparable(measures.hub_authority(ws, *_net(c, ws)), *measures.HUB_AUTHORITY)


def in_degree_share(ws: Workspace, net: Stored, edges: Stored) -> DataFrame:
    """A caller's own measure: a member's share of the links inside the neighbourhood."""
    inside = ws.save(measures.induced_links(net, edges), "inside").df
    received = inside.groupBy("ego", F.col("dst").alias("member")).agg(F.sum("n").alias("own"))
    total = inside.groupBy("ego").agg(F.sum("n").alias("links"))
    share = (F.col("own") / F.col("links")).alias("weight")
    return received.join(total, "ego").select("ego", "member", share)


@query
def plugin_measure(c: Corpus, ws: Workspace) -> DataFrame:
    """Similarity of all pages and their candidates under a measure that a caller has added."""
    measures.CENTRALITIES["IN_DEGREE_SHARE"] = in_degree_share
    net, edges = _net(c, ws)
    weights = measures.vectors(ws, net, edges, "IN_DEGREE_SHARE")
    return _comparable(weights.df, "weight")


# Ranking


@query
def rank_everywhere_hits(c: Corpus, ws: Workspace) -> DataFrame:
    made = analyses.recommend_everywhere(c.graph(ws), STEP)
    return _comparable(analyses.rank(made, "HITS").df, "score")


@query
def rank_everywhere_rpr(c: Corpus, ws: Workspace) -> DataFrame:
    made = analyses.recommend_everywhere(c.graph(ws), STEP)
    return _comparable(analyses.rank(made, "RPR").df, "score")


@query
def rank_by_title_hits(c: Corpus, ws: Workspace) -> DataFrame:
    return _comparable(analyses.rank(_by_title(c, ws), "HITS").df, "score")


@query
def rank_by_title_rpr(c: Corpus, ws: Workspace) -> DataFrame:
    return _comparable(analyses.rank(_by_title(c, ws), "RPR").df, "score")


def _rank_top_k(c: Corpus, ws: Workspace, centrality: str) -> DataFrame:
    made = _by_title(c, ws)
    ranked = analyses.rank(made, centrality)
    return _comparable(reports.ranking_report(ranked, made.graph.pages.df), "jaccard")


@query
def rank_top_k(c: Corpus, ws: Workspace) -> DataFrame:
    return _rank_top_k(c, ws, "HITS")


@query
def rank_top_k_rpr(c: Corpus, ws: Workspace) -> DataFrame:
    return _rank_top_k(c, ws, "RPR")


def _rank_stats(c: Corpus, ws: Workspace, centrality: str) -> DataFrame:
    made = _by_title(c, ws)
    ranked = analyses.rank(made, centrality)
    stats = reports.ranking_statistics(ws, ranked, made.graph.pages.df)
    scores = [n for n in stats.columns if n not in ("query_id", "from", "from_title", "lang")]
    return _comparable(stats, *scores)


@query
def rank_stats(c: Corpus, ws: Workspace) -> DataFrame:
    return _rank_stats(c, ws, "HITS")


@query
def rank_stats_rpr(c: Corpus, ws: Workspace) -> DataFrame:
    return _rank_stats(c, ws, "RPR")


# Relatedness: every page link of the pivot edition gives a pair of titles.


def _related(c: Corpus, ws: Workspace, centrality: str, times: int = 1) -> DataFrame:
    graph = c.graph(ws)
    titled = graph.pages.df.where(F.col("lang") == PIVOT).select("sid", "title")
    pairs = graph.edges.df
    for end, letter in (("from", "a"), ("to", "b")):
        named = titled.select(F.col("sid").alias(end), F.col("title").alias(f"title_{letter}"))
        edges = graph.edges
        pairs = hot_join(pairs, named, end, left_rows=edges.rows, left_profile=edges.df)
    pairs = pairs.select(
        F.concat_ws(" ", "title_a", "title_b").alias("pair_id"), "title_a", "title_b"
    ).distinct()
    for _ in range(times - 1):
        pairs = pairs.unionByName(pairs)
    return _comparable(analyses.relate(graph, pairs, STEP, centrality, PIVOT), "jaccard")


@query
def relatedness_hits(c: Corpus, ws: Workspace) -> DataFrame:
    return _related(c, ws, "HITS")


@query
def relatedness_rpr(c: Corpus, ws: Workspace) -> DataFrame:
    return _related(c, ws, "RPR")


@query
def relatedness_repeated(c: Corpus, ws: Workspace) -> DataFrame:
    """Pairs asked for twice get what they get once."""
    return _related(c, ws, "RPR", times=2)


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bound(function: Query) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: function(corpus(spark, sf_dir), Workspace(spark))

    return {"load_corpus": load_corpus, **{name: bound(f) for name, f in QUERIES.items()}}
