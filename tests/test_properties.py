import pytest
from pyspark.sql import functions as F

from crossweave.operators import centrality as measures
from crossweave.operators.neighborhood import ego_net
from crossweave.operators.similarity import pair_similarity
from crossweave.plans import analyses
from crossweave.plans.workload import corpus

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def loaded(spark):
    return corpus(spark, SMALL)


@pytest.fixture
def graph(loaded, ws):
    return loaded.graph(ws)


def test_frontier_expansion_equals_naive(ws, graph):
    net = ego_net(ws, graph.edges, 3)
    naive = graph.edges.df.select(F.col("from").alias("ego"), F.col("to").alias("member"))
    onward = naive.select(F.col("ego").alias("member"), F.col("member").alias("next"))
    for _ in range(2):
        grown = naive.join(onward, "member").select("ego", F.col("next").alias("member"))
        naive = naive.union(grown).distinct()
    mine = net.df.select("ego", "member")
    assert mine.exceptAll(naive).isEmpty() and naive.exceptAll(mine).isEmpty()


def test_restricted_egos(ws, graph):
    egos = ws.save(graph.edges.df.select(F.col("from").alias("ego")).distinct().orderBy("ego").limit(5), "e")
    some = ego_net(ws, graph.edges, 2, egos).df
    expected = ego_net(ws, graph.edges, 2).df.join(egos.df, "ego", "left_semi")
    assert some.exceptAll(expected).isEmpty() and some.count() == expected.count()


def test_candidates_are_new_and_in_the_receivers_language(ws, graph):
    made = analyses.recommend_everywhere(graph, 2)
    found, pages = made.found.df, graph.pages.df
    assert found.join(graph.edges.df, ["from", "to"], "left_semi").isEmpty()
    langs = found.join(pages.select(F.col("sid").alias("from"), F.col("lang").alias("a")), "from").join(
        pages.select(F.col("sid").alias("to"), F.col("lang").alias("b")), "to"
    )
    assert langs.where("a <> b").isEmpty() and langs.count() == made.found.rows


def test_repaired_cross_net(graph):
    repaired = graph.cross.repaired.df
    assert repaired.groupBy("v", "lang").count().where("count <> 1").isEmpty()
    assert graph.cross.universe.df.count() == graph.cross.universe.df.distinct().count()


def test_ranks_add_up(ws, graph):
    net = ego_net(ws, graph.edges, 2)
    ranks = measures.page_rank(ws, net, graph.edges)
    off = ranks.groupBy("ego").agg((F.sum("score") - F.count("*")).alias("d")).where("abs(d) > 1e-9")
    assert off.isEmpty() and ranks.count() == net.rows


def test_unit_similarity_is_set_jaccard(ws, graph):
    net = ego_net(ws, graph.edges, 2)
    weights = measures.vectors(ws, net, graph.edges, "HITS")
    sets = {r.ego: set(r.m) for r in net.df.groupBy("ego").agg(F.collect_set("member").alias("m")).collect()}
    egos = sorted(sets)[:30]
    wanted = [(a, b) for a in egos for b in egos]
    pairs = ws.save(ws.spark.createDataFrame(wanted, "from bigint, to bigint"), "pairs")
    for unit in (True, False):
        for r in pair_similarity(ws, pairs, weights, unit=unit).collect():
            a, b = sets[r["from"]], sets[r.to]
            assert r.score == pytest.approx(len(a & b) / len(a | b))


def test_one_title_alone_or_among_all(ws, graph):
    """A query's result doesn't depend on the other queries of the job."""
    pivot = graph.pages.df.where("lang = 'r0'").groupBy("title").agg(F.min("sid").alias("query_id"))
    everything = analyses.rank(analyses.recommend(graph, pivot, 2, "r0"), "RPR")
    few = pivot.where("title LIKE '%7'").orderBy("title").limit(3)
    alone = analyses.rank(analyses.recommend(graph, few, 2, "r0"), "RPR")
    keys = ["query_id", "from", "to"]
    expected = everything.df.join(few, "query_id", "left_semi")
    both = expected.join(alone.df.withColumnRenamed("score", "other"), keys, "full")
    assert both.count() == alone.rows == expected.count() > 0
    assert both.where("other IS NULL OR score IS NULL OR abs(score - other) > 1e-9").isEmpty()
