"""Results don't depend on whether keys count as hot or vectors as long."""

import pyarrow as pa
import pytest
from conftest import rows
from pyspark.sql import functions as F

from crossweave.operators import candidates, centrality, neighborhood, similarity, skew
from crossweave.operators.skew import hot_join
from crossweave.plans import analyses
from crossweave.plans.workload import QUERIES, corpus

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_hot_join(spark, how):
    # A third of the left rows and many right rows have key 0; rows repeat.
    left = spark.range(600).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40).alias("k"), (F.col("id") % 50).alias("a")
    )
    right = spark.range(90).select(
        F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 30).alias("k"), F.col("id").alias("b")
    )
    plain = left.join(right, "k", how)
    salted = hot_join(left, right, "k", how, left_rows=600, right_rows=90, hot_rows=20)
    assert sorted(salted.columns) == sorted(plain.columns)
    assert rows(salted.select(plain.columns)) == rows(plain)
    assert "_pl" in salted._jdf.queryExecution().toString()


def test_hot_rows_are_spread(spark):
    # Ten parts of some 100 rows each, by what the rows hold.
    left = spark.range(1000).select(F.lit(7).alias("k"), F.col("id").alias("a"))
    parts = left.groupBy(skew._spread(left, F.lit(10)).alias("part")).count().collect()
    assert len(parts) == 10
    assert all(50 <= r["count"] <= 200 for r in parts)


def test_equal_hot_rows_all_come_through(spark):
    left = spark.range(1000).select(F.lit(7).alias("k"), F.lit(1).alias("a")).repartition(4)
    right = spark.range(1).select(F.lit(7).alias("k"), F.lit(2).alias("b"))
    salted = hot_join(left, right, "k", left_rows=1000, hot_rows=100)
    assert salted.count() == 1000


def test_small_tables_join_plainly(spark):
    left = spark.range(10).withColumnRenamed("id", "k")
    plan = hot_join(left, left, "k", left_rows=10)._jdf.queryExecution().toString()
    assert "xxhash64" not in plan


def test_profile_of_another_table(spark):
    base = spark.range(300).select((F.col("id") % 2).alias("e"), F.col("id").alias("m"))
    left = base.select("e", F.lit("x").alias("lang"), (F.col("m") * 2).alias("t"))
    right = spark.sql("SELECT * FROM VALUES (0L, 'x', 9), (1L, 'y', 8) AS t(e, lang, d)")
    salted = hot_join(
        left, right, ["e", "lang"], left_rows=300, hot_on=["e"], left_profile=base, hot_rows=50
    )
    plain = left.join(right, ["e", "lang"])
    assert rows(salted.select(plain.columns)) == rows(plain)


@pytest.mark.parametrize(
    "name",
    "anomaly_report ego_net_2 translated_net rank_by_title_rpr rank_stats relatedness_hits".split(),
)
def test_queries_with_everything_hot(spark, ws, monkeypatch, name):
    loaded = corpus(spark, SMALL)
    plain = QUERIES[name](loaded, ws)
    key = lambda row: tuple((x is not None, x) for x in row)
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=key)
    expected = rows(plain)
    monkeypatch.setattr(skew, "HOT_ROWS", 3)
    monkeypatch.setattr(similarity, "PACKED_MEMBERS", 12)
    monkeypatch.setattr(centrality, "GROUP_ROWS", 500)
    salted = QUERIES[name](loaded, ws)
    assert salted.columns == plain.columns
    got = rows(salted)
    assert len(got) == len(expected)
    for a, b in zip(got, expected):
        for x, y in zip(a, b):
            assert x == (pytest.approx(y, rel=1e-5) if isinstance(y, float) else y)


def test_without_hot_keys_rows_get_no_part_numbers(spark):
    """Tables long enough for hot keys that have none are joined plainly."""
    left = spark.range(600).select((F.col("id") % 200).alias("k"), F.col("id").alias("a"))
    joined = hot_join(left, left.withColumnRenamed("a", "b"), "k", left_rows=600, right_rows=600, hot_rows=50)
    plan = joined._jdf.queryExecution().toString()
    assert "_pl" not in plan and "xxhash64" not in plan
    assert joined.count() == 1800


def test_hot_keys_are_found_in_shared_buckets(spark, monkeypatch):
    monkeypatch.setattr(skew, "BUCKETS", 2)
    keys = F.when(F.col("id") < 100, None).otherwise(F.col("id") % 100).alias("k")
    shares = skew._shares(spark.range(1000).select(keys), ["k"], 40, "n")
    assert rows(shares) == [(None, 3)]


def test_pages_of_one_query_each_need_no_table_of_distinct_pairs(spark, ws, monkeypatch):
    names, save = [], type(ws).save
    monkeypatch.setattr(type(ws), "save", lambda self, df, name: names.append(name) or save(self, df, name))
    QUERIES["rank_by_title_hits"](corpus(spark, SMALL), ws)
    assert "ranked" in names and "compared" not in names


def _saved(ws, monkeypatch):
    names, save = [], type(ws).save
    monkeypatch.setattr(type(ws), "save", lambda self, df, name: names.append(name) or save(self, df, name))
    return names


def test_many_pairs_are_scored_in_parts(spark, ws, monkeypatch):
    """No write deals out all pairs with their vectors, nor the candidates beside what can be reached."""
    loaded, key = corpus(spark, SMALL), lambda row: tuple((x is not None, x) for x in row)
    expected = sorted((tuple(r) for r in QUERIES["rank_stats"](loaded, ws).collect()), key=key)
    names = _saved(ws, monkeypatch)
    monkeypatch.setattr(similarity, "PARTED_PAIRS", 10)
    got = sorted((tuple(r) for r in QUERIES["rank_stats"](loaded, ws).collect()), key=key)
    assert len(got) == len(expected)
    for a, b in zip(got, expected):
        for x, y in zip(a, b):
            # The order of additions shows in a skewness near 0.
            assert x == (pytest.approx(y, rel=1e-5, abs=1e-9) if isinstance(y, float) else y)
    assert names.count("scored") == similarity.PARTS
    assert {"useful", "alive"} < set(names)


def test_names_travel_in_lists(spark, ws):
    """Members are dealt out once with all their names, not once per language."""
    net = ws.save(spark.sql("SELECT * FROM VALUES (1L, 10L), (1L, 11L), (2L, 10L) AS t(ego, member)"), "net")
    names = "(10L, 'a', 'b', 20L), (10L, 'a', 'c', 30L), (11L, 'a', 'b', 20L), (11L, 'a', 'a', 11L)"
    repaired = ws.save(spark.sql(f"SELECT * FROM VALUES {names} AS t(v, v_lang, lang, member)"), "repaired")
    found = neighborhood.translated_net(net, repaired)
    assert rows(found) == [(1, "a", 11), (1, "b", 20), (1, "c", 30), (2, "b", 20), (2, "c", 30)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning(ego" in line]
    assert exchanges and all("REPARTITION_BY_COL" in line for line in exchanges)


@pytest.mark.parametrize("parted", [False, True])
def test_candidates_of_a_query_are_looked_through_in_one_task(spark, ws, monkeypatch, parted):
    """No rows of what can be reached are dealt out and made distinct, unless a query has too many candidates;
    scores that were written in parts aren't written once more."""
    if parted:
        monkeypatch.setattr(similarity, "PARTED_PAIRS", 10)
    loaded, names = corpus(spark, SMALL), _saved(ws, monkeypatch)
    got = rows(QUERIES["rank_by_title_hits"](loaded, ws))
    assert "alive" in names and not {"rankable", "alone"} & set(names)
    assert ("ranked" in names) != parted
    monkeypatch.setattr(analyses, "QUERY_ROWS", 3)
    assert rows(QUERIES["rank_by_title_hits"](loaded, ws)) == got
    assert {"rankable", "alone"} < set(names)


def test_which_candidates_are_alive():
    table = pa.table(
        {
            "query_id": ["a", "a", "a", "a", "b", "b", "b"],
            "from": [1, 1, 2, 3, 1, 1, 9],
            "to": [10, 11, 20, 30, 10, 20, 90],
            # In "a", 10 and 20 deliver to one another, 11 to a page of another query, 30 to nothing; in "b"
            # nothing that is delivered to is a candidate.
            "dsts": pa.array([[20, 5], [90], [10], None, [5, 30], None, []], pa.list_(pa.int64())),
        }
    )
    found = candidates._looked_through(table).to_pydict()
    assert sorted(zip(*found.values())) == [
        ("a", 1, 10, True), ("a", 2, 20, True), ("a", 3, 30, False),
        ("b", 1, 10, False), ("b", 1, 20, False), ("b", 9, 90, False),
    ]


def test_hot_ends_of_pairs_are_looked_for_once(spark, ws, monkeypatch):
    """However many parts are scored, the rows of each end are counted by bucket once where no key is hot."""
    pairs = ws.save(spark.range(60).select(F.col("id").alias("from"), (F.col("id") + 1).alias("to")), "pairs")
    vector = F.explode(F.sequence(F.col("id"), F.col("id") + 3)).alias("member")
    weights = spark.range(61).select(F.col("id").alias("ego"), vector, F.lit(1.0).alias("weight"))
    counted, shares = [], skew._shares
    monkeypatch.setattr(skew, "_shares", lambda df, keys, *a: counted.append(keys) or shares(df, keys, *a))
    monkeypatch.setattr(skew, "HOT_ROWS", 50)
    monkeypatch.setattr(similarity, "PARTED_PAIRS", 10)
    found = similarity.pair_similarity(ws, pairs, ws.save(weights, "weights"), unit=True, distinct=True)
    assert {r.score for r in found.collect()} == {3 / 5} and found.count() == 60
    assert counted == [["from"], ["to"]]
