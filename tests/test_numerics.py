import math

import pytest
from conftest import rows
from pyspark.sql import functions as F

from crossweave.functions import maps
from crossweave.functions.similarity import LOOKED_UP, array_dot_product, tanimoto_maps
from crossweave.operators import centrality as measures
from crossweave.operators.neighborhood import ego_net
from crossweave.operators.reports import report_score, top_k
from crossweave.operators.similarity import pair_similarity
from crossweave.workspace import Stored


def edges(spark, pairs):
    counted = {}
    for pair in pairs:
        counted[pair] = counted.get(pair, 0) + 1
    data = [(a, b, n) for (a, b), n in counted.items()]
    return Stored(spark.createDataFrame(data, "from bigint, to bigint, n bigint"))


def nets(spark, members):
    data = [(e, m) for e, ms in members.items() for m in ms]
    return Stored(spark.createDataFrame(data, "ego bigint, member bigint"))


RANKS = {
    "link": ([(1, 2)], {1: 0.701754, 2: 1.298246}),
    "cycle": ([(1, 2), (2, 3), (3, 1)], {1: 1.0, 2: 1.0, 3: 1.0}),
    "alone": ([(8, 9)], {1: 1.0}),
    "parallel": (
        [(1, 2), (1, 2), (1, 3), (3, 1), (2, 4)],
        {1: 1.016601, 2: 0.993822, 3: 0.712883, 4: 1.276694},
    ),
}


@pytest.mark.parametrize("local_rows", [None, 0], ids=["local", "joins"])
@pytest.mark.parametrize("case", RANKS)
def test_page_rank(spark, ws, case, local_rows):
    links, expected = RANKS[case]
    net = nets(spark, {100: expected})
    found = measures.page_rank(ws, net, edges(spark, links), local_rows)
    got = {r.member: r.score for r in found.collect()}
    assert got == pytest.approx(expected, abs=1e-6)
    assert sum(got.values()) == pytest.approx(len(got))


@pytest.mark.parametrize("local_rows", [None, 0], ids=["local", "joins"])
def test_hub_score(spark, ws, local_rows):
    net = nets(spark, {100: [1, 2, 3], 200: [1], 300: [5]})
    found = measures.hub_score(ws, net, edges(spark, [(1, 2), (2, 3), (5, 5)]), local_rows)
    assert rows(found.select("ego", "member", "score")) == [
        (100, 1, 32.0), (100, 2, 32.0), (100, 3, 32.0), (200, 1, 1.0), (300, 5, 1024.0),
    ]


def test_large_and_small_neighbourhoods_together(spark, ws):
    links = edges(spark, [(i, (i * 7 + k) % 12) for i in range(12) for k in (1, 3)])
    net = ego_net(ws, links, 2)
    # Each neighbourhood is either side of the limit in one of the runs.
    for measure in (measures.page_rank, measures.hub_score):
        alike = [rows(measure(ws, net, links, n)) for n in (None, 10, 0)]
        for other in alike[1:]:
            assert [r[:2] for r in other] == [r[:2] for r in alike[0]]
            for a, b in zip(other, alike[0]):
                assert a[2] == pytest.approx(b[2], rel=1e-12)


def test_links_that_leave_a_neighbourhood_are_dropped_where_it_is_solved(spark, ws, monkeypatch):
    """No table of all links among members is shuffled and written, however short the lists they travel in."""
    links = edges(spark, [(i, (i * 7 + k) % 30) for i in range(30) for k in (1, 3, 5, 8)])
    net = ego_net(ws, links, 2, ws.save(spark.range(9).withColumnRenamed("id", "ego"), "egos"))
    expected = [rows(m(ws, net, links, 0)) for m in (measures.page_rank, measures.hub_score)]
    names, save = [], type(ws).save
    monkeypatch.setattr(type(ws), "save", lambda self, df, name: names.append(name) or save(self, df, name))
    # The second limit lies between neighbourhoods, the third has them counted and finds none too large.
    for length, limit in ((1024, None), (1, 70), (3, 100)):
        monkeypatch.setattr(measures, "LIST_LINKS", length)
        for measure, by_joins in zip((measures.page_rank, measures.hub_score), expected):
            found = rows(measure(ws, net, links, limit))
            assert [r[:2] for r in found] == [r[:2] for r in by_joins]
            assert [r[2] for r in found] == pytest.approx([r[2] for r in by_joins], rel=1e-12)
        if limit is None:
            assert "graphs" not in names and "sizes" not in names


def test_unknown_centrality(spark, ws):
    with pytest.raises(ValueError):
        measures.vectors(ws, nets(spark, {1: [2]}), edges(spark, [(1, 2)]), "XYZ")


def test_own_centrality(spark, ws, monkeypatch):
    own = lambda ws, net, edges: net.df.select("ego", "member", F.lit(2.0).alias("weight"))
    monkeypatch.setitem(measures.CENTRALITIES, "OWN", own)
    found = measures.vectors(ws, nets(spark, {1: [2]}), edges(spark, [(1, 2)]), "OWN")
    assert rows(found.df) == [(1, 2, 2.0)]


def test_tanimoto_of_maps(spark):
    df = spark.sql(
        "SELECT map('1', 1.0D, '2', 2.0D) a, map('2', 2.0D, '3', 1.0D) b, "
        "CAST(map() AS map<string,double>) e"
    )
    got = df.select(
        tanimoto_maps(F.col("a"), F.col("b")).alias("ab"),
        tanimoto_maps(F.col("a"), F.col("a")).alias("aa"),
        tanimoto_maps(F.col("a"), F.col("e")).alias("ae"),
        tanimoto_maps(F.col("e"), F.col("e")).alias("ee"),
    ).first()
    assert got.ab == pytest.approx(4 / 6)
    assert (got.aa, got.ae, got.ee) == (1.0, 0.0, None)


@pytest.mark.parametrize("shared", [0, 1, LOOKED_UP, LOOKED_UP + 1, 60])
def test_dot_product_of_arrays(spark, shared):
    """However many ids two vectors share, looked up or by maps; a weight that is missing counts as 0."""
    a = {i: 0.5 + i for i in range(shared + 5)}
    b = {i: 2.0 - i / 3 for i in range(5, shared + 15)} | ({} if shared else {99: 1.0})
    b = {i: w for i, w in b.items() if i < 5 + shared or i > 80} | {70: None}
    data = [(list(a), list(a.values()), list(reversed(b)), list(reversed(b.values())))]
    columns = "ma array<bigint>, wa array<double>, mb array<bigint>, wb array<double>"
    df = spark.createDataFrame(data, columns).withColumn("both", F.array_intersect("ma", "mb"))
    assert len(df.first().both) == shared + (70 in a)
    got = df.select(array_dot_product(*[F.col(c) for c in ("both", "ma", "wa", "mb", "wb")])).first()[0]
    assert got == pytest.approx(sum(w * (b.get(i) or 0.0) for i, w in a.items()))


@pytest.mark.parametrize("limit", [None, 2, 0])
def test_pair_similarity_however_long_the_vectors(spark, ws, limit):
    vectors = {
        1: {1: 1.0, 2: 2.0}, 2: {2: 2.0, 3: 1.0}, 3: {7: 1.0},
        4: {1: 0.5, 2: 1.5, 3: 2.5, 7: 1.0}, 5: {1: 1.0, 2: 2.0},
    }
    data = [(e, m, w) for e, v in vectors.items() for m, w in v.items()]
    weights = ws.save(spark.createDataFrame(data, "ego bigint, member bigint, weight double"), "w")
    wanted = [(a, b) for a in vectors for b in vectors]
    pairs = ws.save(spark.createDataFrame(wanted, "from bigint, to bigint"), "p")
    got = {tuple(r)[:2]: r.score for r in pair_similarity(ws, pairs, weights, packed_members=limit).collect()}
    assert set(got) == set(wanted)
    for (a, b), score in got.items():
        dot = sum(w * vectors[b].get(m, 0) for m, w in vectors[a].items())
        na, nb = (sum(w * w for w in vectors[x].values()) for x in (a, b))
        assert score == pytest.approx(dot / (na + nb - dot))
        assert score == pytest.approx(got[b, a])


@pytest.mark.parametrize("limit", [None, 2, 0])
@pytest.mark.parametrize("repeated", [False, True])
def test_pairs_keep_their_columns(spark, ws, limit, repeated):
    data = [(1, 1, 1.0), (1, 2, 1.0), (1, 3, 1.0), (2, 2, 1.0), (2, 3, 1.0), (3, 9, 1.0)]
    weights = ws.save(spark.createDataFrame(data, "ego bigint, member bigint, weight double"), "w")
    wanted = [("x", 1, 2), ("y", 2, 3), (None, 3, 3)] + [("z", 1, 2), ("z", 1, 2)] * repeated
    pairs = ws.save(spark.createDataFrame(wanted, "name string, from bigint, to bigint"), "p")
    scores = {(1, 2): 2 / 3, (2, 3): 0.0, (3, 3): 1.0}
    expected = sorted((str(n), a, b, pytest.approx(scores[a, b])) for n, a, b in wanted)
    for distinct in {False, not repeated}:
        found = pair_similarity(ws, pairs, weights, packed_members=limit, distinct=distinct)
        got = found.select("name", "from", "to", "score").collect()
        assert sorted((str(r[0]), *r[1:]) for r in got) == expected


def test_report_score(spark):
    df = spark.sql("SELECT * FROM VALUES (1.0D), (0.99996D), (0.33333D) AS t(s)")
    got = [r[0] for r in df.select(report_score(F.col("s"))).collect()]
    assert got[:2] == [None, None] and float(got[2]) == 0.3333


def test_perfect_scores_rank_last_unless_exact(spark):
    data = [(1, 1, 10, 1.0, "en"), (1, 1, 11, 0.5, "en"), (1, 2, 11, 0.5, "en"), (1, 2, 12, 0.9, "de")]
    ranked = spark.createDataFrame(
        data, "query_id bigint, from bigint, to bigint, score double, lang string"
    )
    order = lambda df: [(r["from"], r.to, r["rank"]) for r in df.where("lang = 'en'").orderBy("rank").collect()]
    assert order(top_k(ranked)) == [(1, 11, 1), (2, 11, 2), (1, 10, 3)]
    assert order(top_k(ranked, exact=True)) == [(1, 10, 1), (1, 11, 2), (2, 11, 3)]
    assert top_k(ranked, k=1).count() == 2


def test_map_functions(spark):
    df = spark.sql(
        "SELECT map('en', array(1L), 'de', array(2L, 3L)) m, map('de', array(3L, 4L), 'fr', array(5L)) n, "
        "CAST(map() AS map<string,array<bigint>>) e"
    )
    m, n, e = F.col("m"), F.col("n"), F.col("e")
    got = df.select(
        maps.merge_maps(m, n).alias("merged"),
        maps.all_ids(m).alias("ids"),
        maps.all_ids(e).alias("none"),
        maps.map_overlaps(m, F.array(F.lit(3).cast("bigint"))).alias("over"),
        maps.map_overlaps(e, F.array(F.lit(3).cast("bigint"))).alias("under"),
        maps.unambiguous(m).alias("single"),
        maps.ambiguous(m).alias("several"),
        maps.is_anomalous(m).alias("bad"),
        maps.is_anomalous(maps.unambiguous(m)).alias("good"),
        maps.ids_of(m, F.lit("xx")).alias("missing"),
        maps.only_id(maps.ids_of(m, F.lit("en"))).alias("only"),
        maps.only_id(maps.ids_of(m, F.lit("xx"))).alias("nothing"),
        maps.constant_map(maps.ids_of(n, F.lit("de"))).alias("zeros"),
    ).first()
    assert {k: sorted(v) for k, v in got.merged.items()} == {"en": [1], "de": [2, 3, 4], "fr": [5]}
    assert sorted(got.ids) == [1, 2, 3] and got.none == []
    assert (got.over, got.under, got.bad, got.good) == (True, False, True, False)
    assert got.single == {"en": [1]} and got.several == {"de": [2, 3]}
    assert (got.missing, got.only, got.nothing) == ([], 1, None)
    assert got.zeros == {3: 0.0, 4: 0.0}
    assert not math.isnan(got.zeros[3])


def test_solvers_need_no_package_on_the_workers(tmp_path):
    import subprocess
    import sys

    from pyspark import cloudpickle

    (tmp_path / "f").write_bytes(cloudpickle.dumps((measures._page_rank, measures.Graphs)))
    code = (
        "import pickle, numpy as np; rank, graphs = pickle.load(open('f', 'rb'));"
        "one = np.zeros(1, int);"
        "print(rank(graphs(one, one, one, np.ones(1))))"
    )
    done = subprocess.run(
        [sys.executable, "-I", "-c", code], cwd=tmp_path, capture_output=True, text=True
    )
    assert done.returncode == 0, done.stderr
    assert done.stdout.strip() == "[1.]"
