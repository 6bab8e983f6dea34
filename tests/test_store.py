"""Results and tables kept between runs, and reports as text."""

import random

import numpy as np
import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_numerics import edges, nets

from crossweave.functions import maps
from crossweave.operators import centrality as measures
from crossweave.operators import crossnet
from crossweave.plans import graph as graphs
from crossweave.plans.editions import Editions
from crossweave.plans.store import CANDIDATES, RANKED, ResultStore, TableSet
from crossweave.sources import dump, tables
from crossweave.workspace import Workspace
from samples import write_dump


def found(spark, *triples):
    return spark.createDataFrame(triples, "query_id long, from long, to long")


def asked(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "query_id long")


def test_only_committed_runs_are_read(spark, ws, tmp_path):
    store = ResultStore(spark, str(tmp_path))
    store.append(asked(spark, 1, 2), found(spark, (1, 10, 11), (2, 20, 21)), CANDIDATES, 2)
    store.append(asked(spark, 2, 3), found(spark, (2, 20, 21), (3, 30, 31)), CANDIDATES, 2)
    lost = store.write(found(spark, (4, 40, 41), (1, 0, 0)), CANDIDATES, 2)
    everyone = asked(spark, 1, 2, 3, 4)
    expected = [(1, 10, 11), (2, 20, 21), (3, 30, 31)]
    assert rows(store.load(ws, everyone, CANDIDATES, 2).df) == expected
    assert rows(store.pending(everyone, CANDIDATES, 2)) == [(4,)]
    store.commit(asked(spark, 4), lost, CANDIDATES, 2)
    assert rows(store.load(ws, everyone, CANDIDATES, 2).df) == [*expected, (4, 40, 41)]


def test_answers_count_for_their_step_and_centrality_only(spark, ws, tmp_path):
    store = ResultStore(spark, str(tmp_path))
    store.append(asked(spark, 1), found(spark, (1, 10, 11)), CANDIDATES, 2)
    scored = found(spark, (1, 10, 11)).withColumn("score", F.lit(0.5))
    store.append(asked(spark, 1), scored, RANKED, 2, "RPR")
    both = asked(spark, 1, 2)
    assert rows(store.pending(both, CANDIDATES, 2)) == [(2,)]
    assert rows(store.pending(both, CANDIDATES, 1)) == [(1,), (2,)]
    assert rows(store.pending(both, RANKED, 2, "RPR")) == [(2,)]
    assert rows(store.pending(both, RANKED, 2, "HITS")) == [(1,), (2,)]
    assert store.load(ws, both, RANKED, 2, "HITS").rows == 0
    pages = spark.createDataFrame([(10, "a"), (11, "b"), (12, None)], "sid long, title string")
    status = lambda how: rows(store.page_status(pages, 2, how).select("sid", "step", "ranked"))
    assert status("RPR") == [(10, 2, True), (11, 0, False), (12, 0, False)]
    assert status("HITS") == [(10, 2, False), (11, 0, False), (12, 0, False)]


def test_queries_without_rows_are_answered(spark, ws, tmp_path):
    store = ResultStore(spark, str(tmp_path))
    store.append(asked(spark, 5), found(spark, (5, 1, 1)).limit(0), CANDIDATES, 1)
    assert store.pending(asked(spark, 5), CANDIDATES, 1).count() == 0


def test_tables_are_published_together(spark, tmp_path):
    kept = TableSet(spark, str(tmp_path))
    assert kept.read() is None
    one, two = spark.range(3), spark.range(5).selectExpr("id AS other")
    run = kept.write({"one": one})  # a run that stops half-way
    assert kept.read() is None
    built = []

    def build():
        built.append(1)
        return {"one": one, "two": two}

    for _ in range(3):
        read = kept.get_or_build(build)
        assert {n: t.count() for n, t in read.items()} == {"one": 3, "two": 5}
    assert built == [1] and run not in str(read["one"].inputFiles())


def test_second_read_builds_nothing_and_another_load_starts_anew(spark, tmp_path, monkeypatch):
    write_dump(str(tmp_path / "dump"))
    languages = ["en", "nl", "pl", "sv"]
    kinds = [dump.NORMAL_PAGE, dump.PAGE_LINK, dump.LANGUAGE_LINK]
    load = lambda: dump.load_dump(spark, str(tmp_path / "dump"), str(tmp_path / "tables"), languages, kinds)
    load()
    built = []
    plain = graphs.universe_pages
    monkeypatch.setattr(graphs, "universe_pages", lambda *a: built.append(1) or plain(*a))
    with Workspace(spark) as ws:
        first = Editions(ws, str(tmp_path / "tables"), languages)
        expected = rows(first.pages().df), rows(first.anomalies().df)
        again = Editions(ws, str(tmp_path / "tables"), languages[::-1])
        assert (rows(again.pages().df), rows(again.anomalies().df)) == expected and built == [1]
        load()
        other = Editions(ws, str(tmp_path / "tables"), languages)
        assert (rows(other.pages().df), rows(other.anomalies().df)) == expected and built == [1, 1]


def test_consistent_links_are_found_once(spark, tmp_path, monkeypatch):
    """The cross-net, its anomalies and their hot keys are made from one written table; a page listed among its
    own edition's is there without a link that says so."""
    write_dump(str(tmp_path / "dump"))
    languages = ["en", "nl", "pl", "sv"]
    kinds = [dump.NORMAL_PAGE, dump.PAGE_LINK, dump.LANGUAGE_LINK]
    dump.load_dump(spark, str(tmp_path / "dump"), str(tmp_path / "tables"), languages, kinds)
    calls, plain = [], crossnet.consistent_links
    counted = lambda *a, **k: calls.append(1) or plain(*a, **k)
    monkeypatch.setattr(crossnet, "consistent_links", counted)
    monkeypatch.setattr(graphs, "consistent_links", counted)
    with Workspace(spark) as ws:
        editions = Editions(ws, str(tmp_path / "tables"), languages)
        found = rows(editions.anomalies().df)
        assert calls == [1]
        members = crossnet.counterpart_rows(editions._valid_links().df).select("v", "lang", "member").distinct()
        several = editions.cross().ambiguous.df.select("v", "lang")
        assert found and found == rows(members.join(several, ["v", "lang"], "left_semi"))


ODD = ["", None, "\\N", "\\", "a\tb", '"q"', "line\nbreak", "\r\n", "\\t", "\\\\s", " ", "日本\\", "n\\n\n"]


def test_reports_round_trip(spark, tmp_path):
    values = [(i, a, b, i % 2 == 0, i / 3) for i, (a, b) in enumerate((a, b) for a in ODD for b in ODD)]
    schema = "id bigint, a string, b string, even boolean, third double"
    df = spark.createDataFrame(values, schema).repartition(3)
    tables.write_report(df, str(tmp_path / "r"), single_file=True)
    assert len(list((tmp_path / "r").glob("part-*"))) == 1
    back = tables.read_report(spark, str(tmp_path / "r"), schema)
    assert sorted(map(tuple, back.collect())) == values and back.dtypes == df.dtypes


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(texts=st.lists(st.one_of(st.none(), st.text(alphabet="\\tnrsN\t\n\r\" a"))))
def test_any_text_round_trips(spark, tmp_path_factory, texts):
    path = str(tmp_path_factory.mktemp("report") / "r")
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    tables.write_report(df, path)
    assert sorted(map(tuple, tables.read_report(spark, path, "id int, text string").collect())) == list(
        enumerate(texts)
    )


def hubs_by_hand(members, links):
    """Power iteration on the whole matrix."""
    at = {m: i for i, m in enumerate(sorted(members))}
    matrix = np.zeros((len(at), len(at)))
    for a, b in links:
        if a in at and b in at:
            matrix[at[a], at[b]] += 1
    unit = lambda v: v / (np.linalg.norm(v) or 1.0)
    hub, authority = np.ones(len(at)), np.zeros(len(at))
    for _ in range(10):
        authority = unit(matrix.T @ hub)
        hub = unit(matrix @ authority)
    return {m: (hub[i], authority[i]) for m, i in at.items()}


@pytest.mark.parametrize("local_rows", [None, 0], ids=["local", "joins"])
def test_hubs_and_authorities(spark, ws, local_rows):
    draw = random.Random(2)
    links = [(draw.randrange(12), draw.randrange(12)) for _ in range(40)] + [(50, 50)]
    members = {100: range(12), 200: [1, 2, 3], 300: [60], 400: [50]}
    found_scores = measures.hub_authority(ws, nets(spark, members), edges(spark, links), local_rows)
    got = {(r.ego, r.member): (r.hub, r.authority) for r in found_scores.collect()}
    for ego, own in members.items():
        for member, scores in hubs_by_hand(own, links).items():
            assert got[ego, member] == pytest.approx(scores, abs=1e-9)
    assert len(got) == 17 and got[300, 60] == (0.0, 0.0)


def test_map_functions_on_empty_and_missing(spark):
    row = spark.range(1).select(
        F.map_from_entries(F.array().cast("array<struct<k:string,v:array<bigint>>>")).alias("none"),
        F.create_map(F.lit("a"), F.array(F.lit(1), F.lit(2)).cast("array<bigint>"), F.lit("b"), F.array(F.lit(3)).cast("array<bigint>")).alias("sets"),
    )
    got = row.select(
        F.size(maps.all_ids(F.col("none"))),
        maps.map_overlaps(F.col("none"), F.array(F.lit(1).cast("bigint"))),
        maps.only_id(maps.ids_of(F.col("sets"), F.lit("b"))),
        maps.only_id(maps.ids_of(F.col("sets"), F.lit("z"))),
        F.map_keys(maps.ambiguous(F.col("sets"))),
        F.map_keys(maps.unambiguous(F.col("sets"))),
        maps.is_anomalous(F.col("none")),
    ).first()
    assert tuple(got) == (0, False, 3, None, ["a"], ["b"], False)


def test_one_file_keeps_the_order_and_leaves_the_work_to_many_tasks(spark, tmp_path):
    """Lines are formatted by the tasks that sort them; the writing task gets blocks, not lines."""
    df = spark.range(0, 60_000, 1, 6).select((F.lit(60_000) - F.col("id")).alias("n"), F.lit("a\tb").alias("t"))
    path = tmp_path / "r"
    tables.write_report(df.orderBy("n"), str(path), single_file=True)
    (file,) = path.glob("part-*")
    assert file.read_text() == "".join(f"{n}\ta\\tb\n" for n in range(1, 60_001))
    seen = []
    write = tables.Workspace.save
    tables.Workspace.save = lambda self, made, name: seen.append(write(self, made, name)) or seen[-1]
    try:
        tables.write_report(df.orderBy("n"), str(tmp_path / "s"), single_file=True)
    finally:
        tables.Workspace.save = write
    assert 1 < seen[0].rows < 60


def test_one_file_of_no_rows(spark, tmp_path):
    tables.write_report(spark.range(0), str(tmp_path / "r"), single_file=True)
    assert tables.read_report(spark, str(tmp_path / "r"), "id bigint").collect() == []


def test_one_file_travels_in_short_blocks(spark, tmp_path, monkeypatch):
    """Whoever reads blocks holds thousands at a time, so none grows with the rows of a batch; the order is kept."""
    longest, save = [], Workspace.save

    def seen(self, df, name):
        made = save(self, df, name)
        longest.append(made.df.agg(F.max(F.length("value"))).first()[0])
        return made

    monkeypatch.setattr(Workspace, "save", seen)
    long = F.when(F.col("n") % 5000 == 7, F.repeat(F.lit("y"), 40_000)).otherwise("")
    df = spark.range(30_000).select(F.col("id").alias("n"), F.concat(F.lit("x"), long).alias("x")).orderBy("n")
    tables.write_report(df, str(tmp_path / "r"), single_file=True)
    assert len(longest) == 1 and longest[0] <= tables.BLOCK_BYTES + 40_010
    text = "".join(p.read_text() for p in (tmp_path / "r").glob("part-*"))
    lines = text.split("\n")
    assert lines.pop() == "" and [int(line.split("\t")[0]) for line in lines] == list(range(30_000))
    assert len(text) == df.select(F.sum(F.length(F.concat_ws(" ", "n", "x")) + 1)).first()[0]
