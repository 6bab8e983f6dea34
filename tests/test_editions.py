import glob

import pytest
from conftest import rows
from pyspark.sql import functions as F
from samples import Model, write_dump

from crossweave.plans.editions import Editions
from crossweave.plans.store import CANDIDATES, RANKED
from crossweave.sources import dump, tables
from crossweave.workspace import Workspace

FOUR = ["en", "nl", "pl", "sv"]
FIVE = ["en", "nl", "pl", "pt", "sv"]
KINDS = [dump.NORMAL_PAGE, dump.PAGE_LINK, dump.LANGUAGE_LINK]
TITLES = ["River", "Bridge", "Castle", "Market", "Harbour", "Mill"]


def pages_of(df, *columns):
    """Keys as ``(id, lang)`` under the languages of the load."""
    return lambda langs: sorted(
        tuple((r[c] >> 10, langs[r[c] & 1023]) for c in columns) for r in df.collect()
    )


@pytest.fixture(scope="module", params=[FOUR, FIVE], ids=["four", "five"])
def editions(request, spark, tmp_path_factory):
    # A folder that is named like those of a dump mustn't be taken for one.
    folder = tmp_path_factory.mktemp("sample") / "en" / "pagelinks"
    write_dump(str(folder / "dump"))
    dump.load_dump(spark, str(folder / "dump"), str(folder / "tables"), request.param, KINDS)
    with Workspace(spark) as ws:
        yield Editions(ws, str(folder / "tables"), request.param)


@pytest.fixture
def model(editions):
    return Model(editions.languages)


def title(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "title string")


def test_the_sample_has_its_traps():
    model = Model(FIVE)
    assert len(model.cross) < len(model.title) and len(model.valid) < len(model.links)
    assert len(model.resolved) < model.offered
    assert any(a not in model.title for a, _ in model.resolved)
    assert {v for v, s in model.cross.items() if any(len(x) > 1 for x in s.values())} >= {(1001, "en"), (1002, "en")}
    assert model.candidates("River", 2) and any(model.ranked("River", 2).values())


def test_counts(spark, editions, model):
    folder, langs = editions.table_dir, editions.languages
    five = len(langs) == 5
    assert tables.read_pages(spark, folder, langs).count() == len(model.title) == (37 if five else 31)
    assert tables.read_language_link_dump(spark, folder, langs).count() == model.offered
    assert tables.read_language_links(spark, folder, langs).count() == len(
        [1 for a, b in model.resolved if a[1] in langs]
    )
    assert tables.read_links(spark, folder, langs).count() == len(model.links)
    assert editions.pages().rows == len(model.cross)
    assert editions.graph().edges.rows == len(set(model.valid))


def test_anomalies(editions, model):
    langs = editions.languages
    found = pages_of(editions.anomaly_report(), "from", "to")(langs)
    expected = {
        (v, w) for v, sets in model.cross.items() for s in sets.values() if len(s) > 1 for w in s
    }
    assert found == sorted(expected)
    pages = {v for v, _ in expected}
    assert pages_of(editions.cross().anomalous_pages, "sid")(langs) == sorted((p,) for p in pages)
    first = editions.anomaly_report().first()
    assert (first.from_lang, first.from_title, first.to_lang) == ("en", "Bridge", "nl")


def test_repair_drops_whole_entries(editions, model):
    repaired = editions.cross().repaired.df
    assert repaired.groupBy("v", "lang").count().where("count > 1").count() == 0
    got = pages_of(repaired, "v", "member")(editions.languages)
    assert got == sorted((v, w) for v, sets in model.fixed.items() for w in sets.values())
    assert "nl" not in model.fixed[1001, "en"]


@pytest.mark.parametrize("step", [1, 2, 3])
def test_candidates(spark, editions, model, step):
    for name in TITLES:
        report = editions.recommend(title(spark, name), step)
        assert pages_of(report, "from", "to")(editions.languages) == sorted(model.candidates(name, step))


@pytest.mark.parametrize("name", ["River", "Harbour"])
def test_ranking_keeps_only_expandable_candidates(spark, editions, model, name):
    langs = editions.languages
    for centrality in ("HITS", "RPR"):
        editions.rank(title(spark, name), 1, centrality)
    schema = "query_id bigint, from bigint, to bigint, score double"
    stored = editions.store._read(editions.store._folder("rows", RANKED, 1, "HITS"), schema)
    query = min(p for p in model.cross if p[1] == "en" and model.title[p] == name)
    ranked = stored.where(F.col("query_id") == (query[0] << 10) + langs.index("en")).collect()
    key = lambda k: (k >> 10, langs[k & 1023])
    expected = model.ranked(name, 1)
    assert {(key(r["from"]), key(r["to"])): r.score for r in ranked} == pytest.approx(expected)
    weighted = editions.store._read(editions.store._folder("rows", RANKED, 1, "RPR"), schema)
    assert {tuple(r)[:3] for r in stored.collect()} == {tuple(r)[:3] for r in weighted.collect()}
    assert all(0 <= r.score <= 1 for r in weighted.collect())


def test_reports_of_a_ranking(spark, editions, model):
    top, stats = editions.rank(title(spark, "River"), 1, "HITS")
    expected = model.ranked("River", 1)
    assert top.count() == len(expected) < 20
    assert stats.count() == len({a for a, _ in expected})


def test_store_answers_only_new_queries(spark, editions):
    titles = title(spark, "Castle", "Market")
    editions.recommend(title(spark, "Castle"), 4)
    before = rows(editions.store.done(CANDIDATES, 4))
    editions.recommend(titles, 4)
    after = rows(editions.store.done(CANDIDATES, 4))
    assert len(before) == 1 and len(after) == 2 and set(before) < set(after)
    editions.recommend(titles, 4)
    assert rows(editions.store.done(CANDIDATES, 4)) == after
    assert editions.store.done(RANKED, 4, "HITS").count() == 0


def test_page_status(spark, editions, model):
    editions.rank(title(spark, "River"), 1, "HITS")
    pages = editions.pages().df
    status = editions.store.page_status(pages, 1, "HITS")
    assert status.count() == pages.count()
    marked = {p for (p,) in pages_of(status.where("ranked"), "sid")(editions.languages)}
    assert {a for a, _ in model.ranked("River", 1)} <= marked
    assert status.where("step = 0 and ranked").count() == 0


def test_unknown_title_gives_empty_reports(spark, editions):
    assert editions.recommend(title(spark, "Nowhere"), 1).count() == 0
    top, stats = editions.rank(title(spark, "Nowhere"), 1, "HITS")
    assert top.count() == 0 and stats.count() == 0


def test_text_reports(spark, editions):
    path = editions.write_recommendations("River", 1)
    (part,) = glob.glob(f"{path}/part-*")
    lines = open(part).read().splitlines()
    assert len(lines) == editions.recommend(title(spark, "River"), 1).count()
    assert lines[0].split("\t")[1] == "River"
    for written in editions.write_ranking("River", 1, "HITS"):
        assert len(glob.glob(f"{written}/part-*")) == 1


def test_relatedness(spark, editions, model):
    asked = [(1, "River", "Harbour"), (2, "River", "River"), (3, "Market", "None"), (4, "Market", "River")]
    pairs = spark.createDataFrame(asked, "pair_id int, title_a string, title_b string")
    found = {}
    for r in editions.relatedness(pairs, 1, "HITS").collect():
        found.setdefault(r.pair_id, {})[r.lang] = r.jaccard
    expected = {i: model.related(a, b, 1) for i, a, b in asked if model.related(a, b, 1)}
    assert found == {i: pytest.approx(scores) for i, scores in expected.items()}
    # A page is as similar as can be to itself, wherever it takes part at all.
    assert set(found[2].values()) == {1.0}


@pytest.mark.parametrize("centrality", ["HITS", "RPR"])
def test_repeated_pairs_change_nothing(spark, editions, centrality):
    schema = "pair_id int, title_a string, title_b string"
    asked = [(1, "River", "River"), (2, "River", "Harbour"), (3, "Harbour", "River")]
    once = editions.relatedness(spark.createDataFrame(asked, schema), 2, centrality)
    more = editions.relatedness(spark.createDataFrame(asked * 2 + [(9, "River", "River")], schema), 2, centrality)
    same = {r.lang: r.jaccard for r in once.where("pair_id = 1").collect()}
    assert same and all(score == pytest.approx(1.0) for score in same.values())
    assert rows(more.where("pair_id < 9")) == rows(once)


def test_a_new_load_starts_anew(spark, tmp_path):
    folder = str(tmp_path)
    write_dump(f"{folder}/dump")
    dump.load_dump(spark, f"{folder}/dump", f"{folder}/tables", FOUR, KINDS)
    with Workspace(spark) as ws:
        before = Editions(ws, f"{folder}/tables", FOUR)
        assert before.pages().rows > 2 and before.recommend(title(spark, "River"), 1).count()
        for lang in FOUR:
            with open(f"{folder}/dump/{lang}/langlinks/dumps", "w") as out:
                out.write("1000\tnl River en" if lang == "en" else "nothing")
        dump.load_dump(spark, f"{folder}/dump", f"{folder}/tables", FOUR, KINDS)
        after = Editions(ws, f"{folder}/tables", FOUR)
        assert after.pages().rows == 2
        assert after.recommend(title(spark, "River"), 1).count() == 0


def test_a_language_outside_the_list_fails(spark, tmp_path):
    write_dump(str(tmp_path / "dump"))
    lines = dump.read_lines(spark, str(tmp_path / "dump"), dump.PAGE_LINK, ["en", "nl"])
    assert {r.lang for r in lines.collect()} == {"en", "nl"}


def test_languages_in_any_order(spark, editions):
    again = Editions(editions.ws, editions.table_dir, editions.languages[::-1])
    assert again.name == editions.name
