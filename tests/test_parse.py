import pytest
from conftest import rows
from pyspark.sql import functions as F

from crossweave.functions.keys import jvm_hash_key, key_builder
from crossweave.sources import dump, tables

PACKED = key_builder("packed", ["de", "en", "es"])


def parse(spark, kind, lines, lang="en", **options):
    given = spark.createDataFrame([(line, lang) for line in lines], "value string, lang string")
    return dump.parse_lines(given, kind, options.pop("key", PACKED), **options)


def test_page_lines(spark):
    lines = [
        "9  Rodin      false false",
        "5  Title false",
        "3 T false",
        "1 New York false false",
        "a12 B c d",
        "12 13 ",
        "12 13  ",
    ]
    found = parse(spark, dump.NORMAL_PAGE, lines).select("id", "title")
    assert rows(found) == [(1, "New"), (5, ""), (9, "Rodin"), (12, "13"), (12, "B")]


def test_page_key(spark):
    found = parse(spark, dump.NORMAL_PAGE, ["7 A x y"], lang="es")
    assert rows(found) == [(7 * 1024 + 2, 7, "A", "es")]


def test_link_lines(spark):
    lines = ["2   201", "12 13 ", "12 13  ", "9 12\t13", "x", "7\t8"]
    found = parse(spark, dump.PAGE_LINK, lines, key=lambda i, lang: i.cast("bigint"))
    expected = [(2, 201), (7, 8), (12, 13), (12, 13)]
    assert rows(found) == [(a, b, "en", "en") for a, b in expected]


def test_category_link_lines(spark):
    found = parse(
        spark, dump.CATEGORY_LINK, ["5 page\t77  cat", "5 6"], key=lambda i, lang: i.cast("bigint")
    )
    assert rows(found) == [(5, 77, "en", "en")]


def test_language_link_takes_its_language_from_the_line(spark):
    line = "51\ten Austria de"
    hashed = parse(spark, dump.LANGUAGE_LINK, [line], key=jvm_hash_key)
    assert rows(hashed) == [(50452818, "en", "Austria", "de")]
    raw = parse(spark, dump.RAW_LANGUAGE_LINK, [line])
    assert rows(raw) == [(51, "en", "Austria", "de")]


def test_filters(spark):
    lines = ["1 de A en", "2 de Talk:A en", "3 de A zz"]
    kept = parse(spark, dump.LANGUAGE_LINK, lines, where=dump.article_filter(["en", "de"]))
    assert rows(kept.select("title")) == [("A",)]


def test_own_parser(spark, monkeypatch):
    spec = dump.ParseSpec(r"(\d+)=(\w+)", lambda g, lang, key: {"n": g(1), "word": g(2)})
    monkeypatch.setitem(dump.PARSERS, "own", spec)
    assert rows(parse(spark, "own", ["1=a", "b"])) == [("1", "a")]


@pytest.mark.parametrize("page,lang,key", [(1, "en", 1506245), (51, "de", 50452818), (12345678, "fr", 745453237)])
def test_jvm_keys(spark, page, lang, key):
    df = spark.range(1).select(jvm_hash_key(F.lit(page), F.lit(lang)).alias("k"))
    assert df.first().k == key


def test_key_kinds():
    with pytest.raises(ValueError):
        key_builder("other", ["en"])


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b"), (2, "c")], "n bigint, t string")
    tables.write_tsv(df, str(tmp_path / "tsv"), header=True, single_file=True)
    files = list((tmp_path / "tsv").glob("part-*"))
    assert len(files) == 1
    assert sorted(files[0].read_text().splitlines()) == ["1\ta b", "2\tc", "n\tt"]
    tables.write_table(df, str(tmp_path / "t"), single_file=True)
    tables.write_table(df, str(tmp_path / "t"), mode="append")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4


def test_get_or_build_builds_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert tables.get_or_build(spark, str(tmp_path / "t"), build).count() == 3
    assert len(calls) == 1


def test_category_tables(spark, tmp_path):
    def put(name, text):
        path = tmp_path / "dump" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)

    for lang in ("en", "de"):
        put(f"{lang}/page/normal_pages", "1 A x y\n2 B x y")
        put(f"{lang}/page/category_pages", "9 C x y")
        put(f"{lang}/pagelinks", "1 2")
        put(f"{lang}/categorylinks", "1 p 9 c")
    put("en/langlinks/dumps", "1 de A en\n2 de T:B en\n1 fr A en")
    put("de/langlinks/dumps", "1 en A de")
    out = str(tmp_path / "out")
    dump.load_dump(spark, str(tmp_path / "dump"), out, ["en", "de"])
    for categories, pages, links in ((False, 4, 2), (True, 6, 4)):
        assert tables.read_pages(spark, out, ["en", "de"], categories).count() == pages
        assert tables.read_links(spark, out, ["en", "de"], categories).count() == links
    assert tables.read_pages(spark, out, ["de"]).count() == 2
    en, de = (1 * 1024 + 1), (1 * 1024 + 0)
    assert rows(tables.read_language_links(spark, out, ["en", "de"]).select("from", "to")) == [
        (de, en),
        (en, de),
    ]
    assert tables.read_language_links(spark, out, ["en"]).count() == 0
    plan = tables.read_pages(spark, out, ["de"])._jdf.queryExecution().toString()
    # Kind and language are folders: they prune and are not read.
    assert "ReadSchema: struct<sid:bigint,id:bigint,title:string>" in plan
    assert "PushedFilters: []" in plan
