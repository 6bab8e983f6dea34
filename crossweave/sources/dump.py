"""Text dumps: line parsers and the job that turns dumps into tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crossweave.functions.keys import key_builder
from crossweave.operators.linking import resolve_language_links
from crossweave.sources.tables import read_language_link_dump, read_pages, write_table

# Element kinds, line formats and where each kind lies in a dump.
NORMAL_PAGE = "normalpage"
CATEGORY_PAGE = "categorypage"
PAGE_LINK = "interlink"
CATEGORY_LINK = "categorylink"
LANGUAGE_LINK = "crosslink"
RAW_LANGUAGE_LINK = "rawlanglink"

FOUR_FIELDS = r"(\d+)\s+(.*?)\s+(.*?)\s+(.*?)\s?$"
TWO_IDS = r"(\d+)\s+(\d+)\s?$"
ID_TEXT_ID_TEXT = r"(\d+)\s+(.*?)\s+(\d+)\s+(.*?)\s?$"

DUMP_FOLDERS = {
    NORMAL_PAGE: "page/normal_pages",
    CATEGORY_PAGE: "page/category_pages",
    PAGE_LINK: "pagelinks",
    CATEGORY_LINK: "categorylinks",
    LANGUAGE_LINK: "langlinks/dumps",
    RAW_LANGUAGE_LINK: "langlinks/dumps",
}
DEFAULT_KINDS = (NORMAL_PAGE, CATEGORY_PAGE, CATEGORY_LINK, PAGE_LINK, LANGUAGE_LINK)

KeyFn = Callable[[Column, Column], Column]
Groups = Callable[[int], Column]


@dataclass(frozen=True)
class ParseSpec:
    """A line pattern and the output columns made of its groups.

    The first group must be digits, so an empty one means the line doesn't match.
    """

    pattern: str
    columns: Callable[[Groups, Column, KeyFn], dict[str, Column]]


def _page(group: Groups, lang: Column, key: KeyFn) -> dict[str, Column]:
    return {
        "sid": key(group(1), lang),
        "id": group(1).cast("bigint"),
        "title": group(2),
        "lang": lang,
    }


def _link(target: int) -> Callable[[Groups, Column, KeyFn], dict[str, Column]]:
    return lambda group, lang, key: {
        "from": key(group(1), lang),
        "to": key(group(target), lang),
        "fromLang": lang,
        "toLang": lang,
    }


def _language_link(hashed: bool) -> Callable[[Groups, Column, KeyFn], dict[str, Column]]:
    return lambda group, lang, key: {
        "sid": key(group(1), group(4)) if hashed else group(1).cast("bigint"),
        "toLang": group(2),
        "title": group(3),
        "lang": group(4),
    }


# Callers may add kinds of their own.
PARSERS: dict[str, ParseSpec] = {
    NORMAL_PAGE: ParseSpec(FOUR_FIELDS, _page),
    CATEGORY_PAGE: ParseSpec(FOUR_FIELDS, _page),
    PAGE_LINK: ParseSpec(TWO_IDS, _link(2)),
    CATEGORY_LINK: ParseSpec(ID_TEXT_ID_TEXT, _link(3)),
    LANGUAGE_LINK: ParseSpec(FOUR_FIELDS, _language_link(hashed=True)),
    RAW_LANGUAGE_LINK: ParseSpec(FOUR_FIELDS, _language_link(hashed=False)),
}


def parse_lines(lines: DataFrame, kind: str, key: KeyFn, where: Column | None = None) -> DataFrame:
    """Parse ``lines(value, lang)``; lines that don't match are dropped.

    ``where`` is an extra predicate on the parsed columns.
    """
    spec = PARSERS[kind]
    group = lambda i: F.regexp_extract("value", spec.pattern, i)
    columns = spec.columns(group, F.col("lang"), key)
    parsed = lines.where(group(1) != "").select(*[c.alias(n) for n, c in columns.items()])
    return parsed if where is None else parsed.where(where)


def article_filter(languages: Sequence[str]) -> Column:
    """Language links from the wanted editions to titles outside any namespace."""
    return F.col("lang").isin(list(languages)) & ~F.col("title").contains(":")


def read_lines(
    spark: SparkSession, dump_dir: str, kind: str, languages: Sequence[str]
) -> DataFrame:
    """``lines(value, lang)`` of every language in one scan; ``lang`` is the folder.

    The folders of the dump end the path, so names above them don't matter.
    """
    folder = DUMP_FOLDERS[kind]
    paths = [f"{dump_dir}/{lang}/{folder}" for lang in languages]
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    found = F.regexp_extract(path, f"^.*/([^/]+)/{folder}(?:/[^/]*)?$", 1)
    lang = F.when(found.isin(list(languages)), found).otherwise(
        F.raise_error(F.concat(F.lit("no language of the list in "), path))
    )
    return spark.read.text(paths).select("value", lang.alias("lang"))


def read_dump(
    spark: SparkSession,
    dump_dir: str,
    kind: str,
    languages: Sequence[str],
    where: Column | None = None,
    key: str = "packed",
) -> DataFrame:
    lines = read_lines(spark, dump_dir, kind, languages)
    return parse_lines(lines, kind, key_builder(key, languages), where)


def load_dump(
    spark: SparkSession,
    dump_dir: str,
    out_dir: str,
    languages: Sequence[str],
    kinds: Sequence[str] = DEFAULT_KINDS,
    key: str = "packed",
    fmt: str = "parquet",
) -> None:
    """Parse a dump into tables partitioned by language, then resolve its language links.

    One job per kind reads all languages at once.  At the end the tables get a new load id, by
    which analyses of them are told from those of an earlier load.
    """
    for kind in kinds:
        where = article_filter(languages) if kind == LANGUAGE_LINK else None
        parsed = read_dump(spark, dump_dir, kind, languages, where, key)
        if kind in (NORMAL_PAGE, CATEGORY_PAGE):
            path, partition = f"{out_dir}/pages/kind={kind}", "lang"
        elif kind in (PAGE_LINK, CATEGORY_LINK):
            path, partition = f"{out_dir}/links/kind={kind}", "fromLang"
        else:
            path, partition = f"{out_dir}/langlink_dump/kind={kind}", "lang"
        write_table(parsed, path, fmt=fmt, partition_by=[partition])
    if LANGUAGE_LINK in kinds:
        resolve_dump(spark, out_dir, languages, fmt)
    load = spark.range(1).select(F.lit(uuid4().hex).alias("load"))
    write_table(load, f"{out_dir}/load")


def resolve_dump(
    spark: SparkSession, out_dir: str, languages: Sequence[str], fmt: str = "parquet"
) -> None:
    """Resolve the language links of all languages and write them by source language."""
    pages = read_pages(spark, out_dir, languages, fmt=fmt)
    dump = read_language_link_dump(spark, out_dir, languages, fmt=fmt)
    resolved = resolve_language_links(
        dump, pages, dump_rows=dump.count(), page_rows=pages.count()
    )
    # Rebalancing divides a large edition over several files and joins small ones.
    write_table(
        resolved.hint("rebalance", "fromLang"),
        f"{out_dir}/langlinks",
        fmt=fmt,
        partition_by=["fromLang"],
    )
