"""Surrogate keys of pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Room for this many languages in a packed key.
LANGUAGE_SLOTS = 1024


def packed_key(page_id: Column, lang: Column, languages: Sequence[str]) -> Column:
    """Collision-free key: the id and the language's place in the sorted list."""
    ordered = sorted(set(languages))
    if len(ordered) > LANGUAGE_SLOTS:
        raise ValueError(f"more than {LANGUAGE_SLOTS} languages")
    codes = F.create_map(*[x for i, code in enumerate(ordered) for x in (F.lit(code), F.lit(i))])
    code = F.try_element_at(codes, lang)
    return (page_id.cast("bigint") * LANGUAGE_SLOTS + code).cast("bigint")


def jvm_hash_key(page_id: Column, lang: Column) -> Column:
    """Java's 32-bit hash of ``<id>-<lang>``, widened; ASCII text only."""
    text = F.concat_ws("-", page_id.cast("string"), lang)
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("bigint"))
    return F.aggregate(
        codes,
        F.lit(0).cast("bigint"),
        lambda acc, c: (acc * 31 + c).bitwiseAND(F.lit(4294967295).cast("bigint")),
        lambda acc: F.when(acc >= 2147483648, acc - 4294967296).otherwise(acc),
    )


def key_builder(kind: str, languages: Sequence[str]):
    """``(id, lang) -> key`` for ``packed`` or ``jvm`` keys."""
    if kind == "packed":
        return lambda page_id, lang: packed_key(page_id, lang, languages)
    if kind == "jvm":
        return jvm_hash_key
    raise ValueError(f"unknown key kind {kind!r}")
