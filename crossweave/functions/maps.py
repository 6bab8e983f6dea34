"""Functions on maps of sets, for pages kept in nested form.

A set is an array without duplicates; a cross-net is ``map<lang, array<sid>>``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def merge_maps(left: Column, right: Column) -> Column:
    """Union of two maps of sets, language by language."""
    return F.map_zip_with(
        left,
        right,
        lambda _, a, b: F.array_union(
            F.coalesce(a, F.array().cast("array<bigint>")),
            F.coalesce(b, F.array().cast("array<bigint>")),
        ),
    )


def all_ids(sets: Column) -> Column:
    """Every id in any of the sets, once; an empty map gives an empty array."""
    return F.array_distinct(F.flatten(F.map_values(sets)))


def map_overlaps(sets: Column, ids: Column) -> Column:
    """Whether any id of the map is in ``ids``."""
    return F.coalesce(F.arrays_overlap(all_ids(sets), ids), F.lit(False))


def unambiguous(sets: Column) -> Column:
    """The entries with exactly one id."""
    return F.map_filter(sets, lambda _, ids: F.size(ids) == 1)


def ambiguous(sets: Column) -> Column:
    """The entries with several ids."""
    return F.map_filter(sets, lambda _, ids: F.size(ids) > 1)


def is_anomalous(sets: Column) -> Column:
    """Whether any language has several ids."""
    return F.exists(F.map_values(sets), lambda ids: F.size(ids) > 1)


def ids_of(sets: Column, lang: Column) -> Column:
    """The set of one language, empty where the map lacks it."""
    return F.coalesce(F.try_element_at(sets, lang), F.array().cast("array<bigint>"))


def only_id(ids: Column) -> Column:
    """The last id of a set; the only one after repair.  NULL for an empty set."""
    return F.try_element_at(ids, F.lit(-1))


def constant_map(ids: Column, value: float = 0.0) -> Column:
    """A map from every id to one value."""
    return F.map_from_arrays(ids, F.transform(ids, lambda _: F.lit(float(value))))
