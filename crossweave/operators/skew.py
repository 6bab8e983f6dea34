"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key is hot from this many rows on.  A table of n rows has at most
# n / HOT_ROWS hot keys, which bounds the list that is broadcast.
HOT_ROWS = 4_000_000
# Keys are first counted by hash, in this many buckets: a key can only be hot in a bucket that is.
BUCKETS = 65_536


def _shares(df: DataFrame, keys: list[str], hot_rows: int, name: str) -> DataFrame | None:
    """Each hot key with its number of parts, or None where no key is hot.

    A task sends at most one row per bucket; keys themselves are counted, and dealt out for that,
    only in buckets that could hold a hot one.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).alias("_bucket")
    filled = df.groupBy(bucket).agg(F.count(F.lit(1)).alias("_rows"))
    # At most rows / hot_rows of them.
    full = [r["_bucket"] for r in filled.where(F.col("_rows") >= hot_rows).collect()]
    if not full:
        return None
    counted = df.where(bucket.isin(full)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    return counted.where(F.col("_rows") >= hot_rows).select(
        *keys, F.ceil(F.col("_rows") / hot_rows).cast("int").alias(name)
    )


def has_hot(df: DataFrame, key: str, *, rows: int, hot_rows: int | None = None) -> bool:
    """Whether a key has too many of the ``rows`` (an upper bound) for one task."""
    hot_rows = HOT_ROWS if hot_rows is None else hot_rows
    if rows < hot_rows:
        return False
    shares = _shares(df, [key], hot_rows, "_parts")
    return shares is not None and not shares.isEmpty()


def _spread(df: DataFrame, parts: Column) -> Column:
    # Copies of one row also differ by the partition they are read in.
    hashed = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns], F.spark_partition_id())
    return F.pmod(hashed, parts.cast("bigint")).cast("int")


def hot_join(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str],
    how: str = "inner",
    *,
    left_rows: int,
    right_rows: int = 0,
    hot_on: Sequence[str] | None = None,
    left_profile: DataFrame | None = None,
    right_profile: DataFrame | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """Equi-join that divides every hot key over as many tasks as it needs.

    ``left_rows`` and ``right_rows`` are upper bounds of the table sizes.  Below
    ``hot_rows`` no key can be hot and the join is an ordinary one.  Otherwise
    each hot key's rows on one side are dealt to numbered parts and the other
    side's rows of that key are repeated once per part, so the result is the same.
    The right side is divided only in inner joins, as the other kinds must see
    all its rows of a key together.

    ``hot_on`` names the join columns to look for hot values in (default all).
    ``left_profile`` is a written table with at least as many rows per hot value
    as the left side; it is counted instead where the left side is itself a join.
    ``right_profile`` is the same for the right side.  Rows are counted when the join is
    built; where no key is hot it is an ordinary join, whose rows carry no part numbers.
    """
    keys = [on] if isinstance(on, str) else list(on)
    hot_keys = list(hot_on or keys)
    hot_rows = HOT_ROWS if hot_rows is None else hot_rows
    split_left = left_rows >= hot_rows
    split_right = how == "inner" and right_rows >= hot_rows
    if not (split_left or split_right):
        return left.join(right, keys, how)

    sides = []
    if split_left:
        sides.append((left if left_profile is None else left_profile, "_nl", "_nr"))
    if split_right:
        sides.append((right if right_profile is None else right_profile, "_nr", "_nl"))
    shares = []
    for counted, own, other in sides:
        found = _shares(counted, hot_keys, hot_rows, own)
        if found is not None:
            shares.append(found.withColumn(other, F.lit(1)))
    if not shares:
        return left.join(right, keys, how)
    hot = shares[0] if len(shares) == 1 else shares[0].unionByName(shares[1])
    hot = F.broadcast(
        hot.groupBy(*hot_keys).agg(F.max("_nl").alias("_nl"), F.max("_nr").alias("_nr"))
    )

    def divide(df: DataFrame, own: str, other: str, own_part: str, other_part: str) -> DataFrame:
        marked = df.join(hot, hot_keys, "left")
        own_count = F.coalesce(F.col(own), F.lit(1))
        copies = F.coalesce(F.col(other), F.lit(1))
        return (
            marked.withColumn(own_part, _spread(df, own_count))
            .withColumn(other_part, F.explode(F.sequence(F.lit(0), copies - 1)))
            .drop("_nl", "_nr")
        )

    salted_left = divide(left, "_nl", "_nr", "_pl", "_pr")
    salted_right = divide(right, "_nr", "_nl", "_pr", "_pl")
    return salted_left.join(salted_right, [*keys, "_pl", "_pr"], how).drop("_pl", "_pr")
