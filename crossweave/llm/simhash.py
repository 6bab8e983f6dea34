"""Document fingerprints by SimHash, and their search by permuted block tables.

Terms are windows of WINDOW bytes; those that begin a word weigh twice.  Each term's hash
votes on BITS signed bits.  Votes are taken per byte of the hash: how often each byte value
occurs, times its signs.

The search finds all pairs within a Hamming radius: cut into more blocks than the radius, two such
fingerprints agree in some blocks.  There is one table per choice of that many blocks, keyed by
them; a pair is made in the first table it meets in only.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossweave.llm.worker import by_value, columns_named
from crossweave.workspace import Workspace

by_value(__name__)

BITS = 128
WINDOW = 8
# Windows hashed at once, which bounds the memory for very long texts.
AT_ONCE = 1 << 16
#: Documents that follow each other are brought together by ranges of ids, about so many each.
PART_ROWS = 2048
MOST_PARTS = 50_000
#: Blocks of the search, in hexadecimal digits.
BLOCKS = (6, 6, 6, 7, 7)

# Odd multipliers and shifts of the hash; any will do, but fingerprints depend on them.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MIXER = 0xD6E8FEB86659FD93
# +1 or -1 for each bit of each byte value.
SIGNS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64) * 2 - 1
LANES = (np.arange(BITS // 8) * 256)[None, :]


def _terms(data: np.ndarray) -> np.ndarray:
    """The windows of some bytes as integers; those after a byte up to a space are there twice."""
    windows = np.zeros(len(data) - WINDOW + 1, dtype=np.uint64)
    for i in range(WINDOW):
        windows |= data[i : i + len(windows)].astype(np.uint64) << np.uint64(8 * i)
    starts = np.flatnonzero(data[: len(windows) - 1] <= 0x20) + 1
    return np.concatenate([windows, windows[starts]])


def _votes(terms: np.ndarray) -> np.ndarray:
    hashes = np.empty((len(terms), len(MULTIPLIERS)), dtype=np.uint64)
    for i, multiplier in enumerate(MULTIPLIERS):
        x = (terms + np.uint64(i)) * np.uint64(multiplier)
        x ^= x >> np.uint64(32)
        x *= np.uint64(MIXER)
        x ^= x >> np.uint64(29)
        hashes[:, i] = x
    each = hashes.view(np.uint8).reshape(len(terms), BITS // 8) + LANES
    counts = np.bincount(each.ravel(), minlength=BITS // 8 * 256).reshape(BITS // 8, 256)
    return (counts @ SIGNS).ravel()


def fingerprint(text: bytes) -> bytes:
    """BITS bits; a text shorter than a window is padded with zeros, an empty one gives zeros."""
    if not text:
        return bytes(BITS // 8)
    data = np.frombuffer(text.ljust(WINDOW, b"\0"), dtype=np.uint8)
    votes = np.zeros(BITS, dtype=np.int64)
    for start in range(0, len(data) - WINDOW + 1, AT_ONCE):
        # The byte before tells whether a part begins with a word; its own window is counted before.
        votes += _votes(_terms(data[start : start + AT_ONCE + WINDOW - 1]))
    return np.packbits(votes > 0).tobytes()


def likeness(one: bytes, other: bytes, one_empty: bool, other_empty: bool) -> float:
    """The cosine of two texts' terms as their fingerprints tell it, from 0 to 1; an empty
    text is like another empty one only."""
    if one_empty != other_empty:
        return 0.0
    differing = (int.from_bytes(one) ^ int.from_bytes(other)).bit_count()
    return max(0.0, math.cos(math.pi * differing / BITS))


RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str, bool]]:
    for batch in batches:
        for doc_id, text, halo in zip(*(batch.column(i) for i in range(3)), strict=True):
            yield doc_id.as_py(), text.as_py() or "", halo.as_py()


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row of a sorted part with the row after it; after the last comes the part's halo."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_chars", pa.int64())]
        + [(n, pa.string()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")]
        + [(n, pa.float64()) for n in ("near_edited", "near_next")]
    )
    out: list[tuple] = []
    before = None
    for doc_id, text, halo in _rows(batches):
        own = fingerprint(text.encode("utf-8"))
        if before:
            last_id, last, print_ = before
            moved = len(last) // 4
            edited = (last[: len(last) - moved] + text[:moved]).encode("utf-8")
            other = fingerprint(edited)
            out.append(
                (
                    last_id,
                    len(last),
                    hashlib.sha256(edited).hexdigest(),
                    print_.hex(),
                    other.hex(),
                    likeness(print_, other, not last, not edited),
                    likeness(print_, own, not last, not text),
                )
            )
        if halo:
            break
        before = doc_id, text, own
        if len(out) >= 2000:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)],
                schema=schema,
            )
            out = []
    if out:
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)],
            schema=schema,
        )


def fingerprints(docs: DataFrame) -> DataFrame:
    """RESULT's columns for every row of ``docs(doc_id, text)``: fingerprints of the text and of the
    edited text, whose last quarter (in characters, rounded down) is replaced by the beginning of the
    next document, and how like it is to the edited text and to the next document.

    Documents follow each other by doc_id, rows that share one by a hash of their texts, rows
    without one first; the first follows the last, and a single one itself.  Null texts count as empty;
    other columns are ignored; an empty table gives an empty result.
    """
    columns_named(docs, "doc_id", "text")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    rows = ids.count()
    parts = min(rows // PART_ROWS + 1, MOST_PARTS)
    cuts = sorted(
        {
            int(c)
            for c in ids.approxQuantile(
                "doc_id", [i / parts for i in range(1, parts)], 1 / (4 * parts)
            )
        }
        if parts > 1
        else ()
    )

    @F.pandas_udf("int")
    def part_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            known = values.fillna(-(2**63)).astype("int64").to_numpy()
            yield pd.Series(np.searchsorted(cuts, known, side="right").astype("int32"))

    # One row per part: where each begins.
    begins = {
        r.part: r.first
        for r in ids.groupBy(part_of("doc_id").alias("part")).agg(
            F.min_by("doc_id", F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("first")
        ).collect()
    }
    used = sorted(begins)
    ahead = {p: used[i - 1] for i, p in enumerate(used)}

    @F.pandas_udf("array<struct<part:int,halo:boolean>>")
    def places(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            out = []
            for value in values.astype("Int64"):
                value = None if value is pd.NA else int(value)
                part = int(np.searchsorted(cuts, -(2**63) if value is None else value, "right"))
                place = [{"part": part, "halo": False}]
                if value == begins[part]:
                    place.append({"part": ahead[part], "halo": True})
                out.append(place)
            yield pd.Series(out, dtype=object)

    placed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "text",
        F.explode(places(F.col("doc_id").cast("long"))).alias("place"),
    )
    return (
        placed.select("doc_id", "text", "place.halo", "place.part")
        .repartitionById(parts, F.col("part"))
        .sortWithinPartitions("halo", F.asc_nulls_first("doc_id"), F.xxhash64("text"))
        .select("doc_id", "text", "halo")
        .mapInArrow(_compared, RESULT)
    )


# The search.


def _block(fingerprint: Column, i: int) -> Column:
    return F.substring(fingerprint, sum(BLOCKS[:i]) + 1, BLOCKS[i])


def _halves(fingerprint: Column) -> list[Column]:
    # Hexadecimal digits as whole numbers; 15 at most fit.
    return [
        F.conv(F.substring(fingerprint, at, 8), 16, 10).cast("long") for at in range(1, BITS // 4, 8)
    ]


def hamming(one: Column, other: Column) -> Column:
    parts = [F.bit_count(a.bitwiseXOR(b)) for a, b in zip(_halves(one), _halves(other), strict=True)]
    return sum(parts[1:], parts[0])


def near_fingerprints(queries: DataFrame, all_prints: DataFrame, radius: int) -> DataFrame:
    """(query, fingerprint, distance): for each distinct fingerprint of ``queries(fingerprint)`` all
    distinct ones of ``all_prints(fingerprint)`` within ``radius`` bits, itself included if there.

    Null fingerprints take no part.  Fingerprints are distinct on both sides, so copies don't
    multiply pairs.
    """
    if not 0 <= radius < len(BLOCKS):
        raise ValueError(f"the radius must be from 0 to {len(BLOCKS) - 1}")
    tables = list(combinations(range(len(BLOCKS)), len(BLOCKS) - radius))

    def keyed(prints: DataFrame, name: str) -> DataFrame:
        own = prints.where(F.col("fingerprint").isNotNull()).select("fingerprint").distinct()
        keys = F.array(
            *[
                F.struct(
                    F.lit(sum(1 << i for i in blocks)).alias("blocks"),
                    F.concat(*[_block(F.col("fingerprint"), i) for i in blocks]).alias("key"),
                )
                for blocks in tables
            ]
        )
        return own.select(F.col("fingerprint").alias(name), F.explode(keys).alias("at")).select(
            name, "at.blocks", "at.key"
        )

    left, right = keyed(queries, "query").alias("l"), keyed(all_prints, "fingerprint").alias("r")
    agreeing = [
        F.when(_block(F.col("query"), i) == _block(F.col("fingerprint"), i), 1 << i).otherwise(0)
        for i in range(len(BLOCKS))
    ]
    same = sum(agreeing[1:], agreeing[0])
    # Blocks up to the last of the table that agree: just the table's own, in the first table only.
    upto = F.array(*[F.lit((2 << max(b)) - 1) for b in tables])[
        F.array_position(F.array(*[F.lit(sum(1 << i for i in b)) for b in tables]), F.col("l.blocks"))
        .cast("int") - 1
    ]
    first = same.bitwiseAND(upto) == F.col("l.blocks")
    distance = hamming(F.col("query"), F.col("fingerprint"))
    met = (F.col("l.blocks") == F.col("r.blocks")) & (F.col("l.key") == F.col("r.key"))
    return left.join(right, met & first & (distance <= radius)).select(
        "query", "fingerprint", distance.cast("int").alias("distance")
    )


def with_near_counts(docs: DataFrame, *, every: int, radius: int) -> DataFrame:
    """``fingerprints`` with ``n_near``: for rows whose id is divisible by ``every``, how many other
    rows have a fingerprint within ``radius`` bits; null for the others."""
    prints = Workspace(docs.sparkSession).save(fingerprints(docs), "fingerprints").df
    asked = prints.where(F.pmod("doc_id", F.lit(every)) == 0).select("doc_id", "fingerprint")
    counted = prints.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("rows"))
    near = (
        near_fingerprints(asked, counted, radius)
        .join(counted, "fingerprint")
        .groupBy("query")
        .agg((F.sum("rows") - 1).alias("n_near"))
    )
    counts = (
        asked.join(near, asked["fingerprint"] == near["query"])
        .select("doc_id", "fingerprint", "n_near")
        .distinct()
    )
    return prints.join(counts, ["doc_id", "fingerprint"], "left").select(*prints.columns, "n_near")
