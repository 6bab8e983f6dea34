"""Hard negatives by a secondary-sort shuffle.

Anchors meet the rows in blocks, and each block passes on only what can still count: its best positives of
each anchor, then, with an anchor's positive scores known, its best negatives of each positive's window.
The pairs are packed into keys (anchor, descending score, id), dealt out by anchor and sorted within partitions;
an iterator over the sorted pairs opens a window at each positive and emits the negatives that come
by, so no anchor's pairs are ever held together.
"""

from __future__ import annotations

from collections.abc import Iterator
from struct import calcsize, unpack
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crossweave.llm.worker import by_value, columns_named
from crossweave.workspace import Stored, Workspace

by_value(__name__)

#: Rows of a shard and anchors of a block, on average.
SHARD_ROWS = 16384
BLOCK_ANCHORS = 4096
# Anchors scored at once against a shard.
AT_ONCE = 128
# Packed pairs of a sorted partition, on average.
SORTED_PAIRS = 500_000
# Below this, sums of products of whole numbers are exact in double precision.
EXACT = 2.0**53

PAIRS = "anchor long, variant long, score long, vec_id long, vec_variant long"
FOUND = (
    "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
)
POSITIVE, NEGATIVE = 0, 1
# anchor, its variant, descending score, kind, id, its variant: as bytes they sort as the pairs should.
KEY = ">QQQBQQ"
KEY_BYTES = calcsize(KEY)
ANCHOR_BYTES = 16
SIGN = 1 << 63


def _matrix(table: pa.Table, column: str, size: int) -> np.ndarray:
    flat = table[column].combine_chunks().flatten()
    return np.asarray(flat, dtype=np.int64).reshape(table.num_rows, size)


def _best(scores: np.ndarray, at: np.ndarray, ids: np.ndarray, variants: np.ndarray, k: int) -> np.ndarray:
    """The k best of the rows ``at``: greater scores first, then smaller ids."""
    if len(at) > k:
        own = scores[at]
        at = at[own >= np.partition(own, len(at) - k)[len(at) - k]]
    order = np.lexsort((variants[at], ids[at], -scores[at]))
    return at[order[:k]]


def window(positive: int, low: int, high: int) -> tuple[int, int]:
    """The least and greatest whole score from ``low`` to ``high`` percent of a positive's."""
    return -(-low * positive // 100), high * positive // 100


def score_block(
    shard: pa.Table, anchors: pa.Table, k: int, low: int, high: int, kind: int
) -> pa.Table:
    """The pairs of one block of anchors in one shard that can still count."""
    columns: list[list[np.ndarray]] = [[], [], [], [], []]
    shard_sizes = np.asarray(shard["size"])
    anchor_sizes = np.asarray(anchors["size"])
    for size in np.intersect1d(shard_sizes, anchor_sizes):
        rows = shard.filter(pa.array(shard_sizes == size))
        asked = anchors.filter(pa.array(anchor_sizes == size))
        vectors, wanted = _matrix(rows, "vector", int(size)), _matrix(asked, "vector", int(size))
        ids, variants, labels = (np.asarray(rows[c]) for c in ("vec_id", "variant", "label"))
        of_label = {label: np.flatnonzero(labels == label) for label in np.unique(labels)}
        largest = float(np.abs(vectors).max(initial=0)) * float(np.abs(wanted).max(initial=0)) * size
        if largest < EXACT:
            vectors, wanted = vectors.astype(np.float64), wanted.astype(np.float64)
        anchor_ids, anchor_variants = asked["vec_id"].to_pylist(), asked["variant"].to_pylist()
        anchor_labels = asked["label"].to_pylist()
        positives = asked["positives"].to_pylist()
        none = np.empty(0, dtype=np.int64)
        for first in range(0, asked.num_rows, AT_ONCE):
            scored = (wanted[first : first + AT_ONCE] @ vectors.T).astype(np.int64)
            for n, scores in enumerate(scored, first):
                if kind == POSITIVE:
                    at = of_label.get(anchor_labels[n], none)
                    at = _best(scores, at[ids[at] != anchor_ids[n]], ids, variants, k)
                else:
                    other = (labels != anchor_labels[n]) & (ids != anchor_ids[n])
                    found = []
                    for positive in set(positives[n]):
                        least, most = window(positive, low, high)
                        inside = np.flatnonzero(other & (scores >= least) & (scores <= most))
                        found.append(_best(scores, inside, ids, variants, k))
                    at = np.unique(np.concatenate(found)) if found else none
                for column, values in zip(
                    columns,
                    (
                        np.full(len(at), anchor_ids[n]),
                        np.full(len(at), anchor_variants[n]),
                        scores[at],
                        ids[at],
                        variants[at],
                    ),
                    strict=True,
                ):
                    column.append(values)
    names = ("anchor", "variant", "score", "vec_id", "vec_variant")
    return pa.table(
        {
            name: pa.array(np.concatenate(column) if column else [], pa.int64())
            for name, column in zip(names, columns, strict=True)
        }
    )


def _big_endian(values: np.ndarray) -> np.ndarray:
    """Signed numbers as bytes that sort as they do."""
    biased = values.astype(np.int64).view(np.uint64) ^ np.uint64(SIGN)
    return biased.astype(">u8").view(np.uint8).reshape(len(values), 8)


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with their kind as sorting keys."""
    for batch in batches:
        column = lambda name: batch.column(name).to_numpy(zero_copy_only=False)
        keys = np.hstack(
            [
                _big_endian(column("anchor")),
                _big_endian(column("variant")),
                _big_endian(~column("score")),
                column("kind").astype(np.uint8).reshape(-1, 1),
                _big_endian(column("vec_id")),
                _big_endian(column("vec_variant")),
            ]
        ).tobytes()
        whole = [keys[i : i + KEY_BYTES] for i in range(0, len(keys), KEY_BYTES)]
        yield pa.RecordBatch.from_arrays([pa.array(whole, pa.binary())], ["key"])


def by_anchor(key: bytes) -> int:
    return crc32(key[:ANCHOR_BYTES])


def negatives_of(
    keys: Iterator[tuple[bytes, None]], positives: int, negatives: int, low: int, high: int
) -> Iterator[tuple[int, int, int, int, int, int]]:
    """The hard negatives in a stream of sorted keys.

    A positive opens a window of scores, which closes when it is full or scores have fallen below it; at most
    ``positives`` windows are open.
    """
    now, opened = b"", 0
    windows: list[list[int]] = []  # least and greatest score, negatives so far, positive, its score
    for key, _ in keys:
        if key[:ANCHOR_BYTES] != now:
            now, opened, windows = key[:ANCHOR_BYTES], 0, []
        anchor, _, down, kind, vec_id, _ = unpack(KEY, key)
        score = ~(down - SIGN)
        if kind == POSITIVE:
            if opened < positives:
                opened += 1
                windows.append([*window(score, low, high), 0, vec_id - SIGN, score])
            continue
        windows = [w for w in windows if score >= w[0] and w[2] < negatives]
        for w in windows:
            if score <= w[1]:
                w[2] += 1
                yield anchor - SIGN, w[3], w[2], vec_id - SIGN, w[4], score


def _prepared(vectors: DataFrame, levels: int) -> DataFrame:
    """(vec_id, label, vector, size, variant): sound rows, once each, with whole-number components."""
    sound = F.forall(
        "embedding",
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")),
    )
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * levels).cast("long"))
    kept = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(sound, F.lit(False))
    return (
        vectors.where(kept)
        .select(
            F.col("vec_id").cast("long").alias("vec_id"),
            F.col("label").cast("long").alias("label"),
            whole.alias("vector"),
        )
        .distinct()
        .withColumns({"size": F.size("vector"), "variant": F.xxhash64("label", "vector")})
    )


def _pairs(
    rows: Stored, anchors: DataFrame, n_anchors: int, k: int, low: int, high: int, kind: int
) -> DataFrame:
    """What each block of anchors finds in each shard of rows."""
    shards = -(-max(rows.rows, 1) // SHARD_ROWS)
    blocks = -(-max(n_anchors, 1) // BLOCK_ANCHORS)
    dealt = lambda count: F.pmod(F.xxhash64("vec_id", "variant"), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = rows.df.select("*", dealt(shards).alias("shard"), every(blocks).alias("block"))
    right = anchors.select("*", dealt(blocks).alias("block"), every(shards).alias("shard"))
    return (
        left.groupBy("shard", "block")
        .cogroup(right.groupBy("shard", "block"))
        .applyInArrow(lambda a, b: score_block(a, b, k, low, high, kind), PAIRS)
    )


def mine(
    vectors: DataFrame,
    *,
    every: int = 100,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    levels: int = 256,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from
    ``vectors(vec_id, embedding, label)``.

    Anchors are the rows whose id is divisible by ``every``.  Scores are inner products of components
    floor(levels * x), whole and exact (up to 2**56); greater ones come first, ties go to the smaller id.  The
    positives of an anchor are its first other rows of its label, and the hard negatives of a positive the first
    rows of other labels with a score of ``low`` to ``high`` percent of the positive's.  A positive with a
    score below 0 has none, one with 0 those with 0.

    Rows without an id, a label or a vector, or with a null or non-finite component, take no part.  Equal rows
    count once; other rows that share an id are rows of their own, but never each other's
    positive or negative.  Vectors of different lengths don't compare.  Other columns are ignored, and an
    empty table gives an empty result.
    """
    columns_named(vectors, "vec_id", "embedding", "label")
    spark = vectors.sparkSession
    ws = Workspace(spark)
    rows = ws.save(_prepared(vectors, levels), "rows")
    asked = ws.save(rows.df.where(F.col("vec_id") % every == 0), "anchors")
    unknown = asked.df.withColumn("positives", F.array().cast("array<bigint>"))
    near = ws.save(
        _pairs(rows, unknown, asked.rows, positives, low, high, POSITIVE), "positives"
    ).df
    order = W.partitionBy("anchor", "variant").orderBy(F.desc("score"), "vec_id", "vec_variant")
    known = (
        near.withColumn("_place", F.row_number().over(order))
        .where(F.col("_place") <= positives)
        .groupBy(F.col("anchor").alias("vec_id"), "variant")
        .agg(F.collect_list("score").alias("positives"))
    )
    anchors = asked.df.join(known, ["vec_id", "variant"])
    far = _pairs(rows, anchors, asked.rows, negatives, low, high, NEGATIVE)
    kinds = [f.withColumn("kind", F.lit(k)) for k, f in ((POSITIVE, near), (NEGATIVE, far))]
    pairs = ws.save(kinds[0].unionByName(kinds[1]).mapInArrow(pack, "key binary"), "pairs")
    parts = max(-(-pairs.rows // SORTED_PAIRS), spark.sparkContext.defaultParallelism)
    mined = (
        pairs.df.rdd.map(lambda row: (bytes(row[0]), None))
        .repartitionAndSortWithinPartitions(parts, by_anchor)
        .mapPartitions(lambda keys: negatives_of(keys, positives, negatives, low, high))
    )
    return spark.createDataFrame(mined, FOUND)
