"""Shuffled shards by a two-pass external shuffle, with DataFrame functions only.

First pass: every record draws a seeded hash and is written with it.  The draws scatter the
records uniformly into buckets that fit a task's memory, whatever the records hold.  Second pass: each bucket, one
partition of its own, is shuffled by Fisher and Yates' method (Spark's ``shuffle`` of an
array) and takes its place after the buckets before it.  The records of all buckets in turn are one random
order, which is cut into shards with counts at most one apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from crossweave.workspace import Workspace

#: Bytes and rows of a bucket, on average.
BUCKET_BYTES = 16 << 20
BUCKET_ROWS = 100_000
# Buckets whose offsets are summed together; sums of these are summed in turn.
SPAN = 1024
LAW = "rows"


def _offsets(counts: DataFrame) -> DataFrame:
    """(bucket, offset): the records in the buckets before each of ``counts(bucket, n)``."""
    spanned = counts.withColumn("span", F.expr(f"bucket div {SPAN}"))
    before = lambda w: F.coalesce(
        F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long")
    )
    # One row per 1,024 buckets, that is per some 16 GB, comes together here.
    far = spanned.groupBy("span").agg(F.sum("n").alias("n"))
    far = far.select("span", before(W.orderBy("span")).alias("far"))
    near = spanned.withColumn("near", before(W.partitionBy("span").orderBy("bucket")))
    return near.join(far, "span").select("bucket", (F.col("near") + F.col("far")).alias("offset"))


def _bytes(records: DataFrame) -> Column:
    """About the memory a record takes."""
    total = F.lit(0)
    for name, kind in records.dtypes:
        column = F.col(f"`{name}`")
        if kind.startswith(("struct", "array", "map", "variant")):
            length = F.octet_length(F.to_json(F.struct(column)))
        elif kind in ("string", "binary"):
            length = F.octet_length(column)
        else:
            length = F.lit(8)
        total += F.coalesce(length, F.lit(0))
    return total.cast("long")


def shuffled(
    records: DataFrame, *, shards: int, seed: int = 0, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """(row, shard, slot): every record as a struct ``row``, its shard from 0 to ``shards`` - 1 and its place
    there from 0, without gaps.  Counts of records of any two shards are at most one apart.

    Records are dealt without a look at what they hold: nulls, equal, empty and long ones and columns of any
    names and types pass unchanged, and no value can make a bucket hot.  Each task of the second pass holds one
    bucket; a record longer than a bucket only makes its own bucket longer.  Another seed gives another
    order; equal input files, seed and session settings give the same.  A lost task is
    repeated with the same result, as the draws are written first.  An empty table gives an empty result.
    """
    ws = Workspace(records.sparkSession)
    # Columns go by number until the end, as two may have one name.
    numbered = records.toDF(*[f"c{i}" for i in range(len(records.columns))])
    drawn = ws.save(
        numbered.select(
            F.struct(*numbered.columns).alias("row"),
            _bytes(numbered).alias("size"),
            F.monotonically_increasing_id().alias("number"),
        ).withColumn("draw", F.xxhash64(F.lit(seed), "number")),
        "drawn",
    )
    size = drawn.df.agg(F.sum("size")).first()[0] or 0
    buckets = max(-(-size // bucket_bytes), -(-drawn.rows // BUCKET_ROWS), 1)
    bucket = F.pmod("draw", F.lit(buckets)).cast("int").alias("bucket")
    counts = drawn.df.select(bucket).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    offsets = ws.save(_offsets(counts), "offsets").df
    scattered = drawn.df.select(
        bucket, "number", F.struct("row").alias("one"), F.lit(None).cast("long").alias("offset")
    )
    # A bucket's offset goes with its records, as a row without one.
    none = F.lit(None)
    offsets = offsets.select(
        "bucket",
        none.cast("long").alias("number"),
        none.cast(scattered.schema["one"].dataType).alias("one"),
        "offset",
    )
    # Bucket b is partition b, and shuffle() draws by its seed and the number of the partition.
    dealt = (
        scattered.union(offsets)
        .repartitionById(buckets, F.col("bucket"))
        .sortWithinPartitions("bucket", "number")
        .groupBy("bucket")
        .agg(F.max("offset").alias("offset"), F.collect_list("one").alias("all"))
        .select("offset", F.shuffle("all", F.lit(seed)).alias("all"))
        .select("offset", F.posexplode("all").alias("pos", "one"))
    )
    place = F.col("offset") + F.col("pos")
    kinds = drawn.df.schema["row"].dataType.fields
    named = StructType([StructField(n, k.dataType) for n, k in zip(records.columns, kinds, strict=True)])
    cut = dealt.select(
        F.col("one.row").cast(named).alias("row"),
        place.alias("place"),
        F.expr(f"int((offset + pos) * {shards} div {max(drawn.rows, 1)})").alias("shard"),
    )
    # Shard s begins with the first place whose multiple by the shards reaches s times the records.
    start = F.expr(f"(shard * {drawn.rows}L + {shards} - 1) div {shards}")
    return cut.select("row", "shard", (F.col("place") - start).alias("slot"))


def write_shards(
    records: DataFrame,
    path: str,
    *,
    shards: int,
    seed: int = 0,
    bucket_bytes: int = BUCKET_BYTES,
    mode: str = "errorifexists",
) -> None:
    """Write the shards as Parquet in folders ``shard=<n>``: (row, slot), files sorted by slot.

    A bucket lies in one shard or a few, so a task writes few files.
    """
    ready = shuffled(records, shards=shards, seed=seed, bucket_bytes=bucket_bytes)
    ready.sortWithinPartitions("shard", "slot").write.mode(mode).partitionBy("shard").parquet(path)
