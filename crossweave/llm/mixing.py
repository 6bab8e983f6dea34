"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions only.

Each source's rows, in an order of its own, form blocks.  Time is a row of slots, one
block each.  In the ideal, sources flow at their weight over the weights of those that have not
ended.  With v the flow per weight so far, source i's k-th block (from 0) flows from v = k / w[i] to
(k + 1) / w[i], and slot t ends at the v at which t + 1 blocks in all have flown.  A block may run once it
flows, and the one due first does, which meets all windows: at every slot each source is less than one
block from its target, also where sources end.  Nothing is rounded and no period is kept.

That holds for any number of sources: every slot looks at each of them, so work grows with slots x sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crossweave.llm.worker import columns_named
from crossweave.workspace import Workspace

#: A source without a positive weight gets one slot in so many.
PERIOD = 1000
# Slots worked out in one list, and in one row.
PIECE = 1000
PIECES = 64
# Rows of one sorted group; groups of a source are numbered, so no source is one group.
GROUP_ROWS = 512
# Groups whose offsets are summed together; sums of these are summed in turn.
SPAN = 64
# Slots whose lacking rows are summed together.
LACK_SPAN = 4096
# Rows of one part of the mixture's order at least, where there are parts enough for all cores: each part is a file when
# it is written, and small ones cost more in files than in rows.
PART_ROWS = 4096
# Relative room for rounding when flows are compared.
SLACK = 1e-12


def _source_key() -> Column:
    """The source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null"))


def _ranked(docs: DataFrame, ws: Workspace, seed: int) -> tuple[DataFrame, DataFrame]:
    """``docs`` with ``_src`` and ``_rank``, each row's place in its source from 0; rows per source.

    Rows are ordered by a hash of all their columns; only equal rows can change places.
    """
    rows = docs.count()
    groups = rows // GROUP_ROWS + 1
    # No row may hash by a column that another run may give otherwise: all are the input's.
    hashed = docs.withColumns(
        {"_src": _source_key(), "_hash": F.xxhash64(F.lit(seed), *[f"`{c}`" for c in docs.columns])}
    ).withColumn("_group", F.pmod("_hash", F.lit(groups)))
    counts = ws.save(
        hashed.groupBy("_src", "_group").agg(F.count(F.lit(1)).alias("_n")), "groups"
    ).df.withColumn("_span", F.expr(f"_group div {SPAN}"))
    spans = counts.groupBy("_src", "_span").agg(F.sum("_n").alias("_n"))
    before = lambda *of: W.partitionBy(*of[:-1]).orderBy(of[-1]).rowsBetween(
        W.unboundedPreceding, -1
    )
    spans = spans.withColumn("_far", F.coalesce(F.sum("_n").over(before("_src", "_span")), F.lit(0)))
    near = F.sum("_n").over(before("_src", "_span", "_group"))
    offsets = (
        counts.withColumn("_near", F.coalesce(near, F.lit(0)))
        .join(spans.drop("_n"), ["_src", "_span"])
        .select("_src", "_group", (F.col("_near") + F.col("_far")).alias("_offset"))
    )
    within = F.row_number().over(W.partitionBy("_src", "_group").orderBy("_hash", "doc_id"))
    ranked = (
        hashed.withColumn("_within", within)
        .join(offsets, ["_src", "_group"])
        .withColumn("_rank", F.col("_offset") + F.col("_within") - 1)
        .drop("_hash", "_group", "_within", "_offset")
    )
    return ranked, counts.groupBy("_src").agg(F.sum("_n").alias("rows"))


def _targets(sources: DataFrame, weights: DataFrame, block_rows: int) -> DataFrame:
    """(_src, blocks, weight) with exact weights."""
    asked = weights.select(_source_key().alias("_src"), F.col("weight").cast("double"))
    sound = ~F.isnan("weight") & (F.col("weight") > 0) & (F.col("weight") < float("inf"))
    asked = asked.where(sound).groupBy("_src").agg(F.max("weight").alias("weight"))
    # Sums in a fixed order, so that all runs have the same.
    all_rows = W.orderBy("_src").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    total = F.coalesce(F.sum("weight").over(all_rows), F.lit(1.0))
    return (
        sources.join(asked, "_src", "left")
        .select(
            "_src",
            F.ceil(F.col("rows") / block_rows).cast("long").alias("blocks"),
            F.coalesce("weight", total / PERIOD).alias("weight"),
        )
    )


def _flow(targets: DataFrame) -> DataFrame:
    """The pieces (first, last, v, t, rate) between the ends of sources, of at
    most PIECE slots: after s slots, first <= s <= last, the flow per weight is v + (s - t) / rate."""
    end = F.col("blocks") / F.col("weight")
    up = W.orderBy("end", "_src")
    to_here = up.rowsBetween(W.unboundedPreceding, W.currentRow)
    after = W.orderBy(F.desc("end"), F.desc("_src")).rowsBetween(W.unboundedPreceding, -1)
    ends = (
        targets.withColumn("end", end)
        .withColumn("live", F.coalesce(F.sum("weight").over(after), F.lit(0.0)))
        .withColumn("to", F.sum("blocks").over(to_here) + F.col("end") * F.col("live"))
        .withColumn("to", F.max("to").over(to_here))
        .withColumn("t", F.coalesce(F.lag("to").over(up), F.lit(0.0)))
        .withColumn("v", F.coalesce(F.lag("end").over(up), F.lit(0.0)))
    )
    low, high = F.floor("t") + 1, F.floor("to")
    return (
        ends.select("v", "t", (F.col("live") + F.col("weight")).alias("rate"), low.alias("low"), high.alias("high"))
        .where(F.col("low") <= F.col("high"))
        .select("*", F.explode(F.sequence("low", "high", F.lit(PIECE).cast("long"))).alias("first"))
        .select("first", F.least(F.col("first") + PIECE - 1, "high").alias("last"), "v", "t", "rate")
    )


def _flown(piece: Column, slots: Column) -> Column:
    return piece["v"] + (slots - piece["t"]) / piece["rate"]


def _children(targets: DataFrame) -> DataFrame:
    """One row: ``all``, the sources as (_src, blocks, weight), sorted."""
    return targets.groupBy().agg(F.array_sort(F.collect_list(F.struct("_src", "blocks", "weight"))).alias("all"))


def _worked_out(asked: DataFrame) -> DataFrame:
    """(taken, done) of ``asked(all, pieces, done)``: the blocks (i, k, slot) run in the slots of
    the pieces, by piece, and how many blocks of each source have then run."""

    def pick(done: Column, now: Column) -> Column:
        """The flowing block that is due first; where rounding leaves none, the first due of all."""

        def one(child: Column, i: Column) -> Column:
            k = done[i]
            return F.when(
                k < child["blocks"],
                F.struct(
                    (k / child["weight"] >= now * (1 - SLACK)).alias("early"),
                    ((k + 1) / child["weight"]).alias("due"),
                    i.alias("i"),
                    k.alias("k"),
                ),
            )

        return F.array_min(F.transform("all", one))

    def slot(piece: Column):
        def step(state: Column, s: Column) -> Column:
            # A list of one, so that the choice is made once.
            return F.transform(
                F.array(pick(state["done"], _flown(piece, s))),
                lambda best: F.struct(
                    F.transform(
                        state["done"], lambda d, i: F.when(i == best["i"], d + 1).otherwise(d)
                    ).alias("done"),
                    F.concat(
                        state["taken"],
                        F.array(F.struct(best["i"].alias("i"), best["k"].alias("k"), (s - 1).alias("slot"))),
                    ).alias("taken"),
                ),
            )[0]

        return step

    taken = "array<struct<i:int,k:bigint,slot:bigint>>"

    def step(state: Column, piece: Column) -> Column:
        start = F.struct(state["done"].alias("done"), F.array().cast(taken).alias("taken"))
        run = F.aggregate(F.sequence(piece["first"], piece["last"]), start, slot(piece))
        return F.transform(
            F.array(run),
            lambda r: F.struct(
                r["done"].alias("done"), F.concat(state["taken"], F.array(r["taken"])).alias("taken")
            ),
        )[0]

    start = F.struct(F.col("done"), F.array().cast(f"array<{taken}>").alias("taken"))
    return asked.select(F.aggregate("pieces", start, step).alias("run")).select("run.taken", "run.done")


def _by_weight(sources: DataFrame, weights: DataFrame, block_rows: int, ws: Workspace) -> DataFrame:
    """(_src, _block, slot) by the exact weights."""
    targets = ws.save(_targets(sources, weights, block_rows), "targets").df
    slots = targets.agg(F.sum("blocks")).first()[0] or 0
    pieces = ws.save(_flow(targets), "pieces").df
    children = ws.save(_children(targets), "children").df
    row = PIECE * PIECES
    done = children.select(F.transform("all", lambda c: F.lit(0).cast("long")).alias("done"))
    rows = []
    # Each round has one row with the slots of some pieces, so rows stay small at any size.
    for low in range(0, slots, row):
        now = pieces.where((F.col("first") > low) & (F.col("first") <= low + row))
        listed = now.agg(F.array_sort(F.collect_list(F.struct(*now.columns))).alias("pieces"))
        asked = children.crossJoin(listed).crossJoin(done)
        rows.append(ws.save(_worked_out(asked), "slots").df)
        done = rows[-1].select("done")
    names = children.select(F.posexplode("all").alias("i", "one")).select("i", "one._src")
    if not rows:
        return targets.select("_src", F.col("blocks").alias("_block"), F.col("blocks").alias("slot")).limit(0)
    all_rows = rows[0]
    for more in rows[1:]:
        all_rows = all_rows.unionByName(more)
    turns = all_rows.select(F.explode(F.flatten("taken")).alias("one")).select("one.*")
    return turns.join(names, "i").select("_src", F.col("k").alias("_block"), "slot")


def _with_lacking(placed: DataFrame, sources: DataFrame, block_rows: int) -> DataFrame:
    """``placed(_src, _block, slot)`` with ``lacking``, the rows that the blocks before it are short of."""
    blocks = F.ceil(F.col("rows") / block_rows).cast("long")
    last = sources.select(
        "_src", (blocks - 1).alias("_block"), (blocks * block_rows - F.col("rows")).alias("_short")
    )
    spanned = (
        placed.join(last, ["_src", "_block"], "left")
        .withColumn("_short", F.coalesce("_short", F.lit(0).cast("long")))
        .withColumn("_span", F.expr(f"slot div {LACK_SPAN}"))
    )
    before = lambda w: F.coalesce(
        F.sum("_short").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long")
    )
    far = spanned.groupBy("_span").agg(F.sum("_short").alias("_short"))
    far = far.select("_span", before(W.orderBy("_span")).alias("_far"))
    near = spanned.withColumn("_near", before(W.partitionBy("_span").orderBy("slot")))
    return near.join(far, "_span").select(
        "_src", "_block", "slot", (F.col("_near") + F.col("_far")).alias("lacking")
    )


def mix(
    docs: DataFrame,
    weights: DataFrame,
    *,
    block_rows: int,
    seed: int = 0,
) -> DataFrame:
    """``docs`` with ``source_block``, ``slot`` and ``position`` (all long, from 0): the mixture's order.

    ``weights(source, weight)`` has the targets; a source without a positive, finite weight there gets
    one slot in PERIOD.  Where a source ends, the others go on in their proportions.  All rows
    stay; a null source is a source of its own; positions are 0 to rows - 1 without gaps.  Only equal
    rows can change places between runs.  An empty table gives an empty result, and columns
    named like the three are replaced.
    """
    columns_named(docs, "doc_id", "source")
    own = [c for c in docs.columns if c not in ("source_block", "slot", "position")]
    ws = Workspace(docs.sparkSession)
    # Rows travel whole, so that no column of theirs meets one of the mixture's.
    whole = docs.select("doc_id", "source", F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"))
    ranked, sources = _ranked(whole, ws, seed)
    sources = ws.save(sources, "sources").df
    placed = _by_weight(sources, weights, block_rows, ws)
    placed = ws.save(_with_lacking(placed, sources, block_rows), "placed").df
    return (
        ranked.withColumn("_block", F.expr(f"_rank div {block_rows}"))
        .join(placed.withColumnsRenamed({"slot": "_slot"}), ["_src", "_block"])
        .select(
            "row",
            F.col("_block").alias("source_block"),
            F.col("_slot").alias("slot"),
            (F.col("_slot") * block_rows + F.pmod("_rank", F.lit(block_rows)) - F.col("lacking")).alias("position"),
        )
        .select("row.*", "source_block", "slot", "position")
    )


def tempered(docs: DataFrame, power: float) -> DataFrame:
    """(source, weight): weights by rows to a power below 1, which lifts the smaller sources."""
    return docs.groupBy("source").agg(F.pow(F.count(F.lit(1)), F.lit(power)).alias("weight"))


def in_order(docs: DataFrame, weights: DataFrame, *, block_rows: int, seed: int = 0) -> DataFrame:
    """``docs`` in the mixture's order: partition by partition, sorted within; all columns and rows stay."""
    # Whole rows, so that the mixture's columns can't replace any of theirs.
    whole = docs.select("doc_id", "source", F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"))
    mixed = mix(whole, weights, block_rows=block_rows, seed=seed)
    rows, spark = docs.count(), docs.sparkSession
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = min(most, max(rows // PART_ROWS, 2 * spark.sparkContext.defaultParallelism))
    size = rows // parts + 1
    return (
        mixed.repartitionById(parts, F.expr(f"cast(position div {size} as int)"))
        .sortWithinPartitions("position")
        .select("row.*")
    )
