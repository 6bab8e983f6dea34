"""N-gram Jaccard join by prefixes under several global token orders.

Two sets that are as similar as asked share one of the first few tokens of each under *any*
order of all tokens, and more than one if their sizes are close.  Candidates must share as many prefix
tokens as that under every order; only they are compared.  The orders put rare tokens first, by a sketch of the tokens' frequencies of fixed
size (it bears on the cost alone), and break ties differently.

Documents of equal sets are one node.  So that a group of near copies doesn't meet in all its
pairs, nodes that share the first token under two orders at once are compared with a few leaders
first; what these links join needs no more candidates.  Then the prefixes give all candidates
between different components, so that no component is missed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossweave.llm.components import components
from crossweave.llm.shingles import Powers, in_groups, mixed, shingle_sets
from crossweave.llm.worker import by_value, columns_named, trim
from crossweave.workspace import Workspace

by_value(__name__)

#: Slots of the frequency sketch, in pieces of CHUNK.
SLOTS = 1 << 24
CHUNK = 1 << 18
# Sets counted in 16 bits before they are passed on.
COUNTED = 60_000
SETS_AT_ONCE = 5000
#: Bands of two orders each, and leaders of nodes that share one.
BANDS = 7
LEADERS = 4
#: Orders of the prefixes.
ORDERS = 2
#: From this frequency on (by the sketch, which never says too little) tokens are joined by Spark;
#: rarer ones are matched within parts of about PART_DOCUMENTS documents' tokens.
FREQUENT = 2048
PART_DOCUMENTS = 2048
#: Nodes of a block when candidates are compared.
BLOCK_NODES = 2000
#: Tokens that more nodes share make these a cluster, whose pairs are made and compared within tasks,
#: block by block of about so many nodes and shingles.
CLUSTERED = 64
CLUSTER_NODES, CLUSTER_SHINGLES = 500, 400_000
# Columns of an incidence matrix, and up to how many of them pairs are counted by products.
COLUMNS, MOST_COLUMNS = 8192, 50_000
# Bits that tell most documents to be left out when sets are fetched.
FETCH_BITS = 1 << 23

SEEDS = mixed(np.arange(1, 2 * BANDS + ORDERS + 2, dtype=np.uint64)) | np.uint64(1)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, int, bytes]]:
    for batch in batches:
        for doc_id, text_hash, text in zip(*batch.columns, strict=True):
            data = text.as_buffer().to_pybytes() if text.is_valid else b""
            yield doc_id.as_py(), text_hash.as_py(), data


def node_of(tokens: np.ndarray) -> int:
    """The name of a set: equal for equal sets."""
    if not len(tokens):
        return 0
    total = mixed(tokens ^ SEEDS[-1]).sum(dtype=np.uint64) + np.uint64(len(tokens))
    return int(mixed(np.array([total]))[0].astype(np.int64))


def slots_of(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


FIRST = "doc_id long, text_hash long, node long, size int, bands array<long>, chunk int, part int, counts binary"


def _first_pass(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """Each document's node, size and bands; at the end how many sets of the task are in each slot."""
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("text_hash", pa.int64()),
            ("node", pa.int64()),
            ("size", pa.int32()),
            ("bands", pa.list_(pa.int64())),
            ("chunk", pa.int32()),
            ("part", pa.int32()),
            ("counts", pa.binary()),
        ]
    )
    powers, counts, counted = Powers(), np.zeros(SLOTS, dtype=np.uint16), 0
    part = TaskContext.get().partitionId()

    def passed_on() -> Iterator[pa.RecordBatch]:
        for chunk in range(SLOTS // CHUNK):
            own = counts[chunk * CHUNK : (chunk + 1) * CHUNK]
            if own.any():
                row = [*[[None]] * 5, [chunk], [part], [zlib.compress(own.tobytes(), 1)]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(row, schema, strict=True)], schema=schema
                )

    for group in (g[i : i + SETS_AT_ONCE] for g in in_groups(_rows(batches)) for i in range(0, len(g), SETS_AT_ONCE)):
        # Counts have 16 bits: they go on before they could be full.
        if counted + len(group) > COUNTED:
            yield from passed_on()
            counts[:] = 0
            counted = 0
        sets = shingle_sets([text for *_, text in group], words, powers)
        filled = [s for s in sets if len(s)]
        if filled:
            every = np.concatenate(filled)
            starts = np.cumsum([0] + [len(s) for s in filled[:-1]])
            np.add.at(counts, slots_of(every), 1)
            least = [np.minimum.reduceat(mixed(every * seed), starts) for seed in SEEDS[: 2 * BANDS]]
            bands = np.column_stack(
                [mixed(least[i] * SEEDS[0] + least[i + 1]) for i in range(0, 2 * BANDS, 2)]
            ).astype(np.int64)
        keys = iter(bands.tolist() if filled else ())
        n = len(group)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([doc_id for doc_id, *_ in group], pa.int64()),
                pa.array([text_hash for _, text_hash, _ in group], pa.int64()),
                pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()),
                pa.array([len(s) for s in sets], pa.int32()),
                pa.array([next(keys) if len(s) else None for s in sets], schema.field("bands").type),
                pa.nulls(n, pa.int32()),
                pa.nulls(n, pa.int32()),
                pa.nulls(n, pa.binary()),
            ],
            schema=schema,
        )
        counted += n
    yield from passed_on()
    trim()


def _summed(table: pa.Table) -> pa.Table:
    """The sum of one chunk's counts."""
    total = np.zeros(CHUNK, dtype=np.uint32)
    for one in table["counts"]:
        data = zlib.decompress(one.as_py())
        total += np.frombuffer(data, dtype=np.uint16 if len(data) == 2 * CHUNK else np.uint32)
    return pa.table(
        {"chunk": table["chunk"][:1], "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())}
    )


def level_of(count: np.ndarray | int) -> np.ndarray:
    """Frequencies on a scale of one byte; 0 for a token of a single set."""
    return np.minimum(np.floor(8 * np.log2(np.maximum(count, 1))), 255).astype(np.uint8)


def _levels(counts: DataFrame) -> np.ndarray:
    """The sketch as one byte per slot: SLOTS bytes, whatever the input's size."""
    summed = "chunk int, counts binary"
    # In two steps, so that a task holds the counts of some hundred tasks at most.
    near = counts.groupBy("chunk", F.expr("part div 256")).applyInArrow(_summed, summed)
    levels = np.zeros(SLOTS, dtype=np.uint8)

    def coded(table: pa.Table) -> pa.Table:
        total = np.frombuffer(zlib.decompress(_summed(table)["counts"][0].as_py()), dtype=np.uint32)
        packed = pa.array([level_of(total).tobytes()], pa.binary())
        return pa.table({"chunk": table["chunk"][:1], "counts": packed})

    for row in near.groupBy("chunk").applyInArrow(coded, summed).collect():
        start = row["chunk"] * CHUNK
        levels[start : start + CHUNK] = np.frombuffer(row["counts"], dtype=np.uint8)
    return levels


def prefix_size(size: int, percent: int) -> int:
    """How many first tokens of a set must hold one of any set so similar."""
    return size - -(-percent * size // 100) + 1


def _prefixes(tokens: np.ndarray, levels: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, level) with the orders as the lowest bits of the tokens' second array: see below."""
    level = levels[slots_of(tokens)]
    size = prefix_size(len(tokens), percent)
    orders = np.zeros(len(tokens), dtype=np.uint8)
    for i in range(ORDERS):
        ranked = level.astype(np.uint64) << np.uint64(56) | (
            mixed(tokens * SEEDS[2 * BANDS + i]) >> np.uint64(8)
        )
        at = np.argpartition(ranked, size - 1)[:size] if size < len(tokens) else slice(None)
        orders[at] |= 1 << i
    shared = (orders > 0) & (level > 0)  # a token of a single set meets no other
    return np.flatnonzero(shared), orders


SECOND = "part int, frequent boolean, token long, node long, orders int, packed binary"


def _second_pass(
    batches: Iterator[pa.RecordBatch], sketch, parts: int, percent: int, words: int
) -> Iterator[pa.RecordBatch]:
    """Prefix tokens with their nodes: rare ones packed by part, frequent ones as rows."""
    powers = Powers()
    levels = np.frombuffer(sketch.value, dtype=np.uint8)
    frequent = level_of(FREQUENT)
    seen: set[int] = set()

    def rows(*columns) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays(
            [c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            names=["part", "frequent", "token", "node", "orders", "packed"],
        )

    for group in in_groups(_rows(batches), 4 << 20):
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for small in in_groups(group):
            for tokens in shingle_sets([text for *_, text in small], words, powers):
                if not len(tokens):
                    continue
                node = node_of(tokens)
                if node in seen:
                    continue  # an equal set of this task has been here
                if len(seen) >= 200_000:
                    seen.clear()
                seen.add(node)
                at, orders = _prefixes(tokens, levels, percent)
                found.append((tokens[at], np.full(len(at), node), orders[at]))
        if not found:
            continue
        tokens, nodes, orders = (np.concatenate(c) for c in zip(*found, strict=True))
        often = levels[slots_of(tokens)] >= frequent
        if often.any():
            n = int(often.sum())
            yield rows(
                pa.nulls(n, pa.int32()),
                pa.array(np.ones(n, dtype=bool)),
                pa.array(tokens[often].view(np.int64)),
                pa.array(nodes[often]),
                pa.array(orders[often].astype(np.int32)),
                pa.nulls(n, pa.binary()),
            )
        tokens, nodes, orders = tokens[~often], nodes[~often], orders[~often]
        # Within its part a token is told by 32 bits: a rare mix-up only makes a candidate more.
        spread = mixed(tokens)
        part = (spread % np.uint64(parts)).astype(np.int64)
        tokens = (tokens & np.uint64(2**32 - 1)).astype(np.uint32)
        order = np.argsort(part, kind="stable")
        tokens, nodes, orders, part = tokens[order], nodes[order], orders[order], part[order]
        used, starts = np.unique(part, return_index=True)
        blobs = [
            t.tobytes() + n.tobytes() + o.tobytes()
            for t, n, o in zip(
                *(np.split(c, starts[1:]) for c in (tokens, nodes, orders)), strict=True
            )
        ]
        n = len(used)
        yield rows(
            pa.array(used.astype(np.int32)),
            pa.array(np.zeros(n, dtype=bool)),
            pa.nulls(n, pa.int64()),
            pa.nulls(n, pa.int64()),
            pa.nulls(n, pa.int32()),
            pa.array(blobs if n else [], pa.binary()),
        )
    trim()


def _shared(table: pa.Table) -> pa.Table:
    """Rows (token, node, orders) of a part whose token several nodes have."""
    tokens, nodes, orders = [], [], []
    for blob in table["packed"]:
        data = blob.as_py()
        n = len(data) // 13
        tokens.append(np.frombuffer(data, dtype=np.uint32, count=n))
        nodes.append(np.frombuffer(data, dtype=np.int64, count=n, offset=4 * n))
        orders.append(np.frombuffer(data, dtype=np.uint8, count=n, offset=12 * n))
    tokens, nodes, orders = (np.concatenate(c) for c in (tokens, nodes, orders))
    order = np.lexsort((nodes, tokens))
    tokens, nodes, orders = tokens[order], nodes[order], orders[order]
    new = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (nodes[1:] != nodes[:-1])])
    tokens, nodes, orders = tokens[new], nodes[new], orders[new]
    same = np.concatenate([[False], tokens[1:] == tokens[:-1], [False]])
    several = same[1:] | same[:-1]
    return pa.table(
        {
            "token": tokens[several].astype(np.int64) | int(table["part"][0].as_py()) << 32,
            "node": nodes[several],
            "orders": orders[several].astype(np.int32),
        }
    )


# Comparing candidates.


def _compare(pairs: pa.Table, sets: pa.Table, percent: int) -> pa.Table:
    """Those of the pairs that are similar enough."""
    known = {
        node: np.frombuffer(data, dtype=np.uint64)
        for node, data in zip(sets["node"].to_pylist(), sets["tokens"].to_pylist(), strict=True)
    }
    linked = [
        _alike(known[a], known[b], percent)
        for a, b in zip(pairs["a"].to_pylist(), pairs["b"].to_pylist(), strict=True)
    ]
    return pairs.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))


def _common(tokens: np.ndarray, owner: np.ndarray, count: int, most: int | None) -> np.ndarray | None:
    """(count, count): how many tokens each two owners have in common; None if those that several
    have are more than ``most``."""
    _, column, times = np.unique(tokens, return_inverse=True, return_counts=True)
    several = times[column] > 1
    if not several.any():
        return np.zeros((count, count), dtype=np.float32)
    _, column = np.unique(column[several], return_inverse=True)
    owner, width = owner[several], int(column.max()) + 1
    if most is not None and width > most:
        return None
    total = np.zeros((count, count), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for start in range(0, width, COLUMNS):
        low, high = np.searchsorted(column, [start, start + COLUMNS])
        has = np.zeros((count, min(COLUMNS, width - start)), dtype=np.float32)
        has[owner[low:high], column[low:high] - start] = 1
        total += has @ has.T
    return total


def _compare_blocks(table: pa.Table, percent: int) -> pa.Table:
    """Links between two blocks of a cluster, or within one: of nodes of different components, those
    that share enough prefix tokens under all orders are compared.  Only links that join more are told."""
    count = table.num_rows
    nodes, sizes, names = (np.asarray(table[c]) for c in ("node", "size", "component"))
    block, first, second = (np.asarray(table[c]) for c in ("block", "first", "second"))
    prefix, orders = table["prefix"].combine_chunks(), table["orders"].combine_chunks()
    owner = np.repeat(np.arange(count), np.diff(np.asarray(prefix.offsets)))
    tokens, bits = np.asarray(prefix.flatten()), np.asarray(orders.flatten())
    asked = (block[:, None] == first[:, None]) & (block[None, :] == second[None, :])
    asked &= names[:, None] != names[None, :]
    asked &= 100 * np.minimum.outer(sizes, sizes) >= percent * np.maximum.outer(sizes, sizes)
    if first[0] == second[0]:
        asked = np.triu(asked, 1)
    # As Join.least_shared has it.
    needed = -(-percent * np.add.outer(sizes, sizes) // (100 + percent))
    rest = -(-percent * np.maximum.outer(sizes, sizes) // 100) - 1
    least = np.maximum(needed - rest, 1)
    for i in range(ORDERS):
        own = (bits >> i & 1).astype(bool)
        asked &= _common(tokens[own], owner[own], count, None) >= least
    found: list[tuple[int, int]] = []
    if asked.any():
        sets = [np.frombuffer(s.as_py(), dtype=np.uint64) for s in table["tokens"]]
        lengths = [len(s) for s in sets]
        both = _common(np.concatenate(sets), np.repeat(np.arange(count), lengths), count, MOST_COLUMNS)
        if both is not None:
            union = np.add.outer(sizes, sizes) - both
            at = np.argwhere(asked & (100 * both >= percent * union)).tolist()
        else:
            at = [
                (a, b) for a, b in np.argwhere(asked).tolist() if _alike(sets[a], sets[b], percent)
            ]
        roots: dict[int, int] = {}

        def root(name: int) -> int:
            while name in roots:
                name = roots[name]
            return name

        for a, b in at:
            one, other = root(int(names[a])), root(int(names[b]))
            if one != other:
                roots[one] = other
                found.append((int(nodes[a]), int(nodes[b])))
    columns = list(zip(*found, strict=True)) or [(), ()]
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip("ab", columns, strict=True)})


def _alike(one: np.ndarray, other: np.ndarray, percent: int) -> bool:
    if len(one) > len(other):
        one, other = other, one
    if 100 * len(one) < percent * len(other):
        return False
    at = np.searchsorted(other, one)
    at[at == len(other)] = 0
    both = int((other[at] == one).sum())
    return 100 * both >= percent * (len(one) + len(other) - both)


def _set_rows(batches: Iterator[pa.RecordBatch], wanted, words: int) -> Iterator[pa.RecordBatch]:
    powers = Powers()
    bits = np.frombuffer(wanted.value, dtype=np.uint8)

    def asked() -> Iterator[tuple]:
        for doc_id, _, text in _rows(batches):
            spot = _spot(doc_id)
            if bits[spot >> 3] >> (spot & 7) & 1:
                yield doc_id, text

    for group in in_groups(asked()):
        sets = shingle_sets([text for *_, text in group], words, powers)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([node_of(s) for s in sets], pa.int64()),
                pa.array([s.tobytes() for s in sets], pa.binary()),
            ],
            names=["node", "tokens"],
        )


def _spot(doc_id: int | None) -> int:
    value = np.array([(doc_id or 0) & (2**64 - 1)], dtype=np.uint64)
    return int(mixed(value)[0] % np.uint64(FETCH_BITS))


class Join:
    """One run over ``docs``; its tables live in the workspace."""

    def __init__(self, docs: DataFrame, percent: int, words: int, ws: Workspace):
        self.texts = docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.xxhash64("text").alias("text_hash"),
            F.encode("text", "utf-8").alias("text"),
        )
        self.percent, self.words, self.ws = percent, words, ws
        self.spark = docs.sparkSession
        first = ws.save(self.texts.mapInArrow(lambda b: _first_pass(b, words), FIRST), "sets").df
        self.rows = first.where("chunk IS NULL").select("doc_id", "text_hash", "node", "size", "bands")
        self.counts = first.where("chunk IS NOT NULL").select("chunk", "part", "counts")
        self.nodes = ws.save(
            self.rows.where("node IS NOT NULL").groupBy("node").agg(
                F.min("doc_id").alias("doc_id"),
                F.first("size").alias("size"),
                F.first("bands").alias("bands"),
            ),
            "nodes",
        )

    def sets_of(self, nodes: DataFrame) -> tuple[DataFrame, int]:
        """(node, tokens) of the distinct ``nodes(node)``, read again from the texts; how many there are."""
        words = self.words
        needed = self.ws.save(nodes.join(self.nodes.df.select("node", "doc_id"), "node"), "needed")
        # Which documents to read again, as bits: true ones always, others rarely.
        bits = np.zeros(FETCH_BITS // 8, dtype=np.uint8)

        def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = np.zeros(FETCH_BITS // 8, dtype=np.uint8)
            for batch in batches:
                for doc_id in batch.column(0).to_pylist():
                    spot = _spot(doc_id)
                    own[spot >> 3] |= 1 << (spot & 7)
            if own.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([0], pa.int32()), pa.array([zlib.compress(own.tobytes(), 1)], pa.binary())],
                    names=["one", "bits"],
                )

        found = needed.df.select("doc_id").coalesce(64).mapInArrow(marks, "one int, bits binary")
        for row in found.toLocalIterator():
            bits |= np.frombuffer(zlib.decompress(row["bits"]), dtype=np.uint8)
        wanted = self.spark.sparkContext.broadcast(bits.tobytes())
        sets = (
            self.texts.mapInArrow(lambda b: _set_rows(b, wanted, words), "node long, tokens binary")
            .join(needed.df.select("node"), "node", "left_semi")
            .dropDuplicates(["node"])
        )
        return sets, needed.rows

    def linked(self, pairs: DataFrame) -> DataFrame:
        """Those of ``pairs(a, b)``, distinct and a < b, that are similar enough."""
        percent = self.percent
        pairs = self.ws.save(pairs, "pairs").df
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        sets, needed = self.sets_of(ends)
        blocks = needed // BLOCK_NODES + 1
        block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
        placed = pairs.select("a", "b", block("a").alias("row"), block("b").alias("column"))
        uses = (
            placed.select(F.col("a").alias("node"), "row", "column")
            .union(placed.select("b", "row", "column"))
            .distinct()
            # Named anew, so that the two sides below are told apart.
            .select("node", F.col("row").alias("row"), F.col("column").alias("column"))
        )
        return (
            placed.groupBy("row", "column")
            .cogroup(uses.join(sets, "node").groupBy("row", "column"))
            .applyInArrow(lambda p, s: _compare(p, s, percent), "a long, b long")
        )

    def linked_clusters(self, entries: DataFrame) -> DataFrame:
        """Links (a, b) that join components, among nodes that share a token of many nodes; ``entries``
        has the prefix tokens (token, node, orders, size, component, many)."""
        percent, ws = self.percent, self.ws
        least = entries.where("many").groupBy("token").agg(F.min("node").alias("b"))
        spokes = entries.where("many").join(least, "token").select(F.col("node").alias("a"), "b")
        clusters = components(spokes.distinct(), ws).select("node", F.col("component").alias("cluster"))
        prefixes = entries.groupBy("node", "size", "component").agg(
            F.collect_list(F.struct("token", "orders")).alias("own")
        )
        placed = ws.save(prefixes.join(clusters, "node"), "clustered").df
        blocks = placed.groupBy("cluster").agg(
            F.greatest(
                F.ceil(F.count(F.lit(1)) / CLUSTER_NODES), F.ceil(F.sum("size") / CLUSTER_SHINGLES)
            )
            .cast("int")
            .alias("blocks")
        )
        sets, _ = self.sets_of(placed.select("node"))
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
        block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")
        dealt = (
            placed.join(sets, "node")
            .join(blocks, "cluster")
            .select(
                "cluster",
                "node",
                F.col("size").cast("long").alias("size"),
                "component",
                "tokens",
                F.transform("own", lambda e: e["token"]).alias("prefix"),
                F.transform("own", lambda e: e["orders"]).alias("orders"),
                block,
                other,
            )
            .withColumns({"first": F.least("block", "other"), "second": F.greatest("block", "other")})
        )
        return dealt.groupBy("cluster", "first", "second").applyInArrow(
            lambda t: _compare_blocks(t, percent), "a long, b long"
        )

    def led(self) -> DataFrame:
        """Pairs of nodes with leaders of the bands they share."""
        bands = self.nodes.df.select("node", "size", F.posexplode("bands").alias("band", "key"))
        leaders = F.array_distinct(
            F.transform(
                F.array(
                    *[
                        F.min(F.struct(F.xxhash64("node", F.lit(i)), "node", "size"))
                        for i in range(LEADERS)
                    ]
                ),
                lambda s: F.struct(s["node"].alias("node"), s["size"].alias("size")),
            )
        )
        chosen = bands.groupBy("band", "key").agg(leaders.alias("leaders"), F.count(F.lit(1)).alias("n"))
        met = bands.join(chosen.where("n > 1"), ["band", "key"])
        pairs = met.select("node", "size", F.explode("leaders").alias("leader")).where(
            (F.col("node") != F.col("leader.node"))
            & self.alike_in_size(F.col("size"), F.col("leader.size"))
        )
        # A single band may be a passage that many have; near copies share several.
        return (
            pairs.groupBy(
                F.least("node", "leader.node").alias("a"), F.greatest("node", "leader.node").alias("b")
            )
            .agg(F.count(F.lit(1)).alias("bands"))
            .where("bands > 1")
            .select("a", "b")
        )

    def alike_in_size(self, one: Column, other: Column) -> Column:
        """Sets of other sizes can't be similar enough."""
        return 100 * F.least(one, other) >= self.percent * F.greatest(one, other)

    def prefix_entries(self, names: DataFrame) -> DataFrame:
        """(token, node, orders, size, component, many) for all prefix tokens that different components
        (``names(node, component)``; other nodes are their own) share; ``many``: that many nodes have."""
        ws, percent, words = self.ws, self.percent, self.words
        sketch = self.spark.sparkContext.broadcast(_levels(self.counts).tobytes())
        parts = self.nodes.rows // PART_DOCUMENTS + 1
        second = ws.save(
            self.texts.mapInArrow(lambda b: _second_pass(b, sketch, parts, percent, words), SECOND), "prefixes"
        ).df
        rare = (
            second.where("NOT frequent")
            .select("part", "packed")
            .groupBy("part")
            .applyInArrow(_shared, "token long, node long, orders int")
        )
        often = second.where("frequent").select("token", "node", "orders").distinct()
        placed = self.nodes.df.join(names, "node", "left").select(
            "node", "size", F.coalesce("component", "node").alias("component")
        )
        entries = rare.union(often).join(placed, "node")
        entries = ws.save(entries, "entries").df
        # Tokens that more than one component has.
        open_ = (
            entries.groupBy("token")
            .agg(
                F.min("component").alias("low"),
                F.max("component").alias("high"),
                (F.count(F.lit(1)) > CLUSTERED).alias("many"),
            )
            .where("low != high")
            .select("token", "many")
        )
        return ws.save(entries.join(open_, "token"), "open").df

    def candidates(self, entries: DataFrame) -> DataFrame:
        """Pairs of different components that share enough prefix tokens under all orders, by tokens that
        not many nodes have; pairs that share others are within a cluster."""
        entries = entries.where("NOT many")
        other = entries.select(
            "token",
            F.col("node").alias("b"),
            F.col("orders").alias("b_orders"),
            F.col("size").alias("b_size"),
            F.col("component").alias("b_component"),
        )
        met = entries.join(other, "token").where(
            (F.col("node") < F.col("b"))
            & (F.col("component") != F.col("b_component"))
            & (F.col("orders").bitwiseAND(F.col("b_orders")) != 0)
            & self.alike_in_size(F.col("size"), F.col("b_size"))
        )
        both = F.col("orders").bitwiseAND(F.col("b_orders"))
        counts = [F.sum(F.shiftright(both, i).bitwiseAND(1)).alias(f"n{i}") for i in range(ORDERS)]
        paired = met.groupBy(F.col("node").alias("a"), "b", "size", "b_size").agg(*counts)
        least = self.least_shared(F.col("size"), F.col("b_size"))
        enough = [F.col(f"n{i}") >= least for i in range(ORDERS)]
        return paired.where(reduce(and_, enough)).select("a", "b")

    def least_shared(self, one: Column, other: Column) -> Column:
        """How many tokens both prefixes share at least, under any order, if two sets are similar enough.

        Of the shared tokens those up to the end of the prefix that ends first are in both; what
        is left of that set is no more than its size less its prefix.
        """
        percent = self.percent
        needed = F.ceil(F.lit(percent) * (one + other) / (100 + percent))
        rest = F.ceil(F.lit(percent) * F.greatest(one, other) / 100) - 1
        return F.greatest(needed - rest, F.lit(1))

    def named(self) -> DataFrame:
        """(node, doc_id, component) for every node."""
        near = self.ws.save(self.linked(self.led()), "links").df
        names = components(near, self.ws)
        # A pair that lacks shared tokens among those of few nodes has some among those of many, so it
        # is within a cluster; there all prefix tokens count.
        entries = self.prefix_entries(names)
        more = self.ws.save(self.linked(self.candidates(entries)), "links").df
        rest = self.ws.save(self.linked_clusters(entries), "links").df
        names = components(near.union(more).union(rest), self.ws)
        return (
            self.nodes.df.select("node", "doc_id")
            .join(names, "node", "left")
            .select("node", "doc_id", F.coalesce("component", "node").alias("component"))
        )


def _joined(docs: DataFrame, percent: int, words: int) -> Join:
    columns_named(docs, "doc_id", "text")
    if not 50 < percent <= 100:
        raise ValueError("percent must be over 50, up to 100")
    return Join(docs, percent, words, Workspace(docs.sparkSession))


def link_components(docs: DataFrame, *, percent: int, words: int) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs(doc_id, text)``: the size of its set of
    shingles of ``words`` words, and the smallest doc_id reachable by links.

    Words are separated by space, tab and line ends, with A-Z in lower case.  Sets with
    100 * intersection >= percent * union link.  A text with fewer words has one shingle, all its words; a null
    text or one without words has none, and links with nothing.  Shingles are compared by 64-bit
    hashes.  Rows that repeat a doc_id have components of their own texts; a null doc_id is never
    smallest, and is its own component's name if no other is there.  Other columns are ignored; an empty table
    gives an empty result.
    """
    join = _joined(docs, percent, words)
    named = join.named()
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_node = named.join(least, "component").select("node", "component_id")
    return join.rows.join(by_node, "node", "left").select(
        "doc_id",
        F.col("size").cast("long").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
    )


def one_of_each(docs: DataFrame, *, percent: int, words: int) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component of ``link_components`` the row with
    the smallest doc_id stays, of several that repeat it one; rows without an id come last.  Rows
    without words link with nothing and stay.  All columns stay as they are.
    """
    join = _joined(docs, percent, words)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    chosen = (
        join.rows.where("node IS NOT NULL")
        .select("node", "doc_id", "text_hash")
        .join(join.named().select("node", "component"), "node")
        .groupBy("component")
        .agg(first.alias("first"))
        .select(F.col("first.doc_id").alias("first_id"), F.col("first.text_hash").alias("first_hash"))
    )
    chosen = join.ws.save(chosen, "chosen").df
    wordless = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    # Rows travel whole, so that no column of theirs meets one of the join's.
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.where(~wordless).select(
        F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"), whole.alias("row")
    )
    kept = keyed.join(
        chosen,
        F.col("id").eqNullSafe(F.col("first_id")) & (F.col("hash") == F.col("first_hash")),
        "left_semi",
    )
    once = kept.groupBy("id", "hash").agg(F.first("row").alias("row")).select("row.*")
    return once.unionByName(docs.where(wordless))
