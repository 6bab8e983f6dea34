"""Exact top-k search by inner product: a ball tree per shard, searched by branch and bound.

A top tree, fitted on a bounded sample, deals all vectors to cells of near ones; a cell is cut
into shards of bounded size.  A query is answered in its own shard first, then in the cells of the
greatest upper bounds, then in the others.  Its k-th score so far goes with it each time: a cell whose bound
doesn't reach that score is not visited, so the query isn't shipped there, and within a shard a
ball is opened only if its bound reaches it.  Queries come in blocks, so a task holds one shard and one block.
The cells change only what is read: any sample, or none, gives the same results.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crossweave.llm.worker import by_value, columns_named
from crossweave.workspace import Workspace

by_value(__name__)

#: Vectors of a shard and queries of a block, on average.
SHARD_ROWS = 8192
BLOCK_QUERIES = 4096
LEAF_ROWS = 48
#: Rows that the top tree is fitted on, the least of these in a cell, and so the number of cells.
SAMPLE_ROWS = 8192
CELL_SAMPLE = 16
MOST_CELLS = SAMPLE_ROWS // CELL_SAMPLE
#: Cells visited before the k-th score is passed on to the rest.
FIRST_CELLS = 4
# Below this, sums of products of whole numbers are exact in double precision.
EXACT = 2.0**53
HITS = "query_id long, vec_id long, score long"


def upper_bounds(queries: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """The most that each query can score in each ball, safe against rounding."""
    asked = queries.astype(np.float64)
    lengths = np.sqrt((asked**2).sum(axis=1))
    bound = asked @ centres.T + np.outer(lengths, radii)
    size = np.outer(lengths, np.sqrt((centres**2).sum(axis=1)) + radii)
    return bound + 1e-9 * size + 1e-6


class BallTree:
    """Balls around whole-number vectors; leaves are ranges of the reordered rows."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.arange(len(ids))
        points = vectors.astype(np.float64)
        centres, radii, ranges, children = [], [], [], []
        todo = [(0, len(ids), -1, 0)]
        while todo:
            low, high, parent, side = todo.pop()
            own = points[order[low:high]]
            centre = own.mean(axis=0)
            away = np.sqrt(((own - centre) ** 2).sum(axis=1))
            node = len(centres)
            centres.append(centre)
            radii.append(away.max())
            ranges.append((low, high))
            children.append([-1, -1])
            if parent >= 0:
                children[parent][side] = node
            if high - low <= LEAF_ROWS or away.max() == 0:
                continue
            # Split along the line between two far points.
            one = own[away.argmax()]
            other = own[((own - one) ** 2).sum(axis=1).argmax()]
            middle = (high - low) // 2
            along = np.argpartition(own @ (other - one), middle)
            order[low:high] = order[low:high][along]
            todo += [(low, low + middle, node, 0), (low + middle, high, node, 1)]
        self.ids, self.vectors = ids[order], vectors[order]
        self.repeats = len(np.unique(ids)) < len(ids)
        self.points = points[order]
        self.centres, self.radii = np.array(centres), np.array(radii)
        self.ranges, self.children = ranges, children
        self.largest = float(np.abs(points).max()) if points.size else 0.0

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bounds of the score of each query in each ball, safe against rounding."""
        return upper_bounds(queries, self.centres, self.radii)

    def search(
        self, own: int, query: np.ndarray, bounds: np.ndarray, k: int, floor: int | None
    ) -> list[tuple[int, int]]:
        """The k best (score, id) of this shard that may be among the k best of all, each id once:
        greater scores first, then smaller ids; scores below ``floor`` don't count."""
        exact = self.largest * float(np.abs(query).max(initial=0)) * len(query) < EXACT
        rows, asked = (
            (self.points, query.astype(np.float64)) if exact else (self.vectors, query)
        )
        best: list[tuple[int, int]] = []  # (-score, id), sorted
        least = floor
        heap = [(-bounds[0], 0)]
        while heap:
            bound, node = heappop(heap)
            if least is not None and -bound < least:
                break  # no other ball can hold a better one
            left, right = self.children[node]
            if left >= 0:
                heappush(heap, (-bounds[left], left))
                heappush(heap, (-bounds[right], right))
                continue
            low, high = self.ranges[node]
            scores = rows[low:high] @ asked
            ids = self.ids[low:high]
            fits = ids != own
            if least is not None:
                fits &= scores >= least
            (at,) = fits.nonzero()
            if not len(at):
                continue
            if self.repeats:
                # Of each id its greatest score, here and among the best so far.
                at = at[np.lexsort((-scores[at], ids[at]))]
                at = at[np.unique(ids[at], return_index=True)[1]]
            if len(at) > k:
                at = at[np.lexsort((ids[at], -scores[at]))[:k]]
            best = sorted(best + [(-int(scores[i]), int(ids[i])) for i in at])
            if self.repeats:
                firsts: dict[int, int] = {}
                for score, i in best:
                    firsts.setdefault(i, score)
                best = [(score, i) for i, score in firsts.items()]
            best = best[:k]
            if len(best) == k:
                least = max(-best[-1][0], least) if least is not None else -best[-1][0]
        return [(-score, i) for score, i in best]


def _vectors(table: pa.Table) -> Iterator[tuple[np.ndarray, pa.Table]]:
    """(vectors, rows) for each dimension there is: vectors of other lengths don't compare."""
    if not table.num_rows:
        return
    lengths = np.asarray(table["size"])
    for size in np.unique(lengths):
        rows = table.filter(pa.array(lengths == size))
        flat = np.asarray(rows["vector"].combine_chunks().flatten(), dtype=np.int64)
        yield flat.reshape(rows.num_rows, int(size)), rows


class Cells:
    """The top tree: for each length of vectors in the sample, cells of near vectors around a centre.

    Cell 0 has the vectors of all other lengths and no bound.
    """

    def __init__(self, sample: pa.Table, cell_rows: int):
        #: By length: the nodes (direction, border, left, right), or a cell; the root comes first.
        self.trees: dict[int, list] = {}
        #: By length: its first cell and the centres of its cells.
        self.centres: dict[int, tuple[int, np.ndarray]] = {}
        self.count = 1
        for vectors, _ in _vectors(sample):
            size = vectors.shape[1]
            if size and len(vectors) >= CELL_SAMPLE:
                self._fit(size, vectors.astype(np.float64), cell_rows)

    def _fit(self, size: int, points: np.ndarray, cell_rows: int) -> None:
        nodes: list = [None]
        centres: list[np.ndarray] = []
        first = self.count
        todo = [(0, points)]
        while todo:
            node, own = todo.pop()
            centre = own.mean(axis=0)
            away = ((own - centre) ** 2).sum(axis=1)
            if len(own) > cell_rows and len(own) >= 2 * CELL_SAMPLE:
                one = own[away.argmax()]
                direction = own[((own - one) ** 2).sum(axis=1).argmax()] - one
                along = own @ direction
                border = np.partition(along, len(own) // 2)[len(own) // 2]
                left = along < border
                if min(left.sum(), (~left).sum()) >= CELL_SAMPLE:
                    nodes[node] = (direction, border, len(nodes), len(nodes) + 1)
                    todo += [(len(nodes), own[left]), (len(nodes) + 1, own[~left])]
                    nodes += [None, None]
                    continue
            nodes[node] = first + len(centres)
            centres.append(centre)
        self.trees[size] = nodes
        self.centres[size] = first, np.array(centres)
        self.count += len(centres)

    def route(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each vector, and how far it is from that cell's centre."""
        cell, away = np.zeros(len(vectors), np.int32), np.zeros(len(vectors))
        nodes = self.trees.get(vectors.shape[1])
        if nodes is None:
            return cell, away
        points = vectors.astype(np.float64)
        first, centres = self.centres[vectors.shape[1]]
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if isinstance(nodes[node], int):
                cell[at] = nodes[node]
                away[at] = np.sqrt(((points[at] - centres[nodes[node] - first]) ** 2).sum(axis=1))
                continue
            direction, border, left, right = nodes[node]
            low = points[at] @ direction < border
            todo += [(left, at[low]), (right, at[~low])]
        return cell, away

    def assign(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with ``cell`` and ``away``; of equal ones in a batch, one."""
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            for vectors, own in _vectors(rows):
                ids = np.asarray(own["vec_id"], dtype=np.int64)
                _, once = np.unique(np.column_stack([ids, vectors]), axis=0, return_index=True)
                cell, away = self.route(vectors[once])
                placed = own.take(pa.array(once)).append_column("cell", pa.array(cell, pa.int32()))
                yield from placed.append_column("away", pa.array(away, pa.float64())).to_batches()

    def reach(
        self, radii: np.ndarray, low: int, high: int, batches: Iterator[pa.RecordBatch]
    ) -> Iterator[pa.RecordBatch]:
        """Queries with ``cells``: of the cells by falling bound, those from the low-th to before the
        high-th that may hold a score of at least the query's floor."""
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_QUERIES):
                rows = pa.Table.from_batches([batch.slice(start, BLOCK_QUERIES)])
                for vectors, own in _vectors(rows):
                    if vectors.shape[1] not in self.trees:
                        cells = [[0] if low == 0 else []] * len(vectors)
                    else:
                        first, centres = self.centres[vectors.shape[1]]
                        bounds = upper_bounds(vectors, centres, radii[first : first + len(centres)])
                        order = np.argsort(-bounds, axis=1, kind="stable")[:, low:high]
                        floors = [-np.inf if f is None else f for f in own["floor"].to_pylist()]
                        fits = np.take_along_axis(bounds, order, axis=1) >= np.array(floors)[:, None]
                        cells = [(first + o[f]).tolist() for o, f in zip(order, fits, strict=True)]
                    yield from own.append_column("cells", pa.array(cells, pa.list_(pa.int32()))).to_batches()


def search_shard(shard: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """Hits of one block of queries in one shard."""
    hits: list[tuple[int, int, int]] = []
    asked = {vectors.shape[1]: (vectors, rows) for vectors, rows in _vectors(queries)}
    for vectors, rows in _vectors(shard):
        if vectors.shape[1] not in asked:
            continue
        ids = np.asarray(rows["vec_id"], dtype=np.int64)
        # Rows that are equal in id and vector count once.
        _, once = np.unique(np.column_stack([ids, vectors]), axis=0, return_index=True)
        tree = BallTree(ids[once], vectors[once])
        block, block_rows = asked[vectors.shape[1]]
        bounds = tree.bounds(block)
        floors = block_rows["floor"].to_pylist()
        for n, own in enumerate(block_rows["query_id"].to_pylist()):
            found = tree.search(own, block[n], bounds[n], k, floors[n])
            hits += [(own, i, score) for score, i in found]
    columns = list(zip(*hits, strict=True)) or [(), (), ()]
    return pa.table(
        {
            n: pa.array(c, pa.int64())
            for n, c in zip(("query_id", "vec_id", "score"), columns, strict=True)
        }
    )


def quantised(vectors: DataFrame, levels: int) -> DataFrame:
    """(vec_id, vector, size): components as floor(levels * x); rows without an id, and vectors
    that are null or hold null or non-finite components, are left out."""
    sound = F.forall(
        "embedding",
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")),
    )
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * levels).cast("long"))
    return vectors.where(F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        whole.alias("vector"),
        F.size("embedding").alias("size"),
    )


def top_k(vectors: DataFrame, *, every: int, k: int, levels: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``vectors(vec_id, embedding)`` whose id is
    divisible by ``every``, the k other ids with the greatest inner product, ties to the smaller id.

    Components count as floor(levels * x), so scores are whole and exact (up to 2**63).  Vectors
    of different lengths don't compare.  Rows equal in id and vector count once; other rows that share
    an id compete with their best score, and never match a query of that id.  Null ids, null
    vectors and such with null or non-finite components take no part; other columns are ignored;
    an empty table gives an empty result.
    """
    columns_named(vectors, "vec_id", "embedding")
    ws = Workspace(vectors.sparkSession)
    table = quantised(vectors, levels)
    wanted = -(-max(vectors.count(), 1) // SHARD_ROWS)
    sample = table.orderBy(F.rand(0)).limit(SAMPLE_ROWS).toArrow()
    cells = Cells(sample, max(sample.num_rows // wanted, CELL_SAMPLE))
    routed = ws.save(
        table.mapInArrow(cells.assign, "vec_id long, vector array<long>, size int, cell int, away double"),
        "cells",
    ).df
    # One row per cell: at most MOST_CELLS and one.
    radii, parts, shards = np.zeros(cells.count), [1] * cells.count, 0
    for cell, radius, n in routed.groupBy("cell").agg(F.max("away"), F.count(F.lit(1))).collect():
        radii[cell], parts[cell] = radius, -(-n // SHARD_ROWS)
        shards += parts[cell]
    by_cell = lambda numbers: F.element_at(F.lit(numbers), F.col("cell") + 1)
    shard_rows = routed.drop("away").withColumn(
        "part", F.pmod(F.xxhash64("vec_id", "vector"), by_cell(parts)).cast("int")
    )
    queries = shard_rows.where(F.pmod("vec_id", F.lit(every)) == 0).withColumnRenamed("vec_id", "query_id")

    def hits(rows: DataFrame, asked: DataFrame) -> DataFrame:
        keys = ["cell", "part", "block"]
        return (
            rows.groupBy(*keys)
            .cogroup(asked.groupBy(*keys))
            .applyInArrow(lambda left, right: search_shard(left, right, k), HITS)
        )

    def best(found: DataFrame) -> DataFrame:
        """The k best ids of each query with their ranks."""
        # A query whose id repeats may have met one id several times.
        met = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def visit(found: DataFrame, low: int, high: int) -> DataFrame:
        """Hits in the low-th to before the high-th cell of each query, but for its own shard."""
        floors = best(found).where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
        sent = ws.save(
            queries.join(floors, "query_id", "left").mapInArrow(
                lambda batches: cells.reach(radii, low, high, batches),
                "query_id long, vector array<long>, size int, cell int, part int, floor long, cells array<int>",
            ),
            "sent",
        ).df
        asked = sent.withColumnsRenamed({"cell": "own_cell", "part": "own_part"}).withColumn(
            "cell", F.explode("cells")
        )
        blocks = [0] * cells.count
        for cell, n in asked.groupBy("cell").count().collect():
            blocks[cell] = -(-n // BLOCK_QUERIES)
        own = (F.col("cell") == F.col("own_cell")) & (F.col("part") == F.col("own_part"))
        away = (
            asked.withColumn("part", F.explode(F.sequence(F.lit(0), by_cell(parts) - 1)))
            .where(~own)
            .withColumn("block", F.pmod(F.xxhash64("query_id", "vector"), by_cell(blocks)).cast("int"))
            .select("query_id", "vector", "size", "floor", "cell", "part", "block")
        )
        rows = shard_rows.where(by_cell(blocks) > 0).withColumn(
            "block", F.explode(F.sequence(F.lit(0), by_cell(blocks) - 1))
        )
        return ws.save(hits(rows, away), "hits").df

    # Queries of one shard are at most about SHARD_ROWS.
    none = F.lit(0).alias("block")
    found = ws.save(
        hits(
            shard_rows.select("*", none),
            queries.select("*", none, F.lit(None).cast("long").alias("floor")),
        ),
        "home",
    ).df
    if shards > 1:
        found = found.unionByName(visit(found, 0, FIRST_CELLS))
    if cells.count - 1 > FIRST_CELLS:
        found = found.unionByName(visit(found, FIRST_CELLS, MOST_CELLS + 1))
    return best(found).select("query_id", "rank", "vec_id", "score")
