"""The search against comparing all with all."""

import numpy as np
import pyarrow as pa
import pytest

from crossweave.llm import topk_search as search


def by_hand(rows, every, k):
    sound = {
        (i, tuple(int(np.floor(256 * float(np.float32(x)))) for x in v))
        for i, v in rows
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    }
    out = []
    for own, q in sound:
        if own % every:
            continue
        best = {}
        for i, v in sound:
            if i != own and len(v) == len(q):
                score = sum(a * b for a, b in zip(q, v, strict=True))
                best[i] = max(score, best.get(i, score))
        ranked = sorted((-s, i) for i, s in best.items())[:k]
        out += [(own, r, i, -s) for r, (s, i) in enumerate(ranked, 1)]
    return sorted(out)


def vectors(spark):
    random = np.random.default_rng(1)
    rows = [(i, random.standard_normal(6).astype(np.float32).tolist()) for i in range(600)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)] + rows[:5]
    rows += [(None, [1.0] * 6), (2000, None), (2001, []), (2010, []), (2020, [float("nan")] * 6)]
    rows += [(2030, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2040, [float("inf")] * 6), (2050, [0.5, 0.5])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return rows, frame.selectExpr("*", "vec_id AS score", "vec_id AS shard", "vec_id AS query_id")


@pytest.mark.parametrize("shard_rows, block", [(8192, 4096), (60, 4096), (100, 7)])
def test_search_equals_all_pairs(spark, listed, monkeypatch, shard_rows, block):
    monkeypatch.setattr(search, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(search, "BLOCK_QUERIES", block)
    rows, frame = vectors(spark)
    assert listed(search.top_k(frame, every=10, k=5)) == sorted(by_hand(rows, 10, 5), key=repr)


def test_large_numbers_stay_exact(spark, listed):
    rows = [(i, [1e9 + i, 2e9, -1e8 * i]) for i in range(20)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = listed(search.top_k(frame, every=5, k=3, levels=1))
    exact = sorted(
        (q, r, i, -s)
        for q in range(0, 20, 5)
        for r, (s, i) in enumerate(
            sorted(
                (-sum(int(a) * int(b) for a, b in zip(rows[q][1], rows[i][1], strict=True)), i)
                for i in range(20)
                if i != q
            )[:3],
            1,
        )
    )
    assert got == sorted(exact, key=repr)


def test_empty_table(spark):
    _, frame = vectors(spark)
    assert search.top_k(frame.limit(0), every=10, k=5).count() == 0


def test_bounds_hold_and_balls_are_skipped():
    random = np.random.default_rng(2)
    points = (random.standard_normal((2000, 3)) * 300).astype(np.int64)
    tree = search.BallTree(np.arange(2000), points)
    queries = points[:20]
    bounds = tree.bounds(queries)
    for node, (low, high) in enumerate(tree.ranges):
        assert (queries @ tree.vectors[low:high].T <= bounds[:, node : node + 1]).all()
    reads = []
    tree.ranges = type("Watched", (list,), {"__getitem__": lambda s, i: reads.append(i) or list.__getitem__(s, i)})(tree.ranges)
    tree.search(0, queries[0], bounds[0], 5, None)
    assert len(reads) < len(tree.ranges) / 4


@pytest.mark.parametrize("shard_rows", [8192, 40])
def test_ids_repeated_with_different_vectors_take_one_place(spark, listed, monkeypatch, shard_rows):
    monkeypatch.setattr(search, "SHARD_ROWS", shard_rows)
    random = np.random.default_rng(4)
    near = lambda: (2 + 0.1 * random.standard_normal(6)).astype(np.float32).tolist()
    rows = [(i, random.standard_normal(6).astype(np.float32).tolist()) for i in range(200)]
    rows += [(i, near()) for i in (7, 13, 20, 30) for _ in range(70)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    best = {}
    for q, _, i, score in by_hand(rows, 10, len(rows)):
        best[q, i] = max(score, best.get((q, i), score))
    expected = []
    for q in range(0, 200, 10):
        ranked = sorted((-s, i) for (own, i), s in best.items() if own == q)[:5]
        expected += [(q, r, i, -s) for r, (s, i) in enumerate(ranked, 1)]
    assert listed(search.top_k(frame, every=10, k=5)) == sorted(expected, key=repr)


def visited(rows, k=5):
    """(cells that queries of clustered vectors are sent to, cells in all, whether none was missed)."""
    random = np.random.default_rng(5)
    middles = random.standard_normal((rows // 40, 6)) * 300
    points = (np.repeat(middles, 40, axis=0) + 20 * random.standard_normal((rows // 40 * 40, 6))).astype(np.int64)
    table = pa.table({"vec_id": np.arange(len(points)), "vector": points.tolist(), "size": [6] * len(points)})
    cells = search.Cells(table, 40)
    cell, away = cells.route(points)
    radii = np.zeros(cells.count)
    np.maximum.at(radii, cell, away)
    asked = points[::20]
    scores = np.sort(asked @ points.T, axis=1)[:, -k]
    sent = pa.table(
        {"query_id": np.arange(len(asked)), "vector": asked.tolist(), "size": [6] * len(asked), "floor": scores}
    )
    met = []
    for low, high in ((0, 4), (4, search.MOST_CELLS + 1)):
        for batch in cells.reach(radii, low, high, iter(sent.to_batches())):
            met += zip(batch["query_id"].to_pylist(), batch["cells"].to_pylist(), strict=True)
    reached = {(q, c) for q, own in met for c in own}
    assert len(reached) == sum(len(own) for _, own in met)
    whole = all(
        (q, int(cell[i])) in reached
        for q, query in enumerate(asked)
        for i in (points @ query >= scores[q]).nonzero()[0]
    )
    return len(reached), cells.count - 1, len(asked), whole


def test_pruned_cells_hold_nothing_wanted_and_rows_sent_grow_less_than_the_square():
    few, cells, asked, whole = visited(2000)
    many, more_cells, more_asked, whole_too = visited(8000)
    assert whole and whole_too
    assert few < cells * asked / 3 and many < more_cells * more_asked / 3
    assert more_cells > 3 * cells and many < few * 16 * 0.6


def test_vectors_of_a_length_unknown_to_the_sample_are_searched(spark, listed, monkeypatch):
    monkeypatch.setattr(search, "SHARD_ROWS", 30)
    monkeypatch.setattr(search, "SAMPLE_ROWS", 40)
    rows, frame = vectors(spark)
    rows = rows + [(3000 + i, [float(i), 1.0, -float(i)]) for i in range(20)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert listed(search.top_k(frame, every=10, k=5)) == sorted(by_hand(rows, 10, 5), key=repr)
