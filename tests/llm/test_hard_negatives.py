"""Hard negatives against loops over all pairs."""

import math
import random

import pytest

from crossweave.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, shard int, block int, variant string"


def by_hand(rows, every, positives, negatives, low, high):
    sound = []
    for vec_id, vector, label, *_ in rows:
        if None in (vec_id, label) or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        row = (vec_id, label, tuple(math.floor(256 * x) for x in vector))
        if row not in sound:
            sound.append(row)
    found = []
    for anchor in sound:
        if anchor[0] % every:
            continue
        scored = [
            (-sum(x * y for x, y in zip(anchor[2], other[2])), other[0], other[1])
            for other in sound
            if other[0] != anchor[0] and len(other[2]) == len(anchor[2])
        ]
        scored.sort()
        for down, positive, _ in [s for s in scored if s[2] == anchor[1]][:positives]:
            hard = [s for s in scored if s[2] != anchor[1] and -low * down <= -100 * s[0] <= -high * down]
            for rank, (score, negative, _) in enumerate(hard[:negatives], 1):
                found.append((anchor[0], positive, rank, negative, -down, -score))
    return sorted(found)


def floats(values):
    return [None if x is None else struct_float(x) for x in values]


def struct_float(x):
    import numpy as np

    return float(np.float32(x))


def made(seed, n, dims, spread=1.0, labels=3):
    draw = random.Random(seed)
    return [
        (i, floats([draw.gauss(0, spread) for _ in range(dims)]), draw.randrange(labels), 0, 1, "x")
        for i in range(n)
    ]


@pytest.mark.parametrize("seed, spread", [(1, 1.0), (2, 0.01)])  # the second has many ties
def test_equals_all_pairs(spark, monkeypatch, seed, spread):
    rows = made(seed, 300, 6, spread)
    monkeypatch.setattr(hard_negatives, "SHARD_ROWS", 70)
    monkeypatch.setattr(hard_negatives, "BLOCK_ANCHORS", 11)
    monkeypatch.setattr(hard_negatives, "AT_ONCE", 4)
    monkeypatch.setattr(hard_negatives, "SORTED_PAIRS", 100)
    ask = dict(every=7, positives=3, negatives=4, low=30, high=90)
    found = hard_negatives.mine(spark.createDataFrame(rows, SCHEMA).repartition(3), **ask)
    assert sorted(map(tuple, found.collect())) == by_hand(rows, **ask)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    base = made(3, 60, 4)
    odd = [
        (None, [1.0] * 4, 1, 0, 0, ""),
        (100, None, 1, 0, 0, ""),
        (101, [1.0, None, 1.0, 1.0], 1, 0, 0, ""),
        (102, [1.0, nan, 1.0, 1.0], 1, 0, 0, ""),
        (103, [1.0, -inf, 1.0, 1.0], 1, 0, 0, ""),
        (104, [1.0] * 4, None, 0, 0, ""),
        (105, [], 1, 0, 0, ""),
        (106, [2.0] * 9, 1, 0, 0, ""),
        (-10, [0.5] * 4, 1, 0, 0, ""),  # a negative id can be an anchor
        (110, [0.0] * 4, 2, 0, 0, ""),  # scores 0 throughout
        (111, [100.0] * 4, 0, 0, 0, ""),
    ]
    # Equal rows, and rows that share an id only.
    again = [base[0], base[0], (20, [0.25] * 4, 2, 0, 0, ""), (21, [0.75] * 4, 0, 0, 0, "")]
    rows = base + odd + again
    ask = dict(every=10, positives=4, negatives=5, low=30, high=90)
    found = hard_negatives.mine(spark.createDataFrame(rows, SCHEMA), **ask)
    assert sorted(map(tuple, found.collect())) == by_hand(rows, **ask)
    empty = hard_negatives.mine(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == [] and empty.columns[0] == "anchor_id"


def test_large_components_are_exact(spark):
    """Beyond what doubles can hold, products are still whole and exact."""
    draw = random.Random(9)
    rows = [(i, floats([draw.uniform(2**18, 2**19) for _ in range(3)]), i % 2, 0, 0, "") for i in range(40)]
    ask = dict(every=5, positives=3, negatives=4, low=30, high=90)
    found = hard_negatives.mine(spark.createDataFrame(rows, SCHEMA), **ask)
    assert sorted(map(tuple, found.collect())) == by_hand(rows, **ask)


def test_keys_sort_as_pairs_should():
    import pyarrow as pa

    draw = random.Random(1)
    pairs = [tuple(draw.choice((-3, 0, 2, 2**62, -(2**62))) for _ in range(5)) + (draw.randrange(2),) for _ in range(300)]
    names = ("anchor", "variant", "score", "vec_id", "vec_variant", "kind")
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pairs)], list(names))
    (packed,) = hard_negatives.pack(iter([batch]))
    keys = packed.column(0).to_pylist()
    wanted = sorted(range(300), key=lambda i: (pairs[i][0], pairs[i][1], -pairs[i][2], pairs[i][5], pairs[i][3], pairs[i][4]))
    assert sorted(keys) == [keys[i] for i in wanted]


def test_stream_holds_no_more_than_the_windows():
    """A long stream of one anchor passes through without being kept."""
    from struct import pack

    sign = hard_negatives.SIGN
    key = lambda score, kind, i: pack(
        hard_negatives.KEY, 7 + sign, sign, ~score + sign, kind, i + sign, sign
    )
    stream = ((k, None) for k in [key(1000, 0, 1), *(key(s, 1, 10_000 - s) for s in range(950, 250, -1))])
    found = list(hard_negatives.negatives_of(stream, 5, 3, 30, 90))
    assert [(f[2], f[5]) for f in found] == [(1, 900), (2, 899), (3, 898)]
