"""The mixture against the windows it must keep, and against a schedule by hand."""

from collections import Counter
from fractions import Fraction

from pyspark.sql import functions as F

from crossweave.llm import mixing


def by_hand(blocks, weight):
    """Earliest deadline first, slot by slot, in fractions: a block may run once it flows."""
    order, done, flown, flow = [], Counter(), Counter(), Fraction(0)
    weight = {s: Fraction(w) for s, w in weight.items()}
    for _ in range(sum(blocks.values())):
        room = Fraction(1)
        while room:
            live = [s for s in blocks if flown[s] < blocks[s]]
            rate = sum(weight[s] for s in live)
            step = min([room / rate] + [(blocks[s] - flown[s]) / weight[s] for s in live])
            for s in live:
                flown[s] += step * weight[s]
            room, flow = room - step * rate, flow + step
        ready = [s for s in blocks if done[s] < blocks[s] and done[s] / weight[s] < flow]
        best = min(ready, key=lambda s: ((done[s] + 1) / weight[s], s))
        order.append((best, done[best]))
        done[best] += 1
    return order


def mixed(docs, **more):
    rows = mixing.mix(docs, mixing.tempered(docs, 0.5), **more).collect()
    return sorted(rows, key=lambda r: r.position)


def test_schedule_equals_one_by_hand(spark):
    sizes = {"a": 61, "b": 17, None: 9, "c": 2, "d": 40}
    weight = {"a": 0.37, "b": 1.13, None: 0.071, "c": 0.9, "d": 0.2}
    rows = [(i, s) for s, n in sizes.items() for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    weights = spark.createDataFrame(list(weight.items()), "source string, weight double")
    got = sorted(mixing.mix(docs, weights, block_rows=3, seed=5).collect(), key=lambda r: r.position)
    assert [r.position for r in got] == list(range(len(rows)))
    key = {s: "null" if s is None else "=" + s for s in sizes}
    seen = list(dict.fromkeys((key[r.source], r.source_block) for r in got))
    assert seen == by_hand({key[s]: -(-n // 3) for s, n in sizes.items()}, {key[s]: w for s, w in weight.items()})
    assert sorted(map(repr, rows)) == sorted(repr((r.doc_id, r.source)) for r in got)


def test_groups_and_spans_number_a_source_alike(spark, monkeypatch):
    docs = spark.range(900).selectExpr("id AS doc_id", "if(id % 3 = 0, 'x', 'hot') AS source")
    # The order is the groups', so compare what must hold for any of them.
    monkeypatch.setattr(mixing, "GROUP_ROWS", 7)
    monkeypatch.setattr(mixing, "SPAN", 4)
    got = mixed(docs, block_rows=10)
    assert [r.position for r in got] == list(range(900))
    sizes = Counter((r.source, r.source_block) for r in got)
    assert set(sizes.values()) == {10}


def test_awkward_rows(awkward, listed):
    got = mixing.mix(awkward, mixing.tempered(awkward, 0.5), block_rows=2)
    assert sorted(r.position for r in got.collect()) == list(range(awkward.count()))
    ordered = mixing.in_order(awkward, mixing.tempered(awkward, 0.5), block_rows=2)
    assert ordered.columns == awkward.columns and listed(ordered) == listed(awkward)
    none = awkward.limit(0)
    assert mixing.mix(none, mixing.tempered(none, 0.5), block_rows=2).count() == 0
    assert mixing.in_order(none, mixing.tempered(none, 0.5), block_rows=2).count() == 0


def test_bad_weights_get_the_least_share(spark):
    docs = spark.createDataFrame([(i, s) for s in "abc" for i in range(6)], "doc_id long, source string")
    weights = spark.createDataFrame(
        [("a", 3.0), ("b", float("nan")), ("c", -1.0), ("d", 2.0)], "source string, weight double"
    )
    first = mixing.mix(docs, weights, block_rows=1).orderBy("position").limit(6).collect()
    assert [r.source for r in first] == ["a"] * 6


def farthest(got, weight, block_rows):
    """The greatest distance of a source from its target by true weights, over all slots and all sources."""
    blocks = list(dict.fromkeys((r.source, r.source_block) for r in got))
    left, flown, seen = Counter(s for s, _ in blocks), Counter(), Counter()
    size, worst = dict(left), 0.0
    for source, k in blocks:
        assert k == seen[source]
        seen[source] += 1
        room = 1.0  # of this slot, in which sources may end
        while room > 1e-12:
            live = {s: weight[s] for s in size if size[s] - flown[s] > 1e-9}
            total = sum(live.values())
            if not live:
                break
            part = min([room] + [(size[s] - flown[s]) * total / w for s, w in live.items()])
            for s, w in live.items():
                flown[s] += part * w / total
            room -= part
        worst = max(worst, max(abs(seen[s] - flown[s]) for s in size))
    return worst


def test_true_weights_on_a_small_table_through_each_end(spark):
    sizes = {"hot": 3333, None: 200} | {f"s{i}": 100 + 29 * i for i in range(18)}
    docs = spark.createDataFrame(
        [(i, s) for s, n in sizes.items() for i in range(n)], "doc_id long, source string"
    )
    got = mixed(docs, block_rows=64)
    assert [r.position for r in got] == list(range(sum(sizes.values())))
    assert farthest(got, {s: n**0.5 for s, n in sizes.items()}, 64) < 1 + 1e-6


def test_true_weights_without_rounding_to_slots(spark):
    sizes = {"hot": 1000, "tiny": 30} | {f"s{i}": 400 for i in range(19)}
    weight = {"hot": 0.1396, "tiny": 0.0002} | {f"s{i}": 0.8602 / 19 for i in range(19)}
    docs = spark.createDataFrame(
        [(i, s) for s, n in sizes.items() for i in range(n)], "doc_id long, source string"
    )
    weights = spark.createDataFrame(list(weight.items()), "source string, weight double")
    got = sorted(mixing.mix(docs, weights, block_rows=1).collect(), key=lambda r: r.position)
    assert [r.position for r in got] == list(range(sum(sizes.values())))
    assert farthest(got, weight, 1) < 1 + 1e-6


def test_any_number_of_sources(spark):
    sizes = {"hot": 900, None: 40} | {f"s{i}": 1 + i % 9 for i in range(600)}
    docs = spark.createDataFrame(
        [(i, s) for s, n in sizes.items() for i in range(n)], "doc_id long, source string"
    )
    got = mixed(docs, block_rows=2)
    assert [r.position for r in got] == list(range(sum(sizes.values())))
    assert sizes == Counter(r.source for r in got)
    assert farthest(got, {s: n**0.5 for s, n in sizes.items()}, 2) < 1 + 1e-6


def test_many_sources_of_mixed_weights(spark):
    sizes = {f"h{i}": 12 for i in range(130)} | {f"l{i}": 4 for i in range(200)}
    weight = {f"h{i}": 8.0 for i in range(130)}
    weight |= {f"l{i}": (1.0, 1.3, 1.9)[i % 3] * (1.0, 0.25, 0.06)[i // 3 % 3] for i in range(200)}
    docs = spark.createDataFrame(
        [(i, s) for s, n in sizes.items() for i in range(n)], "doc_id long, source string"
    )
    weights = spark.createDataFrame(list(weight.items()), "source string, weight double")
    got = sorted(mixing.mix(docs, weights, block_rows=1).collect(), key=lambda r: r.position)
    assert farthest(got, weight, 1) < 1 + 1e-6


def test_few_rows_make_few_parts(spark):
    """Rows are dealt to no more parts than cores and rows ask for, still in the mixture's order."""
    docs = spark.createDataFrame([(i, "ab"[i % 3 == 0]) for i in range(300)], "doc_id long, source string")
    weights, setting = mixing.tempered(docs, 0.5), "spark.sql.shuffle.partitions"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "64")
    try:
        got = mixing.in_order(docs, weights, block_rows=4).withColumn("part", F.spark_partition_id()).collect()
        expected = mixing.mix(docs, weights, block_rows=4).orderBy("position").collect()
    finally:
        spark.conf.set(setting, before)
    assert len({r.part for r in got}) <= 2 * spark.sparkContext.defaultParallelism
    assert [r.source for r in got] == [r.source for r in expected]
    assert sorted(r.doc_id for r in got) == list(range(300))
