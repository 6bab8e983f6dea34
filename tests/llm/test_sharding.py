import pytest

from crossweave.llm import queries, sharding


def laid_out(df):
    """Rows of each shard by slot; slots must have no gaps."""
    shards = {}
    for row in df.collect():
        shards.setdefault(row.shard, {})[row.slot] = row.row
    for own in shards.values():
        assert sorted(own) == list(range(len(own)))
    return shards


def records(spark, n, parts=3):
    return spark.range(0, n, 1, parts).selectExpr("id", "repeat('x', int(id % 50)) AS text")


@pytest.mark.parametrize("n, shards", [(1000, 40), (1003, 40), (7, 40), (40, 40), (1, 1), (100, 1)])
def test_counts_are_at_most_one_apart(spark, n, shards):
    found = laid_out(sharding.shuffled(records(spark, n), shards=shards, bucket_bytes=2000))
    sizes = [len(found.get(s, ())) for s in range(shards)]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1
    assert sorted(r.id for own in found.values() for r in own.values()) == list(range(n))


def order(df):
    return [r.id for _, own in sorted(laid_out(df).items()) for _, r in sorted(own.items())]


def test_seeds(spark):
    docs = records(spark, 2000)
    first = order(sharding.shuffled(docs, shards=7, seed=1, bucket_bytes=9000))
    assert first == order(sharding.shuffled(docs, shards=7, seed=1, bucket_bytes=9000))
    assert first != order(sharding.shuffled(docs, shards=7, seed=2, bucket_bytes=9000))


@pytest.mark.parametrize("bucket_bytes", [1 << 20, 3000])
def test_places_are_uniform(spark, bucket_bytes):
    """Over many seeds every tenth of the records is met in every tenth of the order alike (chi squared)."""
    n, tenths, seen, docs = 200, 10, [[0] * 10 for _ in range(10)], records(spark, 200).cache()
    for seed in range(12):
        for place, own in enumerate(order(sharding.shuffled(docs, shards=3, seed=seed, bucket_bytes=bucket_bytes))):
            seen[own * tenths // n][place * tenths // n] += 1
    expected = n * 12 / tenths**2
    chi = sum((x - expected) ** 2 / expected for row in seen for x in row)
    assert chi < 150  # 81 degrees of freedom: less than one in a hundred thousand are greater


def test_within_a_bucket_all_orders_come(spark):
    found = {tuple(order(sharding.shuffled(records(spark, 3, 1), shards=1, seed=s))) for s in range(40)}
    assert len(found) == 6


def test_awkward_rows(spark, awkward, listed):
    odd = awkward.selectExpr("*", "map('a', 1) AS row", "1 AS bucket", "2 AS number", "3 AS draw", "4 AS shard", "5 AS offset")
    found = sharding.shuffled(odd, shards=4, bucket_bytes=100)
    assert sorted(map(str, (r.row for r in found.collect()))) == sorted(map(str, odd.collect()))
    laid_out(found)
    empty = sharding.shuffled(odd.limit(0), shards=4)
    assert empty.columns == ["row", "shard", "slot"] and empty.collect() == []


def test_one_value_in_all_rows_leaves_buckets_even(spark):
    same = spark.range(0, 5000, 1, 4).selectExpr("null AS doc_id", "'one text' AS text")
    found = sharding.shuffled(same, shards=10, bucket_bytes=5000)
    assert {len(own) for own in laid_out(found).values()} == {500}


def test_written_shards(spark, tmp_path):
    docs = records(spark, 500)
    sharding.write_shards(docs, str(tmp_path / "out"), shards=6, bucket_bytes=4000)
    found = laid_out(spark.read.parquet(str(tmp_path / "out")))
    assert sorted(len(own) for own in found.values()) == [83, 83, 83, 83, 84, 84]
    one = spark.read.parquet(str(tmp_path / "out" / "shard=0")).select("slot")
    for part in one.rdd.glom().collect():
        slots = [r.slot for r in part]
        assert slots == sorted(slots) or len(part) == 0


def test_query(spark):
    found = queries.op12_sharding(spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    from zlib import crc32

    assert {r.doc_id: (r["size"], r.text_crc32) for r in found} == {
        i: (len(t.encode()) + 16, crc32(t.encode())) for i, t in docs.items()
    }
    assert {(r.law, r.grown_shard) for r in found} == {("rows", None)}
