"""Fingerprints one by one, and the search against all pairs."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from crossweave.llm import simhash


def by_hand(docs):
    rows = sorted(
        docs.select("doc_id", F.coalesce("text", F.lit("")), F.xxhash64("text")).collect(),
        key=lambda r: (r[0] is not None, r[0] or 0, r[2]),
    )
    out = []
    for i, (doc_id, text, _) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        moved = len(text) // 4
        edited = text[: len(text) - moved] + after[:moved]
        one, two, three = (simhash.fingerprint(t.encode()) for t in (text, edited, after))
        out.append(
            (
                doc_id,
                len(text),
                hashlib.sha256(edited.encode()).hexdigest(),
                one.hex(),
                two.hex(),
                simhash.likeness(one, two, not text, not edited),
                simhash.likeness(one, three, not text, not after),
            )
        )
    return sorted(out, key=repr)


@pytest.mark.parametrize("part_rows", [2048, 2])
def test_rows_equal_one_by_one(awkward, listed, monkeypatch, part_rows):
    monkeypatch.setattr(simhash, "PART_ROWS", part_rows)
    assert listed(simhash.fingerprints(awkward)) == by_hand(awkward)


def test_small_tables(awkward, listed):
    assert simhash.fingerprints(awkward.limit(0)).count() == 0
    assert simhash.with_near_counts(awkward.limit(0), every=2, radius=3).count() == 0
    one = awkward.limit(1)
    assert listed(simhash.fingerprints(one)) == by_hand(one)


def test_likeness_tells_edits_from_strangers(sample):
    got = simhash.fingerprints(sample).where("n_chars > 200").collect()
    assert sum(r.near_edited > r.near_next for r in got) > 0.98 * len(got)


def test_long_texts_in_steps(monkeypatch):
    text = random.Random(4).randbytes(5000).replace(b" ", b"  ")
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "AT_ONCE", 64)
    # A word that begins just at a step's first byte may lose its second vote: hardly any bit turns.
    assert (int.from_bytes(whole) ^ int.from_bytes(simhash.fingerprint(text))).bit_count() <= 4


@pytest.mark.parametrize("radius", [0, 1, 3, 4])
def test_search_equals_all_pairs(spark, listed, radius):
    pick = random.Random(radius)
    prints = {pick.getrandbits(128) for _ in range(40)}
    for value in list(prints):
        for _ in range(6):
            turned = value
            for bit in pick.sample(range(128), pick.randint(1, 6)):
                turned ^= 1 << bit
            prints.add(turned)
    texts = [f"{p:032x}" for p in prints]
    all_prints = spark.createDataFrame([(t,) for t in texts + texts[:9] + [None]], "fingerprint string")
    queries = all_prints.limit(60)
    asked = {r[0] for r in queries.collect() if r[0]}
    expected = [
        (a, b, d)
        for a in asked
        for b in texts
        if (d := (int(a, 16) ^ int(b, 16)).bit_count()) <= radius
    ]
    assert listed(simhash.near_fingerprints(queries, all_prints, radius)) == sorted(expected, key=repr)


def test_counts_of_near_rows(sample):
    got = simhash.with_near_counts(sample, every=10, radius=3).collect()
    values = [int(r.fingerprint, 16) for r in got]
    for r, own in zip(got, values, strict=True):
        if r.doc_id % 10:
            assert r.n_near is None
        else:
            assert r.n_near == sum((own ^ v).bit_count() <= 3 for v in values) - 1
