"""The join against comparing all sets that share a shingle."""

import random
import re
from collections import Counter, defaultdict

import pytest

from crossweave.llm import ngram_join as join
from crossweave.llm.components import components
from crossweave.llm.shingles import Powers, shingle_sets


def set_by_hand(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def by_hand(rows, percent, size):
    sets = [set_by_hand(t, size) for _, t in rows]
    group = list(range(len(rows)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    holders = defaultdict(list)
    for n, own in enumerate(sets):
        shared = Counter(m for s in own for m in holders[s])
        for m, both in shared.items():
            if 100 * both >= percent * (len(own) + len(sets[m]) - both):
                group[root(n)] = root(m)
        for s in own:
            holders[s].append(n)
    least = {}
    for n, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(n)] = min(doc_id, least.get(root(n), doc_id))
    out = [(i, len(sets[n]), least.get(root(n), i)) for n, (i, _) in enumerate(rows)]
    return sorted(out, key=repr)


def near_copies(spark):
    pick = random.Random(5)
    base = [pick.choice("abcdefghijk") + str(pick.randint(0, 99)) for _ in range(120)]
    passage = " ".join(f"p{i}" for i in range(40))

    def edited(times):
        words = list(base)
        for _ in range(times):
            words[pick.randrange(len(words))] = f"x{pick.randint(0, 10**6)}"
        return " ".join(words)

    def strange():
        return " ".join(f"w{pick.randint(0, 10**6)}" for _ in range(60))

    texts = [edited(pick.randint(1, 6)) for _ in range(120)]
    texts += [strange() + " " + passage + " " + strange() for _ in range(60)]
    texts += [" ".join(base)] * 20
    texts += ["One two", "one TWO", "one", "a b c d", "É b c d", "é b c d", "w " * 5000]
    rows = list(enumerate(texts)) + [(9, texts[9]), (9, "another text of one id")]
    rows += [(None, "one"), (None, "nobody has this one"), (500, None), (501, ""), (502, " \n\t\r")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture(autouse=True)
def small_sketch(monkeypatch):
    monkeypatch.setattr(join, "SLOTS", 1 << 18)


@pytest.mark.parametrize(
    "percent, words, frequent, clustered, columns",
    [(85, 4, 2048, 64, 50_000), (80, 5, 4, 3, 50_000), (85, 4, 2048, 10, 0), (100, 1, 2048, 1000, 0)],
)
def test_join_equals_all_pairs(
    spark, listed, monkeypatch, percent, words, frequent, clustered, columns
):
    monkeypatch.setattr(join, "FREQUENT", frequent)
    monkeypatch.setattr(join, "CLUSTERED", clustered)
    monkeypatch.setattr(join, "CLUSTER_NODES", 30)
    monkeypatch.setattr(join, "COLUMNS", 64)
    monkeypatch.setattr(join, "MOST_COLUMNS", columns)
    rows, docs = near_copies(spark)
    got = listed(join.link_components(docs, percent=percent, words=words))
    assert got == by_hand(rows, percent, words)


def test_prefixes_alone_miss_nothing(spark, listed, monkeypatch):
    # Without leaders every link must come from the prefixes.
    monkeypatch.setattr(join.Join, "led", lambda self: self.nodes.df.selectExpr("node AS a", "node AS b").limit(0))
    rows, docs = near_copies(spark)
    assert listed(join.link_components(docs, percent=85, words=4)) == by_hand(rows, 85, 4)


def test_awkward_rows(awkward, sample, listed):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert listed(join.link_components(awkward, percent=85, words=4)) == by_hand(rows, 85, 4)
    assert join.link_components(awkward.limit(0), percent=85, words=4).count() == 0
    rows = [(r.doc_id, r.text) for r in sample.collect()]
    assert listed(join.link_components(sample, percent=85, words=4)) == by_hand(rows, 85, 4)


def test_one_of_each(spark, awkward, listed):
    rows, docs = near_copies(spark)
    groups = by_hand(rows, 80, 5)
    kept = join.one_of_each(docs, percent=80, words=5)
    with_words = {g for i, n, g in groups if n and i is not None}
    # Each group has one row; those of one id and different texts are groups of one name.
    assert {r.doc_id for r in kept.collect() if set_by_hand(r.text, 5)} - {None} == with_words
    again = listed(join.link_components(kept.where("length(text) > 4"), percent=80, words=5))
    assert len({(i, n) for i, n, _ in again}) == len(again)
    done = join.one_of_each(awkward, percent=80, words=5)
    assert done.columns == awkward.columns
    left = Counter(r.doc_id for r in done.collect())
    assert left == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 2, None: 1, 7: 1, 8: 1}


def test_percent_must_leave_a_prefix(awkward):
    with pytest.raises(ValueError):
        join.link_components(awkward, percent=40, words=4)


def test_shingles_across_cuts(monkeypatch):
    texts = [("ab cd\tef " * n + "é" * n).encode() for n in range(60)]
    whole = shingle_sets(texts, 4, Powers())
    monkeypatch.setattr("crossweave.llm.shingles.AT_ONCE", 50)
    assert [s.tolist() for s in shingle_sets(texts, 4, Powers())] == [s.tolist() for s in whole]
    assert [len(s) for s in whole] == [len(set_by_hand(t.decode(), 4)) for t in texts]


def test_components(spark, ws):
    pick = random.Random(1)
    edges = [(pick.randrange(300), pick.randrange(300)) for _ in range(220)]
    edges += [(1000 + i, 1001 + i) for i in range(70)] + [(2000, 2000 + i) for i in range(50)]
    got = components(spark.createDataFrame(edges, "a long, b long"), ws).collect()
    name = {r.node: r.component for r in got}
    assert all(name[a] == name[b] for a, b in edges if a != b)
    group = {n: {n} for e in edges for n in e}
    for a, b in edges:
        if group[a] is not group[b]:
            group[a] |= group[b]
            for n in group[b]:
                group[n] = group[a]
    assert len(set(name.values())) == len({id(g) for g in group.values() if len(g) > 1})
