"""Gradients against differences, held-out accuracy, and the texts of laid-out pages."""

import html as entities
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from crossweave.llm import html_text, language_id, quality_mil

MEDIUM = "/root/testdata/sf0.01"


def differences(loss, weights, gradients):
    for weight, gradient in zip(weights, gradients, strict=True):
        for at in np.argsort(-abs(gradient).ravel())[:4]:
            at = np.unravel_index(at, weight.shape)
            weight[at] += 1e-5
            up = loss()
            weight[at] -= 2e-5
            down = loss()
            weight[at] += 1e-5
            assert gradient[at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_backpropagation_through_time():
    random = np.random.default_rng(0)
    net = language_id.Network.start(["a", "b", "c"], 4, random)
    for layer in (net.ahead, net.back):
        layer.inputs, layer.recurrence = layer.inputs.astype(float), layer.recurrence.astype(float)
    net.labels = net.labels.astype(float)
    held = [random.integers(0, 256, n).astype(np.uint8) for n in (7, 5, 5, 2)]
    codes, active, _ = language_id.side_by_side(held)
    truth = np.array([0, 1, 2, 1])
    differences(lambda: net.step(codes, active, truth)[0], net.weights, net.step(codes, active, truth)[1])
    for layer, backward in ((net.ahead, False), (net.back, True)):
        run, quick = layer.run(codes, active, backward), layer.states(codes, active, backward)
        assert all(np.allclose(quick[t, :, :n], run[t][-1]) for t, n in enumerate(active))


def test_language_held_out(spark, awkward):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    got = language_id.identify(docs, parts=4, part=2).select("lang", "held_out", "lang_pred", "score").collect()
    out = [r for r in got if r.held_out]
    assert 150 < len(out) < 350 and all(0 <= r.score <= 1 for r in got)
    assert sum(r.lang == r.lang_pred for r in out) > 0.98 * len(out)


def test_language_of_awkward_rows(awkward):
    got = language_id.identify(awkward, parts=4, part=2)
    assert got.count() == awkward.count() and got.columns.count("score") == 1
    told = {(r.doc_id, r.lang_pred == "und") for r in got.collect()}
    assert {(2, True), (3, True), (4, True), (7, True), (5, False)} <= told
    assert language_id.identify(awkward.limit(0), parts=4, part=2).count() == 0
    nothing = awkward.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.identify(nothing, parts=4, part=2).collect()} == {"und"}
    known = language_id.in_known_language(awkward, parts=4, part=2, least=0.0)
    assert known.columns == awkward.columns
    assert sorted((r.doc_id for r in known.collect()), key=str) == [1, 1, 5, 6, 6, 8, None]


def test_held_out_is_the_crc(spark):
    import zlib

    got = spark.range(50).select("id", language_id.held_out(F.col("id"), 4, 2).alias("out")).collect()
    assert all(r.out == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)


def test_attention_gradients():
    random = np.random.default_rng(0)
    net = quality_mil.Network(random)
    for name in ("encode", "see", "gate", "attend", "score"):
        setattr(net, name, getattr(net, name).astype(float))
    given, starts, truth = random.random((7, quality_mil.FEATURES)), np.array([0, 3, 4]), np.array([1.0, 0, 1])

    def loss():
        c = net.run(given, starts)["chance"]
        return -np.mean(truth * np.log(c) + (1 - truth) * np.log(1 - c))

    differences(loss, net.weights, net.learn(net.run(given, starts), starts, truth))
    assert np.add.reduceat(net.run(given, starts)["attention"], starts) == pytest.approx([1, 1, 1])


def test_quality_held_out(spark, awkward):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet")
    scored = quality_mil.score_quality(docs, labels, parts=5, part=0, threshold=0.3)
    got = scored.join(labels, "doc_id").where("held_out").collect()
    good = [r.score for r in got if r.quality == 1]
    bad = [r.score for r in got if r.quality == 0]
    above = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert len(got) > 40 and above > 0.95
    assert all(r.predicted == (r.score >= 0.3) for r in got)
    odd = labels.unionByName(
        spark.createDataFrame([(None, 1, 0), (1, None, 0), (1, 7, 0)], labels.schema)
    )
    rows = quality_mil.score_quality(awkward, odd, parts=5, part=0, threshold=0.3).collect()
    assert len(rows) == awkward.count() and all(0 <= r.score <= 1 for r in rows)
    none = quality_mil.score_quality(awkward, labels.limit(0), parts=5, part=0, threshold=0.3)
    assert {r.score for r in none.collect()} == {0.5}
    assert quality_mil.score_quality(awkward.limit(0), labels, parts=5, part=0, threshold=0.3).count() == 0


def test_a_text_scores_alike_alone_and_among_others():
    random = np.random.default_rng(1)
    net = quality_mil.Network(random)
    texts = [random.bytes(n) for n in (0, 5, 511, 512, 513, 3000)]
    alone = [net.chances([t])[0] for t in texts]
    assert net.chances(texts) == pytest.approx(alone, abs=1e-5)


def trees(spark):
    pages = spark.read.parquet(f"{MEDIUM}/pages.parquet")
    return pages, html_text.train(html_text.sample_pages(pages))


def test_articles_of_pages(spark):
    pages, fit = trees(spark)
    rows = pages.collect()
    for row, text in zip(rows, html_text.main_texts([r.html for r in rows], fit), strict=True):
        article = re.search("<article>(.*?)</article>", row.html, re.S)[1]
        blocks = [
            " ".join(entities.unescape(re.sub("<[^>]*>", " ", b)).split())
            for b in re.split("</?(?:p|h1)>", article)
        ]
        assert text == "\n".join(b for b in blocks if b)
    page = (
        '<header class="site-header"><h1>The Site</h1><nav><a href=/>Home</a></nav></header>'
        '<div class="cookie-notice"><p>We use cookies, and you agree by reading on.</p></div>'
        "<main><article><h1>Big title</h1><p>First, a paragraph &amp; some&nbsp;words\n in it, and more.</p>"
        '<div class="ad">Buy this now, it is great, really. Yes.</div><p>Second para, of course.</p></article>'
        '<section class="comments"><h2>Comments</h2><div class="comment"><p>I think this is wrong, and I say '
        "so at some length.</p></div></section></main><aside class=sidebar><ul><li><a href=#>Other</a></ul></aside>"
        "<form><p>Subscribe to our letter, it is free.</p><input></form><footer>&copy; 2020</footer>"
        "<script>var x = '<p>no</p>';</script>"
    )
    assert html_text.main_texts([page], fit) == [
        "Big title\nFirst, a paragraph & some words in it, and more.\nSecond para, of course."
    ]
    layouts = html_text.Layouts(
        ["This is a paragraph of prose, with words in it, and more than one sentence. Here it is."] * 3
        + ["Another one, which is rather long as well, and says that it is so, several times over."],
        ["Read more", "Home", "A title of words"],
        99,
    )
    scores = []
    for _ in range(100):
        made = layouts.page()
        mark = html_text.Layouts.MARK
        want = [t[1:] for t in html_text.parse(made).texts.values() if t.startswith(mark)]
        got = html_text.main_texts([made.replace(mark, "")], fit)[0].split("\n")
        both = sum(min(want.count(t), got.count(t)) for t in set(want))
        scores.append(2 * both / (len(want) + len(got)))
    assert np.mean(scores) > 0.9


def test_choices_never_contradict():
    page = html_text.parse("<div><p>a</p><div><p>b</p></div></div><p>c</p>")
    for seed in range(50):
        odds = np.random.default_rng(seed).standard_normal(len(page.parent))
        chosen = html_text.decode(page, odds)
        assert all(chosen[page.parent[n]] for n in range(1, len(chosen)) if chosen[n])
        # No other choice of that kind is likelier.
        best = -np.inf
        for bits in range(1 << len(odds)):
            picked = [bits >> n & 1 for n in range(len(odds))]
            if all(picked[page.parent[n]] for n in range(1, len(odds)) if picked[n]):
                best = max(best, float(odds @ picked))
        assert float(odds @ chosen) == pytest.approx(best)


def test_pages_that_are_awkward(spark):
    rows = [
        (1, "u", None),
        (2, None, ""),
        (None, "u", "<p>a<p>b<b>c"),
        (3, "u", "<div " * 2000),
        (4, "u", "<<<>>> &lt; <a title=\"x>y\">z</a> <!-- never closed"),
        (5, "u", "<div>" * 3000 + "deep, deep text it is, and more of it." + "</p>" * 10),
        (5, "u", "<div>" * 3000 + "deep, deep text it is, and more of it." + "</p>" * 10),
        (6, "u", "<script>" + "x" * 500_000),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "page_id AS text", "1 AS n_chars")
    got = html_text.extract(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.count() == len(rows)
    told = {r.page_id: r.text for r in got.collect()}
    assert told[1] == "" and told[2] == "" and told[6] == ""
    assert html_text.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    "html, texts",
    [
        ("<head><title>T</title><p>Hello <b>you</b></p><p>more", ["Hello you", "more"]),
        ("<head><title>T</title><b>bold</b> text<div>a</div>", ["bold text", "a"]),
        ("<head><meta charset=x><title>T</title></head><body><p>one <svg/> two</p><p>three", ["one two", "three"]),
        ("<p>a <svg viewBox='0'><text>no</text><svg></svg><path/></svg> b</p>", ["a b"]),
        ("<p>a<svg><path> b</p><p>c", ["a b", "c"]),
        ("<p>a <math><mi>x</mi><mo>=</mo><mn>1</mn></math> b</p>", ["a x=1 b"]),
        ("<p>a<select><option>b</p><p>c", ["a b", "c"]),
        ("<p>a<object>b</object>c<noscript>d</noscript>e</p>", ["a c e"]),
        ("<p>a</p><script>if (x) '<p>b</p>'", ["a"]),
        ("<p>a</p><style>p {}</style><p>b</p><textarea>c<p>d", ["a", "b"]),
    ],
)
def test_what_pages_leave_open(html, texts):
    assert list(html_text.parse(html).texts.values()) == texts
