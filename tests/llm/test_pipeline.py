"""The pipeline against the same steps by hand, and its registration."""

import random
import sys
from pathlib import Path

import public_tokenizers
import pytest
import regex
import tiktoken

sys.path.insert(0, str(Path(__file__).parent.parent.parent))

import __spark_entry__ as work  # noqa: E402
import corpus_pipeline as pipeline  # noqa: E402
from crossweave.llm import bpe_transducer, language_id, secret_scan  # noqa: E402

from .test_ngram_join import by_hand, set_by_hand  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def test_all_are_registered():
    names = set(work.queries())
    assert "pipeline" in names
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1


def test_pipeline_equals_its_steps_by_hand(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    windows = language_id.labelled_windows(language_id.learnable(docs, 4, 2))
    network = language_id.train(windows + language_id.random_windows(windows))
    own = [name != language_id.NO_LANGUAGE for name in network.languages]
    rows = {
        r.doc_id: r.text
        for r in docs.collect()
        if r.text
        and regex.search(r"\p{L}", r.text)
        and network.probabilities([r.text.encode()])[0][own].sum() >= 0.3
    }
    groups = by_hand(sorted(rows.items()), pipeline.COPY_PERCENT, pipeline.COPY_WORDS)
    kept = {i for i, _, group in groups if i == group}
    ranks = bpe_transducer.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    expected = {}
    for i in kept:
        text, at, clean = rows[i], 0, ""
        for start, _, end in secret_scan.spans_by_hand(text):
            if start > at or not at:
                clean += text[at:start] + "[secret]"
            at = max(at, end)
        expected[i] = library.encode_ordinary(clean + text[at:])
    got = pipeline.run(spark, SMALL).collect()
    assert {r.doc_id: list(r.ids) for r in got} == expected and len(got) == len(expected)
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in got)


def test_the_mixtures_order_is_kept(spark, ws):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    mixed = pipeline.mixture(spark, docs, SMALL)
    order = [r.doc_id for r in mixed.collect()]
    stored = ws.save(mixed, "mixed").df
    got = pipeline.tokens(spark, stored, SMALL).orderBy("mix_file", "mix_row").collect()
    assert [r.doc_id for r in got] == order and sorted(order) == sorted(r.doc_id for r in docs.collect())


def test_stages_keep_columns_and_awkward_rows(spark, awkward):
    named = dict(pipeline.STAGES)
    for name in ("language", "near_copies", "secrets", "mixture"):
        got = named[name](spark, awkward, "")
        assert got.columns == awkward.columns, name
        # In the language stage document 5, held out, of words and signs nothing else has, goes too.
        assert got.count() == {"language": 6, "near_copies": 10}.get(name, 11)
        assert named[name](spark, awkward.limit(0), "").count() == 0
    assert named["tokens"](spark, awkward, "").count() == 11
    assert named["tokens"](spark, awkward.limit(0), "").count() == 0


def test_clean_documents_stay(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    with_words = {r.doc_id for r in docs.collect() if set_by_hand(r.text, 1) and any(map(str.isalpha, r.text))}
    known = {r.doc_id for r in pipeline.language(spark, docs, SMALL).collect()}
    assert known == with_words


@pytest.mark.parametrize("name", sorted(n for n in work.queries() if n.startswith("op")))
def test_queries_run(spark, name):
    got = work.queries()[name](spark, SMALL)
    assert len(set(got.columns)) == len(got.columns) and got.count() > 0


def test_what_is_in_no_language_goes(spark):
    """Clean documents stay, also short ones; random letters, other scripts and signs go."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    draw = random.Random(4)
    letters = lambda signs, n: "".join(draw.choice(signs) for _ in range(n))
    junk = [
        " ".join(letters("abcdefghijklmnopqrstuvwxyz", draw.randint(2, 9)) for _ in range(draw.randint(4, 200)))
        for _ in range(100)
    ]
    junk += ["qwrtz " * n for n in (3, 20, 300)] + ["zxcv asdf jkl " * 10, "123 456 !!", "", None]
    junk += [
        "Съешь ещё этих мягких французских булок, да выпей же чаю. " * 3,
        "吾輩は猫である。名前はまだ無い。どこで生れたかとんと見当がつかぬ。",
        "Η γρήγορη καφέ αλεπού πηδάει πάνω από το σκυλί",
    ]
    rows = [(1_000_000 + i, text, None, "junk", 0) for i, text in enumerate(junk)]
    mixed = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    kept = {r.doc_id for r in pipeline.language(spark, mixed, "").select("doc_id").collect()}
    lettered = {r.doc_id for r in docs.collect() if r.text and regex.search(r"\p{L}", r.text)}
    assert kept == lettered


def test_any_number_of_languages(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLED_ROWS", 300)
    monkeypatch.setattr(language_id, "STEPS", 3)
    rows = [(i, f"words of tongue {i % 700}", f"l{i % 700}", "s", 0) for i in range(2100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    assert 0 < len(language_id.labelled_windows(docs.select("doc_id", "text", "lang"))) <= 2 * 300 * 3
    found = language_id.identify(docs, parts=4, part=2).collect()
    assert len(found) == 2100 and all(r.lang_pred.startswith("l") and 0 <= r.score <= 1 for r in found)
    assert pipeline.language(spark, docs, "").count() <= 2100
