"""Token counts and the transducer against the libraries whose results they must equal."""

import codecs
import gc
import hashlib
import random
import shutil

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from crossweave.llm import bpe_transducer as bpe
from crossweave.llm import token_counts as counts

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def odd_texts():
    pick = random.Random(1)
    pool = "aZé ñß中文日本語한국어́​\xa0😀'\"<|>\n\t 09²٣sSΣİﬁ'll're"
    texts = ["".join(pick.choice(pool) for _ in range(pick.randint(0, 80))) for _ in range(1500)]
    return texts + [
        "",
        "x<|startoftext|>Hi<|endoftext|> a",
        "<|STARTOFTEXT|> ΣΑΣ",
        "aaaaaaaaaaaaaaaaaaa" * 100,
        " " * 500,
        "\n\n\n a",
        "abc" * 5000,
    ]


def library():
    return tiktoken.Encoding(
        "own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={}
    )


def test_counts_equal_the_library(sample):
    ours, theirs = counts.WordCounter(WORDS), Tokenizer.from_file(WORDS)
    for text in odd_texts() + [r.text or "" for r in sample.collect()]:
        assert ours.text(text) == len(theirs.encode(text, add_special_tokens=False).ids), text


def test_count_table_of_words_stays_bounded(monkeypatch):
    monkeypatch.setattr(counts, "KEPT_WORDS", 50)
    ours, fresh = counts.WordCounter(WORDS), counts.WordCounter(WORDS)
    texts = odd_texts()[:200]
    assert [ours.text(t) for t in texts] == [
        sum(map(fresh.word, fresh.words.findall(counts.normalize("NFC", t).replace("Σ", "σ").lower())))
        for t in texts
    ]
    assert len(ours.known) <= 50


def test_count_rows(awkward, listed):
    got = listed(counts.count_tokens(awkward, WORDS, limit=5))
    assert len(got) == awkward.count()
    assert (2, 0, 0, False) in got and (3, 0, 0, False) in got
    assert got.count((1, 26, 7, True)) == 2
    assert any(r[0] is None for r in got)
    assert counts.count_tokens(awkward.limit(0), WORDS, limit=5).count() == 0


def test_ids_equal_the_library(sample):
    ours, theirs = bpe.Transducer(RANKS, PATTERN), library()
    for text in odd_texts() + [r.text or "" for r in sample.collect()]:
        assert ours.encode(text) == theirs.encode_ordinary(text), text


def test_bounded_tables_give_the_same_ids(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_STATES", 20)
    monkeypatch.setattr(bpe, "KEPT_PAIRS", 30)
    monkeypatch.setattr(bpe, "KEPT_PIECES", 10)
    ours, theirs = bpe.Transducer(RANKS, PATTERN), library()
    for text in odd_texts()[:300] + ["abc" * 700]:
        assert ours.encode(text) == theirs.encode_ordinary(text), text
    assert len(ours.known) <= 10 and len(ours.pairs) <= 30


def test_tokens_are_emitted_before_the_end():
    machine = bpe.Transducer(RANKS, PATTERN)
    state, early, longest = machine.start, 0, 0
    for byte in b"internationalisation" * 20:
        emitted, state = state.on.get(byte) or machine._move(state, byte)
        early += len(emitted)
        longest = max(longest, *(len(g[2]) for g in state.guesses))
    assert early > 50 and longest < 10


def test_incremental_utf8_equals_pythons_decoder():
    pick, machine = random.Random(2), bpe.Utf8Machine()
    pool = [0, 65, 0x80, 0xBF, 0xC2, 0xE0, 0xA0, 0xED, 0x9F, 0xF0, 0x90, 0xF4, 0x8F, 0xFF]
    for _ in range(5000):
        parts = [bytes(pick.choice(pool) for _ in range(pick.randint(0, 4))) for _ in range(4)]
        theirs = codecs.getincrementaldecoder("utf-8")("replace")
        state, text = b"", ""
        for part in parts:
            more, state = machine.feed(state, part)
            text += more
        text += state.decode("utf-8", "replace")
        assert text == "".join(map(theirs.decode, parts)) + theirs.decode(b"", True)


def test_digests_and_round_trip(awkward, listed):
    theirs = library()
    expected = []
    for r in awkward.collect():
        ids = theirs.encode_ordinary(r.text or "")
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        expected.append(
            (
                r.doc_id,
                len(ids),
                hashlib.sha256(packed).hexdigest(),
                hashlib.sha256((r.text or "").encode()).hexdigest(),
            )
        )
    assert listed(bpe.encode_digests(awkward, RANKS, PATTERN)) == sorted(expected, key=repr)
    both = awkward.select(
        "text", bpe.encode(F.col("text"), RANKS, PATTERN).alias("ids")
    ).withColumn("back", bpe.decode(F.col("ids"), RANKS, PATTERN))
    assert both.where("back != coalesce(text, '')").count() == 0
    made = bpe.with_ids(awkward, RANKS, PATTERN)
    assert made.columns == [c for c in awkward.columns if c != "text"] + ["n_tokens", "ids", "round_trip"]
    assert made.count() == awkward.count() and bpe.with_ids(awkward.limit(0), RANKS, PATTERN).count() == 0
    assert made.where("NOT round_trip OR size(ids) != n_tokens").count() == 0
    assert bpe.encode_digests(awkward.limit(0), RANKS, PATTERN).count() == 0


def every_code_point():
    return (chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)


def test_every_code_point_counts_as_in_the_library():
    file = public_tokenizers.path("word_bpe_49k.json")
    counter, library = counts.WordCounter(file), Tokenizer.from_file(file)
    texts = [f"a{c} b{c}'s 1{c} A{c}!" for c in every_code_point()]
    for at in range(0, len(texts), 50_000):
        part = texts[at : at + 50_000]
        found = library.encode_batch(part, add_special_tokens=False)
        assert [len(e.ids) for e in found] == [counter.text(t) for t in part]


def test_every_code_point_is_encoded_as_in_the_library():
    machine = bpe.Transducer(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=machine.ranks, special_tokens={}
    )
    for c in every_code_point():
        text = f"a{c} b{c}'s 1{c}"
        assert machine.encode(text) == library.encode_ordinary(text), hex(ord(c))


def test_texts_are_coded_without_the_collector(spark, monkeypatch, tmp_path):
    """While a batch is coded, the collector doesn't look at all tables again; forgotten states go without it."""
    plain = bpe.Transducer.encode_packed

    def watched(self, text):
        import gc

        if gc.isenabled():
            raise AssertionError("the collector is on")
        return plain(self, text)

    monkeypatch.setattr(bpe, "KEPT_STATES", 200)
    machine = bpe.Transducer(RANKS, PATTERN)
    texts = odd_texts()[:400]
    expected = [library().encode_ordinary(t) for t in texts]
    gc.collect()
    gc.disable()
    try:
        assert [machine.encode(t) for t in texts] == expected
        alive = sum(isinstance(o, bpe.State) for o in gc.get_objects())
    finally:
        gc.enable()
    assert alive <= 250

    monkeypatch.setattr(bpe.Transducer, "encode_packed", watched)
    # A file of its own, as workers keep the coder of one they know.
    own = shutil.copy(RANKS, tmp_path / "ranks.tiktoken")
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts[:50])], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in bpe.encode_digests(docs, str(own), PATTERN).collect()}
    assert got == {i: len(e) for i, e in enumerate(expected[:50])}
