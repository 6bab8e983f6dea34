"""Token alignment against two pointers walking over both sides' tokens."""

import hashlib
import json
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from crossweave.llm import token_alignment
from crossweave.llm.token_counts import printable_bytes

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
FILES = (A, public_tokenizers.PATTERN, B)


@pytest.fixture(scope="module")
def tools():
    return token_alignment.Tokenizers(*FILES)


def spans(tokens):
    at, found = 0, []
    for token in tokens:
        found.append((at, at + len(token)))
        at += len(token)
    return found


def by_hand(texts):
    """n_a, n_b, n_groups, n_links, n_best, count_sum, digest of each text."""
    a_lib = Tokenizer.from_file(A)
    a_lib.encode_special_tokens = True
    b_lib = sentencepiece.SentencePieceProcessor(model_file=B)
    value = {sign: byte for byte, sign in enumerate(printable_bytes())}

    def piece(i):
        p = b_lib.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b_lib.is_byte(i) else p.replace("▁", " ").encode()

    links, told = [], []
    for text in texts:
        own, row = Counter(), (0, 0, 0, 0, "")
        data = (" " + (text or "")).encode()
        a = a_lib.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_lib.encode(text) if text else []
        a_tokens = [bytes(value[c] for c in a_lib.id_to_token(i)) for i in a]
        b_tokens = [piece(i) for i in b]
        if text and b"".join(a_tokens) == data == b"".join(b_tokens):
            of_a, of_b = spans(a_tokens), spans(b_tokens)
            i = j = 0
            while i < len(a) and j < len(b):
                own[a[i], b[j]] += 1
                end_a, end_b = of_a[i][1], of_b[j][1]
                i, j = i + (end_a <= end_b), j + (end_b <= end_a)
            groups = [
                ",".join(str(x) for x, s in zip(a, of_a) if low < s[1] <= end)
                + "|"
                + ",".join(str(x) for x, s in zip(b, of_b) if low < s[1] <= end)
                for low, end in _cuts(of_a, of_b)
            ]
            digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
            row = (len(a), len(b), len(groups), sum(own.values()), digest)
        links.append(own)
        told.append(row)
    held = Counter(pair for own in links for pair in own)
    most = Counter()
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    return [
        (*row[:4], sum(n for p, n in own.items() if held[p] == most[p[0]]), sum(n * held[p] for p, n in own.items()), row[4])
        for own, row in zip(links, told)
    ]


def _cuts(of_a, of_b):
    ends = sorted({s[1] for s in of_a} & {s[1] for s in of_b})
    return list(zip([0, *ends], ends))


def told(df):
    columns = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return {r.doc_id: tuple(r[c] for c in columns) for r in df.collect()}


def test_equals_the_version_by_hand(spark, sample, monkeypatch):
    texts = [r.text for r in sample.orderBy("doc_id").collect()][:60]
    signs = random.Random(5)
    alphabet = "ab 's\n\t  Ümläut日本語😀é́▁<0x41> "
    texts += ["".join(signs.choice(alphabet) for _ in range(signs.randint(0, 60))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(token_alignment, "CHUNK_LINKS", 5000)
    found = told(token_alignment.align_and_count(docs, *FILES))
    assert found == dict(enumerate(by_hand(texts)))


def test_awkward_rows(spark, awkward, listed):
    rows = token_alignment.align_and_count(awkward, *FILES)
    assert rows.columns[0] == "doc_id" and rows.count() == awkward.count()
    found = listed(rows)
    assert [r for r in found if r[0] == 2] == [(2, 0, 0, 0, 0, 0, 0, "")]
    assert [r for r in found if r[0] == 3] == [(3, 0, 0, 0, 0, 0, 0, "")]
    assert len([r for r in found if r[0] == 1]) == 2 and len({r for r in found if r[0] == 1}) == 1
    assert [r[1] > 0 for r in found if r[0] is None] == [True]
    assert token_alignment.align_and_count(awkward.limit(0), *FILES).collect() == []


def test_ranks_give_the_same_tokens(tools):
    assert tools.ranked is not None
    draw = random.Random(7)
    tokens = [t for t in tools.a_bytes if t]
    texts = [b"".join(draw.choices(tokens, k=8)).decode("utf-8", "replace") for _ in range(3000)]
    texts += [f" a{chr(c)} b{chr(c)}'s 1{chr(c)}" for c in range(0, 0x30000, 7) if not 0xD800 <= c < 0xE000]
    texts += [" " * 30_000 + "x", "\n" * 25_000]
    plain = [tools.a.encode(t, add_special_tokens=False).ids for t in texts]
    assert list(tools._a_ids(texts)) == plain


def test_other_vocabularies_are_not_taken_for_ranks():
    with open(A, encoding="utf-8") as source:
        spec = json.load(source)
    assert token_alignment._ids_are_ranks(spec)
    spec["model"]["merges"][5:7] = spec["model"]["merges"][6:4:-1]
    assert not token_alignment._ids_are_ranks(spec)
