"""Token counts by heap-and-linked-list byte-pair merging.

The count of a word is its number of initial symbols less the number of merges,
so no token identifiers are made.  The counts are those of a ``tokenizers``
vocabulary with word ends: NFC, lower case, words split off by a pattern,
bytes as symbols, ``</w>`` on the last symbol.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from unicodedata import normalize

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossweave.llm.splitting import Splitter, lowered
from crossweave.llm.worker import by_value, columns_named, kept

by_value(__name__)

# Words whose counts a worker keeps; the table starts anew when it is full, so memory is bounded.
KEPT_WORDS = 700_000
#: Longer words are rare and aren't kept.
KEPT_LENGTH = 64


def printable_bytes() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable bytes
    stand for themselves, the others for the characters from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class WordCounter:
    """Counts the tokens of texts under one vocabulary file."""

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as source:
            spec = json.load(source)
        self.end = spec["model"]["end_of_word_suffix"] or ""
        specials = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = Splitter(split["pattern"]["Regex"])
        number: dict[str, int] = {}
        symbol = lambda text: number.setdefault(text, len(number))
        signs = printable_bytes()
        self.inner = [symbol(c) for c in signs]
        self.last = [symbol(c + self.end) for c in signs]
        # pair of symbols -> (rank, symbol made of them)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            self.merges.setdefault((symbol(a), symbol(b)), (rank, symbol(a + b)))
        self.known: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Tokens of one word: its symbols less the merges made."""
        data = word.encode("utf-8")
        size = len(data)
        if size == 1:
            return 1
        merges = self.merges
        symbols = [self.inner[b] for b in data]
        symbols[-1] = self.last[data[-1]]
        heap = []
        for i in range(size - 1):
            found = merges.get((symbols[i], symbols[i + 1]))
            if found:
                heap.append((found[0], i, found[1], symbols[i], symbols[i + 1]))
        if not heap:
            return size
        heapify(heap)
        after = list(range(1, size + 1))  # the linked list; size ends it
        before = list(range(-1, size - 1))
        left = size
        while heap:
            _, i, made, a, b = heappop(heap)
            j = after[i] if symbols[i] == a else size
            if j >= size or symbols[j] != b:
                continue  # one of the two was merged with another meanwhile
            symbols[i], symbols[j] = made, -1
            left -= 1
            k = after[i] = after[j]
            if k < size:
                before[k] = i
                found = merges.get((made, symbols[k]))
                if found:
                    heappush(heap, (found[0], i, found[1], made, symbols[k]))
            h = before[i]
            if h >= 0:
                found = merges.get((symbols[h], made))
                if found:
                    heappush(heap, (found[0], h, found[1], symbols[h], made))
        return left

    def _plain(self, text: str) -> int:
        known, total = self.known, 0
        for word in self.words.findall(lowered(normalize("NFC", text))):
            count = known.get(word)
            if count is None:
                count = self.word(word)
                if len(word) <= KEPT_LENGTH:
                    if len(known) >= KEPT_WORDS:
                        known.clear()
                    known[word] = count
            total += count
        return total

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None or "<|" not in text:
            return self._plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))


def token_count(text: Column, file: str) -> Column:
    """Tokens of each text as a long; null counts as empty."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = kept("word_counter", file, lambda: WordCounter(file))
        for texts in batches:
            yield pd.Series([counter.text(t) for t in texts], dtype="int64")

    return count(text)


def count_tokens(docs: DataFrame, file: str, limit: int) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs(doc_id, text)``.

    Null and empty texts have no bytes and no tokens.  Repeated rows give repeated
    results, a null doc_id stays null, other columns are ignored, and an empty table
    gives an empty result.  ``over_limit`` says whether there are more than ``limit`` tokens.
    """
    columns_named(docs, "doc_id", "text")
    counted = docs.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        token_count(F.col("text"), file).alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
