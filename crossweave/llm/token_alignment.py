"""Alignment of two tokenizers' tokens by the bytes they cover.

Both sides' tokens tile the same bytes.  In batches of documents, pandas' ``merge_asof``, keyed by document,
finds for each token's start the other side's covering token; both directions together give all overlaps, and
ends that both sides share cut the tokens into groups.

How many documents hold a pair of ids linked is counted over the corpus.  For that each document keeps its distinct
pairs; documents lie in chunks, and a chunk fetches the counts of its distinct pairs once, however many
of its documents hold them.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossweave.llm.token_counts import printable_bytes
from crossweave.llm.worker import by_value, columns_named, kept
from crossweave.workspace import Workspace

by_value(__name__)

#: Bytes of text aligned at once, and overlaps of a chunk; a longer document is a batch or chunk by itself.
BATCH_BYTES = 1_000_000
CHUNK_LINKS = 3_000_000
# The ranked tokenizer can't take longer runs of white space.
LONG_SPACE = 20_000
# Chunks of one task are numbered below this.
CHUNKS_OF_TASK = 1 << 32

ALIGNED = (
    "doc_id long, chunk long, n_a long, n_b long, n_groups long, n_links long, groups string, "
    "pairs array<long>, times array<int>"
)
COUNTED = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
    "groups_sha256 string"
)


def _ids_are_ranks(spec: dict) -> bool:
    """Whether a byte-level vocabulary merges in the order of its ids and splits by the common pattern, so
    that merging by ranks gives the same tokens."""
    model, split = spec["model"], spec["pre_tokenizer"]
    plain = split["type"] == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"]["".join(pair)] for pair in pairs]
    bytes_first = {model["vocab"].get(sign) for sign in printable_bytes()} == set(range(256))
    return plain and spec["normalizer"] is None and bytes_first and made == list(range(256, 256 + len(made)))


def _has_long_space(text: str) -> bool:
    return any(len(gap) >= LONG_SPACE for gap in re.split(r"\S+", text))


class Tokenizers:
    """The two libraries' tokenizers and the bytes of their tokens."""

    def __init__(self, a_file: str, a_pattern: str, b_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        import tokenizers

        self.a = tokenizers.Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True  # their strings are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        value = {sign: byte for byte, sign in enumerate(printable_bytes())}
        with open(a_file, encoding="utf-8") as source:
            spec = json.load(source)
        vocabulary = spec["model"]["vocab"]
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, number in vocabulary.items():
            if all(sign in value for sign in token):
                self.a_bytes[number] = bytes(value[sign] for sign in token)
        self.ranked = None
        if _ids_are_ranks(spec):
            ranks = {token: i for i, token in enumerate(self.a_bytes) if token}
            self.ranked = tiktoken.Encoding(
                "a", pat_str=a_pattern, mergeable_ranks=ranks, special_tokens={}
            )
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.a_lengths = np.array([len(t) for t in self.a_bytes], dtype=np.int64)
        self.b_lengths = np.array([len(t) for t in self.b_bytes], dtype=np.int64)
        size = max(len(self.a_bytes), len(self.b_bytes))
        # Decimal ids with the sign that follows them.
        self.names = {
            sign: np.array([f"{i}{sign}" for i in range(size)], dtype=object) for sign in ",|;"
        }

    def _piece(self, number: int) -> bytes:
        piece = self.b.id_to_piece(number)
        if self.b.is_byte(number):
            return bytes([int(piece[3:-1], 16)])
        return piece.replace("▁", " ").encode("utf-8")

    def _a_ids(self, texts: list[str]) -> Iterator[list[int]]:
        """Side A's ids; by ranks, which is several times as fast, where that gives the same."""
        for text in texts:
            if self.ranked and (len(text) < LONG_SPACE or not _has_long_space(text)):
                yield self.ranked.encode_ordinary(text)
            else:
                yield self.a.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides; none for texts that either side doesn't give back byte by byte."""
        wanted = [i for i, text in enumerate(texts) if text]
        of_a: list[list[int]] = [[] for _ in texts]
        of_b: list[list[int]] = [[] for _ in texts]
        spaced = [" " + texts[i] for i in wanted]
        encoded_b = self.b.encode([texts[i] for i in wanted], num_threads=1)
        for i, text, a, b in zip(wanted, spaced, self._a_ids(spaced), encoded_b, strict=True):
            data = text.encode("utf-8")
            if (
                b"".join(map(self.a_bytes.__getitem__, a)) == data
                and b"".join(map(self.b_bytes.__getitem__, b)) == data
            ):
                of_a[i], of_b[i] = a, b
        return of_a, of_b


def _side(ids: list[list[int]], lengths: np.ndarray) -> pd.DataFrame:
    """(doc, id, start, end, at) of a batch's tokens, as if the documents stood one after the other."""
    counts = np.array([len(own) for own in ids], dtype=np.int64)
    flat = np.fromiter(chain.from_iterable(ids), dtype=np.int64, count=int(counts.sum()))
    doc = np.repeat(np.arange(len(ids)), counts)
    size = lengths[flat]
    # A byte between documents keeps the end of one from the next one's start.
    end = np.cumsum(size) + doc
    return pd.DataFrame(
        {"doc": doc, "id": flat, "start": end - size, "end": end, "at": np.arange(len(flat))}
    )


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the tokens of A and of B that overlap, each pair once."""
    columns = ["doc", "start", "at"]
    ways = []
    for own, other in ((a, b), (b, a)):
        covering = other[columns].assign(other_start=other["start"])
        ways.append(
            pd.merge_asof(own[columns], covering, on="start", by="doc", suffixes=("", "_other"))
        )
    from_a, from_b = ways
    # Tokens that start together are found from both sides.
    from_b = from_b[from_b["other_start"] < from_b["start"]]
    return (
        np.concatenate([from_a["at"].to_numpy(), from_b["at_other"].to_numpy()]),
        np.concatenate([from_a["at_other"].to_numpy(), from_b["at"].to_numpy()]),
    )


def _texts_of_groups(
    tools: Tokenizers, a: pd.DataFrame, b: pd.DataFrame, docs: int
) -> tuple[list[str], np.ndarray]:
    """Each document's groups as ``a1,a2|b1;a3|b2,b3``, and their number."""
    shared = np.intersect1d(a["end"].to_numpy(), b["end"].to_numpy(), assume_unique=True)
    parts, order = [], []
    for side, (tokens, last) in enumerate(((a, "|"), (b, ";"))):
        end = tokens["end"].to_numpy()
        closes = np.isin(end, shared, assume_unique=True)
        ids = tokens["id"].to_numpy()
        parts.append(np.where(closes, tools.names[last][ids], tools.names[","][ids]))
        order.append(np.searchsorted(shared, end) * 2 + side)
    names = np.concatenate(parts)[np.argsort(np.concatenate(order), kind="stable")]
    each = np.bincount(a["doc"], minlength=docs) + np.bincount(b["doc"], minlength=docs)
    groups, low = [], 0
    for count in each.tolist():
        groups.append("".join(names[low : low + count])[:-1])
        low += count
    closing = a["doc"].to_numpy()[np.isin(a["end"].to_numpy(), shared, assume_unique=True)]
    return groups, np.bincount(closing, minlength=docs)


def align_batch(tools: Tokenizers, doc_ids: list, texts: list) -> dict[str, list]:
    """The columns of ALIGNED but ``chunk`` for some documents."""
    docs = len(texts)
    of_a, of_b = tools.encode(texts)
    a, b = _side(of_a, tools.a_lengths), _side(of_b, tools.b_lengths)
    groups, n_groups = _texts_of_groups(tools, a, b, docs)
    at_a, at_b = overlaps(a, b)
    doc = a["doc"].to_numpy()[at_a]
    width = len(tools.b_bytes)
    span = len(tools.a_bytes) * width
    code = a["id"].to_numpy()[at_a] * width + b["id"].to_numpy()[at_b]
    distinct, times = np.unique(doc * span + code, return_counts=True)
    ends = np.searchsorted(distinct, np.arange(1, docs + 1) * span)
    offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
    return {
        "doc_id": doc_ids,
        "n_a": np.bincount(a["doc"], minlength=docs),
        "n_b": np.bincount(b["doc"], minlength=docs),
        "n_groups": n_groups,
        "n_links": np.bincount(doc, minlength=docs),
        "groups": groups,
        "pairs": pa.ListArray.from_arrays(offsets, pa.array(distinct % span, pa.int64())),
        "times": pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32())),
    }


def _batches(batch: pa.RecordBatch) -> Iterator[tuple[list, list]]:
    """Documents of about BATCH_BYTES together, at least one."""
    ids, texts, size = [], [], 0
    for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
        own = text.as_py() or ""
        if ids and size + len(own) > BATCH_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(doc_id.as_py())
        texts.append(own)
        size += len(own)
    if ids:
        yield ids, texts


def align(docs: DataFrame, a_file: str, a_pattern: str, b_file: str) -> DataFrame:
    """For every row of ``docs(doc_id, text)``: the numbers of tokens, groups and links, ``groups`` as
    ``a1,a2|b1;a3|b2,b3``, the document's distinct linked ``pairs`` as a id * size of B + b id with how many
    ``times`` each, and the ``chunk`` it lies in.

    ``a_file`` is a byte-level vocabulary of the tokenizers library, which gets a space before the text;
    ``a_pattern`` is how such vocabularies split texts.  ``b_file`` is a sentencepiece model, which adds the space itself.  Null and empty texts, and such that either side doesn't give
    back byte by byte, have no tokens.  Rows that share an id are documents of their own; a null id
    stays null.  Other columns are ignored, and an empty table gives an empty result.
    """
    columns_named(docs, "doc_id", "text")

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = (a_file, a_pattern, b_file)
        tools = kept("alignment", files, lambda: Tokenizers(*files))
        chunk, links = TaskContext.get().partitionId() * CHUNKS_OF_TASK, 0
        for batch in batches:
            for ids, texts in _batches(batch):
                found = align_batch(tools, ids, texts)
                own = found["n_links"]
                # A document opens a new chunk where the links so far reach the next multiple.
                before = links + np.cumsum(own) - own
                chunks = chunk + before // CHUNK_LINKS
                links += int(own.sum())
                columns = {"doc_id": pa.array(found.pop("doc_id"), pa.int64()), "chunk": pa.array(chunks)}
                groups = pa.array(found.pop("groups"), pa.string())
                columns |= {n: pa.array(found[n], pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")}
                columns |= {"groups": groups, "pairs": found["pairs"], "times": found["times"]}
                yield pa.RecordBatch.from_pydict(columns)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(aligned, ALIGNED)


def pair_counts(aligned: DataFrame, width: int) -> DataFrame:
    """(pair, documents, best): how many documents hold each pair of ids linked, and whether that is
    the most of its A id's pairs; ``width`` is the size of B's vocabulary."""
    held = aligned.select(F.explode("pairs").alias("pair"))
    counts = held.groupBy("pair").agg(F.count(F.lit(1)).alias("documents"))
    of_a = counts.withColumn("a", F.expr(f"pair div {width}L"))
    most = of_a.groupBy("a").agg(F.max("documents").alias("most"))
    return of_a.join(most, "a").select("pair", "documents", (F.col("documents") == F.col("most")).alias("best"))


def _add_counts(documents: pa.Table, counts: pa.Table) -> pa.Table:
    """One chunk's documents with the sums over their links."""
    pairs = counts["pair"].to_numpy()
    order = np.argsort(pairs)
    pairs, held = pairs[order], counts["documents"].to_numpy()[order]
    best = counts["best"].to_numpy(zero_copy_only=False)[order]
    lists = documents["pairs"].combine_chunks()
    times = documents["times"].combine_chunks().flatten().to_numpy().astype(np.int64)
    at = np.searchsorted(pairs, lists.flatten().to_numpy())
    ends = np.cumsum(np.diff(lists.offsets.to_numpy()))
    found = {}
    for name, values in (("n_best", best), ("count_sum", held)):
        sums = np.concatenate([[0], np.cumsum(times * values[at].astype(np.int64))])
        found[name] = np.diff(np.concatenate([[0], sums[ends]]))
    columns = [c.split()[0] for c in COUNTED.split(", ")]
    return pa.table({n: pa.array(found[n], pa.int64()) if n in found else documents[n] for n in columns})


def align_and_count(docs: DataFrame, a_file: str, a_pattern: str, b_file: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of ``docs``.

    ``n_best`` counts the links whose pair of ids is held by the most documents of all pairs of its A id, ties
    included, and ``count_sum`` adds up over the links how many documents hold the pair.  A document
    without tokens has zeros and an empty ``groups_sha256``.  See ``align`` for the rest.
    """
    import sentencepiece

    ws = Workspace(docs.sparkSession)
    width = sentencepiece.SentencePieceProcessor(model_file=b_file).get_piece_size()
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(F.lit(""))
    found = align(docs, a_file, a_pattern, b_file).withColumn("groups_sha256", digest).drop("groups")
    aligned = ws.save(found, "aligned").df
    counts = ws.save(pair_counts(aligned, width), "counts").df
    # Every chunk asks for its pairs once; only documents without tokens have none.
    asked = aligned.select("chunk", F.explode("pairs").alias("pair")).distinct()
    fetched = asked.join(counts, "pair").select(F.col("chunk").alias("chunk"), "pair", "documents", "best")
    with_tokens = (
        aligned.where("n_a > 0")
        .groupBy("chunk")
        .cogroup(fetched.groupBy("chunk"))
        .applyInArrow(_add_counts, COUNTED)
    )
    zero = F.lit(0).cast("long")
    without = aligned.where("n_a = 0").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", zero.alias("n_best"), zero.alias("count_sum"), "groups_sha256"
    )
    return with_tokens.unionByName(without)
