"""A quality classifier by attention-based multiple-instance learning, in numpy.

A text is a bag of passages.  Each passage is encoded, gated attention (a tanh and a
sigmoid branch, multiplied) weighs the passages of the text, and the weighted sum of their
codes is scored.  All weights are learned together from labels of whole documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossweave.llm.language_id import held_out
from crossweave.llm.worker import by_value, columns_named

by_value(__name__)

#: Bytes of a passage.
PASSAGE = 512
#: The bound of the training sample: about so many documents, of each so many passages at most,
#: spread evenly over its text.  Scoring reads all passages.
TRAINED_ROWS = 5000
TRAINED_PASSAGES = 12
CODE, GATE = 24, 12
ROUNDS = 14
BATCH = 64
RATE = 0.004
#: Hash slots that tell how many different four-byte strings a passage has.
SLOTS = 1024
MORE = 6
FEATURES = 256 + MORE
# Bytes encoded at once.
AT_ONCE = 1 << 20


def passages_of(text: bytes) -> list[bytes]:
    """Consecutive passages; an empty text is one empty passage."""
    return [text[at : at + PASSAGE] for at in range(0, max(len(text), 1), PASSAGE)]


def features(passages: list[bytes]) -> np.ndarray:
    """(passages, FEATURES): shares of byte values, and how words and strings repeat."""
    data = np.frombuffer(b"".join(passages), dtype=np.uint8)
    lengths = np.array([len(p) for p in passages])
    count = len(passages)
    owner = np.repeat(np.arange(count), lengths)
    size = np.maximum(lengths, 1)[:, None]
    shares = np.bincount(owner * 256 + data, minlength=count * 256).reshape(count, 256) / size
    out = np.zeros((count, FEATURES), dtype=np.float32)
    out[:, :256] = np.sqrt(shares)
    if not len(data):
        return out
    # A passage's features are its own: nothing is told from its neighbours.
    new = np.concatenate([[True], owner[1:] != owner[:-1]])
    letter = (data | 0x20) - 0x61 < 26
    letter |= data >= 0x80
    before = np.concatenate([[0x20], data[:-1]]).astype(np.uint8)
    ended = new | ~np.concatenate([[False], letter[:-1]])
    starts = letter & ended
    mixed = starts & ~new & (before > 0x20)

    def per(mask: np.ndarray) -> np.ndarray:
        return np.bincount(owner, weights=mask, minlength=count)

    words = per(starts)
    upper = per((data >= 0x41) & (data <= 0x5A))
    out[:, 256] = np.minimum(per(letter) / np.maximum(words, 1) / 10, 2)
    out[:, 257] = upper / np.maximum(words, 1)
    out[:, 258] = per(mixed) / np.maximum(words, 1)
    out[:, 261] = np.log1p(lengths) / 6
    if len(data) < 4:
        return out
    # Different strings of four bytes, by the slots they fill.
    wide = data.astype(np.uint32)
    four = wide[:-3] | wide[1:-2] << 8 | wide[2:-1] << 16 | wide[3:] << 24
    slot = (four * np.uint32(2654435761)) >> np.uint32(32 - 10)
    inside = owner[3:] == owner[:-3]
    filled = np.bincount(
        owner[:-3][inside] * SLOTS + slot[inside], minlength=count * SLOTS
    ).reshape(count, SLOTS)
    strings = np.maximum(lengths - 3, 1)
    out[:, 259] = (filled > 0).sum(axis=1) / np.minimum(strings, SLOTS)
    out[:, 260] = filled.max(axis=1) / strings
    return out


class Network:
    """Encoder, gated attention and scorer."""

    def __init__(self, random: np.random.Generator):
        def normal(rows: int, columns: int) -> np.ndarray:
            return (random.standard_normal((rows, columns)) / np.sqrt(rows)).astype(np.float32)

        self.centre = np.zeros(FEATURES, dtype=np.float32)
        self.encode = normal(FEATURES + 1, CODE)  # the last row is the offset
        self.see = normal(CODE, GATE)
        self.gate = normal(CODE, GATE)
        self.attend = normal(GATE, 1)
        self.score = normal(CODE + 1, 1)

    @property
    def weights(self) -> list[np.ndarray]:
        return [self.encode, self.see, self.gate, self.attend, self.score]

    def run(self, given: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        """Score bags; the rows of ``given`` from ``starts[i]`` up to the next are bag i."""
        inputs = np.column_stack([given - self.centre, np.ones(len(given), dtype=np.float32)])
        codes = np.tanh(inputs @ self.encode)
        seen = np.tanh(codes @ self.see)
        gates = 0.5 * np.tanh(0.5 * (codes @ self.gate)) + 0.5
        drive = (seen * gates @ self.attend).ravel()
        owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(given))))
        drive = np.exp(drive - np.maximum.reduceat(drive, starts)[owner])
        attention = drive / np.add.reduceat(drive, starts)[owner]
        bag = np.add.reduceat(codes * attention[:, None], starts)
        odds = bag @ self.score[:-1] + self.score[-1]
        chance = 0.5 * np.tanh(0.5 * odds.ravel()) + 0.5
        return dict(
            inputs=inputs, codes=codes, seen=seen, gates=gates, attention=attention,
            owner=owner, bag=bag, chance=chance,
        )

    def learn(self, r: dict[str, np.ndarray], starts: np.ndarray, truth: np.ndarray):
        """Gradients of the mean cross-entropy."""
        error = ((r["chance"] - truth) / len(truth)).astype(np.float32)[:, None]
        d_score = np.vstack([r["bag"].T @ error, error.sum(axis=0, keepdims=True)])
        at_bag = (error @ self.score[:-1].T)[r["owner"]]
        at_codes = at_bag * r["attention"][:, None]
        # Through the softmax over a bag's passages.
        pull = (at_bag * r["codes"]).sum(axis=1)
        mean = np.add.reduceat(pull * r["attention"], starts)[r["owner"]]
        at_drive = (r["attention"] * (pull - mean))[:, None]
        both = r["seen"] * r["gates"]
        d_attend = both.T @ at_drive
        at_both = at_drive @ self.attend.T
        at_seen = at_both * r["gates"] * (1 - r["seen"] ** 2)
        at_gate = at_both * r["seen"] * r["gates"] * (1 - r["gates"])
        at_codes = at_codes + at_seen @ self.see.T + at_gate @ self.gate.T
        at_inputs = at_codes * (1 - r["codes"] ** 2)
        return [
            r["inputs"].T @ at_inputs,
            r["codes"].T @ at_seen,
            r["codes"].T @ at_gate,
            d_attend,
            d_score,
        ]

    def chances(self, texts: list[bytes]) -> np.ndarray:
        """The chance of label 1 for each text."""
        out = np.empty(len(texts))
        held: list[bytes] = []
        starts: list[int] = []
        first, size = 0, 0
        for i, text in enumerate(texts):
            starts.append(len(held))
            held += passages_of(text)
            size += len(text)
            if size >= AT_ONCE or i + 1 == len(texts):
                # A very long text is encoded in steps, then weighed as a whole.
                step = AT_ONCE // PASSAGE
                given = np.concatenate(
                    [features(held[at : at + step]) for at in range(0, len(held), step)]
                )
                out[first : i + 1] = self.run(given, np.array(starts))["chance"]
                held, starts, first, size = [], [], i + 1, 0
        return out


def train(bags: list[tuple[list[bytes], int]], seed: int = 0) -> Network | None:
    """Fit a network to bags of passages and their labels with Adam; None if there are none."""
    if not bags:
        return None
    random = np.random.default_rng(seed)
    network = Network(random)
    each = [features(passages or [b""]) for passages, _ in bags]
    truth = np.array([label for _, label in bags], dtype=np.float32)
    network.centre = np.concatenate(each).mean(axis=0)
    first = [np.zeros_like(w) for w in network.weights]
    second = [np.zeros_like(w) for w in network.weights]
    step, steps = 0, ROUNDS * (-(-len(bags) // BATCH))
    for _ in range(ROUNDS):
        order = random.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            picked = order[at : at + BATCH]
            given = np.concatenate([each[i] for i in picked])
            starts = np.cumsum([0] + [len(each[i]) for i in picked[:-1]])
            run = network.run(given, starts)
            step += 1
            rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
            for weight, g, m, v in zip(
                network.weights, network.learn(run, starts, truth[picked]), first, second,
                strict=True,
            ):
                g = g + 1e-4 * weight
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                weight -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return network


def labelled_bags(docs: DataFrame, labels: DataFrame) -> list[tuple[list[bytes], int]]:
    """A bounded sample of ``labels(doc_id, quality)`` with passages of its documents."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    rows = known.count()
    if not rows:
        return []
    fine = 1_000_000
    chance = F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(fine))
    picked = (
        known.where(chance < fine * TRAINED_ROWS // rows + 1)
        .groupBy("doc_id")
        .agg(F.max("quality").cast("int").alias("quality"))
        .limit(2 * TRAINED_ROWS)
    )
    pieces = F.greatest(F.ceil(F.length("text") / PASSAGE), F.lit(1))
    taken = F.least(pieces, F.lit(TRAINED_PASSAGES))
    passages = F.transform(
        F.sequence(F.lit(0).cast("long"), taken - 1),
        lambda i: F.col("text").substr(
            (F.floor(i * pieces / taken) * PASSAGE + 1).cast("int"), F.lit(PASSAGE)
        ),
    )
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # At most 2 * TRAINED_ROWS ids and labels.
    found = texts.join(F.broadcast(picked), "doc_id").select("doc_id", "quality", passages.alias("passages"))
    bags = [
        (r["doc_id"], [p.encode("utf-8")[:PASSAGE] for p in r["passages"]], r["quality"])
        for r in found.limit(4 * TRAINED_ROWS).collect()
    ]
    return [bag[1:] for bag in sorted(bags)]


def scored(text: Column, network: Network | None) -> Column:
    """The chance of label 1, from 0 to 1; 0.5 if nothing was learned.  Null counts as empty."""

    @F.pandas_udf("double")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            if network is None:
                yield pd.Series(np.full(len(texts), 0.5))
            else:
                yield pd.Series(network.chances([(t or "").encode("utf-8") for t in texts]))

    return read(text)


def score_quality(
    docs: DataFrame, labels: DataFrame, *, parts: int, part: int, threshold: float
) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs(doc_id, text)``, learned from
    ``labels(doc_id, quality)`` of rows that aren't held out: those whose crc32(doc_id as text)
    modulo ``parts`` isn't ``part``.

    Only the text decides the score.  Null texts count as empty; labels other than 0 and 1 are ignored;
    without any label all scores are 0.5.  Of several labels of an id the greatest counts.  Repeated rows
    give repeated results, other columns are ignored, an empty table gives an empty result.
    """
    columns_named(docs, "doc_id", "text")
    columns_named(labels, "doc_id", "quality")
    learned = labels.where(~held_out(F.col("doc_id"), parts, part))
    network = train(labelled_bags(docs.select("doc_id", "text"), learned))
    return docs.select(
        "doc_id",
        held_out(F.col("doc_id"), parts, part).alias("held_out"),
        scored(F.col("text"), network).alias("score"),
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
