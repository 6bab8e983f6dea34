"""Language identification: a bidirectional gated recurrent network over bytes, in numpy.

The network reads windows of a text in both directions, labels every byte, and a text's
probabilities are the mean over all its bytes.  It is trained by backpropagation through time
on windows of a bounded sample of labelled rows, and small enough to travel with its jobs.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossweave.llm.worker import by_value, columns_named, trim

by_value(__name__)

#: The bound of the training sample: about so many rows of each language, and in all, so many windows of each.
ROWS_PER_LANGUAGE = 300
SAMPLED_ROWS = 20_000
WINDOWS_PER_ROW = 3
TRAINED_CHARACTERS = 80
UNITS = 8
STEPS = 240
BATCH = 96
RATE = 0.02
#: Bytes of a window when predicting, and windows read side by side.
WINDOW = 128
SIDE_BY_SIDE = 2048
# Probabilities held at once.
AT_ONCE = 1 << 22
UNKNOWN = "und"
#: The label of windows in no language, where a network learns to tell them apart; no language sorts after it.
NO_LANGUAGE = "\U0010ffff"
#: So many windows of letters drawn at random are learned as no language.
RANDOM_WINDOWS = 900
# First and last letters of alphabets that windows are drawn from.
ALPHABETS = (
    "az", "AZ", "αω", "ая", "את", "عي", "अह", "กฮ", "ぁん", "ァヶ", "一龥", "가힣",
)


@dataclass
class Layer:
    """One direction: inputs by byte (3 * units, 256), recurrence (3 * units, units).

    Rows are those of the update gate, the reset gate, then the candidate.
    """

    inputs: np.ndarray
    recurrence: np.ndarray

    def run(self, codes: np.ndarray, active: np.ndarray, backward: bool) -> list[tuple]:
        """States per step of ``codes`` (steps, windows): window w takes part in the first
        ``lengths[w]`` steps, and windows are sorted by length, so that ``active[t]`` of
        them take part in step t.  For each step (codes, before, update, reset, turned, candidate, after)."""
        units = self.recurrence.shape[1]
        steps, windows = codes.shape
        state = np.zeros((units, windows), dtype=self.inputs.dtype)
        out: list = [None] * steps
        for t in range(steps - 1, -1, -1) if backward else range(steps):
            n = active[t]
            before = state[:, :n]
            given = self.inputs[:, codes[t, :n]]
            turned = self.recurrence @ before
            gates = np.tanh((given[: 2 * units] + turned[: 2 * units]) * 0.5) * 0.5 + 0.5
            update, reset = gates[:units], gates[units:]
            candidate = np.tanh(given[2 * units :] + reset * turned[2 * units :])
            after = before + update * (candidate - before)
            out[t] = (codes[t, :n], before, update, reset, turned[2 * units :], candidate, after)
            state = state.copy()
            state[:, :n] = after
        return out

    def states(self, codes: np.ndarray, active: np.ndarray, backward: bool) -> np.ndarray:
        """As ``run``, only the states after each step (steps, units, windows), in place."""
        units = self.recurrence.shape[1]
        steps, windows = codes.shape
        # Halved, so that a gate is one hyperbolic tangent.
        inputs, recurrence = self.inputs.copy(), self.recurrence.copy()
        inputs[: 2 * units] *= 0.5
        recurrence[: 2 * units] *= 0.5
        given = np.empty((3 * units, windows), dtype=inputs.dtype)
        turned = np.empty_like(given)
        out = np.zeros((steps, units, windows), dtype=inputs.dtype)
        state = np.zeros((units, windows), dtype=inputs.dtype)
        for t in range(steps - 1, -1, -1) if backward else range(steps):
            n = active[t]
            if n < windows:
                x, u, h, new = given[:, :n], turned[:, :n], state[:, :n], out[t, :, :n]
                x = inputs[:, codes[t, :n]]
                u = recurrence @ h
            else:
                x, u, h, new = given, turned, state, out[t]
                np.take(inputs, codes[t], axis=1, out=x, mode="clip")
                np.matmul(recurrence, h, out=u)
            gates = u[: 2 * units]
            gates += x[: 2 * units]
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            candidate = u[2 * units :]
            candidate *= gates[units:]
            candidate += x[2 * units :]
            np.tanh(candidate, out=candidate)
            candidate -= h
            candidate *= gates[:units]
            candidate += h
            new[...] = candidate
            h[...] = candidate
        return out

    def learn(self, run: list[tuple], errors: list[np.ndarray], backward: bool):
        """Gradients of both arrays from the errors of the states, by going back through time."""
        units = self.recurrence.shape[1]
        d_inputs, d_recurrence = np.zeros_like(self.inputs), np.zeros_like(self.recurrence)
        steps = len(run)
        carried = np.zeros((units, max(r[1].shape[1] for r in run)), dtype=self.inputs.dtype)
        for t in range(steps) if backward else range(steps - 1, -1, -1):
            codes, before, update, reset, turned, candidate, _ = run[t]
            n = before.shape[1]
            error = errors[t] + carried[:, :n]
            at_candidate = error * update * (1 - candidate**2)
            at_update = error * (candidate - before) * update * (1 - update)
            at_reset = at_candidate * turned * reset * (1 - reset)
            inward = np.concatenate([at_update, at_reset, at_candidate * reset])
            d_recurrence += inward @ before.T
            carried[:, :n] = error * (1 - update) + self.recurrence.T @ inward
            one_hot = np.zeros((n, 256), dtype=self.inputs.dtype)
            one_hot[np.arange(n), codes] = 1
            d_inputs += np.concatenate([at_update, at_reset, at_candidate]) @ one_hot
        return d_inputs, d_recurrence


@dataclass
class Network:
    languages: list[str]
    ahead: Layer
    back: Layer
    labels: np.ndarray  # (languages, 2 * units + 1), the last column for the offset

    @staticmethod
    def start(languages: list[str], units: int, random: np.random.Generator) -> Network:
        def layer() -> Layer:
            return Layer(
                (random.standard_normal((3 * units, 256)) * 0.5).astype(np.float32),
                (random.standard_normal((3 * units, units)) / np.sqrt(units)).astype(np.float32),
            )

        labels = random.standard_normal((len(languages), 2 * units + 1)) * 0.1
        return Network(languages, layer(), layer(), labels.astype(np.float32))

    def step(self, codes: np.ndarray, active: np.ndarray, truth: np.ndarray):
        """Loss and gradients of one batch: the cross-entropy of every byte."""
        ahead, back = self.ahead.run(codes, active, False), self.back.run(codes, active, True)
        units = self.ahead.recurrence.shape[1]
        bytes_read, loss = int(sum(active)), 0.0
        d_labels = np.zeros_like(self.labels)
        left, right = [], []
        for t, n in enumerate(active):
            seen = np.concatenate(
                [ahead[t][-1], back[t][-1], np.ones((1, n), dtype=np.float32)]
            )
            odds = self.labels @ seen
            odds = np.exp(odds - odds.max(axis=0))
            odds /= odds.sum(axis=0)
            which = truth[:n], np.arange(n)
            loss -= float(np.log(odds[which] + 1e-9).sum())
            odds[which] -= 1
            odds /= bytes_read
            d_labels += odds @ seen.T
            error = self.labels.T @ odds
            left.append(error[:units])
            right.append(error[units : 2 * units])
        return loss / bytes_read, [
            *self.ahead.learn(ahead, left, False),
            *self.back.learn(back, right, True),
            d_labels,
        ]

    @property
    def weights(self) -> list[np.ndarray]:
        return [
            self.ahead.inputs,
            self.ahead.recurrence,
            self.back.inputs,
            self.back.recurrence,
            self.labels,
        ]

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        """(texts, languages): mean of every byte's probabilities; an empty text gets zeros."""
        total = np.zeros((len(texts), len(self.languages)))
        held: list[np.ndarray] = []
        owner: list[int] = []
        for i, text in enumerate(texts):
            data = np.frombuffer(text, dtype=np.uint8)
            for at in range(0, len(data), WINDOW):
                held.append(data[at : at + WINDOW])
                owner.append(i)
                if len(held) >= min(SIDE_BY_SIDE, AT_ONCE // len(self.languages) + 1):
                    self._read(held, np.array(owner), total)
                    held, owner = [], []
        if held:
            self._read(held, np.array(owner), total)
        lengths = np.array([max(len(t), 1) for t in texts])
        return total / lengths[:, None]

    def _read(self, held: list[np.ndarray], owner: np.ndarray, total: np.ndarray) -> None:
        codes, active, order = side_by_side(held)
        ahead = self.ahead.states(codes, active, False)
        back = self.back.states(codes, active, True)
        units = ahead.shape[1]
        sums = np.zeros((len(self.languages), codes.shape[1]), dtype=np.float32)
        for t, n in enumerate(active):
            odds = self.labels[:, :units] @ ahead[t, :, :n]
            odds += self.labels[:, units : 2 * units] @ back[t, :, :n]
            odds += self.labels[:, 2 * units :]
            odds -= odds.max(axis=0)
            np.exp(odds, out=odds)
            odds /= odds.sum(axis=0)
            sums[:, :n] += odds
        np.add.at(total, owner[order], sums.T)


def side_by_side(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows as columns, long ones first: (codes, how many are active at each step, their order)."""
    lengths = np.array([len(h) for h in held])
    order = np.argsort(-lengths, kind="stable")
    codes = np.zeros((len(held), lengths.max()), dtype=np.intp)
    for row, i in enumerate(order):
        codes[row, : lengths[i]] = held[i]
    active = (lengths[:, None] > np.arange(lengths.max())).sum(axis=0)
    return np.ascontiguousarray(codes.T), active, order


def train(windows: list[tuple[bytes, str]], seed: int = 0) -> Network | None:
    """Fit a network to labelled windows with Adam; None if there are none."""
    windows = [(w, label) for w, label in windows if w]
    languages = sorted({label for _, label in windows})
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    network = Network.start(languages, UNITS, rng)
    number = {name: i for i, name in enumerate(languages)}
    by_language: list[list[bytes]] = [[] for _ in languages]
    for w, label in windows:
        by_language[number[label]].append(w)
    first = [np.zeros_like(w) for w in network.weights]
    second = [np.zeros_like(w) for w in network.weights]
    for step in range(1, STEPS + 1):
        # Languages alike often, whatever their share of the rows.
        picked = rng.integers(len(languages), size=BATCH)
        held = [by_language[i][rng.integers(len(by_language[i]))] for i in picked]
        codes, active, order = side_by_side([np.frombuffer(h, dtype=np.uint8) for h in held])
        truth = np.array([number[languages[i]] for i in picked])[order]
        _, gradients = network.step(codes, active, truth)
        rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
        for weight, g, m, v in zip(network.weights, gradients, first, second, strict=True):
            g = np.clip(g, -1, 1)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            weight -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return network


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether a row is kept from learning: crc32 of its id as text, modulo ``parts``."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))


def labelled_windows(labelled: DataFrame) -> list[tuple[bytes, str]]:
    """A bounded sample of ``labelled(doc_id, text, lang)``: windows from all over its texts.

    The more languages, the fewer rows of each; beyond SAMPLED_ROWS languages some have no row in the sample.
    """
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))
    languages = counts.count()
    if not languages:
        return []
    fine = 1_000_000
    per_language = max(1, min(ROWS_PER_LANGUAGE, SAMPLED_ROWS // languages))
    chance = F.pmod(F.xxhash64(F.lit(8), "doc_id"), F.lit(fine))
    # Chosen by id and language alone, so that no texts are dealt out.
    chosen = (
        labelled.select("doc_id", "lang")
        .join(counts, "lang")
        .where(chance < F.least(F.lit(fine), F.expr(f"{fine}L * {per_language} div rows + 1")))
        .select("doc_id", "lang")
        .distinct()
        .limit(2 * max(SAMPLED_ROWS, per_language * min(languages, SAMPLED_ROWS)))
    )
    room = F.greatest(F.length("text") - TRAINED_CHARACTERS, F.lit(0)) + 1
    places = F.array(
        *[
            F.substring(
                F.col("text"),
                (F.pmod(F.xxhash64(F.lit(i), "doc_id"), room) + 1).cast("int"),
                F.lit(TRAINED_CHARACTERS),
            )
            for i in range(WINDOWS_PER_ROW)
        ]
    )
    rows = (
        # The limit above bounds what is broadcast.
        labelled.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi")
        .select("doc_id", "lang", F.explode(places).alias("window"))
        .limit(2 * WINDOWS_PER_ROW * SAMPLED_ROWS)
        .collect()
    )
    return sorted((r["window"].encode("utf-8"), r["lang"]) for r in rows)


def predicted(text: Column, network: Network | None) -> Column:
    """(lang_pred, score) of each text; ``und`` and 0 if it is null or has no letter."""

    @F.pandas_udf("lang_pred string, score double")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            if network is None:
                yield pd.DataFrame({"lang_pred": [UNKNOWN] * len(texts), "score": 0.0})
                continue
            odds = network.probabilities([(t or "").encode("utf-8") for t in texts])
            best = odds.argmax(axis=1)
            found = odds[np.arange(len(best)), best]
            names = [network.languages[b] if p > 0 else UNKNOWN for b, p in zip(best, found, strict=True)]
            yield pd.DataFrame({"lang_pred": names, "score": np.clip(found, 0.0, 1.0)})

    lettered = F.when(text.rlike(r"\p{L}"), text)
    return read(lettered)


def learnable(docs: DataFrame, parts: int, part: int) -> DataFrame:
    """The rows of ``docs(doc_id, text, lang)`` that have a language and are not held out."""
    columns_named(docs, "doc_id", "text", "lang")
    return docs.where(
        F.col("lang").isNotNull()
        & F.col("doc_id").isNotNull()
        & ~held_out(F.col("doc_id"), parts, part)
        & F.col("text").rlike(r"\p{L}")
    ).select("doc_id", "text", "lang")


def random_windows(windows: list[tuple[bytes, str]], seed: int = 0) -> list[tuple[bytes, str]]:
    """Windows in no language: words of random letters, half of them small Latin ones, the others of the
    alphabets that ``windows`` hardly use."""
    draw = random.Random(seed)
    seen = Counter(c for data, _ in windows for c in data.decode("utf-8", "replace"))
    rare = sum(seen.values()) / 1000
    strange = [
        (ord(first), ord(last))
        for first, last in ALPHABETS
        if first in "aA" or sum(n for c, n in seen.items() if first <= c <= last) < rare
    ]
    found = []
    for n in range(RANDOM_WINDOWS if windows else 0):
        low, high = strange[0] if n % 2 else draw.choice(strange)
        text, size = "", draw.randint(10, TRAINED_CHARACTERS)
        while len(text) < size:
            word = "".join(chr(draw.randint(low, high)) for _ in range(draw.randint(1, 9)))
            text += (word.title() if draw.random() < 0.2 else word) + draw.choice("   .,\n")
        found.append((text[:size].encode("utf-8"), NO_LANGUAGE))
    return found


def known_share(text: Column, network: Network | None) -> Column:
    """The share of a text, in probability, that is in one of the learned languages; 0 without letters."""

    @F.pandas_udf("double")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            if network is None:
                yield pd.Series(np.zeros(len(texts)))
                continue
            odds = network.probabilities([(t or "").encode("utf-8") for t in texts])
            own = [i for i, name in enumerate(network.languages) if name != NO_LANGUAGE]
            yield pd.Series(odds[:, own].sum(axis=1))
        trim()

    return read(F.when(text.rlike(r"\p{L}"), text))


def in_known_language(docs: DataFrame, *, parts: int, part: int, least: float) -> DataFrame:
    """The rows of ``docs(doc_id, text, lang)`` that are written in languages learned from them.

    Besides the labelled rows that are not held out, the network learns words of random letters as no
    language.  Rows stay whose known share is at least ``least``; null texts and texts without a letter go, and so
    does every row if there is nothing to learn from.  An empty table gives an empty result.  All
    columns, whatever their names, stay as they are.
    """
    windows = labelled_windows(learnable(docs, parts, part))
    network = train(windows + random_windows(windows))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    read = docs.select(whole.alias("row"), known_share(F.col("text"), network).alias("share"))
    return read.where((F.col("share") >= least) & (F.col("share") > 0)).select("row.*")


def identify(docs: DataFrame, *, parts: int, part: int) -> DataFrame:
    """``docs`` with ``held_out``, ``lang_pred`` and ``score``, learned from its own labelled rows
    that are not held out: those with text and lang whose crc32(doc_id as text) modulo
    ``parts`` isn't ``part``.  A row without an id is held out of learning too, yet not marked.

    Only the text decides.  Null texts and texts without a letter, or all texts if there is
    nothing to learn from, get ``und`` and 0.  All rows and other columns stay; columns of these
    three names are replaced.  An empty table gives an empty result.
    """
    network = train(labelled_windows(learnable(docs, parts, part)))
    own = [F.col(f"`{c}`") for c in docs.columns if c not in ("held_out", "lang_pred", "score")]
    return docs.select(
        F.struct(*own).alias("row"),
        held_out(F.col("doc_id"), parts, part).alias("held_out"),
        predicted(F.col("text"), network).alias("read"),
    ).select("row.*", "held_out", "read.*")
