"""Byte-level BPE encoding by a lazily determinised transducer, and streaming decoding.

A sequence of tokens is the BPE encoding of its bytes just where every token is the
encoding of its own bytes and every two neighbours are the encoding of theirs: merges
inside a token don't depend on what is outside, and the first merge across a border
would also be made on the two neighbours alone.  So a nondeterministic machine that
guesses token borders and checks neighbours accepts one path per text.  Its states are
determinised as they are met: a state holds the open guesses, each a node in the tree of
token bytes with the tokens not yet emitted; tokens all guesses agree on are emitted.
A guess dies as soon as no token goes on from it, so the lookahead is bounded by the
longest token.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crossweave.llm.splitting import Splitter
from crossweave.llm.worker import by_value, columns_named, kept, trim, uncollected

by_value(__name__)

# Bounds of what a worker keeps: up to some 140, 35 and 60 MB, with 30 MB for the vocabulary itself.
KEPT_STATES = 200_000
KEPT_PAIRS = 300_000
KEPT_PIECES = 160_000
# The share of these among the stages of a job that needs the memory for others.
AMONG_OTHERS = 0.5
KEPT_LENGTH = 64
# Marks of pieces met once; a piece is kept from the second time on.
MARKS = 1 << 23
NO_RANK = 1 << 60
# Rows whose ids are held together.
ROWS_AT_ONCE = 500
# Tokens per step of a streaming decoder.
DECODED_AT_ONCE = 2048


def read_ranks(file: str) -> dict[bytes, int]:
    with open(file, "rb") as source:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, source)}


class State:
    """Open guesses; ``on`` has the moves met so far: byte -> (tokens emitted, next state)."""

    __slots__ = ("guesses", "on")

    def __init__(self, guesses: tuple):
        self.guesses = guesses
        self.on: dict[int, tuple[tuple[int, ...], State]] = {}


class Pieces(dict):
    """Packed tokens of pieces met before; a new piece goes through the transducer.

    Pieces met once leave only a mark, as most never come again.  When full, the table becomes the
    elder one and a new one begins; pieces still in use come back.
    """

    def __init__(self, machine: Transducer):
        super().__init__()
        self.machine = machine
        self.elder: dict[str, bytes] = {}
        self.marks, self.marked = bytearray(MARKS // 8), 0

    def _met(self, piece: str) -> bool:
        at = hash(piece) % MARKS
        bit = 1 << (at & 7)
        if self.marks[at >> 3] & bit:
            return True
        if self.marked >= MARKS // 4:
            self.marks, self.marked = bytearray(MARKS // 8), 0
        self.marks[at >> 3] |= bit
        self.marked += 1
        return False

    def __missing__(self, piece: str) -> bytes:
        ids = self.elder.get(piece)
        if ids is None:
            packed = self.machine.packed
            ids = b"".join([packed[i] for i in self.machine.piece(piece.encode("utf-8"))])
            if len(piece) > KEPT_LENGTH or not self._met(piece):
                return ids
        if len(piece) <= KEPT_LENGTH:
            if len(self) >= self.machine.most_pieces:
                self.elder = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Transducer:
    """Encodes pieces of text under one rank file."""

    def __init__(self, file: str, pattern: str, share: float = 1.0):
        self.most_states, self.most_pairs, self.most_pieces = (
            int(share * most) for most in (KEPT_STATES, KEPT_PAIRS, KEPT_PIECES)
        )
        self.ranks = read_ranks(file)
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.packed = {i: i.to_bytes(4, "little") for i in self.bytes_of}
        self.pieces = Splitter(pattern)
        # The tree of token bytes: (node << 8 | byte) -> node, the token that ends at a node, and
        # whether any goes on from it.
        self.child: dict[int, int] = {}
        self.token: list[int] = [-1]
        self.goes_on = bytearray(1)
        for data, token in self.ranks.items():
            if self._merged(data) != [data]:
                continue  # no merges lead to it: only a piece equal to it becomes this token
            node = 0
            for byte in data:
                self.goes_on[node] = 1
                node = self.child.setdefault(node << 8 | byte, len(self.token))
                if node == len(self.token):
                    self.token.append(-1)
                    self.goes_on.append(0)
            self.token[node] = token
        self.pairs: dict[int, bool] = {}
        self.known = Pieces(self)
        self.states: dict[tuple, State] = {}
        # A guess: (node, token before the open one or -1, tokens not emitted, the last included).
        self.start = self._state(((0, -1, ()),))

    def clear(self) -> None:
        """Let go of all tables; states refer to each other in circles."""
        for state in self.states.values():
            state.on.clear()
        self.states.clear()
        self.pairs.clear()
        self.known.clear()
        self.known.elder.clear()

    def _forget(self) -> None:
        """Keep the half of the states nearest to the start, which most pieces come through."""
        near = {self.start: None}
        for state in (queue := [self.start]):
            for _, after in state.on.values():
                if after not in near and len(near) < self.most_states // 2:
                    near[after] = None
                    queue.append(after)
        for state in near:
            state.on = {byte: move for byte, move in state.on.items() if move[1] in near}
        for state in self.states.values():
            if state not in near:
                state.on.clear()  # else circles of states would need the collector
        self.states = {state.guesses: state for state in near}

    def _state(self, guesses: tuple) -> State:
        state = self.states.get(guesses)
        if state is None:
            state = self.states[guesses] = State(guesses)
        return state

    def _merged(self, data: bytes) -> list[bytes]:
        """Merge by rank, leftmost first: the definition, used on one token or two."""
        parts = [data[i : i + 1] for i in range(len(data))]
        rank = self.ranks.get
        ranks = [rank(data[i : i + 2], NO_RANK) for i in range(len(data) - 1)]
        while ranks:
            least = min(ranks)
            if least == NO_RANK:
                break
            i = ranks.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] + parts[i], NO_RANK)
            if i < len(ranks):
                ranks[i] = rank(parts[i] + parts[i + 1], NO_RANK)
        return parts

    def _neighbours(self, left: int, right: int) -> bool:
        key = left << 32 | right
        fits = self.pairs.get(key)
        if fits is None:
            a, b = self.bytes_of[left], self.bytes_of[right]
            fits = self._merged(a + b) == [a, b]
            if len(self.pairs) >= self.most_pairs:
                self.pairs.clear()
            self.pairs[key] = fits
        return fits

    def _move(self, state: State, byte: int) -> tuple[tuple[int, ...], State]:
        child, goes_on, ends = self.child, self.goes_on, self.token
        grown, closed = [], None
        for node, last, pending in state.guesses:
            node = child.get(node << 8 | byte)
            if node is None:
                continue
            if goes_on[node]:
                grown.append((node, last, pending))
            if closed is None:
                token = ends[node]
                if token >= 0 and (last < 0 or self._neighbours(last, token)):
                    closed = (0, token, (*pending, token))
        if grown:
            # Emit what all guesses agree on.
            grown.append(closed)
            emitted = closed[2]
            for _, _, pending in grown:
                while emitted != pending[: len(emitted)]:
                    emitted = emitted[:-1]
            done = len(emitted)
            if done:
                grown = [(node, last, pending[done:]) for node, last, pending in grown]
        else:
            emitted, grown = closed[2], [(0, closed[1], ())]
        state.on[byte] = move = emitted, self._state(tuple(grown))
        return move

    def piece(self, data: bytes) -> list[int]:
        """Tokens of one piece."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        out: list[int] = []
        state = self.start
        for byte in data:
            move = state.on.get(byte)
            if move is None:
                if len(self.states) >= self.most_states:
                    self._forget()
                    state = self._state(state.guesses)
                move = self._move(state, byte)
            if move[0]:
                out += move[0]
            state = move[1]
        for node, _, pending in state.guesses:
            if node == 0:
                out.extend(pending)
        return out

    def encode_packed(self, text: str | None) -> bytes:
        """Tokens of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        return b"".join(map(self.known.__getitem__, self.pieces.findall(text)))

    def encode(self, text: str | None) -> list[int]:
        return list(memoryview(self.encode_packed(text)).cast("I"))


# Which bytes may follow in well-formed UTF-8, by first byte.
# (first byte from, to, continuation bytes, second byte from, to)
UTF8_FORMS = (
    (0x00, 0x7F, 0, 0x80, 0xBF),
    (0xC2, 0xDF, 1, 0x80, 0xBF),
    (0xE0, 0xE0, 2, 0xA0, 0xBF),
    (0xE1, 0xEC, 2, 0x80, 0xBF),
    (0xED, 0xED, 2, 0x80, 0x9F),
    (0xEE, 0xEF, 2, 0x80, 0xBF),
    (0xF0, 0xF0, 3, 0x90, 0xBF),
    (0xF1, 0xF3, 3, 0x80, 0xBF),
    (0xF4, 0xF4, 3, 0x80, 0x8F),
)


class Utf8Machine:
    """Incremental UTF-8: a state is the bytes of an unfinished character, at most three.

    ``feed`` gives the characters that are complete after some more bytes.  What can't be
    the start of a character becomes a replacement character, as Python's own decoder has it.
    """

    def __init__(self):
        self.form = {b: f for f in UTF8_FORMS for b in range(f[0], f[1] + 1)}

    def unfinished(self, data: bytes) -> int:
        """How many of the last bytes are the start of a character."""
        for size in range(1, min(3, len(data)) + 1):
            byte = data[-size]
            if 0x80 <= byte <= 0xBF:
                continue  # goes on from a byte before
            form = self.form.get(byte)
            if form is None or size > form[2]:
                return 0
            return size if size == 1 or form[3] <= data[1 - size] <= form[4] else 0
        return 0

    def feed(self, state: bytes, data: bytes) -> tuple[str, bytes]:
        data = state + data
        end = len(data) - self.unfinished(data)
        return data[:end].decode("utf-8", "replace"), data[end:]


class Decoder:
    """Text of token ids, piece by piece as they come."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of = bytes_of
        self.machine = Utf8Machine()

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        state, bytes_of = b"", self.bytes_of
        ids = iter(ids)
        while part := [bytes_of[i] for i in islice(ids, DECODED_AT_ONCE)]:
            text, state = self.machine.feed(state, b"".join(part))
            if text:
                yield text
        if state:
            yield state.decode("utf-8", "replace")

    def text(self, ids: Iterable[int]) -> str:
        return "".join(self.stream(ids))


def _new_coder(file: str, pattern: str, share: float = 1.0) -> tuple[Transducer, Decoder]:
    machine = Transducer(file, pattern, share)
    return machine, Decoder(machine.bytes_of)


def _coder(file: str, pattern: str) -> tuple[Transducer, Decoder]:
    return kept("bpe_transducer", (file, pattern), lambda: _new_coder(file, pattern))


def encode(text: Column, file: str, pattern: str) -> Column:
    """Token ids of each text, as an array of int; null gives an empty array."""

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine, _ = _coder(file, pattern)
        for texts in batches:
            with uncollected():
                packed = [np.frombuffer(machine.encode_packed(t), dtype="<i4") for t in texts]
            yield pd.Series(packed, dtype=object)

    return ids(text)


def decode(ids: Column, file: str, pattern: str) -> Column:
    """Text of each array of token ids; null gives an empty text, an unknown id fails."""

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        _, decoder = _coder(file, pattern)
        for arrays in batches:
            yield pd.Series(
                [decoder.text([] if a is None else map(int, a)) for a in arrays], dtype=object
            )

    return text(ids)


def with_ids(docs: DataFrame, file: str, pattern: str) -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids`` and ``round_trip`` in the place of ``text``: the token ids of
    each text, and whether they decode to it again; null counts as empty.

    Rows keep their order within a partition; columns of these names are replaced.
    """
    columns_named(docs, "text")
    own = [c for c in docs.columns if c not in ("text", "n_tokens", "ids", "round_trip")]
    made = T.StructType(
        [docs.schema[c] for c in own]
        + [
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids", T.ArrayType(T.IntegerType())),
            T.StructField("round_trip", T.BooleanType()),
        ]
    )

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A coder of the task's own: among other stages, its tables must not stay in the worker.
        machine, decoder = _new_coder(file, pattern, AMONG_OTHERS)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                texts = part.column(len(own)).to_pylist()
                with uncollected():
                    packed = [machine.encode_packed(t) for t in texts]
                same = [
                    decoder.text(memoryview(p).cast("I")) == (t or "")
                    for p, t in zip(packed, texts, strict=True)
                ]
                counts = np.array([len(p) // 4 for p in packed], dtype=np.int64)
                # Ids go to Arrow as they are packed, never as Python numbers.
                ids = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)),
                    pa.array(np.frombuffer(b"".join(packed), dtype="<i4")),
                )
                columns = [part.column(i) for i in range(len(own))]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(counts), ids, pa.array(same, pa.bool_())],
                    names=[*own, "n_tokens", "ids", "round_trip"],
                )
        machine.clear()
        del machine, decoder
        trim()

    return docs.select(*[f"`{c}`" for c in own], "text").mapInArrow(coded, made)


def encode_digests(docs: DataFrame, file: str, pattern: str) -> DataFrame:
    """Encode every text of ``docs(doc_id, text)``, decode the ids, and give the digests of both:
    (doc_id, n_tokens, ids_sha256, decoded_sha256).

    Null and empty texts have no tokens and the digests of no bytes.  Repeated rows give repeated
    results, a null doc_id stays null, other columns are ignored, an empty table gives an
    empty result.
    """
    columns_named(docs, "doc_id", "text")

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        machine, decoder = _coder(file, pattern)
        for texts in batches:
            rows = []
            with uncollected():
                for text in texts:
                    packed = machine.encode_packed(text)
                    back = hashlib.sha256()
                    for part in decoder.stream(memoryview(packed).cast("I")):
                        back.update(part.encode("utf-8"))
                    rows.append(
                        (len(packed) // 4, hashlib.sha256(packed).hexdigest(), back.hexdigest())
                    )
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", digests("text").alias("made")).select("doc_id", "made.*")
