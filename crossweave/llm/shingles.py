"""Sets of hashed word shingles of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

from crossweave.llm.worker import by_value

by_value(__name__)

# Bytes hashed together.
AT_ONCE = 1 << 18
BASE = 0x9E3779B97F4A7C15
MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)
STEP = np.uint64(0xC2B2AE3D27D4EB4F)
BYTE_VALUES = np.random.default_rng(4).integers(1, 2**64, 256, dtype=np.uint64, endpoint=False)
SEPARATORS = np.zeros(256, dtype=bool)
SEPARATORS[[0x20, *range(0x09, 0x0E)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A hash of whole numbers; different numbers stay different."""
    x = (x ^ (x >> np.uint64(32))) * MULTIPLIER
    x = (x ^ (x >> np.uint64(29))) * STEP
    return x ^ (x >> np.uint64(32))


class Powers:
    """Powers of a base and of its inverse, modulo 2**64, made as far as they are asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def reach(self, size: int) -> None:
        if len(self.up) < size:
            for name, base in (("up", BASE), ("down", pow(BASE, -1, 2**64))):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))


def word_hashes(data: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each word: a polynomial in its bytes, from sums over all bytes."""
    powers.reach(len(data))
    inside = ~SEPARATORS[data]
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUES[data] * powers.up[: len(data)], out=sums[1:])
    return starts, mixed((sums[ends] - sums[starts]) * powers.down[starts])


def _words(texts: list[bytes], powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each word of some texts; long texts are cut between words."""
    owners, hashes = [], []
    joined = b" ".join(texts)
    limits = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]]) if texts else np.zeros(0, int)
    at = 0
    while at < len(joined):
        end = at + AT_ONCE
        if end < len(joined):
            while end < len(joined) and not SEPARATORS[joined[end]]:
                end += 1
        part = np.frombuffer(joined, dtype=np.uint8, count=min(end, len(joined)) - at, offset=at)
        starts, found = word_hashes(part, powers)
        owners.append(np.searchsorted(limits, starts + at, side="right") - 1)
        hashes.append(found)
        at = end
    if not owners:
        return np.zeros(0, dtype=int), np.zeros(0, dtype=np.uint64)
    return np.concatenate(owners), np.concatenate(hashes)


def shingle_sets(texts: list[bytes], size: int, powers: Powers) -> list[np.ndarray]:
    """The set of each text, sorted: distinct shingles of ``size`` words, A-Z in lower case; with fewer
    words the whole sequence as one; without words none."""
    owner, words = _words([t.lower() for t in texts], powers)
    counts = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(counts) - counts
    if len(words) >= size:
        count = len(words) - size + 1
        rolled = words[:count]
        for i in range(1, size):
            rolled = mixed(rolled * STEP + words[i : i + count])
    out = []
    for n, start in zip(counts.tolist(), first.tolist(), strict=True):
        if n >= size:
            out.append(np.unique(rolled[start : start + n - size + 1]))
        elif n:
            short = np.uint64(n)
            for word in words[start : start + n]:
                short = mixed(np.array([short]) * STEP + word)[0]
            out.append(np.array([short], dtype=np.uint64))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def in_groups(rows: Iterable[tuple], size: int | None = None) -> Iterator[list[tuple]]:
    """Groups of rows (.., text) of about ``size`` bytes of text, by default AT_ONCE."""
    size = AT_ONCE if size is None else size
    group: list[tuple] = []
    held = 0
    for row in rows:
        group.append(row)
        held += len(row[-1])
        if held >= size:
            yield group
            group, held = [], 0
    if group:
        yield group
