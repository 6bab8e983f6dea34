"""Splitting and lower-casing by the Unicode tables of the tokenizer libraries.

The regex module's tables are newer than theirs, and Python's own older; where they differ is fixed here.
"""

from __future__ import annotations

import re

import regex

from crossweave.llm.worker import by_value

by_value(__name__)

# Code points, from and to, that the regex module counts as letters or numbers and the tokenizer
# library, whose tables are older, as neither.
NEWER = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF "
    "10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 "
    "16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 "
    "191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE "
    "1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 "
    "3D000-3FC3F"
)
# The first code point that may differ is 0x558.
MAY_DIFFER = re.compile("[\u0558-\U0010ffff]")
# Small letters that Python doesn't know of: single ones, then ranges as (from, to, distance).
SMALL = {
    0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5,
    0xA7DA: 0xA7DB, 0xA7DC: 0x19B,
}
SMALL_RANGES = ((0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B))
SMALLER = SMALL | {c: c + by for low, high, by in SMALL_RANGES for c in range(low, high + 1)}


class Splitter:
    """``findall`` of a splitting pattern with the libraries' letters and numbers."""

    def __init__(self, pattern: str):
        self.plain = regex.compile(pattern)
        ends = [[chr(int(end, 16)) for end in part.split("-")] for part in NEWER.split()]
        newer = "".join(f"{first[0]}-{first[-1]}" for first in ends)
        for kind in ("L", "N"):
            pattern = pattern.replace(rf"\p{{{kind}}}", rf"[\p{{{kind}}}--[{newer}]]")
        self.pinned = regex.compile(pattern, regex.V1)

    def findall(self, text: str) -> list[str]:
        if text.isascii() or not MAY_DIFFER.search(text):
            return self.plain.findall(text)
        return self.pinned.findall(text)


def lowered(text: str) -> str:
    """Each capital lowered by itself: a sigma at the end of a word isn't special."""
    if not text.isascii() and MAY_DIFFER.search(text):
        text = text.translate(SMALLER)
    return text.replace("\u03a3", "\u03c3").lower()
