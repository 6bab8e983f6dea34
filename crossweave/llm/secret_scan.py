"""Secret scans through a trigram inverted index, with DataFrame functions only.

From each rule's pattern a Boolean query over trigrams is derived: alternatives, each a
set of trigrams that a match must hold.  The index has a posting (trigram, document) for
every trigram of these queries that a text contains.  Postings are intersected per
alternative by one aggregate, which gives the documents a rule may match in; only there
is its pattern run.  A rule without mandatory trigrams is run on every text.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from re import _constants as ops
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossweave.llm.worker import columns_named

# Beyond this many alternatives a part of a pattern counts as unknown, which only widens the query.
MOST_ALTERNATIVES = 64
BREAK = None  # between two literal strings of an alternative: anything may stand there


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has at least ``least`` characters.

    The pattern must mean the same to Java and Python; case is ignored for ASCII letters only.
    """

    kind: str
    pattern: str
    ignore_case: bool = False
    group: int = 0
    least: int = 0
    base: bool = False

    @property
    def java(self) -> str:
        return ("(?i)" if self.ignore_case else "") + self.pattern


# The base rules, then public formats of keys.  A run of n or more characters is
# asked for in the pattern where that gives the same matches as a later filter would.
RULES = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        ignore_case=True,
        group=2,
        least=6,
        base=True,
    ),
    Rule("access", r"AKIA[A-Z0-9]{16,}", base=True),
    Rule("hex", r"[0-9a-f]{24,}", base=True),
    Rule("pem", r"-----BEGIN (RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
)


# Deriving trigram queries.


def _alternatives(parsed) -> list[tuple]:
    """Each way through a parsed pattern, as characters and breaks."""
    ways: list[tuple] = [()]
    for op, value in parsed:
        if op is ops.LITERAL:
            step = [(chr(value),)]
        elif op is ops.IN and all(o is ops.LITERAL for o, _ in value):
            step = [(chr(c),) for _, c in value]
        elif op is ops.SUBPATTERN:
            step = _alternatives(value[3])
        elif op is ops.BRANCH:
            step = [way for branch in value[1] for way in _alternatives(branch)]
        elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT):
            least, most, inner = value
            once = _alternatives(inner)
            if (least, most) == (1, 1):
                step = once
            elif (least, most) == (0, 1):
                step = [(), *once]
            elif least >= 1:
                step = [(*way, BREAK) for way in once]
            else:
                step = [(BREAK,)]
        elif op is ops.AT:
            step = [()]
        else:
            step = [(BREAK,)]
        if len(ways) * len(step) > MOST_ALTERNATIVES:
            step = [(BREAK,)]
        ways = list(dict.fromkeys((*a, *b) for a in ways for b in step))
    return ways


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives of which a text with a match meets one: sets of trigrams in lower case.

    Empty if there is an alternative without a mandatory trigram: then texts must be scanned.
    """
    found: set[frozenset[str]] = set()
    for way in _alternatives(_parser.parse(pattern)):
        grams = set()
        for i in range(len(way) - 2):
            part = way[i : i + 3]
            if BREAK not in part:
                grams.add("".join(part).lower())
        if not grams:
            return []
        found.add(frozenset(grams))
    # An alternative that asks for more than another adds nothing.
    return sorted((a for a in found if not any(b < a for b in found)), key=sorted)


# The index.


def row_key() -> Column:
    """Key of a row.  Rows that share it get each other's candidates, which are then verified."""
    return F.xxhash64("doc_id", "text")


def postings(docs: DataFrame, grams: Sequence[str]) -> DataFrame:
    """(gram, key): one row for each listed trigram a text contains, case ignored."""
    folded = docs.select(row_key().alias("key"), F.lower("text").alias("folded"))
    present = F.array_compact(
        F.array(*[F.when(F.contains("folded", F.lit(g)), F.lit(i)) for i, g in enumerate(grams)])
    )
    return folded.select("key", F.explode(present).alias("gram"))


def candidates(docs: DataFrame, rules: Sequence[Rule]) -> DataFrame | None:
    """(key, rules): by intersecting postings, the indexed rules that may match in a row."""
    terms = [
        (gram, number, way, bit)
        for number, rule in enumerate(rules)
        for way, grams in enumerate(trigram_query(rule.pattern))
        for bit, gram in enumerate(sorted(grams))
    ]
    if not terms:
        return None
    grams = sorted({t[0] for t in terms})
    values = ", ".join(f"({grams.index(g)}, {n}, {w}, {1 << b}L)" for g, n, w, b in terms)
    # The query's own terms: as many as the rules have trigrams.
    asked = docs.sparkSession.sql(f"SELECT * FROM VALUES {values} AS asked(gram, rule, way, bit)")
    whole = asked.groupBy("rule", "way").agg(F.bit_or("bit").alias("all_bits"))
    met = (
        postings(docs, grams)
        .join(F.broadcast(asked), "gram")
        .groupBy("key", "rule", "way")
        .agg(F.bit_or("bit").alias("bits"))
        .join(F.broadcast(whole), ["rule", "way"])
        .where(F.col("bits") == F.col("all_bits"))
    )
    return met.groupBy("key").agg(F.collect_set("rule").alias("rules"))


# Verification.

SPANS = "array<struct<start:int,kind:int,end:int>>"
PIECES = "array<struct<at:int,size:int>>"
# Entries of a list that are gathered together; characters of a part of a text.
GROUP = 256
PART = 512


def _once(value: Column, use) -> Column:
    """``use(value)``, for which the value is worked out once."""
    return F.transform(F.array(value), use)[0]


def _gathered(items: Column, kind: str, step) -> Column:
    """(at, found): ``step(at, item)`` gives the next place, from 0, and ``one`` to note, or null.

    What is noted is gathered by groups, so that work grows with the items, not with their square.
    """
    none = F.array().cast(kind).alias("found")

    def inner(so_far: Column, item: Column) -> Column:
        return _once(
            step(so_far["at"], item),
            lambda s: F.struct(
                s["at"].alias("at"),
                F.when(s["one"].isNull(), so_far["found"])
                .otherwise(F.concat(so_far["found"], F.array(s["one"]).cast(kind)))
                .alias("found"),
            ),
        )

    def by_group(items: Column) -> Column:
        def outer(so_far: Column, first: Column) -> Column:
            start = F.struct(so_far["at"].alias("at"), none)
            return _once(
                F.aggregate(F.slice(items, first, GROUP), start, inner),
                lambda run: F.struct(
                    run["at"].alias("at"),
                    F.concat(so_far["found"], F.array(run["found"])).alias("found"),
                ),
            )

        firsts = F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), F.lit(GROUP))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("found"))
        return F.aggregate(
            firsts, start, outer, lambda done: F.struct(done["at"].alias("at"), F.flatten(done["found"]).alias("found"))
        )

    return _once(items, by_group)


def _spans(text: Column, number: int, rule: Rule) -> Column:
    """Leftmost non-overlapping matches with their places, counted in characters: the pieces
    between matches give the places."""
    pattern = F.lit(rule.java)
    sized = F.zip_with(
        F.regexp_extract_all(text, pattern, F.lit(0)),
        F.regexp_extract_all(text, pattern, F.lit(rule.group)),
        lambda match, part: F.struct(
            F.length(match).alias("size"), F.length(part).alias("part")
        ),
    )
    gaps = F.zip_with(
        F.split(text, rule.java, -1),
        sized,
        lambda piece, match: F.struct(F.length(piece).alias("gap"), match.alias("match")),
    )

    def step(at: Column, gap: Column) -> Column:
        start = at + gap["gap"]
        end = start + gap["match"]["size"]
        span = F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end"))
        fits = gap["match"].isNotNull() & (gap["match"]["part"] >= rule.least)
        return F.struct(F.coalesce(end, start).alias("at"), F.when(fits, span).alias("one"))

    return _gathered(gaps, SPANS, step)["found"]


def with_spans(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Add ``spans``: all matches as (start, kind, end), sorted; kind is the rule's number.

    A null text counts as empty.  ``docs`` needs doc_id and text and keeps all its columns
    and rows; a column named ``spans`` is replaced.
    """
    columns_named(docs, "doc_id", "text")
    own = [F.col(f"`{c}`") for c in docs.columns if c != "spans"]
    found = candidates(docs, rules)
    # Rows travel whole, so that no column of theirs meets one of the scan's.
    keyed = docs.select(F.struct(*own).alias("row"), "text", row_key().alias("key"))
    if found is None:
        joined = keyed.withColumn("rules", F.array().cast("array<int>"))
    else:
        joined = keyed.join(found.select("key", "rules"), "key", "left")
    text = F.coalesce("text", F.lit(""))
    empty = F.array().cast(SPANS)
    by_rule = []
    for number, rule in enumerate(rules):
        spans = _spans(text, number, rule)
        if trigram_query(rule.pattern):
            asked = F.array_contains("rules", number)
            spans = F.when(asked, spans).otherwise(empty)
        by_rule.append(spans)
    return joined.select("row", F.array_sort(F.concat(*by_rule)).alias("spans")).select("row.*", "spans")


def _written(spans: Column, rules: Sequence[Rule]) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(
                ":", kinds[s["kind"]], s["start"].cast("string"), s["end"].cast("string")
            ),
        ),
        ",",
    )


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(doc_id, n_<base kind> ..., base_sha256, spans) for every row of ``docs(doc_id, text)``.

    Spans are ``kind:start:end`` by start, then kind as listed, joined by commas; without any
    they are empty, and the digest is that of an empty text.  Null texts count as empty,
    repeated rows give repeated results, a null doc_id stays null, other columns are ignored,
    an empty table gives an empty result.
    """
    base = [n for n, r in enumerate(rules) if r.base]
    # Texts and candidates only: columns of other names don't take part.
    spanned = with_spans(docs.select("doc_id", "text"), rules)
    of = lambda n: F.size(F.filter("spans", lambda s: s["kind"] == n)).cast("long")
    based = F.filter("spans", lambda s: s["kind"].isin(base))
    return spanned.select(
        "doc_id",
        *[of(n).alias(f"n_{rules[n].kind}") for n in base],
        F.sha2(_written(based, rules), 256).alias("base_sha256"),
        _written(F.col("spans"), rules).alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[secret]", rules: Sequence[Rule] = RULES) -> DataFrame:
    """``docs`` with each secret in ``text`` replaced by ``mark``; overlapping ones by one mark.

    All rows and columns stay; texts without a secret, and null ones, stay as they are.
    """
    spanned = with_spans(docs, rules)

    def step(at: Column, span: Column) -> Column:
        """Where the rest begins, and the piece to keep before a mark."""
        apart = (span["start"] >= at) & ~((span["start"] == at) & (at > 0))
        piece = F.struct(at.alias("at"), (span["start"] - at).alias("size"))
        return F.struct(F.greatest(at, span["end"]).alias("at"), F.when(apart, piece).alias("one"))

    def written(known: Column) -> Column:
        # A piece is cut from the parts that hold it, not from the text's beginning.
        def piece(at: Column, size: Column) -> Column:
            first, skip = F.floor(at / PART).cast("int"), at % PART
            parts = F.slice(known["parts"], first + 1, F.floor((skip + size) / PART).cast("int") + 1)
            return F.array_join(parts, "").substr(skip + 1, size)

        kept = F.transform(known["run"]["found"], lambda p: F.concat(piece(p["at"], p["size"]), F.lit(mark)))
        end = known["run"]["at"]
        return F.concat(F.array_join(kept, ""), piece(end, F.length("text") - end))

    parts = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PART}}}"), F.lit(0))
    clean = _once(F.struct(parts.alias("parts"), _gathered(F.col("spans"), PIECES, step).alias("run")), written)
    text = F.when(F.size("spans") > 0, clean).otherwise(F.col("text")).alias("text")
    return spanned.select(*[text if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def spans_by_hand(text: str | None, rules: Sequence[Rule] = RULES) -> list[tuple[int, int, int]]:
    """The same spans, rule by rule over the whole text; for tests."""
    found = []
    for number, rule in enumerate(rules):
        flags = re.ASCII | (re.IGNORECASE if rule.ignore_case else 0)
        for match in re.finditer(rule.pattern, text or "", flags):
            if len(match[rule.group]) >= rule.least:
                found.append((match.start(), number, match.end()))
    return sorted(found)
