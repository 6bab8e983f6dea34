"""A training-corpus pipeline of the numbered operators; each stage reads what the one before wrote.

1. language: documents in no language learned from the corpus go.
2. near_copies: of each group of near copies one document stays.
3. secrets: secrets in texts are replaced by a mark.
4. mixture: documents are put in the order in which their sources are to be read.
5. tokens: texts become token ids, decoded again to prove them; the mixture's order is kept as columns.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossweave.llm import bpe_transducer, language_id, mixing, ngram_join, secret_scan
from crossweave.llm.queries import MIX_BLOCK, MIX_POWER
from crossweave.workspace import Workspace

#: Of a text at least this share, in probability, must be in the languages learned.  Of 10,000 held-out and learned
#: documents the least has 0.48, of texts of random letters the greatest 0.13.
LEAST_LANGUAGE = 0.3
#: Near copies: shingles of so many words, alike to so many percent.
COPY_WORDS, COPY_PERCENT = 5, 80

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the languages learned from them; those without letters, in other languages or of random
    letters go.  An empty table stays empty."""
    return language_id.in_known_language(docs, parts=4, part=2, least=LEAST_LANGUAGE)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id; documents without words stay."""
    return ngram_join.one_of_each(docs, percent=COPY_PERCENT, words=COPY_WORDS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their secrets; ``n_chars`` follows where it is there."""
    clean = secret_scan.redact(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        length = F.when(F.col("text").isNotNull(), F.length("text")).cast(kind)
        clean = clean.withColumn("n_chars", F.coalesce(length, "n_chars"))
    return clean


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order in which sources by their tempered weights are to be read."""
    weights = mixing.tempered(docs, MIX_POWER)
    return mixing.in_order(docs, weights, block_rows=MIX_BLOCK)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, lang, mix_file, mix_row, n_tokens, ids, round_trip): ``mix_file`` and ``mix_row``
    are where the mixture's files have the document, null for documents that aren't read from files."""
    file = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    pattern = public_tokenizers.PATTERN
    own = ["doc_id", "source", "lang", "text"]
    try:
        placed = docs.select(
            *own,
            F.col("_metadata.file_name").alias("mix_file"),
            F.col("_metadata.row_index").alias("mix_row"),
        )
        placed.schema  # noqa: B018  (fails here if there are no files)
    except AnalysisException:
        placed = docs.select(
            *own,
            F.lit(None).cast("string").alias("mix_file"),
            F.lit(None).cast("long").alias("mix_row"),
        )
    return bpe_transducer.with_ids(placed, file, pattern)


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_copies", near_copies),
    ("secrets", secrets),
    ("mixture", mixture),
    ("tokens", tokens),
]

# Neither the network nor the byte-pair merges can be told in SQL; tests/llm has a version by hand.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; the result of each but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ws = Workspace(spark)
    for name, stage in STAGES[:-1]:
        docs = ws.save(stage(spark, docs, sf_dir), name).df
    return STAGES[-1][1](spark, docs, sf_dir)
