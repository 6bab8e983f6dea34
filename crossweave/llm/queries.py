"""The registered queries of this package, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossweave.llm import (
    bpe_transducer,
    hard_negatives,
    html_text,
    language_id,
    mixing,
    ngram_join,
    quality_mil,
    secret_scan,
    sharding,
    simhash,
    token_alignment,
    token_counts,
    topk_search,
)
from crossweave.llm.sql import SQL as SQL

TOKEN_LIMIT = 2048
#: Sources are mixed by their rows to this power, in blocks of so many documents.
MIX_POWER = 0.5
MIX_BLOCK = 64
#: Fingerprints of every so many-th document are searched for, within so many bits.
SEARCHED = 100
NEAR_BITS = 3
#: A text is good from this score on.
GOOD = 0.3
SHARDS = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every document in the mixture of sources."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs, mixing.tempered(docs, MIX_POWER), block_rows=MIX_BLOCK)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_counts.count_tokens(
        docs, public_tokenizers.path("word_bpe_49k.json"), limit=TOKEN_LIMIT
    )


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_components(table(spark, sf_dir, "documents"), percent=85, words=4)


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op5_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_transducer.encode_digests(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.with_near_counts(docs, every=SEARCHED, radius=NEAR_BITS)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.identify(table(spark, sf_dir, "documents"), parts=4, part=2)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op9_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_mil.score_quality(
        table(spark, sf_dir, "documents"),
        table(spark, sf_dir, "labels"),
        parts=5,
        part=0,
        threshold=GOOD,
    )


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align_and_count(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.PATTERN,
        public_tokenizers.path("piece_bpe_32k.model"),
    )


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every document goes, told from the shuffled documents themselves."""
    text = F.coalesce("row.text", F.lit(""))
    return sharding.shuffled(table(spark, sf_dir, "documents"), shards=SHARDS).select(
        F.col("row.doc_id").alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit(sharding.LAW).alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh row bears the label after its own."""
    label = F.when(F.expr("vec_id % 7 = 0"), F.expr("(label + 1) % 10")).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", label)
    return hard_negatives.mine(
        vectors, every=100, positives=5, negatives=10, low=30, high=90
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mixing,
        op2_token_counts,
        op3_ngram_join,
        op4_topk_search,
        op5_bpe_transducer,
        op6_html_text,
        op7_simhash,
        op8_language_id,
        op9_quality_mil,
        op10_secret_scan,
        op11_token_alignment,
        op12_sharding,
        op13_hard_negatives,
    )
}
