"""From raw documents to packed training sequences, in stages that each read the table the
stage before has written."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from maskloom.llm import decontaminate, jaccard, packing, quality, substrings
from maskloom.llm.common import carried, saved


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and lie inside the fences of their language and source.

    Null and empty texts have too few words and go; repeated rows are judged alike; null
    languages and sources are groups of their own. An empty table stays empty.
    """
    return quality.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: five-word shingles, Jaccard 0.8 or more.

    The one with the smallest id stays, null ids last; of rows equal in id and text, one.
    Documents without words are no copies of each other. An empty table stays empty.
    """
    return jaccard.one_of_each(docs, "doc_id", "text", 5, 80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 35 words or more that stand anywhere else too.

    A text that loses words becomes its other words joined by one space, maybe none. Null and
    empty texts stay as they are; repeated rows lose their whole text if it is that long. An
    empty table stays empty.
    """
    own, _, names = carried(docs, [])
    cut = substrings.repeated_words(docs.select(*own), names["text"], window=35, first=18, output="text")
    if "n_chars" in names:
        n, text = names["n_chars"], names["text"]
        cut = cut.withColumn(n, F.when(F.col("n_removed") > 0, F.length(text)).otherwise(F.col(n)).cast("long"))
    return cut.select(*[F.col(new).alias(old) for old, new in names.items()])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item.

    Null and empty texts contain none and stay; repeated rows are judged alike; an empty
    benchmark removes nothing. An empty table stays empty.
    """
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of 1024 tokens.

    Null and empty texts are one token, the end; repeated rows are packed each. An empty
    table gives no pieces.
    """
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    added = packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = packing.cut(
        docs.select("doc_id", "text"), path, public_tokenizers.PATTERN, 1024, 2, payload="crc32", added_ids=added
    )
    return packing.pack(pieces, 1024)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: SQL has no tokenizer and no iterated joins of this kind; see tests/llm/test_pipeline.py
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every one but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
