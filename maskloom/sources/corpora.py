"""Corpus sources, the corpus catalog, the tokenized-corpus cache and sinks."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from maskloom.functions.text import detok_for, strip
from maskloom.sources import files


@dataclass(frozen=True)
class Corpus:
    name: str
    path: str
    config: str | None = None
    text_column: str = "text"
    drop: str = "text"
    detokenizer: str | None = None
    holdout: str = "validation"
    wrap: bool = True
    streaming: bool = False
    #: corpus that training on this one is validated on, itself if None
    validated_on: str | None = None


# The known corpora. Names that are not listed are read under their own name.
CORPORA = [
    Corpus("wikitext103", "wikitext", "wikitext-103-raw-v1", detokenizer="wikitext"),
    Corpus("wikitext2", "wikitext", "wikitext-2-raw-v1", detokenizer="wikitext"),
    Corpus("ptb", "ptb_text_only", text_column="sentence", drop="sentence", detokenizer="ptb"),
    Corpus("lambada", "lambada_test.jsonl", detokenizer="lambada"),
    Corpus("text8", "text8", holdout="test"),
    Corpus("text8-crop", "text8", validated_on="text8"),
    Corpus("lm1b", "lm1b", detokenizer="lm1b", holdout="test", wrap=False),
    Corpus("lm1b-gpt2", "lm1b", detokenizer="lm1b", holdout="test"),
    Corpus("lm1b-streaming", "lm1b", detokenizer="lm1b", holdout="test", wrap=False, streaming=True),
    Corpus("openwebtext", "openwebtext", validated_on="wikitext103"),
    Corpus("openwebtext-streaming", "openwebtext", streaming=True, validated_on="wikitext103"),
    Corpus("openwebtext-train", "openwebtext", validated_on="openwebtext-valid"),
    Corpus("openwebtext-valid", "openwebtext"),
    Corpus(
        "scientific_papers_arxiv",
        "scientific_papers",
        "arxiv",
        text_column="article",
        drop="article,abstract,section_names",
        detokenizer="scientific_papers",
    ),
    Corpus(
        "scientific_papers_pubmed",
        "scientific_papers",
        "pubmed",
        text_column="article",
        drop="article,abstract,section_names",
        detokenizer="scientific_papers",
    ),
    Corpus("ag_news", "ag_news", drop="text,label", holdout="test"),
    Corpus("babylm", "*.train"),
]


def catalog(spark: SparkSession) -> DataFrame:
    """The corpus catalog as a table."""
    schema = (
        "name string, path string, config string, text_column string, drop string, "
        "detokenizer string, holdout string, wrap boolean, streaming boolean, validated_on string"
    )
    return spark.createDataFrame([tuple(asdict(c).values()) for c in CORPORA], schema)


def describe(df: DataFrame, corpus: str = "corpus") -> DataFrame:
    """Join the catalog by corpus name; unlisted names get the generic settings."""
    known = catalog(df.sparkSession).withColumnRenamed("name", corpus)
    joined = df.join(known, corpus, "left")
    generic = Corpus("", "")
    fallback = {
        "text_column": F.lit(generic.text_column),
        "drop": F.lit(generic.drop),
        "holdout": F.lit(generic.holdout),
        "wrap": F.lit(generic.wrap),
        "streaming": F.lit(generic.streaming),
        "path": F.col(corpus),
        "validated_on": F.col(corpus),
    }
    for name, value in fallback.items():
        joined = joined.withColumn(name, F.coalesce(F.col(name), value))
    return joined


def read_text_lines(spark: SparkSession, path: str, pattern: str = "*.train") -> DataFrame:
    """Stripped non-empty lines of all matching files: ``(file, line_no, text)``.

    ``line_no`` numbers the kept lines by file name and position. A file block is read
    by one task in order, which makes (file, block start, running id) a total order;
    blocks are bounded by ``spark.sql.files.maxPartitionBytes``.
    """
    if not files.matching(spark, f"{path.rstrip('/')}/{pattern}"):
        raise ValueError(f"no {pattern} files in {path}")
    value = strip(F.col("value"))
    return in_file_order(spark.read.text(path, pathGlobFilter=pattern), value, value != "")


def in_file_order(lines: DataFrame, text: Column, keep: Column | None = None) -> DataFrame:
    """``(file, line_no, text)`` of rows as a file source gives them, numbered densely by file
    name and position over all files.

    One row per file block carries the offsets; no row moves but to its block's window.
    """
    placed = lines.select(
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"),
        text.alias("text"),
        (F.lit(True) if keep is None else keep).alias("_keep"),
    )
    placed = placed.where("_keep").drop("_keep")
    blocks = placed.groupBy("file", "_block").agg(F.count(F.lit(1)).alias("_n"))
    earlier = (
        Window.partitionBy(F.lit(0))
        .orderBy("file", "_block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    # one row per file block
    offsets = blocks.select(
        "file", "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy("file", "_block").orderBy("_at")
    return (
        placed.withColumn("_row", F.row_number().over(inside) - 1)
        .join(offsets, ["file", "_block"])
        .select("file", (F.col("_row") + F.col("_before")).cast("long").alias("line_no"), "text")
    )


def read_jsonl(spark: SparkSession, path: str, schema: str = "text string") -> DataFrame:
    """JSON lines with a declared schema; blank lines give no row, broken ones fail."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def project_text(corpus: Column, columns: dict[str, Column]) -> Column:
    """The text column of a row by corpus name: sentence, article or text."""
    missing = F.lit(None).cast("string")
    return (
        F.when(corpus == "ptb", columns.get("sentence", missing))
        .when(corpus.contains("scientific_papers"), columns.get("article", missing))
        .otherwise(columns.get("text", missing))
    )


def detokenized(df: DataFrame, corpus: str = "corpus", text: str = "text") -> DataFrame:
    return df.withColumn(text, detok_for(F.col(corpus), F.col(text)))


def drop_source_columns(df: DataFrame, corpus: str) -> DataFrame:
    """Leave out the raw columns of a corpus once it is tokenized."""
    found = next((c for c in CORPORA if c.name == corpus), Corpus("", ""))
    return df.drop(*found.drop.split(","))


def cache_name(
    corpus: str, mode: str, block_size: int, wrap: bool, tokenizer: str, source: str
) -> str:
    """Cache folder name; ``tokenizer`` and ``source`` identify contents, see ``content_of``."""
    mark = hashlib.sha256(json.dumps([tokenizer, source]).encode()).hexdigest()[:16]
    kind = "wrapped" if wrap else "unwrapped"
    return f"{corpus}_{mode}_bs{block_size}_{kind}_{mark}.dat"


def content_of(spark: SparkSession, path: str) -> str:
    """A mark of the files below a path: names, lengths and modification times."""
    listed = json.dumps(sorted(files.listing(spark, path)))
    return hashlib.sha256(listed.encode()).hexdigest()


DONE = "done"


def cached(
    spark: SparkSession, folder: str, name: str, build: Callable[[], DataFrame]
) -> DataFrame:
    """Read a table if it was written completely before, else build and write it.

    Completion is a one-row table of its own, written last.
    """
    path = f"{folder.rstrip('/')}/{name}"
    if not files.exists(spark, f"{path}/{DONE}"):
        build().write.mode("overwrite").parquet(f"{path}/data")
        spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{path}/{DONE}")
    return spark.read.parquet(f"{path}/data")


def sink_samples(df: DataFrame, key: str, text: str, step: int, n: int = 2) -> DataFrame:
    """The first ``n`` generated texts of a step as a one-column table with its key."""
    return df.orderBy(key).limit(n).select(
        F.lit(step).cast("long").alias("global_step"), F.col(text).alias("Generated Samples")
    )


def preview_batch(df: DataFrame, key: str, ids: str, k: int = 64) -> DataFrame:
    """First and last ``k`` ids of the first row."""
    head = df.orderBy(key).limit(1)
    n = F.size(ids)
    start = F.greatest(n - k + 1, F.lit(1))
    return head.select(
        key,
        n.alias("length"),
        F.slice(ids, 1, k).alias("first_ids"),
        F.slice(ids, start, F.lit(k)).alias("last_ids"),
    )
