"""From a corpus name to a cached table of blocks or padded rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from maskloom.functions import text as tx
from maskloom.operators import bpe, sequence as sq, splits as sp, tokens as tk
from maskloom.operators.order import dealt
from maskloom.sources.corpora import (
    CORPORA,
    Corpus,
    cache_name,
    cached,
    content_of,
    in_file_order,
    read_jsonl,
    read_text_lines,
)
from maskloom.sources.strings import read_string, with_places

# Rows of the ordered hold-out, and character ranges of the long string.
HOLDOUT_ROWS = 100_000
TEXT8_TRAIN_END, TEXT8_VALID_END = 90_000_000, 95_000_000

DETOKENIZERS: dict[str, Callable[[Column], Column]] = {
    "wikitext": tx.detok_wikitext,
    "ptb": tx.detok_ptb,
    "lm1b": tx.detok_lm1b,
    "lambada": tx.detok_lambada,
    "scientific_papers": tx.detok_scientific,
}


@dataclass(frozen=True)
class Tokenizer:
    """``add_ids`` adds an ``ids`` column from a text column; ``mark`` identifies the contents
    of the vocabulary, so that a new one under an old name is told apart."""

    name: str
    add_ids: Callable[[DataFrame, str], DataFrame]
    bos: int
    eos: int
    cls: int
    sep: int
    pad: int
    mark: str = ""


def char_tokenizer() -> Tokenizer:
    vocab = tk.CHAR_VOCAB
    return Tokenizer(
        "characters",
        lambda df, text: df.withColumn("ids", tk.char_encode(F.col(text))),
        *[vocab.index(token) for token in ("[BOS]", "[EOS]", "[CLS]", "[SEP]", "[PAD]")],
        mark="".join(vocab),
    )


def bpe_tokenizer(model: bpe.BpeModel, name: str, first_encoded: bool = False) -> Tokenizer:
    """Document borders as the trained vocabulary has them: cls opens, sep closes.

    With ``first_encoded`` both are the first id of the encoded border token, which a
    [CLS] ... [SEP] template turns into cls.
    """
    place = {token: i for i, token in enumerate(model.tokens)}
    close = "[CLS]" if first_encoded else "[SEP]"
    return Tokenizer(
        name,
        lambda df, text: bpe.bpe_encode(df, model, text),
        *[place[token] for token in ("[CLS]", close, "[CLS]", "[SEP]", "[PAD]")],
        mark=model.mark(),
    )


def find_corpus(name: str) -> Corpus:
    """Catalog entry; a name that is not listed is its own path."""
    return next((c for c in CORPORA if c.name == name), Corpus(name, name))


def with_doc_id(df: DataFrame, key: str | None = None) -> DataFrame:
    """Number the rows of Parquet files densely by file name and position in the file.

    ``key`` names a column that numbers them already; null or repeated keys are an error.
    """
    if key is not None:
        bad = df.agg(F.count(F.lit(1)) != F.count_distinct(key)).first()[0]
        if bad:
            raise ValueError(f"{key} has nulls or repeats")
        return df.withColumn("doc_id", F.col(key).cast("long"))
    placed = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    # one row per file
    counts = placed.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    files = counts.select("_file", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    others = [F.col(c) for c in df.columns if c != "doc_id"]
    return placed.join(files, "_file").select((F.col("_before") + F.col("_row")).alias("doc_id"), *others)


def load(spark: SparkSession, corpus: str, mode: str, root: str, block_size: int) -> DataFrame:
    """Rows of one split: ``doc_id`` and the raw columns."""
    entry = find_corpus(corpus)
    if corpus == "babylm":
        lines = read_text_lines(spark, root).select(F.col("line_no").alias("doc_id"), "text")
        return sp.split_random_exact(lines, "doc_id").where(F.col("split") == mode)
    if corpus == "lambada":
        rows = read_jsonl(spark, f"{root}/{entry.path}")
        return in_file_order(rows, F.col("text")).select(F.col("line_no").alias("doc_id"), "text")
    if corpus in ("text8", "text8-crop"):
        whole = with_places(read_string(spark, f"{root}/{entry.path}"))
        # the cropped training split is cut at twice the already doubled block
        train = 2 * block_size if corpus == "text8-crop" else None
        chunks = sq.char_chunks(
            whole, "piece", "text", block_size, TEXT8_TRAIN_END, TEXT8_VALID_END, train_size=train, before="before"
        )
        return chunks.where(F.col("split") == mode).withColumnRenamed("chunk_id", "doc_id")
    path = "/".join(part for part in (root, entry.path, entry.config) if part)
    if corpus in ("openwebtext-train", "openwebtext-valid"):
        rows = sp.split_tail(with_doc_id(spark.read.parquet(path)), "doc_id", HOLDOUT_ROWS)
        wanted = "validation" if corpus.endswith("valid") else "train"
        return rows.where(F.col("split") == wanted)
    return with_doc_id(spark.read.parquet(f"{path}/{mode}"))


def tokenized(rows: DataFrame, corpus: str, tokenizer: Tokenizer) -> DataFrame:
    """``(doc_id, ids)`` of detokenized text, raw columns left out."""
    entry = find_corpus(corpus)
    text = F.col(entry.text_column)
    if entry.detokenizer:
        text = DETOKENIZERS[entry.detokenizer](text)
    plain = dealt(rows.select("doc_id", text.alias("text")), "doc_id")
    return tokenizer.add_ids(plain, "text").select("doc_id", "ids")


def prepare(
    spark: SparkSession,
    corpus: str,
    mode: str,
    root: str,
    tokenizer: Tokenizer,
    block_size: int,
    cache_dir: str,
    wrap: bool | None = None,
    group_size: int | None = 1000,
) -> DataFrame:
    """The table that training or evaluation reads, built once and then read from the cache.

    ``wrap`` packs documents into blocks, per ``group_size`` rows or over the whole
    corpus (None); otherwise every document is cut and padded to one row. The catalog says
    which, unless it is given. Mode "valid" prepares the held-out split of the corpus that
    this one is validated on. The cache follows the contents of vocabulary and files.
    """
    if mode == "valid":
        corpus = find_corpus(corpus).validated_on or corpus
        mode = find_corpus(corpus).holdout
    if wrap is None:
        wrap = find_corpus(corpus).wrap
    if corpus == "text8" and not wrap:
        raise ValueError("text8 is only prepared as packed blocks")
    size = 2 * block_size if corpus == "text8-crop" and mode == "train" else block_size
    folder = cache_dir.rstrip("/")
    entry = find_corpus(corpus)
    parts = (root, "" if corpus == "babylm" else entry.path, entry.config or "")
    source = content_of(spark, "/".join(p for p in parts if p))

    def tokens() -> DataFrame:
        rows = load(spark, corpus, mode, root, size)
        return tokenized(rows, corpus, tokenizer)

    def named(stage: str) -> str:
        identity = f"{tokenizer.mark}|{tokenizer.bos}|{tokenizer.eos}|{tokenizer.cls}|{tokenizer.sep}|{group_size}|{stage}"
        return cache_name(corpus, mode, size, wrap, identity, source)

    def build() -> DataFrame:
        # packing looks at the lengths first, so the ids are written down once
        rows = cached(spark, folder, named("tokens"), tokens)
        if not wrap:
            cells = tk.encode_padded(F.col("ids"), size, tokenizer.cls, tokenizer.sep, tokenizer.pad)
            return rows.select("doc_id", cells.alias("e")).select("doc_id", "e.*")
        closed = rows.select("doc_id", tk.append_eos(F.col("ids"), tokenizer.eos).alias("ids"))
        border = (size, tokenizer.bos, tokenizer.eos)
        if group_size is None:
            return sq.pack_blocks_global(closed, "doc_id", "ids", *border)
        return sq.pack_blocks(closed, "doc_id", "ids", *border, group_size=group_size)

    return cached(spark, folder, named("blocks"), build)
