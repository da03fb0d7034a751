"""Character tokenizer, vocabularies and special tokens."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from maskloom.functions import batches
from maskloom.functions.text import norm_bpe

# The character vocabulary, specials first, then a-z and the blank.
CHAR_SPECIALS = ["[CLS]", "[SEP]", "[BOS]", "[EOS]", "[MASK]", "[PAD]", "[RESERVED]", "[UNK]"]
CHAR_LETTERS = "abcdefghijklmnopqrstuvwxyz "
CHAR_VOCAB = [*CHAR_SPECIALS, *CHAR_LETTERS]
CHAR_BOS, CHAR_EOS, CHAR_MASK, CHAR_PAD, CHAR_UNK = 2, 3, 4, 5, 7

# The special tokens of the trained vocabulary, ids 0 to 6.
BPE_SPECIALS = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]", "[BOS]", "[EOS]"]


def characters(text: Column) -> Column:
    """Code points of a string; an empty string has none."""
    return F.when(F.length(text) > 0, F.split(text, "")).otherwise(
        F.array().cast("array<string>")
    )


def char_encode(text: Column) -> Column:
    """Lower-cased characters to ids; anything but a-z and the blank is [UNK]."""
    table = np.full(256, CHAR_UNK, np.int32)
    table[[ord(c) for c in CHAR_LETTERS]] = len(CHAR_SPECIALS) + np.arange(len(CHAR_LETTERS))

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        return batches.in_slices(texts, lambda some: batches.lists(*batches.code_points(some, table)))

    return encode(F.lower(text))


def char_encode_inline(text: Column) -> Column:
    """``char_encode`` as an expression. Spark forgets how rows are laid out behind an Arrow
    function, so packing, which encodes behind its exchange, would move all ids once more."""
    first = len(CHAR_SPECIALS)
    known = {ord(c): first + i for i, c in enumerate(CHAR_LETTERS)}
    by_code = F.lit([known.get(code, CHAR_UNK) for code in range(max(known) + 1)])
    return F.transform(
        characters(F.lower(text)),
        lambda c: F.coalesce(F.get(by_code, F.ascii(c)), F.lit(CHAR_UNK)),
    )


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _code_points(texts: pa.Array) -> pa.Array:
    return batches.lists(*batches.code_points(texts))


def code_points(text: Column) -> Column:
    """Characters as numbers; an empty string has none."""
    return _code_points(text)


def decode_ids(ids: Column, vocab: list[str], joiner: str = "") -> Column:
    """Ids to text through a vocabulary small enough for a literal."""

    @F.arrow_udf("string")
    def decode(rows: pa.Array) -> pa.Array:
        values, lengths, null = batches.flat(rows)
        known = pc.and_(pc.greater_equal(values, 0), pc.less(values, len(vocab)))
        known = pc.fill_null(known, False).to_numpy(zero_copy_only=False)
        if not known.all():
            # what is not in the vocabulary has no text
            lengths = np.diff(batches.ends(known)[batches.ends(lengths)])
            values = values.filter(pa.array(known))
        pieces = pa.array(vocab, pa.string()).take(values)
        return pc.binary_join(batches.lists(pieces, lengths, null), joiner)

    return decode(ids)


def decode_table(df: DataFrame, vocab: DataFrame, ids: str = "ids", joiner: str = "") -> DataFrame:
    """Add ``decoded``, the text of the ids, through a ``vocab(id, token)`` table.

    Ids are dense from 0, so the vocabulary becomes one array indexed by id. Its size
    is the tokenizer's vocabulary size, never that of the corpus.
    """
    entries = F.sort_array(F.collect_list(F.struct("id", "token")))
    tokens = vocab.agg(F.transform(entries, lambda e: e["token"])).scalar()
    pieces = F.transform(F.col(ids), lambda i: F.get(F.col("_tokens"), i))
    return (
        df.withColumn("_tokens", tokens)
        .withColumn("decoded", F.array_join(pieces, joiner))
        .drop("_tokens")
    )


#: distinct words and texts of a task that are held before they are passed on
HELD_WORDS, HELD_TEXTS = 200_000, 256


def _counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of a task with how often each occurs; a word may come more than once."""

    def rows(found: Counter) -> pa.RecordBatch:
        columns = [pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())]
        return pa.record_batch(columns, names=["word", "n"])

    found: Counter = Counter()
    for part in parts:
        for low in range(0, part.num_rows, HELD_TEXTS):
            for text in part.column(0).slice(low, HELD_TEXTS).to_pylist():
                found.update(text.split() if text else ())
            if len(found) >= HELD_WORDS:
                yield rows(found)
                found.clear()
    yield rows(found)


def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Normalized white-space words with their frequencies.

    Normalizing neither makes nor removes white space, so words are counted as they stand
    and only distinct ones are normalized.
    """
    raw = (
        df.select(F.col(text).cast("string").alias("text"))
        .mapInArrow(_counted, "word string, n long")
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
    )
    plain = raw.select(norm_bpe(F.col("word")).alias("word"), "n")
    return plain.where(F.col("word") != "").groupBy("word").agg(F.sum("n").alias("n"))


def char_alphabet(words: DataFrame, specials: list[str] = BPE_SPECIALS) -> DataFrame:
    """Initial vocabulary ``(token, id)``: specials, then characters by code point.

    The distinct characters are bounded by Unicode, so one window over them is small.
    """
    found = words.select(F.explode(characters(F.col("word"))).alias("token")).distinct()
    by_code = Window.partitionBy(F.lit(0)).orderBy(F.ascii("token"))
    letters = found.select(
        "token", (F.row_number().over(by_code) + (len(specials) - 1)).alias("id")
    )
    head = words.sparkSession.createDataFrame(
        [(token, i) for i, token in enumerate(specials)], "token string, id int"
    )
    return head.unionByName(letters)


def pair_counts(words: DataFrame, min_frequency: int = 2) -> DataFrame:
    """Neighbouring characters with word-weighted counts."""
    pair = F.transform(
        F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.col("word").substr(i, F.lit(2))
    )
    return (
        words.where(F.length("word") > 1)
        .select(F.explode(pair).alias("pair"), "n")
        .groupBy("pair")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") >= min_frequency)
        .select(F.col("pair").substr(1, 1).alias("left"), F.col("pair").substr(2, 1).alias("right"), "n")
    )


def append_eos(ids: Column, eos: int) -> Column:
    return F.concat(ids, F.array(F.lit(eos)))


def append_eos_batch(ids: Column, eos: int, kind: T.DataType = T.ArrayType(T.IntegerType())) -> Column:
    """``append_eos`` over whole Arrow batches. Behind another Arrow function both run in one
    step, and the ids between them never become Spark's rows."""

    def ended(rows: pa.Array) -> pa.Array:
        values, lengths, null = batches.flat(rows)
        at = batches.ends(lengths)[1:][~null]
        no_id = np.insert(values.is_null().to_numpy(zero_copy_only=False), at, False) if values.null_count else None
        own = pc.fill_null(values, 0).to_numpy(zero_copy_only=False)
        return batches.lists(pa.array(np.insert(own, at, eos), values.type, mask=no_id), lengths + ~null, null)

    @F.arrow_udf(kind)
    def append(rows: pa.Array) -> pa.Array:
        return batches.in_slices(rows, ended)

    return append(ids)


def add_specials(ids: Column, first: int, last: int) -> Column:
    return F.concat(F.array(F.lit(first)), ids, F.array(F.lit(last)))


def encode_padded(ids: Column, size: int, first: int, last: int, pad: int) -> Column:
    """Struct of ids cut and padded to ``size``, attention mask and token types."""
    framed = add_specials(F.slice(ids, 1, size - 2), first, last)
    used = F.least(F.size(ids) + 2, F.lit(size))
    ones, zeros = F.array_repeat(F.lit(1), used), F.array_repeat(F.lit(0), F.lit(size) - used)
    return F.struct(
        F.concat(framed, F.array_repeat(F.lit(pad), F.lit(size) - used)).alias("input_ids"),
        F.concat(ones, zeros).alias("attention_mask"),
        F.array_repeat(F.lit(0), size).alias("token_type_ids"),
    )


def special_token_resolve(vocab: DataFrame, eos_rule: str = "token") -> DataFrame:
    """One row of special ids: bos falls back to cls, eos to sep, pad to [PAD].

    ``eos_rule="first_encoded"`` takes the first id of the encoded special token,
    which a [CLS] ... [SEP] template turns into the cls id.
    """
    if eos_rule not in ("token", "first_encoded"):
        raise ValueError(f"unknown eos rule {eos_rule!r}")

    def named(token: str) -> Column:
        return F.max(F.when(F.col("token") == token, F.col("id")))

    cls, sep = named("[CLS]"), named("[SEP]")
    bos, eos = F.coalesce(named("<s>"), cls), F.coalesce(named("</s>"), sep)
    if eos_rule == "first_encoded":
        bos, eos = F.coalesce(cls, bos), F.coalesce(cls, eos)
    return vocab.agg(
        bos.alias("bos_id"),
        eos.alias("eos_id"),
        # a vocabulary without [PAD] gets it as a new last entry
        F.coalesce(named("[PAD]"), (F.max("id") + 1).cast("int")).alias("pad_id"),
        named("[MASK]").alias("mask_id"),
        F.count(F.lit(1)).alias("vocab_size"),
    )


def vocab_resize(vocab: DataFrame, mask_token: str = "[MASK]") -> DataFrame:
    """Add a mask entry behind the last id when the vocabulary has none."""
    extra = (
        vocab.agg(
            F.count(F.lit(1)).cast("int").alias("id"),
            F.coalesce(F.bool_or(F.col("token") == mask_token), F.lit(False)).alias("has"),
        )
        .where(~F.col("has"))
        .select(F.lit(mask_token).alias("token"), "id")
    )
    return vocab.select("token", "id").unionByName(extra)


def tokenizer_report(df: DataFrame, vocab: DataFrame, source: str, encoded: str, decoded: str) -> DataFrame:
    """Vocabulary size, special ids and the number of texts that do not round-trip."""
    trips = df.agg(
        F.count(F.lit(1)).alias("texts"),
        F.sum(F.size(encoded)).alias("tokens"),
        F.count_if(F.col(source) != F.col(decoded)).alias("mismatches"),
    )
    # one row as a scalar subquery next to the other one
    counted = trips.select(F.struct("*").alias("trips")).scalar()
    return special_token_resolve(vocab).withColumn("_trips", counted).select("*", "_trips.*").drop("_trips")


def retokenize(
    df: DataFrame, ids: str, batch: str, max_length: int, pad: int, encode: Callable[[Column], Column] = lambda ids: ids
) -> DataFrame:
    """Cut ids of a second tokenizer, pad to the longest of the batch, add the mask.

    ``encode`` makes the ids of what stands in the column, a text say or ids of the first
    tokenizer; the exchange carries that, and the ids are made once more behind it."""
    made = encode(F.col(ids))
    # only sizes meet per batch, never the ids
    widths = df.groupBy(F.struct(batch).alias("_batch")).agg(F.least(F.max(F.size(made)), F.lit(max_length)).alias("_width"))
    sized = df.withColumn("_batch", F.struct(batch)).join(widths, "_batch").withColumn(ids, F.slice(made, 1, max_length))
    gap = F.col("_width") - F.size(ids)
    return sized.select(
        *[c for c in df.columns if c != ids],
        F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), gap)).alias(
            "attention_mask"
        ),
        F.concat(F.col(ids), F.array_repeat(F.lit(pad), gap)).alias(ids),
    )
