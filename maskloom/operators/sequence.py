"""Cutting and packing of token rows and character streams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from maskloom.functions import batches
from maskloom.operators.order import Ranges, ranges, ranked


def _pieces(ids: Column, start: Column, body: int) -> Column:
    """Cut one row at the multiples of ``body`` of the stream it starts in at ``start``.

    Works on slices, so the row costs its own length and no token is exploded.
    """
    first = F.floor(start / F.lit(body)).cast("long")
    last = F.floor((start + F.size(ids) - 1) / F.lit(body)).cast("long")

    def piece(block: Column) -> Column:
        low = F.greatest(block * body - start, F.lit(0)).cast("int")
        high = F.least((block + 1) * body - start, F.size(ids).cast("long")).cast("int")
        return F.struct(
            block.alias("block"),
            (start + low).alias("at"),
            F.slice(ids, low + 1, high - low).alias("ids"),
        )

    return F.when(F.size(ids) > 0, F.transform(F.sequence(first, last), piece))


def glue(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Join the pieces of a block; a block has at most ``body`` of them."""
    return pieces.groupBy(*keys).agg(
        F.flatten(
            F.transform(
                F.sort_array(F.collect_list(F.struct("at", "ids"))), lambda p: p["ids"]
            )
        ).alias("ids"),
        F.min("at").alias("at"),
    )


def frame_block(df: DataFrame, keys: list[str], bos: int, eos: int, size: int) -> DataFrame:
    return df.select(
        *keys,
        F.concat(F.array(F.lit(bos)), F.col("ids"), F.array(F.lit(eos))).alias("input_ids"),
        F.array_repeat(F.lit(1).cast("byte"), size).alias("attention_mask"),
    )


def _group_starts(placed: DataFrame, df: DataFrame, key: str, length: Column, buckets: Ranges, size: int) -> DataFrame:
    """Add the group of a row and the stream position ``_base`` where its group starts.

    A group starts in the bucket of its first row. Rows behind it in that bucket see
    the start in a running maximum; for the group that is open when a bucket begins,
    the start comes from a pass over keys and lengths only.
    """
    narrow = ranked(
        df.select(key, length.alias("_w")), key, weight=F.col("_w"), buckets=buckets, keep_buckets=True
    )
    group = F.floor(F.col("rank") / F.lit(size)).cast("long")
    starts = narrow.where(F.col("rank") % size == 0).select(
        group.alias("_group"), F.col("before").alias("_open")
    )
    opened = (
        narrow.groupBy("_bucket")
        .agg(F.floor(F.min("rank") / F.lit(size)).cast("long").alias("_group"))
        .join(starts, "_group")
        .select("_bucket", "_open")
    )
    so_far = Window.partitionBy("_bucket").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    begun = F.max(F.when(F.col("rank") % size == 0, F.col("before"))).over(so_far)
    return (
        placed.withColumn("_begun", begun)
        .join(opened, "_bucket")
        .withColumn("_base", F.coalesce("_begun", "_open"))
        .withColumn("group_id", group)
    )


def _placed(
    df: DataFrame, key: str, ids: Column, length: Column, offset: int, group_size: int | None
) -> DataFrame:
    """Rows with their place in the stream. ``ids`` is computed behind the shuffle, so
    that the shuffle carries the columns it is made of (text rather than arrays)."""
    buckets = ranges(df, key)
    placed = ranked(df, key, weight=length, buckets=buckets, keep_buckets=True)
    if group_size is None:
        placed = placed.withColumn("_base", F.lit(0)).withColumn("group_id", F.lit(0))
    else:
        placed = _group_starts(placed, df, key, length, buckets, group_size)
    return (
        placed.withColumn("_start", F.col("before") + F.lit(offset) - F.col("_base"))
        .withColumn("_first", F.col("bucket_start") + F.lit(offset))
        .withColumn("_end", F.col("_first") + F.col("bucket_weight"))
        .withColumn("_ids", ids)
    )


def _cut(placed: DataFrame, body: int) -> DataFrame:
    cells = placed.select(
        "_bucket",
        "group_id",
        "_base",
        "_first",
        "_end",
        F.explode(_pieces(F.col("_ids"), F.col("_start"), body)).alias("p"),
    )
    low = F.col("_base") + F.col("p.block") * body
    # a block that reaches over the border of its bucket may continue in a neighbour
    return cells.select(
        "_bucket",
        "group_id",
        "p.*",
        ((low >= F.col("_first")) & (low + body <= F.col("_end"))).alias("inside"),
    )


def _reaches_over(body: int, length: Column) -> Column:
    """Rows with a piece of a block that is not wholly inside their bucket."""
    first = F.floor(F.col("_start") / F.lit(body)) * body
    last = F.floor((F.col("_start") + length - 1) / F.lit(body)) * body
    return (F.col("_base") + first < F.col("_first")) | (
        F.col("_base") + last + body > F.col("_end")
    )


def pack_stream(
    df: DataFrame,
    key: str,
    ids: Column,
    length: Column,
    body: int,
    offset: int = 0,
    opening: DataFrame | None = None,
    group_size: int | None = None,
) -> DataFrame:
    """Blocks ``(group_id, block, ids)`` of rows joined in key order, some maybe short.

    Rows are shuffled once, by range bucket, and blocks inside a bucket are complete
    there. Only the pieces of blocks that reach over a bucket border move again, and
    only the rows that hold them are cut a second time. ``opening`` holds pieces that
    come before the rows; ``group_size`` starts anew after so many rows.
    """
    placed = _placed(df, key, ids, length, offset, group_size)
    inner = glue(_cut(placed, body).where("inside"), ["_bucket", "group_id", "block"])
    edges = _cut(placed.where(_reaches_over(body, length)), body).where("NOT inside")
    edges = edges.select("group_id", "block", "at", "ids")
    if opening is not None:
        edges = edges.unionByName(opening.withColumn("group_id", F.lit(0)))
    columns = ["group_id", "block", "ids"]
    return inner.select(*columns).unionByName(glue(edges, ["group_id", "block"]).select(*columns))


def pack_streams(
    df: DataFrame, by: str, key: str, ids: Column, length: Column, body: int, state: DataFrame | None = None
) -> DataFrame:
    """Blocks ``(by, block, ids)`` of the rows of each ``by`` joined in key order, some maybe short.

    A group of any size is spread over the range buckets, as in ``pack_stream``. ``state`` has
    a row ``(by, block, ids)`` for each group that goes on: the block that is open and its ids,
    which come back as they are where no rows follow.
    """
    at = F.col("block") * body
    starts = None if state is None else state.select(by, at + F.size("ids"))
    placed = (
        ranked(df, key, by=[by], weight=length, buckets=ranges(df, key), keep_buckets=True, starts=starts)
        .withColumn("_base", F.lit(0))
        .withColumn("group_id", F.col("_by"))
        .withColumn("_start", F.col("before"))
        .withColumn("_first", F.col("bucket_start"))
        .withColumn("_end", F.col("bucket_start") + F.col("bucket_weight"))
        .withColumn("_ids", ids)
    )
    inner = glue(_cut(placed, body).where("inside"), ["_bucket", "group_id", "block"])
    edges = _cut(placed.where(_reaches_over(body, length)), body).where("NOT inside")
    edges = edges.select("group_id", "block", "at", "ids")
    if state is not None:
        opening = state.where(F.size("ids") > 0)
        edges = edges.unionByName(opening.select(F.struct(by).alias("group_id"), "block", at.alias("at"), "ids"))
    columns = [F.col("group_id")[by].alias(by), "block", "ids"]
    return inner.select(*columns).unionByName(glue(edges, ["group_id", "block"]).select(*columns))


def pack_blocks_global(
    df: DataFrame,
    key: str,
    ids: Column | str,
    block_size: int,
    bos: int,
    eos: int,
    length: Column | None = None,
) -> DataFrame:
    """Concatenate rows in key order and cut blocks; only the last remainder is dropped.

    ``length`` is a cheaper expression for the number of ids.
    """
    tokens = F.col(ids) if isinstance(ids, str) else ids
    blocks = pack_stream(
        df, key, tokens, F.size(tokens) if length is None else length, block_size - 2
    ).where(F.size("ids") == block_size - 2)
    return frame_block(
        blocks.withColumnRenamed("block", "block_id"), ["block_id"], bos, eos, block_size
    )


def pack_blocks(
    df: DataFrame,
    key: str,
    ids: Column | str,
    block_size: int,
    bos: int,
    eos: int,
    group_size: int = 1000,
    length: Column | None = None,
) -> DataFrame:
    """Pack groups of ``group_size`` consecutive rows; every group drops its remainder."""
    tokens = F.col(ids) if isinstance(ids, str) else ids
    blocks = pack_stream(
        df,
        key,
        tokens,
        F.size(tokens) if length is None else length,
        block_size - 2,
        group_size=group_size,
    ).where(F.size("ids") == block_size - 2)
    return frame_block(
        blocks.withColumnRenamed("block", "block_id"), ["group_id", "block_id"], bos, eos, block_size
    )


def char_chunks(
    df: DataFrame,
    key: str,
    text: str,
    size: int,
    train_end: int,
    valid_end: int,
    train_size: int | None = None,
    drop_last: bool = True,
    before: str | None = None,
) -> DataFrame:
    """Treat rows in key order as one string, cut it in three ranges, then in chunks.

    ``train_size`` is the chunk length of the first range if it differs. ``before`` names a
    column with the number of characters in front of a row, if that is known; the rows are
    then cut where they are.
    """
    ranges = [
        ("train", 0, train_end, train_size or size),
        ("validation", train_end, valid_end, size),
        ("test", valid_end, 1 << 62, size),
    ]
    kept = df.where(F.length(text) > 0)
    if before is None:
        placed = ranked(kept.select(F.col(key), F.col(text)), key, weight=F.length(text))
    else:
        placed = kept.select(F.col(key), F.col(text), F.col(before).alias("before"))
    length = F.length(text).cast("long")

    def overlap(name: str, low: int, high: int, width: int) -> Column:
        start = F.greatest(F.col("before"), F.lit(low))
        end = F.least(F.col("before") + length, F.lit(high))
        return F.when(
            start < end,
            F.struct(
                F.lit(name).alias("split"),
                F.lit(width).cast("long").alias("width"),
                (start - low).alias("start"),
                F.col(text)
                .substr((start - F.col("before") + 1).cast("int"), (end - start).cast("int"))
                .alias("part"),
            ),
        )

    parts = placed.select(
        F.explode(F.filter(F.array(*[overlap(*r) for r in ranges]), lambda p: p.isNotNull())).alias("p")
    ).select("p.*")
    head = F.pmod(-F.col("start"), F.col("width")).cast("int")
    cut = F.lit(None).cast("array<string>")
    for width in sorted({r[3] for r in ranges}):
        # one pass over the string, where a substring per chunk would rescan its prefix
        rest = F.regexp_extract_all(
            F.col("part").substr(head + 1, F.length("part")), F.lit(f"(?s).{{1,{width}}}"), F.lit(0)
        )
        cut = F.when(F.col("width") == width, rest).otherwise(cut)
    cells = F.concat(
        F.when(head > 0, F.array(F.col("part").substr(F.lit(1), head))).otherwise(
            F.array().cast("array<string>")
        ),
        cut,
    )
    pieces = parts.select(
        "split",
        "width",
        F.col("start"),
        F.floor(F.col("start") / F.col("width")).cast("long").alias("first"),
        F.posexplode(cells).alias("i", "piece"),
    )
    chunks = pieces.groupBy("split", "width", (F.col("first") + F.col("i")).alias("chunk_id")).agg(
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.struct("start", "piece"))), lambda p: p["piece"]
            ),
            "",
        ).alias("text")
    )
    if drop_last:
        chunks = chunks.where(F.length("text") == F.col("width"))
    return chunks.select("split", "chunk_id", "text")


def crop_window(
    df: DataFrame, ids: str, start: Column, length: int, bos: int, eos: int
) -> DataFrame:
    """Input and output windows of a double-length block, one step apart."""
    begin = start.cast("int")
    return df.withColumn("_start", begin).select(
        *df.columns,
        F.concat(F.array(F.lit(bos)), F.slice(ids, F.col("_start") + 2, length - 1)).alias("input_ids"),
        F.concat(F.slice(ids, F.col("_start") + 2, length - 1), F.array(F.lit(eos))).alias("output_ids"),
    )


def shift_ar(ids: Column, mask: Column) -> Column:
    """Struct of inputs, targets one step later and the mask of the targets."""
    n = F.size(ids) - 1
    return F.struct(
        F.slice(ids, F.lit(1), n).alias("input_ids"),
        F.slice(ids, F.lit(2), n).alias("target_ids"),
        F.slice(mask, F.lit(2), n).alias("target_mask"),
    )


def context_split(df: DataFrame, ids: str, width: int) -> DataFrame:
    """Cut every row in context windows; the last one may be shorter."""
    cells = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(ids) - 1) / F.lit(width)).cast("int")),
        lambda i: F.slice(F.col(ids), i * width + 1, F.lit(width)),
    )
    # an empty row has no window; a filter here would be pushed below and compute the ids twice
    cells = F.when(F.size(ids) > 0, cells)
    others = [c for c in df.columns if c != ids]
    return df.select(
        *others, F.posexplode(cells).alias("window_id", ids)
    )


def length_to_eos(ids: Column, eos: int) -> Column:
    """Tokens before the first EOS, position 0 not looked at."""
    found = F.array_position(F.slice(ids, F.lit(2), F.greatest(F.size(ids) - 1, F.lit(0))), eos)
    return F.when(found > 0, found - 1).otherwise(F.size(ids) - 1).cast("long")


def stride_prefixes(df: DataFrame, sample: str, stride: str, ids: str) -> DataFrame:
    """For each sample the first i strides joined, i from 2 on."""
    upto = (
        Window.partitionBy(sample).orderBy(stride).rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        df.select(
            sample,
            F.row_number().over(Window.partitionBy(sample).orderBy(stride)).alias("strides"),
            F.flatten(F.collect_list(ids).over(upto)).alias(ids),
        )
        .where(F.col("strides") >= 2)
    )


def first_eos_mask(ids: Column, eos: int, until_first_eos: bool = False) -> Column:
    """1 where a token counts: every non-EOS token and the first EOS.

    ``until_first_eos`` also drops what follows the first EOS.
    """

    @F.arrow_udf("array<int>")
    def mask(rows: pa.Array) -> pa.Array:
        values, lengths, null = batches.flat(rows)
        end = pc.fill_null(pc.equal(values, eos), False).to_numpy(zero_copy_only=False)
        first = np.repeat(batches.firsts(end, lengths), lengths)
        at = batches.places(lengths)
        if until_first_eos:
            counts = (first < 0) | (at <= first)
        else:
            counts = values.is_valid().to_numpy(zero_copy_only=False) & (~end | (at == first))
        return batches.lists(counts.astype(np.int32), lengths, null)

    return mask(ids)
