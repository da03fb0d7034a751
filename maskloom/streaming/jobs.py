"""Structured Streaming versions of ingest, packing, metrics and moving average.

Operators that carry state between micro-batches run the batch operator inside
``foreachBatch``, so a hot key inside a micro-batch is spread like in a batch job.
State is written per epoch, which makes a repeated epoch overwrite itself; an epoch whose
state is not whole stops the stream.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from maskloom.functions.text import detok_for
from maskloom.operators.ema import ema_warmup
from maskloom.operators.sequence import frame_block, pack_stream, pack_streams
from maskloom.operators.tokens import append_eos_batch, char_encode
from maskloom.sources import files


def stream_tokenize(
    stream: DataFrame, key: str, text: str, eos: int, corpus: str | None = None,
    encode: Callable[[Column], Column] = char_encode, keep: list[str] | None = None,
) -> DataFrame:
    """Stateless: detokenize, encode, append EOS; ``keep`` names columns that stay."""
    body = F.col(text) if corpus is None else detok_for(F.col(corpus), F.col(text))
    ids = encode(body)
    kind = stream.select(ids.alias("ids")).schema["ids"].dataType
    return stream.select(key, *(keep or []), append_eos_batch(ids, eos, kind).alias("ids"))


TO_THE_END = {"availableNow": True}


def _write_state(state: DataFrame, path: str, epoch: int) -> None:
    """State of an epoch; the marker that says it is whole is written last."""
    state.write.mode("overwrite").parquet(f"{path}/epoch={epoch}/data")
    state.sparkSession.range(1).coalesce(1).write.mode("overwrite").parquet(f"{path}/epoch={epoch}/done")


def _read_state(spark: SparkSession, path: str, epoch: int) -> DataFrame:
    if not files.exists(spark, f"{path}/epoch={epoch}/done"):
        raise RuntimeError(f"the state of epoch {epoch} is gone from {path}; the stream cannot go on")
    return spark.read.parquet(f"{path}/epoch={epoch}/data")


def stream_pack(
    stream: DataFrame,
    key: str,
    ids: Column | str,
    block_size: int,
    out: str,
    checkpoint: str,
    length: Column | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Pack a stream; the unfinished block of a micro-batch opens the next one.

    Rows are ordered by key inside a micro-batch and by arrival between them. For
    input in key order the blocks equal those of ``pack_blocks_global``. Read them
    with ``packed_blocks``. State that is missing is an error; the last two epochs of
    it are kept.
    """
    tokens = F.col(ids) if isinstance(ids, str) else ids
    size = F.size(tokens) if length is None else length
    body = block_size - 2

    def one_batch(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        # lengths, places and rows are separate passes
        batch = batch.persist()
        carried = _read_state(spark, f"{out}/state", epoch - 1).first() if epoch else None
        offset = carried["offset"] if carried else 0
        # fewer than block_size ids
        rest = carried["ids"] if carried else []
        opening = None
        if rest:
            opening = spark.createDataFrame(
                [(offset // body, offset - len(rest), rest)],
                "block bigint, at bigint, ids array<int>",
            )
        path = f"{out}/blocks/epoch={epoch}"
        pack_stream(batch, key, tokens, size, body, offset, opening).select(
            "block", (F.size("ids") == body).alias("whole"), "ids"
        ).write.mode("overwrite").parquet(path)
        written = spark.read.parquet(path)
        left = written.where("NOT whole").select("block", "ids").first()
        if left:
            seen, rest = left["block"] * body + len(left["ids"]), left["ids"]
        else:
            top = written.agg(F.max("block")).first()[0]
            seen, rest = (offset if top is None else (top + 1) * body), []
        left_over = spark.createDataFrame([(seen, rest)], "offset bigint, ids array<int>").coalesce(1)
        _write_state(left_over, f"{out}/state", epoch)
        files.delete(spark, f"{out}/state/epoch={epoch - 2}")
        batch.unpersist()

    return (
        stream.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or TO_THE_END))
        .start()
    )


def stream_pack_groups(
    stream: DataFrame,
    by: str,
    key: str,
    ids: Column | str,
    block_size: int,
    out: str,
    checkpoint: str,
    length: Column | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Pack a stream for each value of ``by``; its unfinished block opens its next one.

    Order, state and errors are those of ``stream_pack``; read with ``packed_blocks``. The
    rows of a value are spread over range buckets, so one value may have most of the rows.
    The state is a row for each value, at most a block long, and is written whole.
    """
    tokens = F.col(ids) if isinstance(ids, str) else ids
    size = F.size(tokens) if length is None else length
    body = block_size - 2

    def one_batch(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        # keys, lengths, places and rows are separate passes
        batch = batch.persist()
        state = _read_state(spark, f"{out}/state", epoch - 1) if epoch else None
        path = f"{out}/blocks/epoch={epoch}"
        pack_streams(batch, by, key, tokens, size, body, state).select(
            by, "block", (F.size("ids") == body).alias("whole"), "ids"
        ).write.mode("overwrite").parquet(path)
        # of a value, only the last block may be short
        rest = F.when(~F.col("whole"), F.col("ids"))
        last = spark.read.parquet(path).groupBy(by).agg(F.max("block").alias("block"), F.max_by(rest, "block").alias("ids"))
        ids_left = F.coalesce("ids", F.array().cast("array<int>"))
        left = last.select(by, (F.col("block") + F.col("ids").isNull().cast("long")).alias("block"), ids_left.alias("ids"))
        if state is not None:
            # values without rows that stood at the end of a block
            seen = F.col("block") * body + F.size("ids")
            both = left.unionByName(state).groupBy(by).agg(F.max_by(F.struct("block", "ids"), seen).alias("s"))
            left = both.select(by, "s.block", "s.ids")
        _write_state(left, f"{out}/state", epoch)
        files.delete(spark, f"{out}/state/epoch={epoch - 2}")
        batch.unpersist()

    return (
        stream.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or TO_THE_END))
        .start()
    )


def pack_by_key(
    stream: DataFrame, by: str, order: str, ids: str, block_size: int, bos: int, eos: int
) -> DataFrame:
    """Streaming blocks ``(by, block_id, input_ids)`` of each key, with the ids that do not
    fill a block carried per key as Spark's own state.

    Rows of a key are taken in the order of ``order`` inside a micro-batch and by arrival
    between them. A key's rows of one micro-batch meet in one task, so this is for keys that
    are many and none of them large; ``stream_pack_groups`` spreads the rows of a key and
    ``stream_pack`` a single stream.
    """
    body = block_size - 2
    kind = stream.schema[by].dataType.simpleString()

    def pack(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        block, rest = state.get if state.exists else (0, [])
        rows = pd.concat(list(parts)).sort_values(order, kind="stable")
        held = [np.asarray(rest, np.int32), *[np.asarray(x, np.int32) for x in rows["ids"]]]
        flat = np.concatenate(held)
        whole = len(flat) // body
        for low in range(0, whole, 1024):
            some = range(low, min(whole, low + 1024))
            cut = [[bos, *flat[i * body : (i + 1) * body].tolist(), eos] for i in some]
            yield pd.DataFrame({"key": [key[0]] * len(cut), "block_id": [block + i for i in some], "input_ids": cut})
        state.update((block + whole, flat[whole * body :].tolist()))

    chosen = stream.select(F.col(by).alias("key"), F.col(order), F.col(ids).alias("ids"))
    packed = chosen.groupBy("key").applyInPandasWithState(
        pack,
        f"key {kind}, block_id bigint, input_ids array<int>",
        "block bigint, rest array<int>",
        "append",
        GroupStateTimeout.NoTimeout,
    )
    return packed.withColumnRenamed("key", by)


def packed_blocks(spark: SparkSession, out: str, block_size: int, bos: int, eos: int, by: str | None = None) -> DataFrame:
    """The finished blocks that ``stream_pack``, or with ``by`` ``stream_pack_groups``, wrote so far."""
    whole = spark.read.parquet(f"{out}/blocks").where("whole")
    return frame_block(
        whole.withColumnRenamed("block", "block_id"), [*([by] if by else []), "block_id"], bos, eos, block_size
    )


def stream_metrics(
    stream: DataFrame, nll: str, mask: str, event_time: str, epoch: str = "1 hour", late: str = "1 hour"
) -> DataFrame:
    """NLL, bits and perplexity per epoch, an epoch being a window of event time."""
    weight = F.col(mask).cast("double")
    sums = (
        stream.where(~F.isnan(nll))
        .withWatermark(event_time, late)
        .groupBy(F.window(event_time, epoch).alias("epoch"))
        .agg(F.sum(F.col(nll) * weight).alias("_nll"), F.sum(weight).alias("_weight"))
    )
    mean = F.try_divide(F.col("_nll"), F.col("_weight"))
    return sums.select(
        F.col("epoch.start").alias("epoch"),
        mean.alias("nll"),
        (mean / F.lit(math.log(2))).alias("bpd"),
        F.exp(mean).alias("ppl"),
    )


def run_metrics(
    metrics: DataFrame, out: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Write the epochs that a micro-batch changed; rows later than the watermark are left out
    and the state of closed epochs is dropped. Read with ``latest_metrics``."""

    def one_batch(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("version", F.lit(epoch).cast("long")).write.mode("overwrite").parquet(
            f"{out}/data/batch={epoch}"
        )

    return (
        metrics.writeStream.outputMode("update")
        .foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or TO_THE_END))
        .start()
    )


def latest_metrics(spark: SparkSession, out: str) -> DataFrame:
    """One row per epoch, from the last micro-batch that changed it."""
    rows = spark.read.parquet(f"{out}/data").drop("batch")
    names = [c for c in rows.columns if c not in ("epoch", "version")]
    last = rows.groupBy("epoch").agg(F.max_by(F.struct(*names), "version").alias("m"))
    return last.select("epoch", *[F.col(f"m.{c}").alias(c) for c in names])


COMPACT = 20


def stream_ema(
    stream: DataFrame,
    by: list[str],
    order: str,
    value: str,
    out: str,
    checkpoint: str,
    decay: float = 0.9999,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Moving average with (k, shadow) per key carried between micro-batches.

    An epoch writes the state of the keys that it changed; every ``COMPACT`` epochs the
    whole state is written once and what it replaces is deleted.
    """
    folder = f"{out}/state"

    def latest(state: DataFrame) -> DataFrame:
        return state.groupBy(*by).agg(
            F.max("k").alias("k"), F.max_by("shadow", "k").alias("shadow")
        )

    def one_batch(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        first = (epoch - 1) // COMPACT * COMPACT if epoch else 0
        parts = [_read_state(spark, folder, e) for e in range(first, epoch)]
        state = latest(reduce(DataFrame.unionByName, parts)) if parts else None
        path = f"{out}/series/epoch={epoch}"
        ema_warmup(batch, by, order, value, decay, state).write.mode("overwrite").parquet(path)
        changed = latest(spark.read.parquet(path).select(*by, "k", "shadow"))
        if state is not None and epoch % COMPACT == 0:
            changed = latest(changed.unionByName(state))
        _write_state(changed, folder, epoch)
        if epoch % COMPACT == 1 and epoch > COMPACT:
            for old in range(epoch - 1 - COMPACT, epoch - 1):
                files.delete(spark, f"{folder}/epoch={old}")
        batch.unpersist()

    return (
        stream.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or TO_THE_END))
        .start()
    )
