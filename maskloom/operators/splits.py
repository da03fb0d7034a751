"""Train and hold-out splits, row order, shards and batches."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from maskloom.functions.rand import uniform
from maskloom.operators.order import ranked, row_total, shuffled
from maskloom.operators.select import first_rows

# Corpora whose held-out split is called "test".
TEST_SPLIT_CORPORA = ["text8", "lm1b", "ag_news"]
# Corpora that come without splits.
UNSPLIT_CORPORA = ["lambada", "openwebtext-train", "openwebtext-valid"]


def split_tail(df: DataFrame, key: str, holdout: int) -> DataFrame:
    """The last ``holdout`` rows in the order of a unique numeric key are the validation split;
    selected by the key that parts them (``select``), not by a rank of all rows."""
    train = first_rows(df, [key], df.count() - holdout)
    return df.withColumn("split", F.when(train, "train").otherwise("validation"))


def split_random_exact(df: DataFrame, key: str, share: float = 0.1, seed: object = 42) -> DataFrame:
    """Random split with exactly ceil(share * n) validation rows: those with the smallest
    numbers drawn for their unique numeric key."""
    drawn = df.withColumn("_drawn", uniform(seed, key))
    chosen = first_rows(drawn, ["_drawn", key], math.ceil(share * df.count()))
    return drawn.withColumn("split", F.when(chosen, "validation").otherwise("train")).drop("_drawn")


def validation_split(corpus: Column) -> Column:
    return F.when(corpus.isin(*TEST_SPLIT_CORPORA), "test").otherwise("validation")


def split_select(df: DataFrame, mode: str, corpus: str = "corpus", split: str = "split") -> DataFrame:
    """Rows of one mode; corpora without splits are kept whole.

    Mode "valid" stands for the held-out split of each corpus.
    """
    name = F.col(corpus)
    wanted = validation_split(name) if mode == "valid" else F.lit(mode)
    return df.where(name.isin(*UNSPLIT_CORPORA) | (F.col(split) == wanted))


def epoch_shuffle(df: DataFrame, key: str, seed: int, epoch: int) -> DataFrame:
    return shuffled(df, seed + epoch, key)


def shard(
    df: DataFrame, replicas: int, drop_last: bool = False, rows: Column | None = None
) -> DataFrame:
    """Deal ranked rows to replicas in turn, every replica getting the same number.

    Without ``drop_last`` the first rows come again (more than once if needed) to
    fill up; with it the surplus rows are left out. Expects a ``rank`` column. ``rows``
    is the row count where it is cheaper to get from the table before ranking.
    """
    n = row_total(df) if rows is None else rows
    if drop_last:
        size = F.floor(n / F.lit(replicas)).cast("long") * replicas
        dealt = df.where(F.col("rank") < size).withColumn("place", F.col("rank"))
    else:
        size = F.ceil(n / F.lit(replicas)).cast("long") * replicas
        places = F.sequence(F.col("rank"), size - 1, n)
        dealt = df.withColumn("place", F.explode(places))
    return dealt.select(
        *df.columns,
        (F.col("place") % replicas).cast("int").alias("replica"),
        F.floor(F.col("place") / F.lit(replicas)).cast("long").alias("position"),
    )


def resume(df: DataFrame, counter: int, position: str = "position") -> DataFrame:
    """Rows that are left after ``counter`` rows of each replica were consumed."""
    return df.where(F.col(position) >= counter)


def assign_batches(df: DataFrame, key: str, batch_size: int, seed: object | None = None) -> DataFrame:
    """Batches in key order, or in a seeded random order."""
    placed = ranked(df, key) if seed is None else shuffled(df, seed, key)
    return placed.withColumn(
        "batch_id", F.floor(F.col("rank") / F.lit(batch_size)).cast("long")
    )


def limit_batches(
    df: DataFrame, batch_size: int, limit: float | int, rows: Column | None = None
) -> DataFrame:
    """Keep a share (float) or a number (int) of the batches of a batched table."""
    if isinstance(limit, int):
        return df.where(F.col("batch_id") < limit)
    n = row_total(df) if rows is None else rows
    batches = F.ceil(n / F.lit(batch_size)).cast("long")
    return df.where(F.col("batch_id") < F.floor(F.lit(limit) * batches))


def eval_batches(df: DataFrame, key: str, batch_size: int, drop_remainder: bool = False) -> DataFrame:
    """Evaluation batches; the rows after the last full batch can be dropped."""
    out = assign_batches(df, key, batch_size)
    if not drop_remainder:
        return out
    n = row_total(df)
    size = F.least(F.lit(batch_size).cast("long"), n)
    whole = F.floor(F.try_divide(n, size)).cast("long") * size
    return out.where(F.col("rank") < whole)


def batch_plan(
    df: DataFrame, global_batch: str, eval_batch: str, nodes: int, devices: int, accumulate: int
) -> DataFrame:
    """Per-device batch size and the checks on it, one row per input row."""
    ways = nodes * devices * accumulate
    size = F.floor(F.col(global_batch) / F.lit(ways)).cast("long")
    return df.select(
        "*",
        size.alias("batch_size"),
        (size * ways).alias("effective"),
        F.ceil(F.col(global_batch) / F.lit(devices * nodes)).cast("long").alias("per_machine"),
        (size * ways == F.col(global_batch)).alias("reaches_global"),
        (F.col(global_batch) % (devices * accumulate) == 0).alias("train_divides"),
        (F.col(eval_batch) % devices == 0).alias("eval_divides"),
    )
