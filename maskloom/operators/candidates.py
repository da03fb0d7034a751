"""Candidate sequences: k draws per position, energy resampling, cache checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from maskloom.functions.draws import draw_many
from maskloom.functions.rand import uniform


def draw_candidates(df: DataFrame, keys: list[str], probs: Column, k: int, seed: object) -> DataFrame:
    """k independent draws per row, keyed by ``cand_id``; candidates cannot mix.

    The draws of a row are made together, so its scores are not copied k times.
    """
    tokens = draw_many(probs, k, seed, *keys)
    return df.select(*keys, F.posexplode(tokens).alias("cand_id", "token"))


def energy_resample(
    df: DataFrame, seq: str, energy: str, temperature: float, seed: object, sign: int = 1
) -> DataFrame:
    """Choose one candidate per sequence with weight softmax(sign * energy / temperature).

    Input has one row per (sequence, cand_id), k rows per sequence.
    """
    of_seq = Window.partitionBy(seq)
    scaled = F.lit(float(sign)) * (F.col(energy) - F.max(F.lit(sign) * F.col(energy)).over(of_seq) * sign)
    weighted = df.withColumn("_w", F.exp(scaled / F.lit(temperature)))
    running = of_seq.orderBy("cand_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = weighted.withColumn(
        "_upto", F.sum("_w").over(running) / F.sum("_w").over(of_seq)
    ).withColumn("_last", F.max("cand_id").over(of_seq))
    # the last candidate also closes the gap that rounding may leave below 1
    return (
        placed.where((F.col("_upto") >= uniform(seed, seq)) | (F.col("cand_id") == F.col("_last")))
        .groupBy(seq)
        .agg(F.min("cand_id").alias("cand_id"))
    )


def in_window(df: DataFrame, t: str, cached: str, start: float, end: float) -> DataFrame:
    """Rows that are resampled: t in [end, start] and nothing cached."""
    return df.where(F.col(t).between(end, start) & ~F.col(cached))


def cache_valid(df: DataFrame, seq: str, before: str, after: str) -> DataFrame:
    """Per sequence whether a step changed nothing, so its prediction can be used again."""
    changed = F.col(after) != F.col(before)
    return df.groupBy(seq).agg(
        F.bool_and(~changed).alias("unchanged"), F.count_if(changed).alias("changed")
    )
