"""Joins between score tables and token tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def join_scores(scores: DataFrame, tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Token rows with their score rows: one row per (sequence, position) on each side.

    A token row without scores stays, with nulls.

    Joined on the full key, never on the sequence alone, so that a sequence with a
    large share of all positions is still spread by position.
    """
    return tokens.join(scores, keys, "left")


def to_long(df: DataFrame, keys: list[str], scores: str) -> DataFrame:
    """One row per token: rows times the vocabulary. The array form is a row per position,
    which is what the other operators work on."""
    return df.select(*keys, F.posexplode(scores).alias("token_id", "score"))
