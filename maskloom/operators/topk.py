"""Top-k perturbation with gamma noise."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

TERMS = 10


def topk_noise(
    df: DataFrame, keys: list[str], scores: str, k: int, seed: int, tau: float = 1.0
) -> DataFrame:
    """Add ``noisy``: scores plus tau / k * (sum of weighted gamma draws - ln 10).

    Gamma variates are no built-in, so Arrow batches are drawn from a counter-based
    generator keyed by the row: the same row gets the same noise in any partitioning.
    """

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def perturb(marks: pd.Series, rows: pd.Series) -> pd.Series:
        share = np.arange(1, TERMS + 1)[:, None] / k

        def one(mark: int, row: np.ndarray) -> np.ndarray:
            source = np.random.Generator(np.random.Philox(key=[seed, mark & (2**64 - 1)]))
            draws = source.gamma(1.0 / k, size=(TERMS, len(row)))
            return row + tau / k * ((draws * share).sum(axis=0) - math.log(TERMS))

        return pd.Series([one(int(m), np.asarray(r)) for m, r in zip(marks, rows)])

    return df.withColumn("noisy", perturb(F.xxhash64(*keys), F.col(scores)))
