"""Corruption of token rows: a narrow stage, no shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from maskloom.functions import batches
from maskloom.functions.batches import digests
from maskloom.functions.losses import loss_cov, weight
from maskloom.functions.noise import EPS, Schedule, antithetic, discretize_t, move_chance, move_chance_cov, spread_t
from maskloom.functions.rand import key_text, uniform


def mask_tokens(ids: Column, chance: Column, mask: int, seed: object, *keys: Column | str) -> Column:
    """Each token becomes ``mask`` with the given probability; the numbers drawn are ``rand.uniforms``."""

    @F.arrow_udf("array<int>")
    def draw(rows: pa.Array, key: pa.Array, chance: pa.Array) -> pa.Array:
        values, lengths, null = batches.flat(rows)
        if not len(values):
            return rows
        # a number (lane + 0.5) / 2^32 is below the chance where the lane is below this bound
        bound = np.ceil(pc.fill_null(chance, 0.0).to_numpy(zero_copy_only=False) * 2.0**32 - 0.5)
        groups = -(-lengths // 4)
        lanes = digests(key, groups).T.reshape(-1)
        first = 4 * batches.ends(groups)[:-1] - batches.ends(lengths)[:-1]
        own = lanes[np.arange(len(values)) + np.repeat(first, lengths)]
        hidden = own < np.repeat(bound, lengths)
        return batches.lists(pc.if_else(pa.array(hidden), pa.scalar(mask, pa.int32()), values), lengths, null)

    return draw(ids, key_text(seed, keys), chance.cast("double"))


def prior_mask(length: Column, mask: int) -> Column:
    return F.array_repeat(F.lit(mask), length)


def draw_t(
    key: str,
    schedule: Schedule,
    seed: object,
    eps: float = EPS,
    batch_size: int | None = 512,
    importance: bool = False,
    steps: int = 0,
) -> Column:
    """A time per row. ``batch_size`` draws antithetically: the rows of a batch, which are
    consecutive dense keys, get one time in each of as many strata; None draws plainly.
    ``importance`` spaces the loss weight evenly, ``steps`` > 0 takes the next grid point."""
    u = uniform(f"{seed}t", key)
    if batch_size is not None:
        u = antithetic(u, F.col(key) % batch_size, F.lit(batch_size))
    t = spread_t(u, eps)
    return discretize_t(schedule.importance(t) if importance else t, steps)


def corruption_job(
    df: DataFrame,
    key: str,
    ids: str,
    mask: int,
    schedule: Schedule,
    seed: object,
    eps: float = EPS,
    batch_size: int | None = 512,
    importance: bool = False,
    steps: int = 0,
    change_of_variables: bool = False,
) -> DataFrame:
    """Add t, sigma, dsigma, move_chance, the loss weight and the noisy row ``xt``.

    With ``change_of_variables`` the masking chance follows t directly; there and with
    ``importance`` the weight of a negative log-probability is the same for every time.
    Rows that are cropped or shifted for a model (``crop_window``, ``shift_ar``) are passed
    as ``ids`` of the input window.
    """
    timed = df.withColumn("t", draw_t(key, schedule, seed, eps, batch_size, importance, steps))
    noisy = timed.withColumn("sigma", schedule.sigma(F.col("t"))).withColumn(
        "dsigma", schedule.rate(F.col("t"))
    )
    if change_of_variables:
        chance = move_chance_cov(F.col("t"), schedule.sigma_min, schedule.sigma_max)
    else:
        chance = move_chance(F.col("sigma"))
    even = importance or change_of_variables
    loss_weight = -loss_cov(F.lit(1.0), schedule.sigma_min) if even else weight(F.col("sigma"), F.col("dsigma"))
    return (
        noisy.withColumn("move_chance", chance)
        .withColumn("weight", loss_weight)
        .withColumn("xt", mask_tokens(F.col(ids), F.col("move_chance"), mask, f"{seed}x", key))
    )
