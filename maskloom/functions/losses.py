"""Per-token losses as column expressions over log scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from maskloom.functions.arrays import at, total


def weight(sigma: Column, rate: Column) -> Column:
    """Loss weight rate / expm1(sigma); null where sigma is 0."""
    return F.try_divide(rate, F.expm1(sigma))


def loss_subs(log_p: Column, sigma: Column, rate: Column) -> Column:
    return -log_p * weight(sigma, rate)


def loss_cov(log_p: Column, sigma_min: float) -> Column:
    return log_p * F.lit(math.log1p(-math.exp(-sigma_min)))


def loss_d3pm(log_p: Column, log_mask: Column, xt: Column, t: Column, steps: int, mask: int) -> Column:
    """Discrete-time bound on masked positions; the last grid step has no second term."""
    dt = F.lit(1.0 / steps)
    time = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0 - 1e-4))
    p_mask = F.exp(log_mask)
    now = F.log((F.lit(1.0) - time) * p_mask / time + 1)
    first = dt / time * (now - log_p)
    before = time - dt
    second = F.when(F.abs(before) < F.lit(1e-12), F.lit(0.0)).otherwise(
        (F.lit(1.0) - dt / time)
        * (now - F.log(F.try_divide((F.lit(1.0) - before) * p_mask, before) + 1))
    )
    return F.lit(float(steps)) * F.when(xt == mask, first + second).otherwise(F.lit(0.0))


def score_entropy(log_score: Column, x0: Column, xt: Column, sigma: Column, mask: int) -> Column:
    """Score entropy of masked positions, 0 at visible ones."""
    q = F.try_divide(F.lit(1.0), F.expm1(sigma))
    positive = total(
        F.transform(
            log_score, lambda x, i: F.when(i == mask, F.lit(0.0)).otherwise(F.exp(x))
        )
    )
    value = positive - q * at(log_score, x0) + q * (F.log(q) - 1)
    return F.when(xt == mask, value).otherwise(F.lit(0.0))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def loss_nce(energy_pos: Column, energy_neg: Column) -> Column:
    tiny = F.lit(1e-8)
    return -(F.log(sigmoid(-energy_pos) + tiny) + F.log(sigmoid(energy_neg) + tiny))


def theta_log_p(discrete_loss: Column, sigma: Column, rate: Column, sigma_min: float | None = None) -> Column:
    """Token log-probability that the continuous-time weight turns back into a discrete loss;
    ``sigma_min`` is given for times drawn by importance sampling or change of variables."""
    if sigma_min is not None:
        return discrete_loss / F.lit(math.log1p(-math.exp(-sigma_min)))
    return -F.try_divide(discrete_loss, weight(sigma, rate))


def energy_nll(log_p: Column, sigma: Column, rate: Column, sigma_min: float | None = None) -> Column:
    """Loss of a log-probability that holds the energy, by the way the times were drawn."""
    return loss_subs(log_p, sigma, rate) if sigma_min is None else loss_cov(log_p, sigma_min)


def energy_log_p(
    log_p: Column, length: Column, energy_pos: Column, energy_neg: Column | None = None
) -> Column:
    """Token log-probability with the sequence energy spread over its positions."""
    gain = -energy_pos if energy_neg is None else energy_neg - energy_pos
    return log_p + gain / length
