"""Noise schedules: closed forms in a time column ``t`` in [0, 1]."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

EPS = 1e-3
HALF_PI = math.pi / 2


class Schedule:
    """``sigma`` is the noise accumulated up to t, ``rate`` its derivative."""

    def sigma(self, t: Column) -> Column:
        raise NotImplementedError

    def rate(self, t: Column) -> Column:
        raise NotImplementedError

    def move_chance(self, t: Column) -> Column:
        return move_chance(self.sigma(t))


@dataclass(frozen=True)
class LogLinear(Schedule):
    eps: float = EPS

    @property
    def sigma_max(self) -> float:
        return -math.log1p(-(1 - self.eps))

    @property
    def sigma_min(self) -> float:
        return self.eps

    def sigma(self, t: Column) -> Column:
        return -F.log1p(t * F.lit(-(1 - self.eps)))

    def rate(self, t: Column) -> Column:
        return F.lit(1 - self.eps) / (F.lit(1.0) - t * F.lit(1 - self.eps))

    def importance(self, t: Column) -> Column:
        return -F.expm1(-_even_sigma(t, self)) / F.lit(1 - self.eps)


@dataclass(frozen=True)
class Cosine(Schedule):
    eps: float = EPS

    def sigma(self, t: Column) -> Column:
        return -F.log(F.lit(self.eps) + F.lit(1 - self.eps) * F.cos(t * F.lit(HALF_PI)))

    def rate(self, t: Column) -> Column:
        keep = F.lit(1 - self.eps)
        angle = t * F.lit(HALF_PI)
        return F.lit(HALF_PI) * keep * F.sin(angle) / (keep * F.cos(angle) + F.lit(self.eps))


@dataclass(frozen=True)
class CosineSquared(Schedule):
    eps: float = EPS

    def sigma(self, t: Column) -> Column:
        squared = F.pow(F.cos(t * F.lit(HALF_PI)), F.lit(2.0))
        return -F.log(F.lit(self.eps) + F.lit(1 - self.eps) * squared)

    def rate(self, t: Column) -> Column:
        keep = F.lit(1 - self.eps)
        squared = F.pow(F.cos(t * F.lit(HALF_PI)), F.lit(2.0))
        return (
            F.lit(HALF_PI) * keep * F.sin(t * F.lit(math.pi)) / (keep * squared + F.lit(self.eps))
        )


@dataclass(frozen=True)
class Linear(Schedule):
    sigma_min: float = 0.0
    sigma_max: float = 10.0

    def sigma(self, t: Column) -> Column:
        return F.lit(self.sigma_min) + t * F.lit(self.sigma_max - self.sigma_min)

    def rate(self, t: Column) -> Column:
        return F.when(t.isNotNull(), F.lit(self.sigma_max - self.sigma_min))

    def importance(self, t: Column) -> Column:
        return (_even_sigma(t, self) - F.lit(self.sigma_min)) / F.lit(
            self.sigma_max - self.sigma_min
        )


@dataclass(frozen=True)
class Geometric(Schedule):
    sigma_min: float = 1e-3
    sigma_max: float = 1.0

    def sigma(self, t: Column) -> Column:
        return F.pow(F.lit(self.sigma_min), F.lit(1.0) - t) * F.pow(F.lit(self.sigma_max), t)

    def rate(self, t: Column) -> Column:
        return self.sigma(t) * F.lit(math.log(self.sigma_max) - math.log(self.sigma_min))


def schedule(name: str, **params: float) -> Schedule:
    kinds = {
        "geometric": Geometric,
        "loglinear": LogLinear,
        "cosine": Cosine,
        "cosinesqr": CosineSquared,
        "linear": Linear,
    }
    if name not in kinds:
        raise ValueError(f"unknown noise schedule {name!r}")
    return kinds[name](**params)


def _log_keep(sigma: float) -> float:
    """log(1 - exp(-sigma)), minus infinity at 0."""
    return math.log1p(-math.exp(-sigma)) if sigma > 0 else -math.inf


def _even_sigma(t: Column, s: LogLinear | Linear) -> Column:
    """Sigma at which log(1 - exp(-sigma)) has gone the share t of its range."""
    end, start = _log_keep(s.sigma_max), _log_keep(s.sigma_min)
    return -F.log1p(-F.exp(t * F.lit(end) + (F.lit(1.0) - t) * F.lit(start)))


def move_chance(sigma: Column) -> Column:
    return -F.expm1(-sigma)


def move_chance_cov(t: Column, sigma_min: float, sigma_max: float) -> Column:
    """Masking probability under the change of variables."""
    start, end = _log_keep(sigma_min), _log_keep(sigma_max)
    return F.exp(F.lit(start) + t * F.lit(end - start))


def spread_t(u: Column, eps: float = EPS) -> Column:
    return u * F.lit(1 - eps) + F.lit(eps)


def antithetic(u: Column, index: Column, n: Column) -> Column:
    """Move u into stratum ``index`` of ``n``."""
    return F.pmod(u / n + index / n, F.lit(1.0))


def discretize_t(t: Column, steps: int) -> Column:
    """Next grid point of 1/T ... 1; T = 0 means continuous time."""
    if steps == 0:
        return t
    return F.floor(t * F.lit(float(steps))) / F.lit(float(steps)) + F.lit(1.0 / steps)


def lr_warmup_constant(step: Column, base: float, warmup: int) -> Column:
    return F.lit(base) * F.least(F.lit(1.0), step / F.lit(float(max(1, warmup))))


def lr_cosine_warmup(
    step: Column, base: float, warmup: int, total: int, start: float = 1e-6, floor: float = 1e-6
) -> Column:
    """Linear warm-up from ``start``, then one cosine half-wave down to ``floor``."""
    after = step - F.lit(warmup)
    rising = F.lit(start) + step * F.lit((base - start) / max(1, warmup))
    falling = F.lit(floor) + F.lit(0.5 * (base - floor)) * (
        F.lit(1.0) + F.cos(F.lit(math.pi) * after / F.lit(float(total)))
    )
    return F.when(step < warmup, rising).when(after < total, falling).otherwise(F.lit(floor))


def timestep_grid(df: DataFrame, steps: str, eps: float = 1e-5) -> DataFrame:
    """Rows times the grid of ``steps`` + 1 times from 1 down to ``eps``: (i, t, dt)."""
    dt = F.lit(1 - eps) / F.col(steps)
    return (
        df.withColumn("dt", dt)
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.col(steps).cast("int"))))
        .withColumn("t", F.lit(1.0) - F.col("i") * F.col("dt"))
    )
