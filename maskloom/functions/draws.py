"""Weighted draws and one-step updates of a token row."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from maskloom.functions.arrays import argmax, let, replace_at, total
from maskloom.functions.rand import uniform_open, uniforms
from maskloom.functions.scores import softmax, staggered, transition

# Fixed value: keeps the logarithms and divisions of the draws finite.
TINY = 1e-10

CHUNK = 256


def categorical(probs: Column, noise: Column) -> Column:
    """Index drawn with probability proportional to ``probs`` (exponential race)."""
    race = F.zip_with(
        probs, noise, lambda p, u: p / (F.lit(TINY) - F.log(u + F.lit(TINY)))
    )
    return argmax(race)


def draw_race(probs: Column, seed: object, *keys: Column | str) -> Column:
    """Categorical draw with one uniform per vocabulary entry."""
    return let(probs, lambda p: categorical(p, uniforms(seed, list(keys), F.size(p))))


def _reach(weights: Column, target: Column) -> Column:
    """Struct of the first index whose running sum reaches ``target`` and the sum before it.

    Entries that are not positive are never chosen; the last positive one closes the gap
    that rounding may leave at the end.
    """
    start = F.struct(
        F.lit(0).alias("i"),
        F.lit(0.0).alias("sum"),
        F.lit(0).alias("at"),
        F.lit(0.0).alias("before"),
    )

    def step(acc: Column, w: Column) -> Column:
        here = (w > 0) & (acc["sum"] < target)
        return F.struct(
            (acc["i"] + 1).alias("i"),
            F.when(here, acc["sum"] + w).otherwise(acc["sum"]).alias("sum"),
            F.when(here, acc["i"]).otherwise(acc["at"]).alias("at"),
            F.when(here, acc["sum"]).otherwise(acc["before"]).alias("before"),
        )

    return F.aggregate(weights, start, step)


def inverse(probs: Column, us: Column) -> Column:
    """Indices drawn with probability proportional to ``probs``, one per uniform in ``us``.

    The running sum is walked over chunks first and then inside one chunk, so that a
    large vocabulary costs little more than its plain sum.
    """

    def chunk(p: Column, c: Column) -> Column:
        return F.slice(p, c * CHUNK + 1, F.lit(CHUNK))

    def sums(p: Column) -> Column:
        last = F.floor((F.size(p) - 1) / F.lit(CHUNK)).cast("int")
        return F.transform(
            F.sequence(F.lit(0), last),
            lambda c: F.aggregate(
                chunk(p, c), F.lit(0.0), lambda acc, x: acc + F.greatest(x, F.lit(0.0))
            ),
        )

    def pick(p: Column, c: Column, target: Column) -> Column:
        return let(
            _reach(c, target),
            lambda hit: hit["at"] * CHUNK
            + _reach(chunk(p, hit["at"]), target - hit["before"])["at"],
        )

    return let(
        probs,
        lambda p: let(
            sums(p),
            lambda c: let(
                total(c),
                lambda whole: F.transform(us, lambda u: let(whole * u, lambda t: pick(p, c, t))),
            ),
        ),
    )


def draw(probs: Column, seed: object, *keys: Column | str) -> Column:
    """Categorical draw with a single uniform per row."""
    return inverse(probs, F.array(uniform_open(seed, *keys)))[0]


def draw_many(probs: Column, k: int, seed: object, *keys: Column | str) -> Column:
    """Array of ``k`` independent categorical draws from one row."""
    us = F.transform(
        F.sequence(F.lit(0), F.lit(k - 1)), lambda c: uniform_open(seed, *keys, c)
    )
    return inverse(probs, us)


def gumbel(logits: Column, seed: object, *keys: Column | str) -> Column:
    """argmax(logits + Gumbel noise)."""
    return let(
        logits,
        lambda s: argmax(
            F.zip_with(
                s,
                uniforms(seed, list(keys), F.size(s)),
                lambda x, u: x - F.log(-F.log(u)),
            )
        ),
    )


def carry_over(xt: Column, new: Column, mask: int) -> Column:
    return F.when(xt != mask, xt).otherwise(new)


def ddpm_probs(probs: Column, chance_t: Column, chance_s: Column, mask: int) -> Column:
    return let(
        F.array(chance_t - chance_s, chance_s),
        lambda c: F.transform(probs, lambda p, i: F.when(i == mask, c[1]).otherwise(p * c[0])),
    )


def step_ddpm(
    probs: Column,
    xt: Column,
    chance_t: Column,
    chance_s: Column,
    mask: int,
    seed: object,
    *keys: Column | str,
) -> Column:
    drawn = draw(ddpm_probs(probs, chance_t, chance_s, mask), seed, *keys)
    return carry_over(xt, drawn, mask)


def analytic_probs(score: Column, xt: Column, dsigma: Column, mask: int) -> Column:
    return F.zip_with(
        staggered(score, dsigma, mask),
        transition(xt, dsigma, F.size(score), mask),
        lambda s, e: s * e,
    )


def step_analytic(
    score: Column, xt: Column, dsigma: Column, mask: int, seed: object, *keys: Column | str
) -> Column:
    return draw(analytic_probs(score, xt, dsigma, mask), seed, *keys)


def step_denoise(
    score: Column, xt: Column, sigma: Column, mask: int, seed: object, *keys: Column | str
) -> Column:
    return draw(replace_at(analytic_probs(score, xt, sigma, mask), mask, 0.0), seed, *keys)


def topk_hard(scores: Column, k: int) -> Column:
    """1 where a score reaches the k-th largest, ties included."""
    return let(
        F.element_at(F.sort_array(scores, asc=False), k),
        lambda limit: F.transform(
            scores, lambda x: F.when(x >= limit, F.lit(1.0)).otherwise(F.lit(0.0))
        ),
    )


def topk_soft(scores: Column) -> Column:
    """Centered scores divided by their length."""
    return let(
        total(scores) / F.size(scores),
        lambda mean: let(
            F.transform(scores, lambda x: x - mean),
            lambda c: let(
                F.sqrt(total(F.transform(c, lambda x: x * x))),
                lambda norm: F.transform(c, lambda x: F.try_divide(x, norm)),
            ),
        ),
    )


def gumbel_noise(u: Column) -> Column:
    return -F.log(F.lit(TINY) - F.log(u + F.lit(TINY)))


def gumbel_softmax(
    logits: Column, temperature: float, seed: object, *keys: Column | str
) -> Column:
    """Struct of the relaxed sample and the index of the hard one."""
    noisy = let(
        logits,
        lambda s: F.zip_with(
            s, uniforms(seed, list(keys), F.size(s)), lambda x, u: x + gumbel_noise(u)
        ),
    )
    return let(
        noisy,
        lambda s: F.struct(
            softmax(F.transform(s, lambda x: x / F.lit(float(temperature)))).alias("soft"),
            argmax(s).alias("hard"),
        ),
    )


def bernoulli_relaxed(p: Column, seed: object, *keys: Column | str) -> Column:
    """Struct of the hard and the relaxed sample of one probability."""
    plus = gumbel_noise(uniform_open(f"{seed}+", *keys))
    minus = gumbel_noise(uniform_open(f"{seed}-", *keys))
    odds = F.exp(minus - plus)
    return F.struct(
        F.when(p * (F.lit(1.0) + odds) > 1, F.lit(1.0)).otherwise(F.lit(0.0)).alias("hard"),
        F.try_divide(p, p + (F.lit(1.0) - p) * odds).alias("soft"),
    )


def normal(u: Column, v: Column) -> Column:
    """Standard normal from two uniforms in (0, 1)."""
    return F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(2.0) * F.pi() * v)


def gaussian(row: Column, seed: object, *keys: Column | str) -> Column:
    """First half of the row is the mean, softplus of the second half the variance."""
    half = F.floor(F.size(row) / F.lit(2)).cast("int")

    def drawn(parts: Column) -> Column:
        z = F.zip_with(parts["u"], parts["v"], normal)
        scaled = F.zip_with(
            F.transform(parts["raw"], lambda s: F.sqrt(F.log1p(F.exp(s)))), z, lambda s, e: s * e
        )
        return F.zip_with(parts["mu"], scaled, lambda m, e: m + e)

    return let(
        F.struct(
            F.slice(row, F.lit(1), half).alias("mu"),
            F.slice(row, half + 1, F.size(row) - half).alias("raw"),
            uniforms(f"{seed}u", list(keys), half).alias("u"),
            uniforms(f"{seed}v", list(keys), half).alias("v"),
        ),
        drawn,
    )


def sign_discretize(row: Column) -> Column:
    """Struct of the signs and of the row divided by its length."""
    return let(
        F.sqrt(total(F.transform(row, lambda x: x * x))),
        lambda norm: F.struct(
            F.transform(row, F.signum).alias("hard"),
            F.transform(row, lambda x: F.try_divide(x, norm)).alias("soft"),
        ),
    )
