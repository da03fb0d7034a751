"""Transforms of one score row: ``scores`` is array<double> over the vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from maskloom.functions.arrays import at, let, replace_at, total

# Stand-ins for minus infinity.
NEG_INFINITY = -1000000.0
NEG_INFINITY_AR = -1000.0


def logsumexp(scores: Column) -> Column:
    return let(
        F.array_max(scores),
        lambda top: top + F.log(total(F.transform(scores, lambda x: F.exp(x - top)))),
    )


def log_softmax(scores: Column) -> Column:
    return let(scores, lambda s: let(logsumexp(s), lambda z: F.transform(s, lambda x: x - z)))


def softmax(scores: Column) -> Column:
    return F.transform(log_softmax(scores), F.exp)


def _suppress(scores: Column, mask: int) -> Column:
    return F.transform(
        scores, lambda x, i: F.when(i == mask, x + F.lit(NEG_INFINITY)).otherwise(x)
    )


def _only(scores: Column, token: Column) -> Column:
    """All mass on one token, as log-probabilities."""
    return F.transform(
        scores, lambda x, i: F.when(i == token, F.lit(0.0)).otherwise(F.lit(NEG_INFINITY))
    )


def carry_over_scores(log_probs: Column, xt: Column, mask: int) -> Column:
    """Visible tokens keep themselves with probability one."""
    return F.transform(
        log_probs,
        lambda x, i: F.when(xt == mask, x)
        .when(i == xt, F.lit(0.0))
        .otherwise(F.lit(NEG_INFINITY)),
    )


def subs(scores: Column, xt: Column, mask: int) -> Column:
    return F.when(xt == mask, log_softmax(_suppress(scores, mask))).otherwise(_only(scores, xt))


def d3pm(scores: Column, mask: int, subs_masking: bool = False) -> Column:
    return log_softmax(_suppress(scores, mask) if subs_masking else scores)


def sedd(scores: Column, xt: Column, sigma: Column) -> Column:
    shift = F.log(F.expm1(sigma)) + F.log((F.size(scores) - 1).cast("double"))
    return let(
        shift,
        lambda z: F.transform(
            scores, lambda x, i: F.when(i == xt, F.lit(0.0)).otherwise(x - z)
        ),
    )


def ar(scores: Column, mask: int) -> Column:
    return log_softmax(replace_at(scores, mask, NEG_INFINITY_AR))


def process_sigma(sigma: Column, time_conditioning: bool) -> Column:
    return sigma if time_conditioning else F.when(sigma.isNotNull(), F.lit(0.0))


def parameterize(
    name: str,
    scores: Column,
    mask: int,
    xt: Column | None = None,
    sigma: Column | None = None,
    subs_masking: bool = False,
) -> Column:
    """Log scores by parameterization name; other names return the raw scores.

    ``sigma`` is the noise level itself; what the model is conditioned on is
    ``process_sigma`` of it.
    """
    if name == "subs":
        return subs(scores, xt, mask)
    if name == "sedd":
        return sedd(scores, xt, sigma)
    if name == "d3pm":
        return d3pm(scores, mask, subs_masking)
    if name == "ar":
        return ar(scores, mask)
    return scores


def log_prob(scores: Column, token: Column) -> Column:
    """Log-probability of one token of raw scores, without normalizing the others."""
    return let(scores, lambda s: at(s, token) - logsumexp(s))


def gather(scores: Column, token: Column) -> Column:
    return at(scores, token)


def ratio(log_probs: Column, xt: Column, sigma: Column, mask: int) -> Column:
    """Concrete score p(y)/p(x) of a one-token change, from substituted log-probs."""
    log_k = -F.log(F.expm1(sigma))
    masked = let(
        log_k,
        lambda k: F.transform(
            log_probs, lambda x, i: F.when(i == mask, F.lit(0.0)).otherwise(x + k)
        ),
    )
    visible = let(
        log_k,
        lambda k: F.transform(
            log_probs,
            lambda x, i: F.when(i == mask, -k)
            .when(i == xt, F.lit(0.0))
            .otherwise(F.lit(NEG_INFINITY)),
        ),
    )
    return F.transform(F.when(xt == mask, masked).otherwise(visible), F.exp)


def staggered(score: Column, dsigma: Column, mask: int) -> Column:
    grown = F.exp(dsigma)
    return let(
        score,
        lambda s: let(
            F.array(grown, (F.lit(1.0) - grown) * total(s)),
            lambda c: F.transform(
                s, lambda x, i: x * c[0] + F.when(i == mask, c[1]).otherwise(F.lit(0.0))
            ),
        ),
    )


def transition(xt: Column, sigma: Column, vocab: Column | int, mask: int) -> Column:
    """Row ``xt`` of the transposed transition matrix."""
    size = F.lit(vocab) if isinstance(vocab, int) else vocab
    return let(
        F.exp(-sigma),
        lambda stay: F.transform(
            F.sequence(F.lit(0), size - 1),
            lambda i: F.when(i == xt, stay).otherwise(F.lit(0.0))
            + F.when(xt == mask, F.lit(1.0) - stay).otherwise(F.lit(0.0)),
        ),
    )


def clamp(token: Column, vocab: int) -> Column:
    return F.least(F.greatest(token, F.lit(0)), F.lit(vocab - 1))
