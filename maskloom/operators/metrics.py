"""Aggregates over loss tables: partial sums first, formulas on the small result."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from maskloom.functions import batches
from maskloom.functions.arrays import at, let, replace_at, total
from maskloom.functions.scores import NEG_INFINITY, logsumexp


def _sums(df: DataFrame, nll: str, mask: str, by: list[str]) -> DataFrame:
    counted = df.where(~F.isnan(nll))
    weight = F.col(mask).cast("double")
    return counted.groupBy(*by).agg(
        F.sum(F.col(nll) * weight).alias("_nll"), F.sum(weight).alias("_weight")
    )


def mean_nll(sums: DataFrame) -> Column:
    return F.try_divide(sums["_nll"], sums["_weight"])


def metric_nll(df: DataFrame, nll: str, mask: str, by: list[str]) -> DataFrame:
    """Mean NLL weighted by the mask; NaN rows do not count."""
    sums = _sums(df, nll, mask, by)
    return sums.select(*by, mean_nll(sums).alias("nll"))


def metric_bpd(df: DataFrame, nll: str, mask: str, by: list[str]) -> DataFrame:
    sums = _sums(df, nll, mask, by)
    return sums.select(*by, (mean_nll(sums) / F.lit(math.log(2))).alias("bpd"))


def metric_ppl(df: DataFrame, nll: str, mask: str, by: list[str]) -> DataFrame:
    sums = _sums(df, nll, mask, by)
    return sums.select(*by, F.exp(mean_nll(sums)).alias("ppl"))


def _all_three(sums: DataFrame, keys: list[str | Column]) -> DataFrame:
    nll = mean_nll(sums)
    return sums.select(
        *keys,
        nll.alias("nll"),
        (nll / F.lit(math.log(2))).alias("bpd"),
        F.exp(nll).alias("ppl"),
    )


def metrics(df: DataFrame, nll: str, mask: str, by: list[str]) -> DataFrame:
    return _all_three(_sums(df, nll, mask, by), list(by))


def metric_epoch(df: DataFrame, nll: str, mask: str, split: str, epoch: str) -> DataFrame:
    """All three metrics per split and epoch, per split, and overall."""
    weight = F.col(mask).cast("double")
    sums = (
        df.where(~F.isnan(nll))
        .rollup(split, epoch)
        .agg(F.sum(F.col(nll) * weight).alias("_nll"), F.sum(weight).alias("_weight"))
    )
    return _all_three(sums, [split, epoch])


def masked_batch_loss(df: DataFrame, loss: str, mask: str, by: list[str]) -> DataFrame:
    weight = F.col(mask).cast("double")
    return df.groupBy(*by).agg(
        F.try_divide(F.sum(F.col(loss) * weight), F.sum(weight)).alias("loss")
    )


def cross_entropy(df: DataFrame, log_p: str, target: str, by: list[str], ignore: int = -100) -> DataFrame:
    return df.where(F.col(target) != ignore).groupBy(*by).agg(F.avg(-F.col(log_p)).alias("loss"))


def cross_entropy_weighted(
    df: DataFrame, log_p: str, target: str, weight: str, by: list[str], ignore: int = -100
) -> DataFrame:
    w = F.when(F.col(target) == ignore, F.lit(0.0)).otherwise(F.col(weight))
    # an ignored target has no log-probability of its own
    ce = F.when(F.col(target) == ignore, F.lit(0.0)).otherwise(-F.col(log_p))
    return df.groupBy(*by).agg(F.try_divide(F.sum(ce * w), F.sum(w)).alias("loss"))


def sequence_energy(
    scores: DataFrame,
    candidates: DataFrame,
    seq: str,
    pos: str,
    mask: int,
    ar: str = "ar",
    diffusion: str = "diffusion",
    xt: str = "xt",
    tokens: str = "tokens",
    carry_over: bool = True,
) -> DataFrame:
    """Energy of whole candidate sequences: diffusion minus autoregressive log-probability.

    ``scores`` holds the raw score arrays of both models per position; ``candidates`` holds the
    noisy token ``xt`` and an array with the token of each candidate. The diffusion side takes
    the substituted scores of a position for its own token; visible tokens have probability
    one. The autoregressive side takes the scores of a position, without the mask entry, for
    the token of the next one; with ``carry_over`` visible tokens have probability one there
    too. Returns ``(seq, energies, n, missing)``: an energy per candidate, the number of
    positions and of those without scores, whose sequence has null energies. The score table
    is read once and moved once.
    """
    s, y, x = F.col(diffusion), F.col(tokens), F.col(xt)
    after = candidates.select(
        seq, (F.col(pos) - 1).alias(pos), F.col(tokens).alias("_next"), F.col(xt).alias("_next_xt")
    )
    cells = candidates.select(seq, pos, xt, tokens).join(after, [seq, pos], "left")
    rows = cells.join(scores.select(seq, pos, ar, diffusion), [seq, pos], "left")

    # one logarithm of sums serves all candidates of a position
    def own(z: Column) -> Column:
        hidden = lambda t: at(s, t) + F.when(t == mask, NEG_INFINITY).otherwise(0.0) - z
        visible = lambda t: F.when(t == x, 0.0).otherwise(NEG_INFINITY)
        return F.transform(y, lambda t: F.when(x == mask, hidden(t)).otherwise(visible(t)))

    def following(z: Column) -> Column:
        def one(t: Column) -> Column:
            scored = F.when(t == mask, F.lit(NEG_INFINITY)).otherwise(at(F.col(ar), t)) - z
            if not carry_over:
                return scored
            kept = F.when(t == F.col("_next_xt"), 0.0).otherwise(NEG_INFINITY)
            return F.when(F.col("_next_xt") == mask, scored).otherwise(kept)

        return F.transform("_next", one)

    hushed = F.transform(s, lambda v, i: F.when(i == mask, v + NEG_INFINITY).otherwise(v))
    parts = rows.select(
        seq,
        let(logsumexp(hushed), own).alias("_own"),
        let(logsumexp(replace_at(F.col(ar), mask, NEG_INFINITY)), following).alias("_following"),
        F.col("_next").isNotNull().alias("_inner"),
        (s.isNotNull() & F.col(ar).isNotNull()).alias("_have"),
    )
    # the last position of a sequence has no next token
    terms = F.when(
        F.col("_inner"), F.zip_with("_own", "_following", lambda a, b: a - b)
    ).otherwise(F.col("_own"))
    # a position without scores becomes one row without a candidate
    terms = F.when(F.col("_have"), terms)
    flat = parts.select(seq, F.posexplode_outer(terms).alias("_cand", "_term"))
    per = flat.groupBy(seq, "_cand").agg(F.sum("_term").alias("_e"), F.count(F.lit(1)).alias("_n"))
    found = F.transform(
        F.sort_array(F.collect_list(F.when(F.col("_cand").isNotNull(), F.struct("_cand", "_e")))), lambda c: c["_e"]
    )
    whole = per.groupBy(seq).agg(
        found.alias("_energies"),
        F.max(F.when(F.col("_cand").isNotNull(), F.col("_n"))).alias("_scored"),
        F.max(F.when(F.col("_cand").isNull(), F.col("_n"))).alias("_unscored"),
    )
    missing = F.coalesce("_unscored", F.lit(0))
    return whole.select(
        seq,
        F.when(missing == 0, F.col("_energies")).alias("energies"),
        (F.coalesce("_scored", F.lit(0)) + missing).alias("n"),
        missing.alias("missing"),
    )


def counted_tokens(windows: DataFrame, ids: str, eos: int, keep: list[str]) -> DataFrame:
    """One row ``(keep..., i, id)`` per token of a context window that counts.

    The first token of a window has no prediction; EOS counts once per window.
    """
    # looked up before the explode: next to it, it would run once per token
    first = F.array_position(ids, eos).cast("int") - 1
    marked = windows.select(*keep, ids, first.alias("_eos_at"))
    cells = marked.select(*keep, "_eos_at", F.posexplode(ids).alias("i", "id"))
    return cells.where(
        (F.col("i") > 0) & ((F.col("id") != eos) | (F.col("i") == F.col("_eos_at")))
    ).drop("_eos_at")


def gen_ppl(tokens: DataFrame, scores: DataFrame, keys: list[str]) -> DataFrame:
    """Perplexity of counted tokens under a ``(keys..., lp)`` score table.

    Keys are the window and position for a model's scores, or the token id for a
    table of vocabulary size. Tokens without a score, or with NaN, count as missing.
    """
    scored = tokens.join(scores, keys, "left").withColumn("lp", F.nanvl("lp", F.lit(None)))
    sums = scored.agg(
        F.sum(-F.col("lp")).alias("_nll"),
        F.count("lp").alias("_weight"),
        F.count_if(F.col("lp").isNull()).alias("unscored"),
    )
    return sums.select(
        F.col("_weight").alias("tokens"), F.exp(mean_nll(sums)).alias("gen_ppl"), "unscored"
    )


def by_window(scores: DataFrame, keys: list[str], place: str = "i", lp: str = "lp") -> DataFrame:
    """A score table with a row per position as one with a row per window: ``lps``, the
    log-probabilities by place, null where there is none. A window is as long as a model's
    context, so a row is bounded."""
    found = F.map_from_entries(F.collect_list(F.struct(F.col(place).cast("int"), F.col(lp))))
    rows = scores.groupBy(*keys).agg(found.alias("_found"), F.max(F.col(place).cast("int")).alias("_last"))
    return rows.select(*keys, F.transform(F.sequence(F.lit(0), "_last"), lambda i: F.try_element_at("_found", i)).alias("lps"))


def counted_places(ids: Column, eos: int) -> Column:
    """Which tokens of a context window count, a flag each: what ``counted_tokens`` keeps."""

    @F.arrow_udf("array<boolean>")
    def counts(rows: pa.Array) -> pa.Array:
        values, lengths, null = batches.flat(rows)
        end = pc.fill_null(pc.equal(values, eos), False).to_numpy(zero_copy_only=False)
        at, first = batches.places(lengths), np.repeat(batches.firsts(end, lengths), lengths)
        known = values.is_valid().to_numpy(zero_copy_only=False)
        return batches.lists((at > 0) & ((~end & known) | (at == first)), lengths, null)

    return counts(ids)


def counted_ppl(windows: DataFrame, counts: Column, lps: Column) -> DataFrame:
    """``gen_ppl`` of context windows with the flags of ``counted_places`` and their
    log-probabilities, a row per window; positions behind the end of the log-probabilities,
    without a value or with NaN are unscored."""

    @F.arrow_udf("struct<n: long, scored: long, nll: double>")
    def add_up(flags: pa.Array, scores: pa.Array) -> pa.Array:
        values, lengths, _ = batches.flat(flags)
        counts = pc.fill_null(values, False).to_numpy(zero_copy_only=False)
        at, owner = batches.places(lengths), np.repeat(np.arange(len(lengths)), lengths)
        lp, held, _ = batches.flat(scores)
        lp = lp.to_numpy(zero_copy_only=False)
        found = counts & (at < held[owner])
        # null reads as NaN here
        value = lp[(batches.ends(held)[:-1][owner] + at)[found]]
        rest, owner_found = ~np.isnan(value), owner[found]
        total = lambda of, **weights: np.bincount(of, minlength=len(lengths), **weights)
        return pa.StructArray.from_arrays(
            [
                pa.array(total(owner[counts]), pa.int64()),
                pa.array(total(owner_found[rest]), pa.int64()),
                pa.array(total(owner_found[rest], weights=-value[rest]).astype(float)),
            ],
            names=["n", "scored", "nll"],
        )

    rows = windows.select(add_up(counts, lps.cast("array<double>")).alias("s")).select("s.*")
    sums = rows.agg(
        F.sum("nll").alias("_nll"),
        F.coalesce(F.sum("scored"), F.lit(0)).alias("_weight"),
        F.coalesce(F.sum(F.col("n") - F.col("scored")), F.lit(0)).alias("unscored"),
    )
    return sums.select(F.col("_weight").alias("tokens"), F.exp(mean_nll(sums)).alias("gen_ppl"), "unscored")


def window_ppl(windows: DataFrame, ids: str, eos: int, lps: str = "lps") -> DataFrame:
    """``gen_ppl`` of context windows with their log-probabilities beside the ids, a row per
    window; positions behind the end of ``lps``, without a value or with NaN are unscored."""
    return counted_ppl(windows, counted_places(F.col(ids), eos), F.col(lps))


def entropy_of_ids(ids: Column) -> Column:
    """Shannon entropy in bits of the token counts of one row.

    With n tokens and counts c it is log2(n) - sum(c * log2(c)) / n; the counts are
    the run lengths of the sorted ids.
    """

    return _entropy(ids)


@F.arrow_udf(T.DoubleType())
def _entropy(rows: pa.Array) -> pa.Array:
    values, lengths, null = batches.flat(rows)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    pairs = np.sort((owner << 32) | values.to_numpy(zero_copy_only=False).astype(np.uint32))
    starts = np.flatnonzero(np.diff(pairs, prepend=-1))
    counts = np.diff(starts, append=len(pairs)).astype(float)
    spread = np.bincount(pairs[starts] >> 32, counts * np.log2(counts), len(lengths))
    n = np.maximum(lengths, 1)
    return pa.array(np.log2(n) - spread / n, mask=null | (lengths == 0))


def sample_entropy(df: DataFrame, ids: str) -> DataFrame:
    """Unweighted mean over samples of their token entropy; no shuffle per token."""
    return df.agg(F.avg(entropy_of_ids(F.col(ids))).alias("entropy"))


def metric_time(df: DataFrame, start: str, end: str, by: list[str]) -> DataFrame:
    seconds = F.unix_micros(F.col(end).cast("timestamp")) - F.unix_micros(
        F.col(start).cast("timestamp")
    )
    return df.groupBy(*by).agg((F.avg(seconds) / F.lit(1e6)).alias("seconds"))


def nan_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """NaN count and flag of each score column, one row per column."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.isnan(c)).alias(c) for c in columns]
    )
    return counts.select(
        "_rows",
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("nans")) for c in columns])
        ).alias("c"),
    ).select(
        F.col("c.name").alias("name"),
        F.col("c.nans").alias("nans"),
        (F.col("c.nans") > 0).alias("any_nan"),
        F.col("_rows").alias("rows"),
    )


def topk_checkpoints(df: DataFrame, nll: str, step: str, k: int = 10) -> DataFrame:
    """The k rows with the smallest loss, plus the last row if it is not among them."""
    best = df.orderBy(nll, step).limit(k)
    last = df.orderBy(F.desc(step)).limit(1)
    return best.unionByName(last).distinct()


def every_n(df: DataFrame, step: str, n: int = 500) -> DataFrame:
    return df.where(F.col(step) % n == 0)


def sink_metrics(df: DataFrame, path: str) -> None:
    """Append metric rows to a metrics table."""
    df.write.mode("append").parquet(path)
