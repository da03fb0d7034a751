"""Randomness as a pure function of a seed and row keys.

Nothing depends on partitioning, retries or row order, and any SQL engine with
md5 can reproduce the numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F, types as T

from maskloom.functions import batches
from maskloom.functions.batches import digests

_TWO_32 = float(1 << 32)
_TWO_52 = float(1 << 52)


def key_text(seed: object, keys: tuple[Column | str, ...]) -> Column:
    """What a digest is made of."""
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])


def _digest(seed: object, keys: tuple[Column | str, ...]) -> Column:
    return F.md5(key_text(seed, keys))


def uniform(seed: object, *keys: Column | str) -> Column:
    """52-bit uniform in [0, 1)."""
    head = F.conv(F.substring(_digest(seed, keys), 1, 13), 16, 10).cast("long")
    return head / F.lit(_TWO_52)


def uniform_open(seed: object, *keys: Column | str) -> Column:
    """52-bit uniform in (0, 1), safe below a logarithm."""
    head = F.conv(F.substring(_digest(seed, keys), 1, 13), 16, 10).cast("long")
    return (head + F.lit(0.5)) / F.lit(_TWO_52)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _uniform_each(keys: pa.Array, n: pa.Array) -> pa.Array:
    lengths = pc.fill_null(n, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    high, low, *_ = digests(keys, lengths).astype(np.int64)
    # the first 13 hex digits
    return batches.lists(((high << 20) | (low >> 12)) / _TWO_52, lengths)


def uniform_each(seed: object, keys: list[Column | str], n: Column) -> Column:
    """``uniform(seed, *keys, i)`` for each i below ``n``."""
    return _uniform_each(key_text(seed, tuple(keys)), n)


def hex_lanes(seed: object, keys: list[Column | str], n: Column) -> Column:
    """``n`` random 32-bit numbers for one row, as strings of eight hex digits.

    One digest feeds four neighbouring positions, which takes three quarters off
    the hashing of long sequences.
    """
    last = F.greatest(F.floor((n - 1) / F.lit(4)).cast("int"), F.lit(0))
    digests = F.transform(F.sequence(F.lit(0), last), lambda g: _digest(seed, (*keys, g)))
    lanes = F.flatten(
        F.transform(
            digests,
            lambda d: F.array(*[F.substring(d, 1 + 8 * lane, 8) for lane in range(4)]),
        )
    )
    return F.slice(lanes, F.lit(1), n.cast("int"))


def uniforms(seed: object, keys: list[Column | str], n: Column) -> Column:
    """``n`` 32-bit uniforms in (0, 1) for one row."""
    return F.transform(
        hex_lanes(seed, keys, n),
        lambda h: (F.conv(h, 16, 10).cast("long") + F.lit(0.5)) / F.lit(_TWO_32),
    )


def hex_threshold(chance: Column) -> Column:
    """The bound for which ``lane < bound`` is the same as ``uniform < chance``.

    Hex digits of equal length compare like the numbers, so no lane is parsed.
    """
    bound = F.ceil(chance * F.lit(_TWO_32) - F.lit(0.5))
    return F.when(bound >= F.lit(1 << 32), F.lit("g")).otherwise(
        F.lpad(F.lower(F.hex(F.greatest(bound, F.lit(0)))), 8, "0")
    )
