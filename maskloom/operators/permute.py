"""Random order as a keyed permutation of places, computed row by row.

Swap-or-not: each round pairs every place with another one, ``c - x`` modulo n, and a hash of
the greater of the two decides for both whether they change. A round is a permutation of
exactly n places, so no place is left out or met twice for any n, and no row has to move to
find its place. An epoch is another key.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, functions as F

from maskloom.functions.arrays import let
from maskloom.operators.order import ranked

ROUNDS = 48
#: a prime; products of two residues fit into 64 bits
PRIME = (1 << 31) - 1


def round_keys(seed: object, rounds: int = ROUNDS) -> list[tuple[int, int, int, int]]:
    """Offset and hash multipliers of each round."""
    out = []
    for r in range(rounds):
        digest = hashlib.sha256(f"{seed}|{r}".encode()).digest()
        numbers = [int.from_bytes(digest[8 * i : 8 * i + 8], "big") for i in range(4)]
        out.append((numbers[0] >> 4, *[(x >> 34) | 1 for x in numbers[1:]]))
    return out


def permuted(place: Column, n: Column, seed: object, rounds: int = ROUNDS) -> Column:
    """Where a place of [0, n) goes; places are below 2 ** 50."""
    keys = F.array(*[F.struct(*[F.lit(v).cast("long").alias(c) for c, v in zip("oabc", key)]) for key in round_keys(seed, rounds)])

    def swap(x: Column, other: Column, key: Column) -> Column:
        top = F.greatest(x, other)
        y = (top.bitwiseAND(F.lit(PRIME)) * key["a"] + F.shiftright(top, 31) * key["b"] + key["c"]) % PRIME
        bit = F.shiftright((y * y + key["c"]) % PRIME, 9).bitwiseAND(F.lit(1))
        return F.when(bit == 1, other).otherwise(x)

    def one(x: Column, key: Column) -> Column:
        return let(F.pmod(key["o"] - x, n), lambda other: swap(x, other, key))

    return F.when(n > 0, F.aggregate(keys, place.cast("long"), one))


def epoch_order(df: DataFrame, key: str, seed: int, epoch: int) -> DataFrame:
    """Adds ``rank``, the place of a row in the order of an epoch. The rows are ranked by their
    unique numeric key once; a table that keeps that rank needs no exchange for later epochs."""
    n = F.lit(df.count()).cast("long")
    return ranked(df, key).withColumn("rank", permuted(F.col("rank"), n, f"{seed}|{epoch}"))


def write_epoch(order: DataFrame, path: str, span: int, position: str = "position") -> None:
    """Write a dealt epoch in folders of ``span`` positions each, one task a folder."""
    placed = order.withColumn("span", F.floor(F.col(position) / F.lit(span)).cast("long"))
    placed.repartition("span").sortWithinPartitions("span", position).write.partitionBy("span").mode("overwrite").parquet(path)


def resumed(spark, path: str, counter: int, span: int, position: str = "position") -> DataFrame:
    """Rows of a written epoch that are left after ``counter`` positions; folders before the
    counter are not opened."""
    rows = spark.read.parquet(path)
    return rows.where((F.col("span") >= counter // span) & (F.col(position) >= counter)).drop("span")
