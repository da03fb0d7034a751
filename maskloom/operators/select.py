"""The first k rows of an order without ranking the rest.

The k-th value is found by histograms: one pass counts the rows of a few thousand buckets
between the least and the greatest value, and the next one looks only into the bucket that
holds the k-th row. What is left is a comparison with that value, in a narrow stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BUCKETS = 4096


def kth(df: DataFrame, value: str, k: int, buckets: int = BUCKETS) -> tuple[object, int, int]:
    """The k-th smallest number of a column (from 1), how many rows are smaller, and how many
    equal it. Nulls do not count. Each pass exchanges a row per bucket and task; the bucket of
    the least value differs from that of the greatest, so passes come to an end for any values."""
    rows = df.select(F.col(value).alias("v")).where("v is not null")
    ends = rows.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("v").alias("n")).first()
    if not 1 <= k <= ends["n"]:
        raise ValueError(f"{k} is not between 1 and the {ends['n']} rows")
    low, high, n, before = ends["low"], ends["high"], ends["n"], 0
    while low != high:
        share = (F.col("v") - F.lit(low)).cast("double") / F.lit(float(high - low))
        place = F.least(F.floor(share * buckets), F.lit(buckets - 1))
        found = (
            rows.where((F.col("v") >= F.lit(low)) & (F.col("v") <= F.lit(high)))
            .groupBy(place.alias("place"))
            .agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
            .orderBy("place")
            .collect()
        )
        for row in found:
            if before + row["n"] >= k:
                low, high, n = row["low"], row["high"], row["n"]
                break
            before += row["n"]
    return low, before, n


def first_rows(df: DataFrame, order: list[str], k: int) -> Column:
    """Whether a row is among the first ``k`` by numeric columns, the last of which is unique;
    a later column is looked at only where rows are equal in the ones before."""
    column = F.col(order[0])
    if k <= 0:
        return F.lit(False)
    value, before, equal = kth(df, order[0], k)
    if before + equal == k or len(order) == 1:
        return column <= F.lit(value)
    ties = df.where(column == F.lit(value))
    return (column < F.lit(value)) | ((column == F.lit(value)) & first_rows(ties, order[1:], k - before))
