"""Exact global ranks and prefix sums without a one-partition window.

Rows go into order-preserving buckets. Each bucket is ranked on its own, and the
bucket totals (a table whose length is bounded by the number of buckets) supply
the offsets. Buckets follow from the data alone, so retries cannot move a row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from maskloom.functions.rand import uniform

ROWS_PER_BUCKET = 10_000
COARSE_BUCKETS = 1024


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Deal rows over the partitions that ``spark.maskloom.inputPartitions`` asks for.

    For inputs in fewer splits than cores. Without the setting nothing is shuffled.
    """
    asked = df.sparkSession.conf.get("spark.maskloom.inputPartitions", None)
    return df.repartition(int(asked), key) if asked else df


@dataclass(frozen=True)
class Ranges:
    """Order-preserving buckets of a numeric key, cut at quantiles of the keys."""

    cuts: list[float]

    def add(self, df: DataFrame, key: str, name: str) -> DataFrame:
        if not self.cuts:
            return df.withColumn(name, F.lit(0))
        edges = [float("-inf"), *self.cuts, float("inf")]
        numeric = df.withColumn(name + "_in", F.col(key).cast("double"))
        cut = Bucketizer(splits=edges, inputCol=name + "_in", outputCol=name).transform(numeric)
        return cut.withColumn(name, F.col(name).cast("int")).drop(name + "_in")


def _wanted(df: DataFrame, rows: int, rows_per_bucket: int) -> int:
    """Buckets of about ``rows_per_bucket`` rows, and several per shuffle partition, which
    evens out how they hash to partitions."""
    parallel = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(16 * parallel, -(-rows // rows_per_bucket))


def ranges(
    df: DataFrame,
    key: str,
    rows_per_bucket: int = ROWS_PER_BUCKET,
    coarse_buckets: int = COARSE_BUCKETS,
) -> Ranges:
    """Buckets of equal row counts, whatever the gaps between the keys.

    Reads the key column only. Up to ``coarse_buckets`` quantiles come from one pass; more
    buckets are cut at the quantiles of each of these ranges, in a second pass.
    """
    shares = F.lit([i / coarse_buckets for i in range(1, coarse_buckets)])
    row = df.agg(
        F.count(key).alias("n"), F.percentile_approx(key, shares, 10 * coarse_buckets).alias("cuts")
    ).first()
    if not row["n"]:
        return Ranges([])
    wanted = _wanted(df, row["n"], rows_per_bucket)
    coarse = min(wanted, coarse_buckets)
    cuts = {float(row["cuts"][i * coarse_buckets // coarse - 1]) for i in range(1, coarse)}
    fine = -(-wanted // coarse)
    if fine > 1:
        inner = F.lit([i / fine for i in range(1, fine)])
        within = Ranges(sorted(cuts)).add(df.select(key), key, "_bucket").groupBy("_bucket")
        # as many numbers as there are buckets
        for part in within.agg(F.percentile_approx(key, inner, max(1000, 10 * fine)).alias("cuts")).collect():
            cuts.update(float(c) for c in part["cuts"] or [])
    return Ranges(sorted(cuts))


def _rank_in_buckets(
    df: DataFrame, order: list[Column], by: list[str], weight: Column | None, starts: DataFrame | None = None
) -> DataFrame:
    # a struct is never null itself, so groups with null keys are joined as well
    columns = df.columns
    df = df.withColumn("_by", F.struct(*by)) if by else df
    by = ["_by"] if by else []
    keys = [*by, "_bucket"]
    load = F.lit(0) if weight is None else weight
    totals = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(load.cast("long")).alias("bucket_weight")
    )
    earlier = (
        (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0)))
        .orderBy("_bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = totals.select(
        *keys,
        "bucket_weight",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_rows_before"),
        F.coalesce(F.sum("bucket_weight").over(earlier), F.lit(0)).alias("bucket_start"),
    )
    if starts is not None:
        # joined to the bucket totals, so the rows of a group do not meet
        first = starts.select(F.struct(*starts.columns[:-1]).alias("_by"), F.col(starts.columns[-1]).alias("_from"))
        offsets = (
            offsets.join(first, "_by", "left")
            .withColumn("bucket_start", F.col("bucket_start") + F.coalesce("_from", F.lit(0)))
            .drop("_from")
        )
    inside = Window.partitionBy(*keys).orderBy(*order)
    ranked_rows = df.withColumn("_rank", (F.row_number().over(inside) - 1).cast("long"))
    if weight is not None:
        running = F.sum(load.cast("long")).over(
            inside.rowsBetween(Window.unboundedPreceding, -1)
        )
        ranked_rows = ranked_rows.withColumn("_prefix", F.coalesce(running, F.lit(0)))
    # The rows are already laid out by bucket, so this join moves the offsets only;
    # adaptive execution broadcasts them when they turn out small.
    placed = ranked_rows.join(offsets, keys).withColumn(
        "rank", F.col("_rank") + F.col("_rows_before")
    )
    if weight is not None:
        placed = placed.withColumn("before", F.col("_prefix") + F.col("bucket_start"))
    added = ["rank", "bucket_weight", "bucket_start"] + ([] if weight is None else ["before"])
    return placed.select(*columns, *by, *added)


def ranked(
    df: DataFrame,
    key: str,
    by: list[str] | None = None,
    weight: Column | None = None,
    buckets: Ranges | None = None,
    keep_buckets: bool = False,
    starts: DataFrame | None = None,
) -> DataFrame:
    """Add the zero-based ``rank`` in the order of a unique, non-null numeric key.

    With ``weight`` also ``before``, the sum of the weights of all earlier rows.
    ``by`` ranks within groups; a group of any size is spread over the buckets.
    ``keep_buckets`` keeps ``_bucket`` and the weight span of its rows, and ``_by``, the struct
    of the group. ``starts`` has the columns of ``by`` and the weight that a group has already.
    """
    found = ranges(df, key) if buckets is None else buckets
    out = _rank_in_buckets(found.add(df, key, "_bucket"), [F.col(key)], by or [], weight, starts)
    return out if keep_buckets else out.drop("_by", "_bucket", "bucket_weight", "bucket_start")


def shuffled(
    df: DataFrame,
    seed: object,
    key: str,
    by: list[str] | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Add ``rank`` in a random order that depends on the seed and the key only.

    Without a number the hash buckets follow the row count.
    """
    if buckets is None:
        buckets = _wanted(df, df.count(), ROWS_PER_BUCKET)
    drawn = df.withColumn("_u", uniform(seed, key)).withColumn(
        "_bucket", F.floor(F.col("_u") * buckets).cast("int")
    )
    out = _rank_in_buckets(drawn, [F.col("_u"), F.col(key)], by or [], None)
    return out.drop("_u", "_by", "_bucket", "bucket_weight", "bucket_start")


def row_total(df: DataFrame) -> Column:
    """Number of rows, as a scalar subquery."""
    return df.agg(F.count(F.lit(1))).scalar()
