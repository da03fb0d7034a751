"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructField

from maskloom.session import scratch_path


def saved(df: DataFrame, label: str) -> DataFrame:
    """The rows of ``df``, written below ``spark.checkpoint.dir`` and read again.

    This cuts the lineage, fixes ids drawn on the way, and outlives lost executors.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """A unique row number; rows may repeat and their ids may be null."""
    return df.withColumn(name, F.monotonically_increasing_id())


def carried(docs: DataFrame, leave: Sequence[str]) -> tuple[list[Column], list[StructField], dict[str, str]]:
    """The caller's columns but ``leave`` under names that cannot clash with ours: the
    select list, the fields for a schema, and the new name of each."""
    kept = [f for f in docs.schema.fields if f.name not in leave]
    names = {f.name: f"own_{i}" for i, f in enumerate(kept)}
    select = [F.col(f"`{old}`").alias(new) for old, new in names.items()]
    return select, [StructField(names[f.name], f.dataType) for f in kept], names


def given_back(df: DataFrame, docs: DataFrame, names: dict[str, str], made: dict[str, str]) -> DataFrame:
    """The caller's columns in their order and under their names; ``made`` names the
    columns that replace or follow them."""
    back = {**names, **made}
    order = [c for c in docs.columns if c in back] + [c for c in made if c not in docs.columns]
    return df.select(*[F.col(back[c]).alias(c) for c in order])


def as_fields(column, kind):
    """An Arrow column with the declared type (nested null flags may differ)."""
    return column if column.type == kind else column.cast(kind)


def byte_slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices whose texts have about ``limit`` bytes, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    low, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if total and total + size > limit:
            yield batch.slice(low, i - low)
            low, total = i, 0
        total += size
    if low < batch.num_rows:
        yield batch.slice(low)


def rank_in_class(df: DataFrame, kind: str, key: str, out: str, rows_per_group: int = 50_000) -> DataFrame:
    """Zero-based rank of each row within its value of ``kind``.

    ``key`` is unique. A class of any size is spread over hash groups of about
    ``rows_per_group`` rows; the group totals supply the offsets.
    """
    groups = max(1, -(-df.count() // rows_per_group))
    df = df.withColumn("_group", F.pmod(F.xxhash64(key), F.lit(groups)).cast("int"))
    totals = df.groupBy(kind, "_group").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(kind).orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(kind, "_group", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(kind, "_group").orderBy(key)
    ranked = df.withColumn("_place", F.row_number().over(inside) - 1)
    return (
        ranked.join(starts, [kind, "_group"])
        .withColumn(out, (F.col("_place") + F.col("_start")).cast("long"))
        .drop("_group", "_place", "_start")
    )


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether every ``a`` has one ``b`` and no ``b`` is an ``a``; one exchange of node counts."""
    one, none = F.lit(1), F.lit(0)
    ends = edges.select(F.col("a").alias("node"), one.alias("out"), none.alias("into"))
    ends = ends.union(edges.select(F.col("b").alias("node"), none.alias("out"), one.alias("into")))
    nodes = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return nodes.where("out > 1 or (out > 0 and into > 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an edge table ``(a, b)`` of any orderable type.

    Returns ``(node, root)`` for every node that has an edge to another one; ``root``
    is the smallest node of its component. Alternates large-star and small-star
    rounds until the edges are stars around the roots; each round reads narrow rows and
    writes them to the shared folder, and only a count and a test reach the driver. Null
    ends and self loops are left out.
    """
    a, b = F.col("a"), F.col("b")
    # written first, so that long expressions of the caller are computed once
    edges = saved(edges.select("a", "b"), "edges")
    edges = (
        edges.where(a.isNotNull() & b.isNotNull() & (a != b))
        .select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        .distinct()
    )
    edges = saved(edges, "edges")
    while not _is_star_forest(edges):
        both = edges.select(a.alias("u"), b.alias("v")).union(edges.select(b.alias("u"), a.alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = (
            large.join(lowest, "a")
            .where(b != F.col("m"))
            .select(b.alias("a"), F.col("m").alias("b"))
        )
        edges = saved(moved.union(lowest.select("a", F.col("m").alias("b"))).distinct(), "edges")
    return edges.select(a.alias("node"), b.alias("root")).union(
        edges.select(b.alias("node"), b.alias("root")).distinct()
    )
