"""Registered queries and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from maskloom.functions import batches

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def r6(value: Column | str) -> Column:
    """Six decimals, because engines add doubles in different orders."""
    return F.round(value, 6)


def joined(ids: Column | str) -> Column:
    """An id array as one string."""
    column = F.col(ids) if isinstance(ids, str) else ids
    return F.array_join(column.cast("array<string>"), " ")


def joined_batch(ids: Column | str) -> Column:
    """``joined`` over whole Arrow batches, for ids that come out of an Arrow function."""

    @F.arrow_udf("string")
    def join(rows: pa.Array) -> pa.Array:
        return batches.in_slices(rows, batches.joined)

    return join(F.col(ids) if isinstance(ids, str) else ids)


def s6(value: str) -> str:
    return f"(round({value}, 6) + 0.0)"


def sql_u(seed: object, *keys: str) -> str:
    """SQL of ``uniform``."""
    text = ", ".join(["'|'", f"'{seed}'", *keys])
    return f"(('0x' || substr(md5(concat_ws({text})), 1, 13))::BIGINT / 4503599627370496::DOUBLE)"


def sql_u_open(seed: object, *keys: str) -> str:
    """SQL of ``uniform_open``."""
    text = ", ".join(["'|'", f"'{seed}'", *keys])
    head = f"('0x' || substr(md5(concat_ws({text})), 1, 13))::BIGINT"
    return f"(({head} + 0.5::DOUBLE) / 4503599627370496::DOUBLE)"


def sql_lane(seed: object, index: str, *keys: str) -> str:
    """SQL of element ``index`` of ``uniforms``."""
    text = ", ".join(["'|'", f"'{seed}'", *keys, f"({index}) // 4"])
    head = f"('0x' || substr(md5(concat_ws({text})), 1 + 8 * (({index}) % 4), 8))::BIGINT"
    return f"(({head} + 0.5::DOUBLE) / 4294967296::DOUBLE)"
