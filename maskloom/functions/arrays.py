"""Small array helpers shared by the score and draw functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``.

    A column captured by a lambda may be inlined there by the optimizer and then
    runs once per element; a one-element array pins it to one evaluation per row.
    """
    return F.transform(F.array(value), body)[0]


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def argmax(values: Column) -> Column:
    """Zero-based index of the largest value, the smallest index on ties."""
    return let(values, lambda v: (F.array_position(v, F.array_max(v)) - 1).cast("int"))


def at(values: Column, index: Column) -> Column:
    """Element at a zero-based index."""
    return F.element_at(values, (index + 1).cast("int"))


def replace_at(values: Column, index: Column | int, value: Column | float) -> Column:
    where = index if isinstance(index, Column) else F.lit(index)
    new = value if isinstance(value, Column) else F.lit(float(value))
    return F.transform(values, lambda x, i: F.when(i == where, new).otherwise(x))
