"""Checks on run settings held in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def config_violations(df: DataFrame) -> DataFrame:
    """Add ``violations``, the names of the broken rules of each run.

    Expects parameterization, T, importance_sampling, change_of_variables and
    subs_masking columns.
    """
    kind = F.col("parameterization")
    steps = F.col("T")
    rules = {
        "one_variance_reduction": ~(F.col("change_of_variables") & F.col("importance_sampling")),
        "sedd_plain": (kind != "sedd")
        | ~(F.col("importance_sampling") | F.col("change_of_variables")),
        "d3pm_discrete": (kind != "d3pm") | (steps > 0),
        "discrete_kinds": (steps <= 0) | kind.isin("d3pm", "subs"),
        "subs_masking_d3pm": ~F.col("subs_masking") | (kind == "d3pm"),
    }
    found = [F.when(~ok, F.lit(name)) for name, ok in rules.items()]
    return df.withColumn("violations", F.array_compact(F.array(*found)))
