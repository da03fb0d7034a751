"""Exponential moving average with warm-up, per key.

One update is s -> d*s + (1-d)*p, an affine map, and affine maps compose. A key of
any size is therefore cut in chunks: chunks are folded on their own, the chunk maps
are chained level by level, and each chunk is replayed from its starting value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from maskloom.operators.order import ranked

# a replayed chunk copies its prefix at every step, so chunks are short and levels three
CHUNK = 64
LEVELS = 2


def decay_at(k: Column, decay: float) -> Column:
    """Decay of update k = 1, 2, ...; row 0 is the starting value itself."""
    return F.when(k == 0, F.lit(0.0)).otherwise(F.least(F.lit(decay), (k + 1) / (k + 10)))


def _compose(maps: Column) -> Column:
    """One map a*s + b for a sequence of maps, the first applied first."""
    return F.aggregate(
        maps,
        F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b")),
        lambda acc, m: F.struct(
            (acc["a"] * m["a"]).alias("a"), (acc["b"] * m["a"] + m["b"]).alias("b")
        ),
    )


def _as_maps(items: Column, decay: float) -> Column:
    def one(x: Column) -> Column:
        d = decay_at(x["k"], decay)
        return F.struct(d.alias("a"), ((F.lit(1.0) - d) * x["value"]).alias("b"))

    return F.transform(items, one)


def _replay(items: Column, start: Column, decay: float) -> Column:
    """The values after each update of a chunk."""

    def step(acc: Column, x: Column) -> Column:
        s = F.element_at(acc, -1)["shadow"]
        moved = s - (F.lit(1.0) - decay_at(x["k"], decay)) * (s - x["value"])
        return F.concat(acc, F.array(F.struct(x["k"].alias("k"), moved.alias("shadow"))))

    opening = F.array(F.struct(F.lit(-1).cast("long").alias("k"), start.alias("shadow")))
    return F.slice(F.aggregate(items, opening, step), F.lit(2), F.size(items))


def _chained(maps: DataFrame, by: list[str], chunk: int, levels: int) -> DataFrame:
    """Add ``start``, the composition of all earlier maps of the key, to (by..., c, a, b)."""
    if levels == 0:
        before = Window.partitionBy(*by).orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
        return maps.withColumn("start", _compose(F.collect_list(F.struct("a", "b")).over(before)))
    grouped = maps.withColumn("_g", F.floor(F.col("c") / chunk).cast("long"))
    upper = grouped.groupBy(*by, "_g").agg(
        _compose(F.sort_array(F.collect_list(F.struct("c", "a", "b")))).alias("m")
    )
    upper = upper.select(
        *by, F.col("_g").alias("c"), F.col("m.a").alias("a"), F.col("m.b").alias("b")
    )
    above = _chained(upper, by, chunk, levels - 1).select(
        *by, F.col("c").alias("_g"), F.col("start").alias("_above")
    )
    inside = (
        Window.partitionBy(*by, "_g").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    )
    local = grouped.withColumn("_local", F.collect_list(F.struct("a", "b")).over(inside))
    start = _compose(F.concat(F.array(F.col("_above")), F.col("_local")))
    return local.join(above, [*by, "_g"]).withColumn("start", start).drop("_g", "_above", "_local")


def ema_warmup(
    df: DataFrame,
    by: list[str],
    order: str,
    value: str,
    decay: float = 0.9999,
    state: DataFrame | None = None,
    chunk: int = CHUNK,
    levels: int = LEVELS,
) -> DataFrame:
    """The moving average after every row: ``(by..., k, shadow)``.

    ``order`` is a unique numeric key. ``state`` holds the last ``(by..., k, shadow)``
    of keys seen before; a new key starts with its first value as k = 0. The top
    level of the chain has rows / chunk ** (levels + 1) entries per key.
    """
    # a struct is never null itself, so keys with nulls survive the joins
    names, by = by, ["_key"]
    whole = F.struct(*names).alias("_key")
    steps = ranked(df.select(whole, order, value), order, by=by)
    if state is None:
        steps = steps.withColumn("_s", F.lit(0.0)).withColumn("k", F.col("rank"))
    else:
        last = state.select(whole, F.col("k").alias("_k"), F.col("shadow").alias("_s"))
        steps = (
            steps.join(last, by, "left")
            .withColumn("k", F.col("rank") + F.coalesce(F.col("_k") + 1, F.lit(0)))
            .withColumn("_s", F.coalesce("_s", F.lit(0.0)))
        )
    # a chunk holds at most ``chunk`` rows of one key
    chunks = (
        steps.withColumn("c", F.floor(F.col("rank") / chunk).cast("long"))
        .groupBy(*by, "c")
        .agg(
            F.sort_array(
                F.collect_list(F.struct("k", F.col(value).cast("double").alias("value")))
            ).alias("items"),
            F.first("_s").alias("_s"),
        )
    )
    maps = chunks.select(*by, "c", _compose(_as_maps(F.col("items"), decay)).alias("m")).select(
        *by, "c", F.col("m.a").alias("a"), F.col("m.b").alias("b")
    )
    starts = _chained(maps, by, chunk, levels).select(*by, "c", "start")
    begin = F.col("start.a") * F.col("_s") + F.col("start.b")
    return (
        chunks.join(starts, [*by, "c"])
        .select(*by, F.explode(_replay(F.col("items"), begin, decay)).alias("e"))
        .select(*[F.col(f"_key.{name}") for name in names], "e.k", "e.shadow")
    )
