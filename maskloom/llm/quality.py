"""Quality rules with adaptive thresholds.

Each text gets a few counts. Their distribution in every language and source is kept in a
mergeable quantile sketch: counts per logarithmic bucket, so a quantile is right within
``ACCURACY`` and sketches of parts merge by adding, in any order and with the same result.
Rows that fail the fixed base rule are left out of the sketches. The fences of a language and
source come from its own sketch, or, where it has few rows, from the merged sketch of its
language or of the whole table; no fence is a fixed number. A join brings them back to the
rows.

An upper fence lies above a high quantile by twice the distance between that quantile and a
lower one. A source whose lower quantile is inside the fence of its language is an ordinary one,
and junk in it cannot lift its fence above that of the language; another source has habits
of its own and keeps its own fence. Word lengths have quartile fences on both sides.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from maskloom.llm.common import as_fields, byte_slices, carried, given_back, saved
from maskloom.llm.words import read_words, windows

ACCURACY = 0.01
GAMMA = (1 + ACCURACY) / (1 - ACCURACY)
ZERO = -(1 << 20)
#: a language and source needs so many rows for fences of its own
LEAST_ROWS = 200
#: the quantiles between which a fence is measured: the higher one plus so many times their distance
TAIL_REACH = 2.0
TAILS = {"symbols": ("q50", "q90"), "lines": ("q90", "q99"), "repeats": ("q90", "q99")}
#: fences of the word length lie this many quartile distances outside the quartiles
REACH = 3.0
QUANTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75, "q90": 0.9, "q99": 0.99}
#: the least event of a feature, which no fence can tell from none: a symbol, a line, a window of
#: three words found twice
UNITS = {"symbols": (1, "word_chars"), "lines": (1, "n_lines"), "repeats": (6, "n_words")}
FENCES = ["high_symbols", "high_lines", "high_repeats", "high_length", "low_length"]
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
BROADCAST_ROWS = 100_000

_SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\v\f\r"


def count_text(texts: list[str | None]) -> list[list[int]]:
    """The values of ``COUNTS`` for each text; a null text has zeros."""
    raw = [b"" if x is None else x.encode() for x in texts]
    words = read_words(raw)
    value, _ = windows(words, 3)
    sizes = words.end - words.start
    running = np.concatenate([[0], np.cumsum(sizes)])
    out = []
    for i, data in enumerate(raw):
        low, high = int(words.first[i]), int(words.first[i + 1])
        spaces = len(data) - int(running[high] - running[low])
        lines = [x for x in data.split(b"\n") if x.strip(_SPACES)]
        own = value[low : max(low, high - 2)]
        ordered = np.sort(own)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        repeated = 0
        if len(twice):
            at = np.flatnonzero(np.isin(own, twice))
            hit = np.zeros(high - low, bool)
            for step in range(3):
                hit[at + step] = True
            repeated = int(hit.sum())
        out.append(
            [
                high - low,
                len(texts[i] or "") - spaces,
                len(data) - len(data.translate(None, _SYMBOLS)),
                len(lines) - len(set(lines)),
                repeated,
                len(lines),
            ]
        )
    return out


def measure(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Adds ``COUNTS`` to every row, in a narrow stage over whole texts."""
    leave = [*COUNTS, *([] if keep_text else [text])]
    select, fields, names = carried(docs, leave)
    shape = StructType([*fields, *[StructField(c, LongType()) for c in COUNTS]])
    target = to_arrow_schema(shape)

    def read(batches):
        for batch in batches:
            for part in byte_slices(batch, "counted"):
                found = count_text(part.column("counted").to_pylist())
                own = [as_fields(part.column(f.name), target.field(f.name).type) for f in fields]
                counts = [pa.array(c, pa.int64()) for c in zip(*found)]
                yield pa.record_batch([*own, *counts], names=target.names)

    done = docs.select(*select, F.col(f"`{text}`").alias("counted")).mapInArrow(read, shape)
    return given_back(done, docs, names, {c: c for c in COUNTS})


def features() -> dict[str, Column]:
    return {
        "symbols": F.col("n_symbols") / F.greatest("word_chars", F.lit(1)),
        "lines": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "repeats": F.col("n_repeat_words") / F.greatest("n_words", F.lit(1)),
        "length": F.col("word_chars") / F.greatest("n_words", F.lit(1)),
    }


def base_failed() -> Column:
    """Fewer than 50 words, or over half of them in repeated three-word windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def sketch(measured: DataFrame, by: list[str]) -> DataFrame:
    """Bucket counts ``(by..., feature, bucket, n)`` of every feature over the rows that pass
    the base rule. Rows are added up before they are exchanged, so a hot group costs a task no
    more than its buckets."""
    values = [F.struct(F.lit(k).alias("feature"), v.cast("double").alias("v")) for k, v in features().items()]
    rows = measured.where(~base_failed()).select(*by, F.explode(F.array(*values)).alias("one"))
    bucket = F.when(F.col("one.v") <= 0, F.lit(ZERO)).otherwise(F.ceil(F.log("one.v") / math.log(GAMMA)).cast("int"))
    return rows.groupBy(*by, F.col("one.feature").alias("feature"), bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("n")
    )


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    return sketches.groupBy(*by, "feature", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, by: list[str]) -> DataFrame:
    """``n`` and ``QUANTILES`` of each group and feature."""
    group = Window.partitionBy(*by, "feature")
    rows = sketches.withColumn("seen", F.sum("n").over(group.orderBy("bucket"))).withColumn("all", F.sum("n").over(group))
    middle = F.when(F.col("bucket") == ZERO, F.lit(0.0)).otherwise(F.pow(F.lit(GAMMA), F.col("bucket")) * 2 / (1 + GAMMA))
    rows = rows.withColumn("v", middle)
    picked = [
        F.min(F.when(F.col("seen") >= F.ceil(F.col("all") * share), F.col("v"))).alias(name)
        for name, share in QUANTILES.items()
    ]
    return rows.groupBy(*by, "feature").agg(F.max("all").alias("n"), *picked)


def fences(measured: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """The fences of each language and source (null is a value of its own): columns ``lang``,
    ``source`` and ``FENCES``. Groups without a row that passes the base rule have none."""
    named = measured.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{source}`").alias("source"), *COUNTS)
    own = saved(sketch(named, ["lang", "source"]), "sketch")
    of_lang = merged(own, ["lang"])
    levels = [
        quantiles(own, ["lang", "source"]).alias("a"),
        quantiles(of_lang, ["lang"]).alias("b"),
        quantiles(merged(of_lang, []), []).alias("c"),
    ]
    both = levels[0].join(
        levels[1], F.col("a.lang").eqNullSafe(F.col("b.lang")) & (F.col("a.feature") == F.col("b.feature"))
    ).join(levels[2], F.col("a.feature") == F.col("c.feature"))
    few, few_lang = F.col("a.n") < LEAST_ROWS, F.col("b.n") < LEAST_ROWS
    wide = {q: F.when(few_lang, F.col(f"c.{q}")).otherwise(F.col(f"b.{q}")) for q in QUANTILES}
    near = {q: F.when(few, wide[q]).otherwise(F.col(f"a.{q}")) for q in QUANTILES}
    rows = both.select(
        "a.lang", "a.source", "a.feature", *[c.alias(q) for q, c in near.items()], *[c.alias(f"wide_{q}") for q, c in wide.items()]
    )

    def of(feature: str, value: Column) -> Column:
        return F.max(F.when(F.col("feature") == feature, value))

    out = []
    for feature, (low, high) in TAILS.items():
        narrow, broad = (F.col(p + high) + TAIL_REACH * (F.col(p + high) - F.col(p + low)) for p in ("", "wide_"))
        ordinary = F.col(low) <= broad
        out.append(of(feature, F.when(ordinary, F.least(narrow, broad)).otherwise(narrow)).alias(f"high_{feature}"))
    # copies of one text must not make a spread of nothing
    spread = F.greatest(F.col("q75") - F.col("q25"), F.col("wide_q75") - F.col("wide_q25"))
    out.append(of("length", F.col("q75") + REACH * spread).alias("high_length"))
    out.append(of("length", F.col("q25") - REACH * spread).alias("low_length"))
    return rows.groupBy("lang", "source").agg(*out)


def within() -> dict[str, Column]:
    """For each feature, whether a row lies inside its fences; a sketch is right within a
    bucket, and a single event passes."""
    out = {}
    for name, (unit, total) in UNITS.items():
        room = F.greatest(F.col(f"high_{name}") * GAMMA, unit / F.greatest(total, F.lit(1)))
        out[name] = F.coalesce(features()[name] <= room, F.lit(True))
    length = features()["length"]
    inside = (length <= F.col("high_length") * GAMMA) & (length >= F.col("low_length") / GAMMA)
    return {**out, "length": F.coalesce(inside, F.lit(True))}


def fenced(measured: DataFrame, limits: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """``measured`` under names that cannot clash (``own_<i>``), beside its counts and fences."""
    select, _, names = carried(measured, COUNTS)
    rows = measured.select(*select, *COUNTS)
    few = limits.count() <= BROADCAST_ROWS
    same = F.col(names[lang]).eqNullSafe(F.col("lang")) & F.col(names[source]).eqNullSafe(F.col("source"))
    return rows.join(F.broadcast(limits) if few else limits, same, "left")


def judged(measured: DataFrame, limits: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Adds ``base_failed`` and ``kept`` (no base failure, all features inside the fences)."""
    _, _, names = carried(measured, COUNTS)
    inside = within()
    kept = ~base_failed() & inside["symbols"] & inside["lines"] & inside["repeats"] & inside["length"]
    rows = fenced(measured, limits, lang, source).withColumn("made_failed", base_failed()).withColumn("made_kept", kept)
    return given_back(
        rows, measured, {**names, **{c: c for c in COUNTS}}, {"base_failed": "made_failed", "kept": "made_kept"}
    )


def rejections(measured: DataFrame, limits: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Per language and source: rows, rows that fail the base rule, and of the others those that
    lie outside the fences of each feature, beside the fences."""
    rows = fenced(measured, limits, lang, source)
    _, _, names = carried(measured, COUNTS)
    groups = rows.groupBy(F.col(names[lang]).alias("lang"), F.col(names[source]).alias("source"))
    out = [F.count_if(~base_failed() & ~ok).alias(f"out_{k}") for k, ok in within().items()]
    return groups.agg(F.count(F.lit(1)).alias("n"), F.count_if(base_failed()).alias("base_failed"), *out, *[F.max(c).alias(c) for c in FENCES])


def rules(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``COUNTS``, ``base_failed`` and ``kept``.

    Every row and the whole of every text counts, in the sketches too. Null and empty texts
    have no words and fail. Null languages and sources are groups of their own. Equal rows
    get equal results; columns of the caller with an added name are replaced; an empty table
    gives an empty table. With ``keep_text`` the texts are read twice, without it the counts
    are written once and read again.
    """
    if keep_text:
        counts = measure(docs.select(*dict.fromkeys([f"`{lang}`", f"`{source}`", f"`{text}`"])), text, keep_text=False)
        return judged(measure(docs, text), fences(counts, lang, source), lang, source)
    counts = saved(measure(docs, text, keep_text=False), "counts")
    return judged(counts, fences(counts, lang, source), lang, source)


def passing(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``docs`` that ``rules`` keeps, with the caller's columns only, also those
    that have a name of ours."""
    select, _, names = carried(docs, [])
    back = [F.col(new).alias(old) for old, new in names.items()]
    return rules(docs.select(*select), names[text], names[lang], names[source]).where("kept").select(*back)
