"""Substring deduplication by level-wise doubling.

Windows of a short length that occur once in the corpus are dropped; those that repeat
are extended to twice their length (the last step is cut to the wanted length) and
counted again, until the wanted length is reached or no candidate survives. A window of
2n words can only repeat if both its halves do, so a level looks at candidates only.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from maskloom.llm import repeats
from maskloom.llm.common import as_fields, carried, given_back, numbered
from maskloom.llm.words import Words, read_words, windows


def levels(first: int, window: int) -> list[int]:
    """Window lengths by doubling, the last one ``window``."""
    if not 1 <= first <= window:
        raise ValueError("first lies between 1 and window")
    sizes = [first]
    while sizes[-1] < window:
        sizes.append(min(2 * sizes[-1], window))
    return sizes


def _candidates(words: Words, ranges: repeats.Ranges, sizes: list[int], found: list[pa.Table]) -> np.ndarray:
    """Word positions whose window of ``sizes[len(found)]``, or of the last size, may still
    repeat, given the repeated windows of the levels so far."""
    last = len(sizes) - 1
    live = np.ones(len(words.hash), bool)
    for level, size in enumerate(sizes[: len(found) + 1]):
        value, room = windows(words, size)
        if level:
            half = sizes[level - 1]
            shifted = np.zeros(len(live), bool)
            shifted[: max(0, len(live) - (size - half))] = live[size - half :]
            live &= shifted
        live &= room
        if level < len(found):
            live[live] = repeats.lookup(found[level], value[live], ranges, level == last) > 0
    return live


def _table(table: pa.Table, name: str) -> list[bytes | None]:
    return [None if x is None else x.encode() for x in table.column(name).to_pylist()]


def repeated_words(
    docs: DataFrame, text: str = "text", window: int = 35, first: int = 18, output: str = "text"
) -> DataFrame:
    """Remove every word that lies in a window whose words also start anywhere else.

    Windows are ``window`` consecutive words of one row and are judged on the input,
    rows of the same table and other places in the same row alike. All columns of
    ``docs`` come back, one row per input row, with ``n_words``, ``n_removed`` and

    * ``output="text"``: ``text`` replaced by the kept words joined by one space, or as
      it was where nothing goes;
    * ``output="spans"``: ``removed``, the removed word ranges as ``[start, end)`` pairs;
    * ``output="sha256"``: ``kept_sha256``, the digest of the kept words joined by one space.

    The result is one lazy plan: a level is an exchange of packed keys, and the texts are
    exchanged once. Null and empty texts have no words; a null text
    stays null. Rows that repeat count as two places. An empty table gives an empty
    table. Columns of the caller travel under other names, so they cannot clash; an added
    column that the caller has already is replaced.
    """
    sizes = levels(first, window)
    last = len(sizes) - 1
    total = repeats.text_bytes(docs, text)
    ranges = repeats.ranges_for(total)
    added = ["n_words", "n_removed", {"text": text, "spans": "removed", "sha256": "kept_sha256"}[output]]
    select, fields, names = carried(docs, [*added, text])
    base = numbered(docs.select(*select, F.col(f"`{text}`").alias("text")), "row")
    laid = repeats.segmented(base, "row", "text", total)

    def send(level: int):
        def one(key, table, *found):
            if not table.num_rows:
                return repeats.packed(np.zeros(0, np.uint64), 0, ranges, True)
            words = read_words(_table(table, "text"))
            live = _candidates(words, ranges, sizes, list(found))
            value, _ = windows(words, sizes[level])
            return repeats.packed(value[live], key[0].as_py(), ranges, level == last)

        if level == 0:
            return lambda key, table: one(key, table)
        return lambda key, table, answers: one(key, table, *by_level(answers, level))

    def by_level(answers: pa.Table, count: int) -> list[pa.Table]:
        marks = np.array(answers.column("level").to_pylist(), dtype=np.int64)
        return [answers.filter(pa.array(marks == i)) for i in range(count)]

    found = None
    for level in range(len(sizes)):
        if level == 0:
            sent = laid.groupBy("seg").applyInArrow(send(0), repeats.SENT)
        else:
            both = laid.groupBy("seg").cogroup(found.groupBy("seg"))
            sent = both.applyInArrow(send(level), repeats.SENT)
        answers = repeats.matched(sent, ranges, level == last).withColumn("level", F.lit(level))
        found = answers if found is None else found.union(answers)

    kind = ArrayType(ArrayType(IntegerType())) if output == "spans" else StringType()
    shape = StructType(
        [*fields, StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("made", kind)]
    )
    target = to_arrow_schema(shape)

    def finish(key, table, answers):
        texts = _table(table, "text")
        words = read_words(texts)
        n = len(words.hash)
        live = _candidates(words, ranges, sizes, by_level(answers, len(sizes)))
        at = np.flatnonzero(live)
        delta = np.zeros(n + 1, np.int64)
        delta[at] += 1
        np.subtract.at(delta, at + window, 1)
        gone = np.cumsum(delta)[:n] > 0
        counts, removed, made = [], [], []
        for i, value in enumerate(texts):
            low, high = int(words.first[i]), int(words.first[i + 1])
            cut = gone[low:high]
            counts.append(high - low)
            removed.append(int(cut.sum()))
            if output == "spans":
                edge = np.flatnonzero(np.diff(cut.astype(np.int8), prepend=0, append=0))
                made.append([[int(a), int(b)] for a, b in zip(edge[0::2], edge[1::2])])
            elif output == "text" and not removed[-1]:
                made.append(None if value is None else value.decode())
            else:
                if removed[-1]:
                    keep = np.flatnonzero(~cut) + low
                    kept = b" ".join([words.data[a:b] for a, b in zip(words.start[keep].tolist(), words.end[keep].tolist())])
                else:
                    kept = b" ".join((value or b"").split())
                made.append(kept.decode() if output == "text" else hashlib.sha256(kept).hexdigest())
        own = [as_fields(table.column(f.name), target.field(f.name).type) for f in fields]
        values = [pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(made, target.field("made").type)]
        return pa.table([*own, *values], names=target.names)

    done = laid.groupBy("seg").cogroup(found.groupBy("seg")).applyInArrow(finish, shape)
    return given_back(done, docs, names, {added[2]: "made", "n_words": "n_words", "n_removed": "n_removed"})
