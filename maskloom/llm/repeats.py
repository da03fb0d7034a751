"""Which 64-bit keys occur more than once in the whole corpus.

Rows are dealt to segments of a few megabytes. A segment sends its distinct keys, as
packed numbers, to ranges of the key space; a range sends those that another segment
has as well (or that the segment itself has twice) back. A key that a third of all
rows share is therefore sent once per segment, not once per row. The exchange of the
texts is planned once and read again by every later step of the same query.

Packed keys keep 32 bits inside a range in the first, broad pass: the ranges grow with
the corpus, so about one key in a thousand is taken for a repeated one at any size.
Later passes keep all bits.

A segment sends at most ``FAN`` rows, whatever the size of the corpus. Where there are more
ranges than that, its rows go to coarse parts of the key space instead, and a hub, one per
coarse part and ``FAN`` segments, stands between segments and ranges: it has about as many
keys as a segment, asks the ranges of its part for their distinct ones, and hands the
answers to the segments they came from. Rows, like bytes, then grow with the corpus and
not with its square.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SEGMENT_BYTES = 2 << 20
RANGE_BYTES = 12 << 20
#: rows that a segment sends at most, up to FAN * FAN ranges (200 TB)
FAN = 4096

SENT = "range int, seg int, once binary, twice binary"
FOUND = "seg int, range int, keys binary, spread binary"
_SENT = pa.schema([("range", pa.int32()), ("seg", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])
_FOUND = pa.schema([("seg", pa.int32()), ("range", pa.int32()), ("keys", pa.binary()), ("spread", pa.binary())])


def text_bytes(docs: DataFrame, text: str) -> int:
    return docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0


def segmented(docs: DataFrame, row: str, text: str, size: int) -> DataFrame:
    """Adds ``seg`` and lays the rows out by it; ``size`` is the byte total of the texts."""
    segments = max(1, -(-size // SEGMENT_BYTES))
    return docs.withColumn("seg", F.pmod(F.xxhash64(row), F.lit(segments)).cast("int")).repartition("seg")


@dataclass(frozen=True)
class Ranges:
    """``count`` ranges of the key space, reached over hubs where there are more than ``fan``."""

    count: int
    fan: int

    @property
    def hubs(self) -> bool:
        return self.count > self.fan

    @property
    def coarse(self) -> int:
        """Ranges in a coarse part."""
        return -(-self.count // self.fan)


def ranges_for(size: int) -> Ranges:
    count = max(64, -(-size // RANGE_BYTES))
    return Ranges(count, max(FAN, isqrt(count - 1) + 1))


def range_of(keys: np.ndarray, ranges: Ranges) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(ranges.count)) >> np.uint64(32)


def _codes(keys: np.ndarray, ranges: Ranges, wide: bool) -> np.ndarray:
    """Keys as they are told apart: all bits, or the range and 32 bits inside it."""
    if wide:
        return keys
    return (range_of(keys, ranges) << np.uint64(32)) | (keys & np.uint64(0xFFFFFFFF))


def _ranges_of_codes(codes: np.ndarray, ranges: Ranges, wide: bool) -> np.ndarray:
    return (range_of(codes, ranges) if wide else codes >> np.uint64(32)).astype(np.int64)


def _inside(codes: np.ndarray, wide: bool) -> np.ndarray:
    """What a row to one range has to hold of a code."""
    return codes if wide else (codes & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _rows(where: np.ndarray, part: np.ndarray, again: np.ndarray, seg: int) -> pa.Table:
    """A row per value of ``where``, which is in order."""
    cuts = np.flatnonzero(np.diff(where, prepend=-1))
    rows = ([], [], [], [])
    for low, high in zip(cuts, [*cuts[1:], len(where)]):
        twice = again[low:high]
        rows[0].append(int(where[low]))
        rows[1].append(seg)
        rows[2].append(part[low:high][~twice].tobytes())
        rows[3].append(part[low:high][twice].tobytes())
    return pa.table(list(rows), schema=_SENT)


def packed(keys: np.ndarray, seg: int, ranges: Ranges, wide: bool) -> pa.Table:
    """The distinct keys of a segment, a row per range (or coarse part): those found once and
    those found again."""
    keys = np.sort(keys)
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    distinct = keys[new]
    again = np.diff(np.append(np.flatnonzero(new), len(keys))) > 1
    where = range_of(distinct, ranges).astype(np.int64)
    codes = _codes(distinct, ranges, wide)
    if ranges.hubs:
        return _rows(where // ranges.coarse, codes, again, seg)
    return _rows(where, _inside(codes, wide), again, seg)


def answered(
    sent: DataFrame, find: Callable, ranges: Ranges, wide: bool, adds: bool = True, owner: bool = False
) -> DataFrame:
    """The answers of ``find``, which is run once per range, for the segments that ask.

    Over hubs, a key that several segments of a hub have counts as found again if ``adds``;
    with ``owner``, the answer 1 is for the first segment that has the key, and 2 for others.
    """
    if not ranges.hubs:
        return sent.groupBy("range").applyInArrow(find, FOUND)
    fan = ranges.fan
    sent = sent.withColumn("hub", F.expr(f"int(seg div {fan}) * {fan} + range")).repartition("hub")

    def relay(key, table):
        once = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("once")]
        twice = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table.column("twice")])
        codes, count = np.unique(np.concatenate([*once, twice]), return_counts=True)
        again = count > 1 if adds else np.zeros(len(codes), bool)
        again[np.searchsorted(codes, twice)] = True
        return _rows(_ranges_of_codes(codes, ranges, wide), _inside(codes, wide), again, key[0].as_py())

    def hand_back(key, table, answers):
        # in the order of segments, so that the first one is the owner
        table = table.sort_by("seg")
        segs = table.column("seg").to_pylist()
        codes = [np.frombuffer(a.as_py() + b.as_py(), np.uint64) for a, b in zip(table.column("once"), table.column("twice"))]
        ends = np.cumsum([len(x) for x in codes])[:-1]
        own = np.concatenate([np.zeros(0, np.uint64), *codes])
        value = _looked_up(*_known(answers, wide), own)
        if owner:
            later = np.ones(len(own), bool)
            later[np.unique(own, return_index=True)[1]] = False
            value = np.where((value == 1) & later, 2, value).astype(np.uint32)
        rows = ([], [], [], [])
        for seg, part, spread in zip(segs, codes, np.split(value, ends)):
            ok = spread > 0
            if ok.any():
                rows[0].append(seg)
                rows[1].append(key[0].as_py() % fan)
                rows[2].append(part[ok].tobytes())
                rows[3].append(spread[ok].tobytes())
        return pa.table(list(rows), schema=_FOUND)

    asked = sent.groupBy("hub").applyInArrow(relay, SENT)
    answers = asked.groupBy("range").applyInArrow(find, FOUND).withColumnRenamed("seg", "hub")
    return sent.groupBy("hub").cogroup(answers.groupBy("hub")).applyInArrow(hand_back, FOUND)


def matched(sent: DataFrame, ranges: Ranges, wide: bool) -> DataFrame:
    """The repeated keys of each segment, and in how many segments (or hubs) each one occurs."""
    kind = np.uint64 if wide else np.uint32

    def find(key, table):
        segs = table.column("seg").to_pylist()
        once = [np.frombuffer(x.as_py(), kind) for x in table.column("once")]
        twice = [np.frombuffer(x.as_py(), kind) for x in table.column("twice")]
        keys = np.concatenate([*once, *twice])
        values, spread = np.unique(keys, return_counts=True)
        sure = np.zeros(len(values), bool)
        sure[np.searchsorted(values, np.concatenate(twice))] = True
        hit = (spread > 1) | sure
        values, spread = values[hit], np.minimum(spread[hit], 0xFFFFFFFF).astype(np.uint32)
        rows = ([], [], [], [])
        for seg, one, two in zip(segs, once, twice):
            own = np.concatenate([one, two])
            at = np.minimum(np.searchsorted(values, own), max(len(values) - 1, 0))
            ok = values[at] == own if len(values) else np.zeros(len(own), bool)
            if ok.any():
                rows[0].append(seg)
                rows[1].append(key[0].as_py())
                rows[2].append(own[ok].tobytes())
                rows[3].append(spread[at[ok]].tobytes())
        return pa.table(list(rows), schema=_FOUND)

    return answered(sent, find, ranges, wide)


def _known(found: pa.Table, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    """Codes and values of the answers that ranges give."""
    kind = np.uint64 if wide else np.uint32
    parts = [np.frombuffer(x.as_py(), kind).astype(np.uint64) for x in found.column("keys")]
    if not wide:
        parts = [(np.uint64(r) << np.uint64(32)) | p for r, p in zip(found.column("range").to_pylist(), parts)]
    spread = [np.frombuffer(x.as_py(), np.uint32) for x in found.column("spread")]
    return np.concatenate([np.zeros(0, np.uint64), *parts]), np.concatenate([np.zeros(0, np.uint32), *spread])


def _looked_up(known: np.ndarray, spread: np.ndarray, codes: np.ndarray) -> np.ndarray:
    if not len(known) or not len(codes):
        return np.zeros(len(codes), np.uint32)
    order = np.argsort(known)
    known, spread = known[order], spread[order]
    at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
    return np.where(known[at] == codes, spread[at], 0).astype(np.uint32)


def lookup(found: pa.Table, keys: np.ndarray, ranges: Ranges, wide: bool) -> np.ndarray:
    """For each key, the answer it got: 0 if there was none, as it occurs once in all."""
    if not found.num_rows or not len(keys):
        return np.zeros(len(keys), np.uint32)
    # hubs answer in whole codes
    return _looked_up(*_known(found, wide or ranges.hubs), _codes(keys, ranges, wide))
