"""Removal of repeated byte strings by distributed prefix doubling over sampled suffixes.

A suffix array sorts suffixes by the ranks of their prefixes, pairs them with the ranks some
bytes further on, and sorts again, until ranks are unique or the prefix is long enough. Here
Spark sorts names of prefixes over the whole corpus, and whatever is unique leaves at once:

* Every window of ``window`` bytes picks one of the places in it by content (the least hash of
  a few bytes), so equal windows pick the same place. The windows that pick one place are
  dealt to blocks by their distance from it, and the bytes that all windows of a block share
  are its core. Round one sorts the names of the cores. A block whose core is unique is done.
* Round two sorts the names of all bytes that the windows of a block cover. Where these
  occur again, every window of the block is repeated.
* Round three sorts pairs, the names of the two halves of a window, for the blocks that are
  unique as a whole although their core is not (ends of repeats), and for one copy of each
  repeated block that such a block can agree with.

Names are 64-bit fingerprints in place of dense ranks: they say the same about equality and
need no trip back to be handed out. Each round sends packed names to ranges of the name
space and gets the repeated ones back (``repeats``), so a string that a third of all texts
share travels once per segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from maskloom.llm import repeats
from maskloom.llm.common import as_fields, carried, given_back, numbered
from maskloom.llm.words import mixed

_U = np.uint64
_HIGH = _U(0xFFFFFFFF00000000)
_LOW = _U(0xFFFFFFFF)
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_BYTE = np.random.Generator(np.random.PCG64(12)).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
#: bytes of text that are hashed at a time
PIECE = 2 << 20
#: bytes whose hash picks a place
GRAM = 16
BLOCK = np.dtype([("row", "<i8"), ("low", "<i8"), ("n", "<i4"), ("state", "<i4"), ("core", "<u8"), ("all", "<u8")])
WHOLE, LENT, OPEN = 0, 1, 2
SPANS = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))


class Names:
    """Fingerprints of any substring of some bytes; equal strings have equal names anywhere."""

    def __init__(self, data: bytes):
        codes = np.frombuffer(data, np.uint8)
        up = np.full(len(codes), _ODD, np.uint64)
        up[:1] = 1
        np.multiply.accumulate(up, out=up)
        self.total = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(_BYTE[codes] * up, dtype=np.uint64, out=self.total[1:])
        self.back = np.full(len(codes) + 1, _INVERSE, np.uint64)
        self.back[0] = 1
        np.multiply.accumulate(self.back, out=self.back)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.total[end] - self.total[start]) * self.back[start])

    def grams(self, size: int) -> np.ndarray:
        """Names of the ``size`` bytes from every place on."""
        return mixed((self.total[size:] - self.total[:-size]) * self.back[: len(self.total) - size])


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of ``width`` values from each place on."""
    n = len(values)
    grid = np.full((-(-n // width), width), ~_U(0))
    grid.ravel()[:n] = values
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def _pieces(rows: list[int], texts: list[bytes | None], window: int) -> Iterator[tuple[bytes, list[tuple[int, int, int, int]]]]:
    """Bytes to hash together and the stretches in them: row, place in its text, place in the
    bytes, length. Each window of a text lies in one stretch of one piece."""
    parts: list[bytes] = []
    marks: list[tuple[int, int, int, int]] = []
    size = 0
    for row, text in zip(rows, texts):
        if text is None or len(text) < window:
            continue
        for low in range(0, len(text) - window + 1, PIECE):
            part = text[low : low + PIECE + window - 1]
            marks.append((row, low, size, len(part)))
            parts.append(part)
            size += len(part)
            if size >= PIECE:
                yield b"".join(parts), marks
                parts, marks, size = [], [], 0
    if parts:
        yield b"".join(parts), marks


def blocks_of(data: bytes, marks: list[tuple[int, int, int, int]], window: int) -> np.ndarray:
    """The blocks of windows: row, first window, number of windows, names of the core and of
    all bytes."""
    sample, spread = window // 4, max(1, window * 4 // 25)
    gram, width = min(GRAM, sample), window - sample + 1
    names = Names(data)
    order = (names.grams(gram) & _HIGH) | np.arange(len(data) - gram + 1, dtype=np.uint64)
    # the place that the window from each place on picks: the first one with the least hash
    pick = (least(order[: len(data) - sample + 1], width) & _LOW).astype(np.int64)
    at = np.concatenate([np.arange(place, place + size - window + 1) for _, _, place, size in marks])
    which = np.repeat(np.arange(len(marks)), [size - window + 1 for *_, size in marks])
    pick = pick[at]
    group = (pick - at) // spread
    new = np.ones(len(at), bool)
    new[1:] = (pick[1:] != pick[:-1]) | (group[1:] != group[:-1]) | (which[1:] != which[:-1])
    cut = np.flatnonzero(new)
    out = np.zeros(len(cut), BLOCK)
    low, pick, group, which = at[cut], pick[cut], group[cut], which[cut]
    out["n"] = np.diff(np.append(cut, len(at)))
    row, start, place, _ = np.array(marks).T
    out["row"], out["low"] = row[which], low - place[which] + start[which]
    nearest, farthest = group * spread, np.minimum((group + 1) * spread, width) - 1
    out["core"] = mixed(names.of(pick - nearest, pick - farthest + window) + group.astype(np.uint64))
    out["all"] = names.of(low, low + out["n"] - 1 + window)
    return out


def _all_blocks(table: pa.Table, window: int) -> Iterator[np.ndarray]:
    texts = table.column("text").to_pylist()
    for data, marks in _pieces(table.column("row").to_pylist(), texts, window):
        yield blocks_of(data, marks, window)


def _window_names(table: pa.Table, blocks: np.ndarray, window: int) -> np.ndarray:
    """Names of the pairs of halves of all windows of some blocks, one after the other."""
    place = {row: i for i, row in enumerate(table.column("row").to_pylist())}
    texts = table.column("text")
    half = window // 2
    out = []
    size = blocks["n"].astype(np.int64) - 1 + window
    batch = np.cumsum(size) // PIECE
    for cut in np.split(np.arange(len(blocks)), np.flatnonzero(np.diff(batch)) + 1):
        if not len(cut):
            continue
        own, parts = blocks[cut], []
        last, text = None, None
        for row, low, n in zip(own["row"].tolist(), own["low"].tolist(), size[cut].tolist()):
            if row != last:
                last, text = row, texts[place[row]].as_buffer()
            parts.append(text[low : low + n].to_pybytes())
        names = Names(b"".join(parts))
        start = np.cumsum(size[cut]) - size[cut]
        counts = own["n"].astype(np.int64)
        at = np.repeat(start - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        first, second = names.of(at, at + half), names.of(at + half, at + window)
        out.append(mixed(first * _U(3) + second))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _ranges_answer(sent: DataFrame, decide, ranges: repeats.Ranges) -> DataFrame:
    """Answers of the ranges: ``decide`` gets, for the distinct keys that a range holds, the
    segments and flags of each entry, and returns which entries are answered and how."""

    def find(key, table):
        segs = table.column("seg").to_numpy()
        once = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("once")]
        twice = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("twice")]
        keys = np.concatenate([x for pair in zip(once, twice) for x in pair])
        sizes = np.array([n for a, b in zip(once, twice) for n in (len(a), len(b))])
        seg = np.repeat(np.repeat(segs, 2), sizes)
        flag = np.repeat(np.tile([False, True], len(segs)), sizes)
        hit, value = decide(keys, seg, flag)
        order = np.flatnonzero(hit)[np.argsort(seg[hit], kind="stable")]
        rows = ([], [], [], [])
        for part in np.split(order, np.flatnonzero(np.diff(seg[order])) + 1):
            if len(part):
                rows[0].append(int(seg[part[0]]))
                rows[1].append(key[0].as_py())
                rows[2].append(keys[part].tobytes())
                rows[3].append(value[part].astype(np.uint32).tobytes())
        return pa.table(list(rows), schema=repeats._FOUND)

    return repeats.answered(sent, find, ranges, True, adds=decide is _repeated, owner=decide is _repeated)


def _repeated(keys, seg, flag):
    """Keys in more than one segment or twice in one; 1 for the first segment that has one, else 2."""
    _, place, count = np.unique(keys, return_inverse=True, return_counts=True)
    sure = np.zeros(len(count), bool)
    sure[place[flag]] = True
    owner = np.full(len(count), np.iinfo(np.int64).max)
    np.minimum.at(owner, place, seg)
    return ((count > 1) | sure)[place], np.where(owner[place] == seg, 1, 2)


def _flagged(keys, seg, flag):
    """Keys that any segment has flagged."""
    _, place = np.unique(keys, return_inverse=True)
    some = np.zeros(place.max(initial=-1) + 1, bool)
    some[place[flag]] = True
    return some[place], np.ones(len(keys))


def _blocks(table: pa.Table, column: str) -> np.ndarray:
    parts = [np.frombuffer(x.as_py(), BLOCK) for x in table.column(column)]
    return np.concatenate([np.zeros(0, BLOCK), *parts])


def _at(answers: pa.Table, level: int) -> pa.Table:
    return answers.filter(pa.array(np.array(answers.column("level").to_pylist(), np.int64) == level))


def _merged(spans: np.ndarray) -> np.ndarray:
    """Spans that overlap or touch become one."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.ones(len(spans), bool)
    new[1:] = spans[1:, 0] > reach[:-1]
    cut = np.flatnonzero(new)
    return np.stack([spans[cut, 0], reach[np.append(cut[1:], len(spans)) - 1]], axis=1)


def repeated_bytes(docs: DataFrame, text: str = "text", window: int = 400) -> DataFrame:
    """Remove every byte that lies in a string of ``window`` bytes which also starts anywhere else.

    Texts are their UTF-8 bytes; strings lie within one row and are judged on the input, rows of
    the table and other places of the same row alike, overlapping ones too. All columns of
    ``docs`` but ``text`` come back, one row per input row, with ``n_bytes``, ``n_removed``,
    ``spans`` (the maximal removed byte ranges ``[start, end)`` in order) and ``kept`` (binary,
    the other bytes; a cut may fall inside a character).

    One lazy plan; the texts are exchanged once. Texts are hashed ``PIECE`` bytes at a time, so
    a very long one needs little more memory than its bytes. Null and empty texts have no bytes
    and an empty ``kept``. Rows that repeat are two places, so equal texts of at least
    ``window`` bytes go entirely. An empty table gives an empty table. Columns of the caller
    travel under other names, so they cannot clash; one with an added name is replaced.
    """
    if window < 8:
        raise ValueError("window is 8 or more")
    added = ["n_bytes", "n_removed", "spans", "kept"]
    total = repeats.text_bytes(docs, text)
    ranges = repeats.ranges_for(total)
    select, fields, names = carried(docs, [*added, text])
    base = numbered(docs.select(*select, F.col(f"`{text}`").cast("binary").alias("text")), "row")
    laid = repeats.segmented(base, "row", "text", total)

    def send_cores(key, table):
        cores = [b["core"] for b in _all_blocks(table, window)]
        return repeats.packed(np.concatenate([np.zeros(0, np.uint64), *cores]), key[0].as_py(), ranges, False)

    def one_row(seg, blocks):
        return pa.table([pa.array([seg], pa.int32()), pa.array([blocks.tobytes()], pa.binary())], names=["seg", "blocks"])

    def alive_blocks(key, table, found):
        left = [np.zeros(0, BLOCK)]
        for blocks in _all_blocks(table, window):
            left.append(blocks[repeats.lookup(found, blocks["core"], ranges, False) > 0])
        return one_row(key[0].as_py(), np.concatenate(left))

    def send_all(key, table):
        return repeats.packed(_blocks(table, "blocks")["all"], key[0].as_py(), ranges, True)

    def send_open_cores(key, table, found):
        blocks = _blocks(table, "blocks")
        single = repeats.lookup(found, blocks["all"], ranges, True) == 0
        # a flag is a key sent twice
        keys = [np.unique(blocks["core"][~single]), *[np.unique(blocks["core"][single])] * 2]
        flagged = np.isin(keys[0], keys[1])
        return repeats.packed(np.concatenate([keys[0][~flagged], *keys[1:]]), key[0].as_py(), ranges, True)

    def judge(key, table, answers):
        blocks = _blocks(table, "blocks").copy()
        again = repeats.lookup(_at(answers, 1), blocks["all"], ranges, True)
        wanted = repeats.lookup(_at(answers, 2), blocks["core"], ranges, True) > 0
        blocks["state"] = np.where(again == 0, OPEN, np.where(wanted & (again == 1), LENT, WHOLE))
        return one_row(key[0].as_py(), blocks)

    def send_windows(key, table, judged):
        blocks = _blocks(judged, "blocks")
        windows = _window_names(table, blocks[blocks["state"] != WHOLE], window)
        return repeats.packed(windows, key[0].as_py(), ranges, True)

    cores = repeats.matched(laid.groupBy("seg").applyInArrow(send_cores, repeats.SENT), ranges, False)
    shape = "seg int, blocks binary"
    alive = laid.groupBy("seg").cogroup(cores.groupBy("seg")).applyInArrow(alive_blocks, shape).repartition("seg")
    wholes = _ranges_answer(alive.groupBy("seg").applyInArrow(send_all, repeats.SENT), _repeated, ranges)
    asked = alive.groupBy("seg").cogroup(wholes.groupBy("seg")).applyInArrow(send_open_cores, repeats.SENT)
    answers = wholes.withColumn("level", F.lit(1)).union(_ranges_answer(asked, _flagged, ranges).withColumn("level", F.lit(2)))
    judged = alive.groupBy("seg").cogroup(answers.groupBy("seg")).applyInArrow(judge, shape).repartition("seg")
    sent = laid.groupBy("seg").cogroup(judged.groupBy("seg")).applyInArrow(send_windows, repeats.SENT)
    windows = repeats.matched(sent, ranges, True).withColumn("level", F.lit(3))
    nothing = F.lit(b"").cast("binary")
    last = judged.select("seg", F.lit(-1).alias("range"), F.col("blocks").alias("keys"), nothing.alias("spread"), F.lit(0).alias("level"))
    last = last.union(windows)

    made = [StructField("n_bytes", LongType()), StructField("n_removed", LongType()), StructField("spans", SPANS), StructField("kept", BinaryType())]
    out = StructType([*fields, *made])
    target = to_arrow_schema(out)

    def finish(key, table, answers):
        blocks = _blocks(_at(answers, 0), "keys")
        settled = blocks[blocks["state"] != OPEN]
        open_ = blocks[blocks["state"] == OPEN]
        hit = repeats.lookup(_at(answers, 3), _window_names(table, open_, window), ranges, True) > 0
        counts = open_["n"].astype(np.int64)
        begin = np.cumsum(counts) - counts
        at = np.repeat(open_["low"] - begin, counts) + np.arange(counts.sum())
        row = np.concatenate([settled["row"], np.repeat(open_["row"], counts)[hit]])
        low = np.concatenate([settled["low"], at[hit]])
        high = np.concatenate([settled["low"] + settled["n"] - 1, at[hit]]) + window
        order = np.argsort(row, kind="stable")
        row, found = row[order], np.stack([low, high], axis=1)[order]
        results = ([], [], [], [])
        for r, value in zip(table.column("row").to_pylist(), table.column("text").to_pylist()):
            data = value or b""
            i, j = np.searchsorted(row, [r, r + 1])
            spans = _merged(found[i:j]).tolist() if i < j else []
            results[0].append(len(data))
            results[1].append(sum(b - a for a, b in spans))
            results[2].append([{"start": a, "end": b} for a, b in spans])
            edges = [0, *[x for s in spans for x in s], len(data)]
            results[3].append(b"".join([data[a:b] for a, b in zip(edges[0::2], edges[1::2])]) if spans else data)
        own = [as_fields(table.column(f.name), target.field(f.name).type) for f in fields]
        values = [pa.array(v, target.field(c).type) for v, c in zip(results, added)]
        return pa.table([*own, *values], names=target.names)

    done = laid.groupBy("seg").cogroup(last.groupBy("seg")).applyInArrow(finish, out)
    return given_back(done, docs, names, {c: c for c in added})
