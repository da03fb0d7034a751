"""Best-fit packing of token pieces into sequences of fixed capacity.

Bulk-synchronous best fit: documents and gaps are ordered by size, a sweep matches every gap
with the largest document that fits and that no smaller gap has taken (the successor relation
of best fit, solved like brackets), documents of equal size are told apart by rank, gaps
shrink, and the next round begins. A round takes the sizes within a narrow band below the
largest size that is left; when no document of the band finds a gap, as many new sequences
are opened as the band's tokens need, the largest first.

Sizes are whole numbers up to the capacity, so a sweep works on classes of equal size and
their row counts: at most ``capacity`` numbers, whatever the number of rows. The rows
themselves are ranked within their class by Spark and find their place from the rounds'
matches in a narrow stage.
"""

from __future__ import annotations

import base64
import json
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from maskloom.llm.common import as_fields, byte_slices, carried, numbered, rank_in_class, saved

#: a round takes sizes down to this share of the largest one
BAND = 0.95
CACHE_WORDS = 300_000
_UNEVEN = regex.compile(r"\s\s|\s\Z")


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def added_tokens(path: str) -> dict[str, int]:
    """Text and id of the added tokens of a ``tokenizers`` file."""
    with open(path, encoding="utf-8") as lines:
        found = json.load(lines)["added_tokens"]
    if any(x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] for x in found):
        raise ValueError("an added token is more than its plain text")
    return {x["content"]: x["id"] for x in found}


class Encoder:
    """Token ids of texts as packed 32-bit numbers.

    A text is first cut at the texts of ``added``, which have ids of their own.

    The vocabulary's pattern never joins a blank with what stands before it, so a text
    without double white space can be cut at its blanks and line ends, and the parts be
    remembered. Other texts are encoded as a whole.
    """

    def __init__(self, path: str, pattern: str, added: dict[str, int] | None = None):
        self.encoding = _encoding(path, pattern)
        self.known: dict[str, bytes] = {}
        self.added = {x: np.array([i], "<u4").tobytes() for x, i in (added or {}).items()}
        # at one place the longest one counts
        some = "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))
        self.cuts = regex.compile(f"({some})") if some else None

    def _pack(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), dtype="<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if self.cuts is None or not any(x in text for x in self.added):
            return self._plain(text)
        parts = self.cuts.split(text)
        return b"".join(self.added[x] if i % 2 else self._plain(x) for i, x in enumerate(parts))

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        if _UNEVEN.search(text):
            return self._pack(text)
        # "\\n" begins a part of its own; any other part follows a blank
        head, *parts = text.replace("\n", " \n").split(" ")
        ids = list(map(self.known.get, parts))
        if None in ids:
            if len(self.known) > CACHE_WORDS:
                self.known.clear()
            for i, x in enumerate(ids):
                if x is None:
                    part = parts[i]
                    x = self.known.get(part)
                    if x is None:
                        x = self.known[part] = self._pack(part if part[:1] == "\n" else " " + part)
                    ids[i] = x
        return (self._pack(head) if head else b"") + b"".join(ids)


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str, added: tuple[tuple[str, int], ...]) -> Encoder:
    return Encoder(path, pattern, dict(added))


def cut(
    docs: DataFrame, vocabulary: str, pattern: str, capacity: int = 1024, end_id: int = 2, text: str = "text", payload: str = "ids",
    added_ids: dict[str, int] | None = None,
) -> DataFrame:
    """Pieces of every text: its ids and ``end_id``, cut into pieces of ``capacity`` where
    longer; the first piece is the shorter one.

    Returns the caller's columns but the text with ``piece``, ``start``, ``length`` and ``ids``
    (``payload="ids"``) or ``ids_crc32`` (``payload="crc32"``, of the ids as little-endian
    unsigned 32-bit numbers). Null texts count as empty and have one piece, the end. Narrow;
    ``vocabulary`` is a rank file that every task can read, see ``Encoder``; ``added_ids`` are
    the tokens that it does not hold, see ``added_tokens``.
    """
    added = ["piece", "start", "length", "ids" if payload == "ids" else "ids_crc32"]
    select, fields, names = carried(docs, [text, *added])
    last = ArrayType(LongType()) if payload == "ids" else LongType()
    shape = StructType(
        [*fields, StructField("piece", IntegerType()), StructField("start", LongType()), StructField("length", LongType()), StructField("made", last)]
    )
    target = to_arrow_schema(shape)
    end = np.array([end_id], "<u4").tobytes()

    extra = tuple((added_ids or {}).items())

    def read(batches):
        encode = _encoder(vocabulary, pattern, extra)
        for batch in batches:
            for part in byte_slices(batch, "read"):
                row, piece, start, length, made = [], [], [], [], []
                for i, value in enumerate(part.column("read").to_pylist()):
                    ids = encode(value or "") + end
                    n = len(ids) // 4
                    first = (n - 1) % capacity + 1
                    cuts = [0, *range(first, n + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        row.append(i)
                        piece.append(k)
                        start.append(a)
                        length.append(b - a)
                        own = ids[4 * a : 4 * b]
                        made.append(np.frombuffer(own, "<u4").astype(np.int64) if payload == "ids" else zlib.crc32(own))
                at = pa.array(row, pa.int32())
                own = [as_fields(part.column(f.name).take(at), target.field(f.name).type) for f in fields]
                values = [pa.array(v, target.field(f).type) for v, f in ((piece, "piece"), (start, "start"), (length, "length"), (made, "made"))]
                yield pa.record_batch([*own, *values], names=target.names)

    done = docs.select(*select, F.col(f"`{text}`").alias("read")).mapInArrow(read, shape)
    back = {new: old for old, new in names.items()}
    return done.select(*[F.col(c).alias(back.get(c, added[3] if c == "made" else c)) for c in target.names])


def rounds(counts: dict[int, int], capacity: int, band: float = BAND) -> tuple[np.ndarray, np.ndarray]:
    """Matches of all rounds, from the number of pieces of each length.

    Returns two tables of intervals. ``taken``: (length, first rank, end rank, gap, gap rank),
    pieces of a length that go into gaps of a size, gap 0 standing for new sequences, whose
    number is the gap rank. ``left``: (gap, first rank, end rank, the interval of ``taken``
    that left it). Gaps of a size are numbered as they come up and taken in that order.
    """
    pieces = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        pieces[length] = n
    used = np.zeros(capacity + 1, np.int64)  # pieces of a length that are placed
    made = np.zeros(capacity + 1, np.int64)  # gaps of a size that ever came up
    filled = np.zeros(capacity + 1, np.int64)  # those that are taken
    taken, left, opened = [], [], 0

    def place(length: int, gap: int, n: int) -> None:
        nonlocal opened
        low = int(used[length])
        taken.append((length, low, low + n, gap, int(filled[gap]) if gap else opened))
        used[length] += n
        pieces[length] -= n
        if gap:
            filled[gap] += n
        else:
            opened += n
        rest = (gap or capacity) - length
        if rest:
            grown.append((rest, n, len(taken) - 1))

    while pieces.any():
        high = int(np.flatnonzero(pieces)[-1])
        low = min(int(high * band), high - 1)
        grown: list[tuple[int, int, int]] = []
        matches, open_ = [], []
        for size in range(low + 1, capacity + 1):
            if size <= high and pieces[size]:
                open_.append([size, int(pieces[size])])
            free = int(made[size] - filled[size])
            while free and open_:
                n = min(free, open_[-1][1])
                matches.append((open_[-1][0], size, n))
                free -= n
                open_[-1][1] -= n
                if not open_[-1][1]:
                    open_.pop()
        for length, gap, n in matches:
            place(length, gap, n)
        # what finds no gap, while no gap grows either, opens sequences
        tokens = 0 if matches else sum(size * int(pieces[size]) for size in range(low + 1, high + 1))
        if tokens:
            new = max(-(-tokens // capacity), int(pieces[max(capacity // 2, low) + 1 :].sum()))
            for size in range(high, low, -1):
                n = min(new, int(pieces[size]))
                if n:
                    place(size, 0, n)
                    new -= n
        # gaps of this round can be taken from the next one on
        for rest, n, source in grown:
            left.append((rest, int(made[rest]), int(made[rest]) + n, source))
            made[rest] += n
    shape = lambda rows, k: np.array(sorted(rows), np.int64).reshape(-1, k)
    order = sorted(range(len(taken)), key=lambda i: taken[i])
    new_number = {old: new for new, old in enumerate(order)}
    return shape(taken, 5), shape([(g, a, b, new_number[s]) for g, a, b, s in left], 4)


def find_places(length: np.ndarray, rank: np.ndarray, taken: np.ndarray, left: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of pieces by length and rank: each goes back over the gaps of its
    sequence to the piece that opened it."""
    shift = 48
    starts = (taken[:, 0] << shift) + taken[:, 1]
    gaps = (left[:, 0] << shift) + left[:, 1]
    at = np.searchsorted(starts, (length << shift) + rank, "right") - 1
    offset = np.where(taken[at, 3] > 0, capacity - taken[at, 3], 0)
    gap, number = taken[at, 3].copy(), taken[at, 4] + rank - taken[at, 1]
    going = np.flatnonzero(gap > 0)
    while len(going):
        i = np.searchsorted(gaps, (gap[going] << shift) + number[going], "right") - 1
        source = left[i, 3]
        along = number[going] - left[i, 1]
        gap[going] = taken[source, 3]
        number[going] = taken[source, 4] + along
        going = going[gap[going] > 0]
    return number, offset


def pack(pieces: DataFrame, capacity: int = 1024, length: str = "length", band: float = BAND) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces of 1 to ``capacity`` tokens.

    A sequence is filled from 0 without gaps. The rows are written once with their rank; the
    result is a narrow stage over them. Every row is a piece of its own, repeated rows
    included; null lengths are an error. The caller's columns come back; ``sequence_id`` and
    ``offset`` replace columns of these names. An empty table gives an empty table.
    """
    added = ["sequence_id", "offset"]
    select, fields, names = carried(pieces, added)
    base = saved(numbered(pieces.select(*select), "row"), "pieces")
    size = names[length]
    counts = {r[size]: r["count"] for r in base.groupBy(size).count().collect()}
    if any(n is None or not 1 <= n <= capacity for n in counts):
        raise ValueError(f"pieces have 1 to {capacity} tokens")
    taken, left = rounds(counts, capacity, band)
    shared = pieces.sparkSession.sparkContext.broadcast((taken, left))
    shape = StructType([*fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    target = to_arrow_schema(shape)

    def read(batches):
        taken, left = shared.value
        for batch in batches:
            n = batch.column(size).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            sequence, offset = find_places(n, rank, taken, left, capacity)
            own = [as_fields(batch.column(f.name), target.field(f.name).type) for f in fields]
            yield pa.record_batch([*own, pa.array(sequence), pa.array(offset)], names=target.names)

    done = rank_in_class(base, size, "row", "rank").drop("row").mapInArrow(read, shape)
    return done.select(*[F.col(new).alias(old) for old, new in names.items()], *added)
