"""Periodic runs of words, found by block convolution.

A run with period p repeats every one of its blocks p words later. At each dyadic scale
``b`` the words are cut in blocks of ``b``, and one number-theoretic transform per block
gives the sums of squared differences between the block and every place at a distance of
the scale (``2b - 1`` to ``4b - 2`` words). A sum of zero is an occurrence without a
mismatch: it holds exactly modulo the prime, so none is missed, and what is zero only
modulo the prime fails the comparison of words that follows. Blocks that agree at one
distance side by side are joined, compared word by word with their surroundings, and give
the runs of that distance. Distances that only repeat a run of a smaller period are dropped
before that, so a text that says one word a million times costs no more than another.

Any run of period p has ``2b - 1`` words from which one step of p leads into the run again,
and these hold a whole aligned block; so every run is found.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from maskloom.llm.common import as_fields, byte_slices, carried, given_back

#: 15 * 2**27 + 1: transforms of up to 2**27 places, so periods of 2**27 words
PRIME = 15 * (1 << 27) + 1
GENERATOR = 31
#: cells of one transform or comparison at a time, one block at least
CELLS = 1 << 20
LEAST_BLOCK = 2
PIECE = 1 << 20
RUNS = ArrayType(
    StructType([StructField("start", LongType()), StructField("length", LongType()), StructField("period", LongType())])
)
_P = np.uint64(PRIME)


@lru_cache(maxsize=64)
def _powers(half: int, inverse: bool) -> np.ndarray:
    """Powers 0 to ``half - 1`` of a root of unity of order ``2 * half``."""
    root = pow(GENERATOR, (PRIME - 1) // (2 * half), PRIME)
    if inverse:
        root = pow(root, -1, PRIME)
    out = np.ones(half, np.uint64)
    done = 1
    while done < half:
        step = np.uint64(pow(root, done, PRIME))
        take = min(done, half - done)
        out[done : done + take] = out[:take] * step % _P
        done += take
    return out


def transform(rows: np.ndarray) -> np.ndarray:
    """Number-theoretic transform of each row, in bit-reversed order."""
    count, size = rows.shape
    out = rows
    half = size // 2
    while half:
        pair = out.reshape(count, -1, 2, half)
        a, b = pair[:, :, 0], pair[:, :, 1]
        out = np.empty_like(pair)
        out[:, :, 0] = (a + b) % _P
        out[:, :, 1] = (a + (_P - b)) * _powers(half, False) % _P
        half //= 2
    return out.reshape(count, size)


def inverse(rows: np.ndarray) -> np.ndarray:
    """The rows of which ``transform`` gave ``rows``."""
    count, size = rows.shape
    out = rows
    half = 1
    while half < size:
        pair = out.reshape(count, -1, 2, half)
        a = pair[:, :, 0]
        b = pair[:, :, 1] * _powers(half, True) % _P
        out = np.empty_like(pair)
        out[:, :, 0] = (a + b) % _P
        out[:, :, 1] = (a + (_P - b)) % _P
        half *= 2
    return out.reshape(count, size) * np.uint64(pow(size, -1, PRIME)) % _P


def occurrences(x: np.ndarray, squares: np.ndarray, at: np.ndarray, b: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances at which the block of ``b`` numbers from each place of ``at``
    stands again without a mismatch modulo the prime. ``squares`` is the running sum of the
    squares, modulo the prime each."""
    count, size = high - low + 1, 4 * b
    left = np.zeros((len(at), size), np.uint64)
    left[:, :b] = x[at[:, None] + np.arange(b - 1, -1, -1)]
    right = np.zeros((len(at), size), np.uint64)
    right[:, : count + b - 1] = x[at[:, None] + low + np.arange(count + b - 1)]
    product = inverse(transform(left % _P) * transform(right % _P) % _P)[:, b - 1 : b - 1 + count]
    there = at[:, None] + low + np.arange(count)
    total = (squares[at + b] - squares[at])[:, None] + (squares[there + b] - squares[there])
    row, step = np.nonzero(total % _P == product * np.uint64(2) % _P)
    return at[row], step + low


def _spans(low: np.ndarray, high: np.ndarray, step: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal stretches inside ``low`` to ``high`` of places whose word stands ``step``
    later again: first place, number, step."""
    size = high - low + 1  # one place more, which counts as a mismatch
    ends = np.cumsum(size)
    flat = np.arange(ends[-1]) - np.repeat(ends - size - low, size)
    which = np.repeat(np.arange(len(low)), size)
    same = x[flat] == x[np.minimum(flat + step[which], len(x) - 1)]
    same[ends - 1] = False
    edge = np.diff(same.astype(np.int8), prepend=np.int8(0))
    first, after = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return flat[first], after - first, step[which[first]]


def find_runs(words: np.ndarray, text: np.ndarray, min_length: int = 12) -> np.ndarray:
    """All runs ``(start, end, period)`` of at least ``min_length`` words and two periods in
    texts that stand one behind the other: ``words`` are small numbers, those of separators
    unique, and ``text`` tells the text of each place. Sorted by start, then period."""
    if min_length < 6:
        raise ValueError("min_length is 6 or more")
    n = len(words)
    found = np.zeros((0, 3), np.int64)
    if n < min_length:
        return found
    order = np.lexsort((words, text))
    again = (words[order[1:]] == words[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
    gap = np.full(n, n, np.int64)
    gap[order[:-1][again]] = (order[1:] - order[:-1])[again]
    longest = int(np.bincount(text).max())
    b, low = LEAST_BLOCK, 1
    while 2 * low <= longest:
        high = 4 * b - 2
        # a number that no word has fills what lies behind the last text
        x = np.concatenate([words, np.full(8 * b, words.max() + 1, np.int64)]).astype(np.uint64)
        rest = x % _P
        squares = np.concatenate([np.zeros(1, np.uint64), np.cumsum(rest * rest % _P, dtype=np.uint64)])
        # every word of a block with an occurrence stands again within the distance
        whole = n // b
        at = np.flatnonzero(gap[: whole * b].reshape(whole, b).max(axis=1) <= high) * b
        wide = found[found[:, 1] - found[:, 0] >= low + b]
        places, steps = [], []
        part = max(1, CELLS // (4 * b))
        for k in range(0, len(at), part):
            place, step = occurrences(x, squares, at[k : k + part], b, low, high)
            new = np.ones(len(place), bool)
            # a distance inside a known run that is a multiple of its period gives that run
            for start, end, period in wide.tolist():
                i, j = np.searchsorted(place, [start, end])
                new[i:j] &= (place[i:j] + step[i:j] + b > end) | (step[i:j] % period != 0)
            places.append(place[new])
            steps.append(step[new])
        if places:
            place, step = np.concatenate(places), np.concatenate(steps)
            order = np.lexsort((place, step))
            place, step = place[order], step[order]
            cut = np.flatnonzero((np.diff(step, prepend=-1) != 0) | (np.diff(place, prepend=-b) != b))
            last = np.append(cut[1:], len(place)) - 1
            begin = np.maximum(place[cut] - (b - 1), 0)
            stop = np.minimum(place[last] + 2 * b - 1, n) if len(cut) else begin
            step = step[cut]
            bounds = np.searchsorted(np.cumsum(stop - begin + 1), np.arange(CELLS, int((stop - begin + 1).sum()) + CELLS, CELLS))
            for i, j in zip([0, *bounds], [*bounds, len(cut)]):
                if i < j:
                    first, size, period = _spans(begin[i:j], stop[i:j], step[i:j], x)
                    long = size + period >= np.maximum(min_length, 2 * period)
                    runs = np.stack([first, first + size + period, period], axis=1)[long]
                    found = np.concatenate([found, runs])
            # the same stretch has the smallest of its periods
            found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
            new = np.ones(len(found), bool)
            new[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
            found = found[new]
        b, low = 2 * b, high + 1
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _pieces(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, about ``PIECE`` bytes of them at a time."""
    low, size = 0, len(data)
    while low < size:
        high = min(low + PIECE, size)
        if high < size:
            # up to the next blank, which ends a word
            ends = [p for p in (data.find(c, high, high + PIECE) for c in (b" ", b"\n", b"\t", b"\v", b"\f", b"\r")) if p >= 0]
            while not ends and high < size:
                high = min(high + PIECE, size)
                ends = [p for p in (data.find(c, high, high + PIECE) for c in (b" ", b"\n", b"\t", b"\v", b"\f", b"\r")) if p >= 0]
            high = min(ends) if ends else size
        yield data[low:high].split()
        low = high


def _numbers(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Words of all texts as numbers with a unique one behind each text, the text of each
    place, and the first place of each text."""
    known: dict[bytes, int] = {}
    arrays, counts = [], []
    for t, data in enumerate(texts):
        n = 0
        for words in _pieces(data):
            arrays.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)))
            n += len(words)
        # negative for now
        arrays.append(np.array([-1 - t]))
        counts.append(n + 1)
    words = np.concatenate(arrays)
    words = np.where(words < 0, len(known) - 1 - words, words)
    first = np.concatenate([[0], np.cumsum(counts)])
    return words, np.repeat(np.arange(len(texts)), counts), first.tolist()


def _collapsed(data: bytes, gone: np.ndarray) -> bytes:
    """The words that stay, joined by one space."""
    if not gone.any():
        return b" ".join([b" ".join(words) for words in _pieces(data) if words])
    kept, low = [], 0
    for words in _pieces(data):
        own = gone[low : low + len(words)].tolist()
        low += len(words)
        left = [w for w, g in zip(words, own) if not g]
        if left:
            kept.append(b" ".join(left))
    return b" ".join(kept)


def periodic_runs(docs: DataFrame, text: str = "text", min_length: int = 12) -> DataFrame:
    """Adds the periodic runs of every text and the text without their repetitions.

    * ``n_words``: its words, maximal stretches without space and the controls 9 to 13;
    * ``runs``: ``(start, length, period)`` of every run by start, then period. A run is a
      stretch of words with smallest period q, at least ``min_length`` words and two periods
      long, that no neighbouring word extends;
    * ``collapsed``: the words that no run holds after its first q words, joined by one space.

    All columns of ``docs`` come back. A narrow stage over whole texts, about a megabyte of
    them at a time; a longer text is read in pieces, and takes a few dozen bytes of memory per
    word. Null texts have no words, no runs and an empty ``collapsed``; empty ones likewise.
    Equal rows get equal results. An empty table gives an empty table. Columns of the caller
    travel under other names, so they cannot clash; one with an added name is replaced.
    """
    added = ["n_words", "runs", "collapsed"]
    select, fields, names = carried(docs, added)
    shape = StructType([*fields, StructField("n_words", LongType()), StructField("runs", RUNS), StructField("collapsed", StringType())])
    target = to_arrow_schema(shape)

    def read(batches):
        for batch in batches:
            for part in byte_slices(batch, "counted"):
                raw = [b"" if x is None else x.encode() for x in part.column("counted").to_pylist()]
                words, of, first = _numbers(raw)
                found = find_runs(words, of, min_length)
                cuts = np.searchsorted(found[:, 0], first).tolist()
                made = ([], [], [])
                for t, data in enumerate(raw):
                    n = first[t + 1] - first[t] - 1
                    own = found[cuts[t] : cuts[t + 1]] - [first[t], first[t], 0]
                    delta = np.zeros(n + 1, np.int64)
                    np.add.at(delta, own[:, 0] + own[:, 2], 1)
                    np.subtract.at(delta, own[:, 1], 1)
                    made[0].append(n)
                    made[1].append([{"start": s, "length": e - s, "period": p} for s, e, p in own.tolist()])
                    made[2].append(_collapsed(data, np.cumsum(delta)[:n] > 0).decode())
                own = [as_fields(part.column(f.name), target.field(f.name).type) for f in fields]
                values = [pa.array(v, target.field(c).type) for v, c in zip(made, added)]
                yield pa.record_batch([*own, *values], names=target.names)

    done = docs.select(*select, F.col(f"`{text}`").alias("counted")).mapInArrow(read, shape)
    return given_back(done, docs, names, {c: c for c in added})
