"""The state of merge training: word types in shards, and pair counts kept up by differences.

The word types are dealt to shards, one row each: the symbols of all words of a shard behind
each other, and how often each word occurs. A round applies its merges inside every shard and
gives back by how much the pairs of the touched words changed. The driver keeps the counts of
the leading pairs only. A pair that it does not keep ranks behind a known border and cannot
become more frequent, as long as the merges make new symbols: their pairs come whole with the
differences of the round that makes them. So a full count over all words is needed only when
the leading pairs are used up, or a merge makes a symbol that was there before.

A pair that occurs too seldom to be merged is never merged, nor is one that stands over its
place later, as long as the merges make new symbols. So words are cut there (``compacted``),
pieces of one symbol go, and equal pieces become one; what is left of few symbols is held by
the driver, where a round is no Spark job.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: words of a shard, about
SHARD_WORDS = 200_000
#: with more shards the differences are added up by Spark before they reach the driver
DIRECT_SHARDS = 64
#: symbols of all words together that the driver holds, 4 bytes each
HELD_SYMBOLS = 8_000_000
SEPARATOR = -1
STATE = "shard int, symbols binary, counts binary"
Merge = tuple[int, int, int]


def pair_key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A pair as one number, in the order of left, then right."""
    return (left.astype(np.int64) << 32) | right.astype(np.int64)


def shards_of(words: DataFrame, alphabet: list[str], first: int) -> DataFrame:
    """``words(word, n)`` as shards; the symbol of a character is ``first`` and its place in
    the sorted ``alphabet``. Words of one symbol have no pair and are left out."""
    points = np.array([ord(c) for c in alphabet], np.uint32)
    spark = words.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(tasks, -(-words.count() // SHARD_WORDS))

    def build(key, table):
        text = " ".join(table.column("word").to_pylist()) + " "
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        symbols = (np.searchsorted(points, codes) + first).astype(np.int32)
        symbols[codes == 32] = SEPARATOR
        counts = table.column("n").to_numpy().astype(np.int64)
        return pa.table(
            [pa.array([key[0].as_py()], pa.int32()), pa.array([symbols.tobytes()]), pa.array([counts.tobytes()])],
            names=["shard", "symbols", "counts"],
        )

    some = words.where(F.length("word") > 1).select(
        F.col("word"), F.col("n").cast("long").alias("n"), F.pmod(F.xxhash64("word"), F.lit(shards)).cast("int").alias("shard")
    )
    # one shard per partition: rounds are many and short
    return some.groupBy("shard").applyInArrow(build, STATE).repartition(shards, "shard")


class Shard:
    """Symbols of words behind each other; a separator ends each word."""

    def __init__(self, symbols: bytes, counts: bytes):
        self.x = np.frombuffer(symbols, np.int32).copy()
        self.n = np.frombuffer(counts, np.int64)
        self._ends = None

    @property
    def ends(self) -> np.ndarray:
        """The place of each word's separator."""
        if self._ends is None:
            self._ends = np.flatnonzero(self.x == SEPARATOR)
        return self._ends

    def merge(self, batch: list[Merge]) -> np.ndarray:
        """Replace pairs from left to right in every word; where they began. No merge of
        the batch has as its left symbol the right one of another, so the pairs do not overlap,
        but for a doubled symbol."""
        x = self.x
        left, right, new = np.array(batch, np.int64).T
        keys = pair_key(left, right)
        order = np.argsort(keys)
        keys, new = keys[order], new[order]
        # the separator, -1, is the last place
        starts = np.zeros(max(int(left.max()), int(x.max(initial=0))) + 2, bool)
        starts[left] = True
        hit = np.flatnonzero(starts[x[:-1]])
        own = pair_key(x[hit], x[hit + 1])
        which = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        ok = keys[which] == own
        hit, which = hit[ok], which[ok]
        # of the overlapping places of a doubled symbol the first, the third and so on
        begin = np.diff(hit, prepend=-2) > 1
        start = hit[np.maximum.accumulate(np.where(begin, np.arange(len(hit)), 0))]
        ok = (hit - start) % 2 == 0
        hit, which = hit[ok], which[ok]
        if len(hit):
            x[hit] = new[which]
            keep = np.ones(len(x), bool)
            keep[hit + 1] = False
            self.x, self._ends = x[keep], None
        return hit

    def pairs(self, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The pairs and how often they occur, of all or of some places."""
        if at is None:
            at = np.arange(max(len(self.x) - 1, 0))
        at = at[(self.x[at] != SEPARATOR) & (self.x[at + 1] != SEPARATOR)]
        return added_up(pair_key(self.x[at], self.x[at + 1]), self.n[np.searchsorted(self.ends, at)])

    def differences(self, batch: list[Merge]) -> tuple[np.ndarray, np.ndarray]:
        """Apply a batch; how the counts of pairs change. Only pairs with a merged symbol do."""
        before = Shard.__new__(Shard)
        before.x, before.n, before._ends = self.x.copy(), self.n, self.ends
        hit = self.merge(batch)
        if not len(hit):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        old, less = before.pairs(_beside(hit, hit + 1, len(before.x)))
        # each merge before a place has taken a symbol away
        place = hit - np.arange(len(hit))
        new, more = self.pairs(_beside(place, place, len(self.x)))
        key, change = added_up(np.concatenate([old, new]), np.concatenate([-less, more]))
        return key[change != 0], change[change != 0]


def _beside(first: np.ndarray, last: np.ndarray, size: int) -> np.ndarray:
    """Where the pairs begin that have a symbol from ``first`` to ``last``, two symbols at most."""
    at = np.unique(np.concatenate([first - 1, first, last]))
    return at[(at >= 0) & (at < size - 1)]


def added_up(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    cut = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
    return keys[cut], np.add.reduceat(values, cut)


def advanced(state: DataFrame, done: list[list[Merge]]) -> DataFrame:
    """The state after some batches."""

    def apply(batches):
        for batch in batches:
            for shard, symbols, counts in zip(*(batch.column(c).to_pylist() for c in ("shard", "symbols", "counts"))):
                own = Shard(symbols, counts)
                for some in done:
                    own.merge(some)
                yield pa.record_batch(
                    [pa.array([shard], pa.int32()), pa.array([own.x.tobytes()]), pa.array([counts])], names=["shard", "symbols", "counts"]
                )

    return state.mapInArrow(apply, STATE)


def _answers(state: DataFrame, done: list[list[Merge]], batch: list[Merge] | None, packed: bool) -> DataFrame:
    """Pair counts after some batches, or how ``batch`` then changes them."""
    shape = "keys binary, n binary" if packed else "pair long, n long"

    def count(batches):
        for part in batches:
            for symbols, counts in zip(part.column("symbols").to_pylist(), part.column("counts").to_pylist()):
                own = Shard(symbols, counts)
                for some in done:
                    own.merge(some)
                keys, n = own.pairs() if batch is None else own.differences(batch)
                if packed:
                    yield pa.record_batch([pa.array([keys.tobytes()]), pa.array([n.tobytes()])], names=["keys", "n"])
                else:
                    yield pa.record_batch([pa.array(keys), pa.array(n)], names=["pair", "n"])

    return state.mapInArrow(count, shape)


def differences(
    state: DataFrame | Shard, done: list[list[Merge]], batch: list[Merge], shards: int
) -> tuple[np.ndarray, np.ndarray]:
    """How a batch changes the counts of pairs over all shards. What the driver holds is changed."""
    if isinstance(state, Shard):
        return state.differences(batch)
    if shards <= DIRECT_SHARDS:
        rows = _answers(state, done, batch, True).collect()
        keys = np.concatenate([np.frombuffer(r["keys"], np.int64) for r in rows])
        return added_up(keys, np.concatenate([np.frombuffer(r["n"], np.int64) for r in rows]))
    rows = _answers(state, done, batch, False).groupBy("pair").agg(F.sum("n").alias("n")).collect()
    return np.array([r["pair"] for r in rows], np.int64), np.array([r["n"] for r in rows], np.int64)


class Leading:
    """Counts of the leading pairs. Ranks are (count, most first; pair)."""

    def __init__(self, rows: list[tuple[int, int]], whole: bool):
        self.counts = dict(rows)
        #: pairs that are not here rank behind this one
        self.border = (0, 0) if whole or not rows else (-rows[-1][1], rows[-1][0])

    def inside(self, pair: int, n: int) -> bool:
        return n > 0 and (self.border == (0, 0) or (-n, pair) <= self.border)

    def change(self, keys: np.ndarray, change: np.ndarray, fresh: set[int]) -> None:
        """``fresh`` are the symbols that the changes have made."""
        for pair, n in zip(keys.tolist(), change.tolist()):
            if pair in self.counts:
                n += self.counts[pair]
            elif (pair >> 32) not in fresh and (pair & 0xFFFFFFFF) not in fresh:
                continue
            if self.inside(pair, n):
                self.counts[pair] = n
            else:
                self.counts.pop(pair, None)

    def top(self, limit: int) -> list[tuple[int, int]]:
        """The first pairs and their counts."""
        best = heapq.nsmallest(limit, ((-n, pair) for pair, n in self.counts.items()))
        return [(pair, -n) for n, pair in best]


def leading(state: DataFrame | Shard, done: list[list[Merge]], limit: int) -> Leading:
    """The first ``limit`` pairs of a full count."""
    if isinstance(state, Shard):
        for some in done:
            state.merge(some)
        keys, n = state.pairs()
        first = np.lexsort((keys, -n))[:limit]
        return Leading(list(zip(keys[first].tolist(), n[first].tolist())), len(first) < limit)
    counted = _answers(state, done, None, False).groupBy("pair").agg(F.sum("n").alias("n"))
    rows = counted.orderBy(F.desc("n"), "pair").limit(limit).collect()
    return Leading([(r["pair"], r["n"]) for r in rows], len(rows) < limit)


def held(state: DataFrame) -> Shard | None:
    """All shards as one on the driver, if they have few symbols."""
    if (state.agg(F.sum(F.length("symbols"))).first()[0] or 0) > 4 * HELD_SYMBOLS:
        return None
    rows = state.select("symbols", "counts").collect()
    return Shard(b"".join(r["symbols"] for r in rows), b"".join(r["counts"] for r in rows))


def pieces(shard: Shard, live: np.ndarray) -> pa.Table:
    """``(symbols, n)``: the words cut between symbols that are no pair of ``live``, which is
    sorted; pieces of one symbol are left out and equal ones are one."""
    x, n = shard.x, shard.n
    keys = pair_key(x[:-1], x[1:])
    alive = np.zeros(len(keys), bool)
    if len(live):
        alive = live[np.minimum(np.searchsorted(live, keys), len(live) - 1)] == keys
    # a piece is a run of live pairs and has one symbol more
    edge = np.diff(np.concatenate([[False], alive, [False]]).astype(np.int8))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1
    weights = n[np.searchsorted(shard.ends, starts)]
    lengths = stops - starts
    places = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
    offsets = np.concatenate([[0], np.cumsum(lengths * 4)]).astype(np.int64)
    own = pa.Array.from_buffers(
        pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(x[places]))]
    )
    summed = pa.table([own, pa.array(weights)], names=["symbols", "n"]).group_by("symbols").aggregate([("n", "sum")])
    return pa.table([summed["symbols"].cast(pa.binary()), summed["n_sum"]], names=["symbols", "n"])


def compacted(state: DataFrame, done: list[list[Merge]], live: np.ndarray, shards: int) -> DataFrame:
    """The state after some batches as the pieces that pairs of ``live`` hold together, each
    once, in ``shards`` shards."""

    def cut(batches):
        for part in batches:
            for symbols, counts in zip(part.column("symbols").to_pylist(), part.column("counts").to_pylist()):
                own = Shard(symbols, counts)
                for some in done:
                    own.merge(some)
                yield from pieces(own, live).combine_chunks().to_batches()

    def build(key, table):
        end = np.array([SEPARATOR], np.int32).tobytes()
        symbols = b"".join(s + end for s in table.column("symbols").to_pylist())
        counts = table.column("n").to_numpy().astype(np.int64).tobytes()
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([symbols]), pa.array([counts])], names=["shard", "symbols", "counts"])

    whole = state.mapInArrow(cut, "symbols binary, n long").groupBy("symbols").agg(F.sum("n").alias("n"))
    dealt = whole.select("symbols", "n", F.pmod(F.xxhash64("symbols"), F.lit(shards)).cast("int").alias("shard"))
    return dealt.groupBy("shard").applyInArrow(build, STATE).repartition(shards, "shard")
