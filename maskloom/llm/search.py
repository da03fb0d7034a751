"""Ranked lexical search with Block-Max MaxScore.

The corpus becomes shards, each a small inverted index in one row of a table: the postings
of a term are packed in blocks, and beside a block lie the pairs of term frequency and
document length that no other posting of the block beats. Weights and lengths of the whole
corpus are known only after all shards are, so these pairs are what makes an exact block
maximum possible without unpacking a block.

A query sorts its terms by the greatest score that each can give. Those whose sum stays
below the score of the current k-th document are not essential: a document that has no other
term cannot enter. Documents are gathered from the essential lists; for the others the block
maximum rejects a document first, and only blocks of documents still in the race are
unpacked. The heap of a query goes on from shard to shard of a task; the heaps of the tasks
meet in one ranking.
"""

from __future__ import annotations

import bisect
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from maskloom.llm.common import byte_slices, numbered, saved

#: text of a shard, one row at least
SHARD_BYTES = 4 << 20
BLOCK = 128
#: documents whose scores are added up at a time
RANGE = 2048
PIECE = 1 << 20
#: queries of one pass over the index, by number and bytes of their text
QUERY_ITEMS, QUERY_BYTES = 4096, 8 << 20

_TERM = bytes([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])
_TABLE = bytes(ord(chr(c).lower()) if c < 128 and c in _TERM else c if c in _TERM else 32 for c in range(256))

#: the columns of a shard: name and number type, all packed; what they imply is not stored
PARTS = {
    "lengths": np.int32,  # terms of each document, with repeats
    "dfs": np.int32,  # documents of each term, in blocks of BLOCK and a shorter last one
    "last": np.int32,  # last document of each block
    "widths": np.uint8,  # bytes of a gap, 16 times, and of a frequency
    "pairs": np.uint8,  # pairs of each block
    "pair_tf": np.int32,
    "pair_n": np.int32,
    "payload": np.uint8,  # the blocks: gaps, then frequencies
}


def terms_of(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text, a piece of it at a time: digits, letters and all that is not
    ASCII, A-Z lower-cased."""
    data = (text or "").encode().translate(_TABLE)
    low = 0
    while low < len(data):
        high = data.find(b" ", low + PIECE)
        high = len(data) if high < 0 else high
        yield data[low:high].split()
        low = high


def _bytes_scattered(out: np.ndarray, at: np.ndarray, values: np.ndarray, width: np.ndarray) -> None:
    for w in (1, 2, 4):
        own = width == w
        for k in range(w):
            out[at[own] + k] = (values[own] >> (8 * k)) & 255


def _width(most: np.ndarray) -> np.ndarray:
    return np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4))


def build_shard(texts: list[str | None]) -> tuple[list[int], bytes, dict[str, np.ndarray]]:
    """Places of the texts that have a term, the sorted terms, and ``PARTS``."""
    vocabulary: defaultdict[bytes, int] = defaultdict()
    vocabulary.default_factory = vocabulary.__len__
    places, lengths, sizes, ids, tfs = [], [], [], [], []
    for place, text in enumerate(texts):
        counts: Counter[bytes] = Counter()
        for words in terms_of(text):
            counts.update(words)
        if counts:
            places.append(place)
            ids.extend(map(vocabulary.__getitem__, counts))
            tfs.extend(counts.values())
            sizes.append(len(counts))
            lengths.append(counts.total())
    terms = sorted(vocabulary)
    rank = np.empty(len(terms), np.int64)
    rank[[vocabulary[t] for t in terms]] = np.arange(len(terms))
    term = rank[np.array(ids, np.int64)]
    order = np.argsort(term, kind="stable")
    term, doc = term[order], np.repeat(np.arange(len(sizes)), sizes)[order]
    tf, length = np.array(tfs, np.int64)[order], np.array(lengths, np.int64)
    dfs = np.bincount(term, minlength=len(terms))
    start = np.cumsum(dfs) - dfs
    inside = np.arange(len(term)) - start[term]
    head = inside % BLOCK == 0
    block = np.cumsum(head) - 1
    begin = np.flatnonzero(head)
    counts = np.diff(np.append(begin, len(term)))
    before = np.where(inside > 0, np.concatenate([[-1], doc[:-1]]), -1)
    gap = doc - before
    gap_width = _width(np.maximum.reduceat(gap, begin)) if len(begin) else np.zeros(0, np.int64)
    tf_width = _width(np.maximum.reduceat(tf, begin)) if len(begin) else np.zeros(0, np.int64)
    sizes_ = counts * (gap_width + tf_width)
    offset = np.cumsum(sizes_) - sizes_
    payload = np.zeros(int(sizes_.sum()), np.uint8)
    step = np.arange(len(term)) - begin[block]
    _bytes_scattered(payload, offset[block] + step * gap_width[block], gap, gap_width[block])
    _bytes_scattered(payload, offset[block] + (counts * gap_width)[block] + step * tf_width[block], tf, tf_width[block])
    # a pair counts if every posting with its frequency or more is in a longer document
    n = length[doc]
    by_tf = np.lexsort((n, -tf, block))
    least = n[by_tf] + (len(begin) - 1 - block[by_tf]) * (n.max(initial=0) + 1)
    running = np.minimum.accumulate(least)
    best = np.ones(len(least), bool)
    best[1:] = least[1:] < running[:-1]
    chosen = by_tf[best]
    values = {
        "lengths": length,
        "dfs": dfs,
        "last": doc[begin + counts - 1],
        "widths": gap_width * 16 + tf_width,
        "pairs": np.bincount(block[chosen], minlength=len(begin)),
        "pair_tf": tf[chosen],
        "pair_n": n[chosen],
        "payload": payload,
    }
    return places, b"\n".join(terms), {k: values[k].astype(kind) for k, kind in PARTS.items()}


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per shard: ``keys`` of its documents, ``terms`` and the packed ``PARTS``.

    Every row with a term is indexed, over the whole text; null texts and those without a
    term are in no shard. Repeated rows are documents of their own, keys may be null. Other
    columns are left out; an empty table gives an empty index. A narrow stage; a shard is about
    ``SHARD_BYTES`` of text. Write the result before searching it more than once.
    """
    shape = StructType(
        [
            StructField("keys", ArrayType(docs.schema[key].dataType)),
            StructField("terms", BinaryType()),
            *[StructField(c, BinaryType()) for c in PARTS],
        ]
    )
    target = to_arrow_schema(shape)

    def read(batches):
        for batch in batches:
            for part in byte_slices(batch, "text", SHARD_BYTES):
                places, terms, values = build_shard(part.column("text").to_pylist())
                if places:
                    keys = part.column("key").take(pa.array(places)).to_pylist()
                    row = [[keys], [terms], *[[v.tobytes()] for v in values.values()]]
                    yield pa.record_batch([pa.array(v, f.type) for v, f in zip(row, target)], names=target.names)

    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(read, shape)


def length_factor(n: int, documents: int, total: int) -> int:
    """The m of a document: 75 and a quarter of its length over the mean length, in hundredths."""
    return 75 + 25 * n * documents // total


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class Shard:
    """A shard under the statistics of the whole corpus."""

    def __init__(self, terms: bytes, parts: dict[str, np.ndarray], documents: int, total: int):
        self.__dict__.update(parts)
        self.terms = terms.split(b"\n")
        self.size = len(self.lengths)
        self.m = np.array([length_factor(n, documents, total) for n in self.lengths.tolist()], np.int64)
        pair_m = np.array([length_factor(n, documents, total) for n in self.pair_n.tolist()], np.int64)
        pairs = self.pairs.astype(np.int64)
        self.most = np.maximum.reduceat(impact(self.pair_tf.astype(np.int64), pair_m), np.cumsum(pairs) - pairs)
        blocks = -(-self.dfs // BLOCK)
        self.first = np.concatenate([[0], np.cumsum(blocks)])
        self.counts = np.full(len(self.last), BLOCK, np.int64)
        self.counts[self.first[1:] - 1] = self.dfs - BLOCK * (blocks - 1)
        self.base = np.concatenate([[-1], self.last[:-1]])
        self.base[self.first[:-1]] = -1
        size = self.counts * (self.widths // 16 + self.widths % 16)
        self.offset = np.cumsum(size) - size
        self.lists: dict[int, Postings] = {}

    def postings(self, term: bytes) -> Postings | None:
        at = bisect.bisect_left(self.terms, term)
        if at == len(self.terms) or self.terms[at] != term:
            return None
        if at not in self.lists:
            self.lists[at] = Postings(self, int(self.first[at]), int(self.first[at + 1]))
        return self.lists[at]


class Postings:
    """One list of a shard; its blocks are unpacked when they are asked for, and kept."""

    def __init__(self, shard: Shard, low: int, high: int):
        self.shard, self.low = shard, low
        self.last = shard.last[low:high]
        self.most = shard.most[low:high]
        self.greatest = int(self.most.max())
        counts = shard.counts[low:high]
        self.start = np.concatenate([[0], np.cumsum(counts)])
        # a packed block shows its last document, so the list is in order at any time
        self.docs = np.repeat(self.last, counts).astype(np.int64)
        self.impacts = np.zeros(len(self.docs), np.int64)
        self.open = np.zeros(high - low, bool)

    def unpack(self, blocks: np.ndarray) -> None:
        shard = self.shard
        for b in blocks[~self.open[blocks]].tolist():
            k = self.low + b
            gap_width, tf_width = divmod(int(shard.widths[k]), 16)
            n, at = int(shard.counts[k]), int(shard.offset[k])
            gaps = np.frombuffer(shard.payload, f"<u{gap_width}", n, at)
            tf = np.frombuffer(shard.payload, f"<u{tf_width}", n, at + n * gap_width).astype(np.int64)
            docs = int(shard.base[k]) + np.cumsum(gaps, dtype=np.int64)
            low, high = int(self.start[b]), int(self.start[b + 1])
            self.docs[low:high] = docs
            self.impacts[low:high] = impact(tf, shard.m[docs])
            self.open[b] = True

    def between(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents from ``low`` to below ``high`` and their impacts."""
        first, after = np.searchsorted(self.last, [low, high])
        self.unpack(np.arange(first, min(after + 1, len(self.last))))
        i, j = np.searchsorted(self.docs, [low, high])
        return self.docs[i:j], self.impacts[i:j]


class Heap:
    """The k best documents so far: highest score first, then the smallest key, null keys last."""

    def __init__(self, k: int):
        self.k = k
        self.rows: list[tuple] = []

    @property
    def least(self) -> int:
        """What a document needs to be looked at; equal scores are decided by the key."""
        return -self.rows[-1][0] if len(self.rows) == self.k else 1

    def add(self, scores: list[int], keys: list) -> None:
        self.rows += [(-s, key is None, 0 if key is None else key) for s, key in zip(scores, keys)]
        self.rows.sort()
        del self.rows[self.k :]


def search_shard(shard: Shard, keys: list, query: list[tuple[bytes, int]], heap: Heap) -> None:
    """Add the documents of the shard to the heap; ``query`` holds terms and their weights."""
    lists = [(p, w) for p, w in ((shard.postings(t), w) for t, w in query if w > 0) if p is not None]
    lists.sort(key=lambda x: x[0].greatest * x[1])
    bounds = np.cumsum([0, *[p.greatest * w for p, w in lists]])
    for low in range(0, shard.size, RANGE):
        least = heap.least
        if bounds[-1] < least:
            return
        high = min(low + RANGE, shard.size)
        # lists before this one are not essential: together they stay below the heap
        cut = int(np.searchsorted(bounds[1:], least))
        score = np.zeros(high - low, np.int64)
        for postings, w in lists[cut:]:
            docs, impacts = postings.between(low, high)
            score[docs - low] += w * impacts
        left = np.flatnonzero(score)
        for i in range(cut - 1, -1, -1):
            left = left[score[left] + bounds[i + 1] >= least]
            if not len(left):
                break
            postings, w = lists[i]
            block = np.searchsorted(postings.last, left + low)
            most = np.append(postings.most, 0)[block] * w
            stay = score[left] + most + bounds[i] >= least
            left, block = left[stay], block[stay]
            held = block < len(postings.last)
            postings.unpack(np.unique(block[held]))
            at = np.minimum(np.searchsorted(postings.docs, left + low), len(postings.docs) - 1)
            hit = held & (postings.docs[at] == left + low)
            score[left[hit]] += w * postings.impacts[at[hit]]
        left = left[score[left] >= least]
        if len(left) > heap.k:
            left = left[score[left] >= np.partition(score[left], -heap.k)[-heap.k]]
        if len(left):
            heap.add(score[left].tolist(), [keys[low + d] for d in left.tolist()])


@dataclass
class Queries:
    """Queries of one pass: the words of each with their number, and the words of all."""

    keys: list
    words: list[list[tuple[bytes, int]]]
    weights: dict[bytes, int]


def _statistics(index: DataFrame, words: Broadcast) -> tuple[int, int, dict[bytes, int]]:
    """Documents and terms of the corpus, and in how many documents each word is; the sums
    of each shard are added up by Spark, as many rows as there are words reach the driver."""

    def read(batches):
        wanted = words.value
        for batch in batches:
            for terms, dfs, lengths in zip(*(batch.column(c).to_pylist() for c in ("terms", "dfs", "lengths"))):
                df, n = np.frombuffer(dfs, PARTS["dfs"]), np.frombuffer(lengths, PARTS["lengths"])
                rows = [(None, len(n), int(n.sum()))]
                for at, term in enumerate(terms.split(b"\n")):
                    if term in wanted:
                        rows.append((term, int(df[at]), 0))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.int64(), pa.int64()))], names=["term", "n", "total"])

    found = index.select("terms", "dfs", "lengths").mapInArrow(read, "term binary, n bigint, total bigint")
    rows = found.groupBy("term").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
    whole = next(((r["n"], r["total"]) for r in rows if r["term"] is None), (0, 0))
    return *whole, {bytes(r["term"]): r["n"] for r in rows if r["term"] is not None}


def search(
    index: DataFrame, items: DataFrame, item_key: str = "item_id", item_text: str = "text", k: int = 20, key: str = "doc_id"
) -> DataFrame:
    """The ``k`` best documents of an index for each row of ``items``: ``item_key``, ``rank``
    from 1, ``key`` (the documents' key; ``found_<key>`` where the name is taken) and ``score``.

    A score sums, over the terms of the item with repeats, the term's weight times its impact
    in the document (``weight``, ``impact``, ``length_factor``), all in whole numbers. Only
    scores above 0 count; equal ones are ordered by key, null keys last. Every row of ``items``
    is a query, whose repeats give repeated results; null and empty ones give nothing, as do an
    empty index and empty ``items``. Queries go out in groups of at most ``QUERY_ITEMS`` rows and
    about ``QUERY_BYTES`` of text, so what is broadcast is bounded; each group reads the index twice.
    """
    spark = items.sparkSession
    kind = index.schema["keys"].dataType.elementType
    shape = StructType([StructField("query", IntegerType()), StructField("key", kind), StructField("score", LongType())])
    target = to_arrow_schema(shape)
    rows = items.select(F.col(f"`{item_key}`").alias("key"), F.col(f"`{item_text}`").alias("text")).where("text is not null")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes")).first()
    groups = max(1, -(-size["n"] // QUERY_ITEMS), -(-(size["bytes"] or 0) // QUERY_BYTES))
    if groups > 1:
        rows = saved(numbered(rows, "row").withColumn("part", F.pmod(F.xxhash64("row"), F.lit(groups))), "queries")
    other = f"found_{key}" if key in (item_key, "rank", "score") else key
    item_kind = items.schema[item_key].dataType
    out = None
    for group in range(groups):
        part = rows if groups == 1 else rows.where(F.col("part") == group)
        counted = [(r["key"], Counter(w for words in terms_of(r["text"]) for w in words)) for r in part.select("key", "text").collect()]
        counted = [(a, c) for a, c in counted if c]
        vocabulary = set().union(*[c for _, c in counted])
        documents, total, df = _statistics(index, spark.sparkContext.broadcast(vocabulary))
        weights = {w: weight(documents, df[w]) for w in vocabulary if w in df}
        asked = [[(w, n) for w, n in c.items() if w in weights] for _, c in counted]
        shared = spark.sparkContext.broadcast(Queries([a for a, _ in counted], asked, weights))

        def read(batches, shared=shared, documents=documents, total=total):
            queries = shared.value
            asked = [[(w, n * queries.weights[w]) for w, n in words] for words in queries.words]
            heaps = [Heap(k) for _ in asked]
            for batch in batches:
                for i in range(batch.num_rows):
                    parts = {c: np.frombuffer(batch.column(c)[i].as_py(), t) for c, t in PARTS.items()}
                    shard = Shard(batch.column("terms")[i].as_py(), parts, documents, total)
                    keys = batch.column("keys")[i].as_py()
                    for query, heap in zip(asked, heaps):
                        search_shard(shard, keys, query, heap)
            found = [(q, None if none else a, -s) for q, heap in enumerate(heaps) for s, none, a in heap.rows]
            if found:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*found), target)], names=target.names)

        best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("key"))
        ranked = index.mapInArrow(read, shape).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        named = spark.createDataFrame(
            [(q, a) for q, a in enumerate(shared.value.keys)],
            StructType([StructField("query", IntegerType()), StructField("item", item_kind)]),
        )
        ranked = ranked.join(F.broadcast(named), "query").select(
            F.col("item").alias(item_key), "rank", F.col("key").alias(other), "score"
        )
        out = ranked if out is None else out.union(ranked)
    return out
