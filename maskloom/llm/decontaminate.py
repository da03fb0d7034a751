"""Benchmark decontamination with a BM25 index and block-max WAND.

The items are the documents of a small inverted index, the passages of the corpus are the
queries: every passage of every text is asked, and all items above a share of their own
score come back, none is cut off by rank. Weights are divided by each item's threshold, so
one threshold of 1 serves all. Every word keeps its postings, its greatest weight, and a
sparse list of its greatest weight in each block of items. A passage is dropped when the
greatest weights of its words add up to less than the threshold, or no block reaches it by
its block maxima. Else cursors over the words' postings, ordered by their items, choose as
pivot the first item that the greatest weights up to it can lift to the threshold; a pivot in
a block that cannot reach it sends all cursors behind the block, others are scored when all
cursors before have caught up. A hit is then verified on the words: the item's shingles, its
question and its answer.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from maskloom.llm.common import as_fields, byte_slices, carried, saved

K1, B = 1.2, 0.75
BLOCK = 4
#: what rounding may take from a sum that reaches the threshold
SLACK = 1e-9
#: bytes of text that are asked at once, and cells of passages and blocks
ASKED_BYTES, CELLS = 1 << 18, 1 << 21
#: items and bytes of text per index: larger benchmarks are asked in several passes over the texts
INDEX_ITEMS = 4096
INDEX_BYTES = 8 << 20
SCORE_SHARE = 0.5
SHINGLE, OVERLAP, PART_OVERLAP = 5, 0.8, 0.5
_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def tokens(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def question_and_answer(text: str) -> tuple[str, str]:
    """First line and the rest; for one line, all but the last sentence and the last."""
    lines = [x for x in text.split("\n") if x.strip()]
    if len(lines) > 1:
        return lines[0], "\n".join(lines[1:])
    sentences = _SENTENCE.split(text.strip())
    return (" ".join(sentences[:-1]), sentences[-1]) if len(sentences) > 1 else (text, "")


def shingles(words: list[str]) -> set[tuple[str, ...]]:
    if len(words) < SHINGLE:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(SHINGLE))))


@dataclass
class Item:
    key: object
    text: str
    words: list[str]


@dataclass
class Whole:
    """What weights and passages need of all items: their number, mean and greatest length in
    words, and in how many items a word occurs."""

    n: int
    mean: float
    longest: int
    df: dict[str, int]


class Index:
    """Postings of the items, word by word in one array, and their block maxima. ``whole``
    describes the whole benchmark where the rows are a part of it."""

    def __init__(self, rows: list[tuple[object, str]], whole: Whole | None = None):
        self.items = [Item(key, text, words) for key, text, words in ((k, t, tokens(t)) for k, t in rows) if words]
        n = len(self.items)
        counts = [Counter(i.words) for i in self.items]
        # in the order of the words, so a score is added up alike in any part
        self.vocabulary = {w: v for v, w in enumerate(sorted(set().union(*counts)))}
        size = len(self.vocabulary)
        if whole is None:
            lengths = [len(i.words) for i in self.items]
            seen = Counter(w for c in counts for w in c)
            whole = Whole(n, sum(lengths) / max(n, 1), max(lengths, default=1), seen)
        self.longest, mean = whole.longest, whole.mean
        df = np.array([whole.df[w] for w in self.vocabulary], np.float64)
        idf = np.log1p((whole.n - df + 0.5) / (df + 0.5))
        words, items, weights = [], [], []
        for i, (item, c) in enumerate(zip(self.items, counts)):
            norm = K1 * (1 - B + B * len(item.words) / mean)
            own = [self.vocabulary[w] for w in c]
            weight = [idf[v] * f * (K1 + 1) / (f + norm) for v, f in zip(own, c.values())]
            bound = SCORE_SHARE * sum(weight)
            words += own
            items += [i] * len(own)
            weights += [x / bound for x in weight]
        word, item, weight = np.array(words, np.int64), np.array(items, np.int64), np.array(weights, np.float64)
        order = np.argsort(word, kind="stable")
        word, self.item, self.weight = word[order], item[order], weight[order]
        self.first = np.searchsorted(word, np.arange(size + 1))
        # one entry per word and block of items that has the word
        block = self.item // BLOCK
        head = np.ones(len(word), bool)
        head[1:] = (word[1:] != word[:-1]) | (block[1:] != block[:-1])
        cut = np.flatnonzero(head)
        self.block = block[cut]
        self.block_max = np.maximum.reduceat(self.weight, cut) if len(cut) else np.zeros(0)
        self.block_first = np.searchsorted(word[cut], np.arange(size + 1))
        # the last one is any word that no item has
        self.most = np.zeros(size + 1)
        if size:
            self.most[:size] = np.maximum.reduceat(self.weight, self.first[:-1])

    def alive(self, of: np.ndarray, ids: np.ndarray, count: int) -> np.ndarray:
        """Which blocks reach the threshold by their maxima, a row for each of ``count``
        passages; ``of`` and ``ids`` are the passage and the word of each distinct pair."""
        low = self.block_first[ids]
        size = self.block_first[ids + 1] - low
        ends = np.cumsum(size)
        at = np.repeat(low - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        blocks = -(-len(self.items) // BLOCK)
        cell = np.repeat(of, size) * blocks + self.block[at]
        bound = np.bincount(cell, self.block_max[at], minlength=count * blocks)
        return bound.reshape(count, blocks) >= 1 - SLACK

    def retrieve(self, ids: np.ndarray, alive: list[int]) -> list[tuple[int, float]]:
        """Items whose score reaches their threshold, for a passage of distinct word ids in order
        and the blocks, in order, that its block maxima leave."""
        spans = list(zip(self.first[ids].tolist(), self.first[ids + 1].tolist()))
        lists = [self.item[a:b].tolist() for a, b in spans]
        weights = [self.weight[a:b].tolist() for a, b in spans]
        most = self.most[ids].tolist()
        place = [0] * len(lists)
        cursors = [(items[0], k) for k, items in enumerate(lists)]
        found = []
        while cursors:
            cursors.sort()
            total, pivot = 0.0, None
            for item, k in cursors:
                total += most[k]
                if total >= 1 - SLACK:
                    pivot = item
                    break
            if pivot is None:
                break
            next_block = bisect_left(alive, pivot // BLOCK)
            if next_block == len(alive):
                break
            if alive[next_block] != pivot // BLOCK:
                goal = alive[next_block] * BLOCK
            elif cursors[0][0] == pivot:
                # cursors are in the order of the words
                score = 0.0
                for item, k in cursors:
                    if item != pivot:
                        break
                    score += weights[k][place[k]]
                if score >= 1 - SLACK:
                    found.append((pivot, score))
                goal = pivot + 1
            else:
                goal = pivot
            behind = bisect_left(cursors, (goal,))
            moved = cursors[behind:]
            for _, k in cursors[:behind]:
                items = lists[k]
                place[k] = bisect_left(items, goal, place[k])
                if place[k] < len(items):
                    moved.append((items[place[k]], k))
            cursors = moved
        return found

    def passages(self, sizes: list[int], ids: np.ndarray) -> Iterator[tuple[int, int, list[tuple[int, float]]]]:
        """``(text, first word, items)`` of every passage that an item's score reaches its
        threshold in; texts of ``sizes`` words lie one behind the other in ``ids``."""
        # any stretch of the longest item's words lies in one passage
        step, none = self.longest, len(self.vocabulary)
        size = np.array(sizes, np.int64)
        count = np.maximum(1, -(-(size - step) // step))
        base = np.cumsum(count) - count
        at = np.flatnonzero(ids < none)
        text = np.repeat(np.arange(len(size)), size)[at]
        place = (at - (np.cumsum(size) - size)[text]) // step
        # a word lies in the passage that starts in its stretch and in the one before
        pairs = []
        for k in (place, place - 1):
            ok = (k >= 0) & (k < count[text])
            pairs.append((base[text[ok]] + k[ok]) * (none + 1) + ids[at[ok]])
        of, word = np.divmod(np.unique(np.concatenate(pairs)), none + 1)
        total = int(count.sum())
        enough = np.bincount(of, self.most[word], minlength=total) >= 1 - SLACK
        of, word = of[enough[of]], word[enough[of]]
        owner = np.repeat(np.arange(len(size)), count)
        part = max(1, CELLS // max(1, -(-len(self.items) // BLOCK)))
        for low in range(0, total, part):
            i, j = np.searchsorted(of, [low, low + part])
            if i == j:
                continue
            alive = self.alive(of[i:j] - low, word[i:j], min(part, total - low))
            for w in np.flatnonzero(alive.any(axis=1)).tolist():
                a, b = np.searchsorted(of, [low + w, low + w + 1])
                hits = self.retrieve(word[a:b], np.flatnonzero(alive[w]).tolist())
                if hits:
                    t = int(owner[low + w])
                    yield t, (low + w - int(base[t])) * step, hits

    def search(self, texts: list[str | None]) -> list[dict[int, tuple[float, float, int]]]:
        """Verified items of each text: item -> (score share, shingle overlap, first word of the
        passage), the best passage of each."""
        found: list[dict[int, tuple[float, float, int]]] = [{} for _ in texts]
        if not self.items:
            return found
        words = [tokens(x) for x in texts]
        none = len(self.vocabulary)
        sizes = [len(x) for x in words]
        ids = np.fromiter(map(self.vocabulary.get, chain.from_iterable(words), repeat(none)), np.int64, sum(sizes))
        for t, low, hits in self.passages(sizes, ids):
            passage = words[t][low : low + 2 * self.longest]
            bag = set(passage)
            for i, score in hits:
                item = self.items[i]
                k = len(item.words)
                grams = shingles(passage) if k >= SHINGLE else set(zip(*(passage[j:] for j in range(k))))
                wanted = shingles(item.words)
                overlap = len(wanted & grams) / len(wanted)
                halves = [set(tokens(part)) for part in question_and_answer(item.text)]
                parts = [len(p & bag) >= PART_OVERLAP * len(p) for p in halves]
                if overlap >= OVERLAP and all(parts):
                    best = (score * SCORE_SHARE, overlap, low)
                    if i not in found[t] or best[:2] > found[t][i][:2]:
                        found[t][i] = best
        return found


@dataclass
class Part:
    """Rows of an index, which is built where it is asked first."""

    rows: list[tuple[object, str]]
    whole: Whole | None = None
    built: Index | None = None

    def index(self) -> Index:
        if self.built is None:
            self.built = Index(self.rows, self.whole)
        return self.built


def _item_words(rows: DataFrame) -> DataFrame:
    """``(part, length, word)``: the distinct words of each item, the length only beside the
    first one."""

    def read(batches):
        for batch in batches:
            for part, text in zip(batch.column("part").to_pylist(), batch.column("text").to_pylist()):
                words = tokens(text)
                own = list(dict.fromkeys(words))
                if own:
                    lengths = [len(words), *[None] * (len(own) - 1)]
                    yield pa.record_batch(
                        [pa.array([part] * len(own), pa.int64()), pa.array(lengths, pa.int64()), pa.array(own)],
                        names=["part", "length", "word"],
                    )

    return rows.select("part", "text").mapInArrow(read, "part bigint, length bigint, word string")


def _parts(items: DataFrame, key: str, text: str) -> list[Broadcast]:
    """The rows of one index each, in groups by a hash of key and text. Weights and passages
    are those of the whole benchmark, so they do not depend on the groups. The driver holds one
    group at a time."""
    spark = items.sparkSession
    rows = items.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).where("text is not null")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes")).first()
    groups = max(1, -(-size["n"] // INDEX_ITEMS), -(-(size["bytes"] or 0) // INDEX_BYTES))

    def one(part: DataFrame, whole: Whole | None = None) -> Broadcast:
        # the broadcast keeps a file, not the rows
        return spark.sparkContext.broadcast(Part([(r["key"], r["text"]) for r in part.orderBy("key", "text").collect()], whole))

    if groups == 1:
        return [one(rows)]
    rows = saved(rows.withColumn("part", F.pmod(F.xxhash64("key", "text"), F.lit(groups))), "items")
    found = saved(_item_words(rows), "words")
    total = found.agg(F.count("length").alias("n"), F.avg("length").alias("mean"), F.max("length").alias("longest")).first()
    df = found.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    used = saved(found.select("part", "word").distinct().join(df, "word"), "df")
    out = []
    for g in range(groups):
        own = {r["word"]: r["df"] for r in used.where(F.col("part") == g).collect()}
        whole = Whole(total["n"], total["mean"] or 0.0, total["longest"] or 1, own)
        out.append(one(rows.where(F.col("part") == g), whole))
    return out


def leaks(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """One row per text and item that it contains: ``key``, ``item_key``, ``score`` (BM25
    share of the item's own score), ``overlap`` (share of the item's five-word shingles in the
    passage) and ``word`` (where the passage starts).

    An item counts as contained when a passage reaches half of the item's own score, holds at
    least 0.8 of its five-word shingles (shorter items: all words in a row) and half of the
    words of its question and of its answer. Case and punctuation do not matter. All passages
    of whole texts are asked; null and empty texts and items match nothing; repeated rows give
    repeated results; null keys stay null. Other columns are ignored. Either table may be
    empty. A narrow stage per index of about ``INDEX_ITEMS`` items or
    ``INDEX_BYTES`` of text; scores are the same for any number of indexes.
    """
    shape = StructType(
        [
            StructField("key", docs.schema[key].dataType),
            StructField("item", items.schema[item_key].dataType),
            StructField("score", DoubleType()),
            StructField("overlap", DoubleType()),
            StructField("word", IntegerType()),
        ]
    )
    target = to_arrow_schema(shape)
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    found = None
    for shared in _parts(items, item_key, item_text):

        def read(batches, shared=shared):
            model = shared.value.index()
            for batch in batches:
                out = []
                for some in byte_slices(batch, "text", ASKED_BYTES):
                    for k, hits in zip(some.column("key").to_pylist(), model.search(some.column("text").to_pylist())):
                        for i, (score, overlap, word) in sorted(hits.items()):
                            out.append((k, model.items[i].key, score, overlap, word))
                if out:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), target)], names=target.names)

        part = rows.mapInArrow(read, shape)
        found = part if found is None else found.union(part)
    return found.select(F.col("key").alias(key), F.col("item").alias(item_key), "score", "overlap", "word")


def without_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that contain no item, unchanged; see ``leaks``."""
    select, fields, names = carried(docs, [])
    shape = StructType(fields)
    target = to_arrow_schema(shape)
    rows = docs.select(*select)
    for k, shared in enumerate(_parts(items, item_key, item_text)):

        def read(batches, shared=shared):
            model = shared.value.index()
            for batch in batches:
                for some in byte_slices(batch, names[text], ASKED_BYTES):
                    clean = [not hits for hits in model.search(some.column(names[text]).to_pylist())]
                    kept = some.filter(pa.array(clean, pa.bool_()))
                    own = [as_fields(kept.column(f.name), target.field(f.name).type) for f in fields]
                    yield pa.record_batch(own, names=target.names)

        # a stage holds one index
        rows = (saved(rows, "clean") if k else rows).mapInArrow(read, shape)
    return rows.select(*[F.col(new).alias(old) for old, new in names.items()])
