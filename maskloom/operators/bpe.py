"""Byte-pair merges: exact training in Spark rounds and in-task encoding.

Training keeps the word types in shards (``merging``): a round applies merges inside the
shards and sends back how the counts of pairs have changed.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from maskloom.functions import batches
from maskloom.functions.text import plain
from maskloom.operators import merging
from maskloom.operators.merging import Merge
from maskloom.operators.tokens import BPE_SPECIALS, characters, decode_table
from maskloom.session import saved

#: leading pairs that the driver keeps, and looks at in a round
CANDIDATES = 1 << 15
TOP = 256
#: rounds until the shards are written again
PENDING_ROUNDS = 24
#: rounds until the shards are kept in memory as they stand, so that a round repeats few others
NEAR_ROUNDS = 4
MEMO_WORDS = 500_000
#: texts that are encoded at once
ENCODED_TEXTS = 256


@dataclass
class BpeModel:
    """Vocabulary in id order and merges in rank order as (left, right, merged) ids."""

    tokens: list[str]
    merges: list[tuple[int, int, int]] = field(default_factory=list)
    rounds: int = 0

    def vocab_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            list(enumerate(self.tokens)), "id int, token string"
        )

    def merge_table(self, spark: SparkSession) -> DataFrame:
        rows = [(rank, *merge) for rank, merge in enumerate(self.merges)]
        return spark.createDataFrame(rows, "rank int, left int, right int, merged int")

    def mark(self) -> str:
        """A digest of the contents."""
        return hashlib.sha256(json.dumps([self.tokens, self.merges]).encode()).hexdigest()

    def save(self, spark: SparkSession, path: str) -> None:
        """Write both tables; a model of any earlier contents is replaced."""
        self.vocab_table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/vocab")
        self.merge_table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/merges")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BpeModel:
        vocab = spark.read.parquet(f"{path}/vocab").orderBy("id").collect()
        merges = spark.read.parquet(f"{path}/merges").orderBy("rank").collect()
        return cls([r["token"] for r in vocab], [(r["left"], r["right"], r["merged"]) for r in merges])


def _safe_prefix(
    top: list[tuple[int, int]], inside, model: BpeModel, ids: dict[str, int], vocab_size: int, min_frequency: int
) -> tuple[list[Merge], bool]:
    """Take pairs in rank order as long as one round equals one merge at a time; and whether
    the last one made a symbol that was there before.

    A merge (a, b) only changes pairs that end in a or start with b, so a later pair
    is untouched unless it is one of those. New pairs are never more frequent than
    such a pair, which ranks below everything taken, and lose ties by their new id.
    The two exceptions close the round: a doubled symbol, whose merge can create
    frequent pairs by itself, and a merged string that already has an id.
    """
    taken: list[Merge] = []
    lefts: set[int] = set()
    rights: set[int] = set()
    for pair, n in top:
        left, right = pair >> 32, pair & 0xFFFFFFFF
        if n < max(1, min_frequency) or len(ids) >= vocab_size or not inside(pair, n):
            break
        if right in lefts or left in rights:
            break
        text = model.tokens[left] + model.tokens[right]
        known = text in ids
        if not known:
            ids[text] = len(model.tokens)
            model.tokens.append(text)
        taken.append((left, right, ids[text]))
        lefts.add(left)
        rights.add(right)
        if known or left == right:
            return taken, known
    return taken, False


def bpe_train(
    words: DataFrame,
    vocab_size: int = 32000,
    min_frequency: int = 2,
    candidates: int = CANDIDATES,
) -> BpeModel:
    """Learn merges from ``words(word, n)``: most frequent pair first, ties by ids.

    The driver keeps the counts of up to ``candidates`` leading pairs and of the new ones that
    rank among them. Each round takes every merge that is safe together and gets back how the
    counts change, over the words that hold a merged pair. The shards are kept in memory every
    ``NEAR_ROUNDS`` rounds and written every ``PENDING_ROUNDS``, so a lost executor costs a few
    rounds at most. When they are written, words are cut at pairs that will hardly be merged; if
    it comes to those after all, training goes on from the words as they were. What is left of
    few symbols is held by the driver.
    """
    spark = words.sparkSession
    # the corpus is read once
    base = saved(words.select("word", "n"), "words")
    # distinct characters are bounded by Unicode
    alphabet = sorted(
        row["c"]
        for row in base.select(F.explode(characters(F.col("word"))).alias("c")).distinct().collect()
    )
    model = BpeModel([*BPE_SPECIALS, *alphabet])
    ids = {token: i for i, token in enumerate(model.tokens)}
    state = saved(merging.shards_of(base, alphabet, len(BPE_SPECIALS)), "shards").persist()
    shards = state.count()
    # words before they were cut and the batches since then; pairs below the floor are not counted
    whole: DataFrame | None = None
    since: list[list[Merge]] = []
    floor = min_frequency
    local = merging.held(state) if shards else None
    if local is not None:
        state.unpersist()
        state = local
    # the state, the batches that it lacks, and how many have come since it was written
    pending: list[list[Merge]] = []
    unwritten = 0
    known = merging.leading(state, pending, candidates) if shards else None
    while known is not None and len(ids) < vocab_size:
        batch, again = _safe_prefix(known.top(TOP), known.inside, model, ids, vocab_size, floor)
        if whole is not None and (not batch or again):
            # a pair below the floor may be next, or a symbol that was there before comes back
            since += [batch] if batch else []
            model.merges += batch
            model.rounds += bool(batch)
            if not isinstance(state, merging.Shard):
                state.unpersist()
            state = saved(merging.advanced(whole, since), "shards").persist()
            shards, whole, since, pending, unwritten, floor = state.count(), None, [], [], 0, min_frequency
            known = merging.leading(state, pending, candidates)
            continue
        if not batch:
            # nothing is left, or the leading pairs are used up
            best = known.top(1)
            if known.border == (0, 0) or (best and known.inside(*best[0])) or -known.border[0] < max(1, min_frequency):
                break
            known = merging.leading(state, pending, candidates)
            if not known.counts:
                break
            continue
        model.merges += batch
        model.rounds += 1
        if again:
            # pairs of a symbol that was there before may be outside of the leading ones
            known = merging.leading(state, [*pending, batch], candidates)
        else:
            keys, change = merging.differences(state, pending, batch, shards)
            known.change(keys, change, {new for *_, new in batch})
        since.append(batch)
        if isinstance(state, merging.Shard):
            continue
        pending.append(batch)
        unwritten += 1
        if len(pending) >= NEAR_ROUNDS or unwritten >= PENDING_ROUNDS:
            ahead = merging.advanced(state, pending)
            if unwritten >= PENDING_ROUNDS:
                ahead, unwritten = saved(ahead, "shards"), 0
                border, live = _worth_keeping(known, vocab_size - len(ids), floor)
                if live is not None:
                    if whole is None:
                        whole, since = ahead, []
                    ahead, floor = saved(merging.compacted(ahead, [], live, shards), "shards"), border
            old, state = state, ahead.persist()
            shards = state.count()
            old.unpersist()
            pending = []
            local = merging.held(state) if not unwritten else None
            if local is not None:
                state.unpersist()
                state = local
    if not isinstance(state, merging.Shard):
        state.unpersist()
    return model


def _worth_keeping(known: merging.Leading, missing: int, floor: int) -> tuple[int, np.ndarray | None]:
    """A count that the ``missing`` merges will hardly fall below, and the pairs that have it,
    where these are known."""
    counts = sorted(known.counts.values(), reverse=True)
    if len(counts) <= 2 * missing:
        return floor, None
    border = max(floor, counts[2 * missing])
    # pairs that are not known have as many as the border of the known ones at most
    if border <= -known.border[0]:
        return floor, None
    return border, np.array(sorted(pair for pair, n in known.counts.items() if n >= border), np.int64)


class _Encoder:
    """Merges one word at a time, remembering recent words."""

    def __init__(self, model: BpeModel, unk: str) -> None:
        self.rank = {
            (left, right): (rank, merged)
            for rank, (left, right, merged) in enumerate(model.merges)
        }
        self.single = {token: i for i, token in enumerate(model.tokens) if len(token) == 1}
        self.unk = model.tokens.index("[UNK]") if unk == "unk" else None
        self.memo: dict[str, list[int]] = {}
        self.seen: dict[str, np.ndarray] = {}

    def word(self, text: str) -> list[int]:
        found = self.memo.get(text)
        if found is None:
            if len(self.memo) >= MEMO_WORDS:
                self.memo.clear()
            found = self.memo[text] = self._merge(text)
        return found

    def raw(self, text: str) -> np.ndarray:
        """Ids of a word as it stands in a text. Normalizing neither makes nor removes white
        space, so only words that were not seen lately are normalized."""
        found = self.seen.get(text)
        if found is None:
            if len(self.seen) >= MEMO_WORDS:
                self.seen.clear()
            found = self.seen[text] = np.array(self._merge(text.lower() if text.isascii() else plain(text)), np.int32)
        return found

    def _merge(self, text: str) -> list[int]:
        """Merge the best pair, the leftmost of equal ones, until none is left: a heap of pairs
        over a linked list, so a word of n symbols takes about n log n steps."""
        ids = [i for i in (self.single.get(c, self.unk) for c in text) if i is not None]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for at, pair in enumerate(zip(ids, ids[1:])):
            found = self.rank.get(pair)
            if found is not None:
                heap.append((found[0], at, pair))
        heapify(heap)
        while heap:
            _, at, pair = heappop(heap)
            right = after[at]
            # a pair of which a side was merged meanwhile
            if ids[at] is None or right >= n or (ids[at], ids[right]) != pair:
                continue
            ids[at], ids[right] = self.rank[pair][1], None
            after[at] = after[right]
            if after[at] < n:
                before[after[at]] = at
            for left in (before[at], at):
                if left >= 0 and after[left] < n:
                    pair = (ids[left], ids[after[left]])
                    found = self.rank.get(pair)
                    if found is not None:
                        heappush(heap, (found[0], left, pair))
        return [i for i in ids if i is not None]


def bpe_encode(df: DataFrame, model: BpeModel, text: str = "text", name: str = "ids", unk: str = "drop") -> DataFrame:
    """Add token ids of a text column.

    A narrow stage without any shuffle: a frequent word is merged once per task and
    then looked up, so no word of any frequency becomes a hot key. Characters outside
    the alphabet vanish, or become [UNK] with ``unk="unk"``.
    """
    if unk not in ("drop", "unk"):
        raise ValueError(f"unknown unk rule {unk!r}")
    # bounded by the vocabulary size
    shared = df.sparkSession.sparkContext.broadcast((model.tokens, model.merges))

    @F.arrow_udf("array<int>")
    def encode(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens, merges = shared.value
        encoder = _Encoder(BpeModel(tokens, merges), unk)
        for part in parts:
            cut = [_encoded(part.slice(low, ENCODED_TEXTS), encoder) for low in range(0, len(part), ENCODED_TEXTS)]
            yield pa.concat_arrays(cut) if cut else pa.array([], pa.list_(pa.int32()))

    return df.withColumn(name, encode(F.col(text)))


def _encoded(texts: pa.Array, encoder: _Encoder) -> pa.Array:
    """Ids of some texts: a word is looked up once for all of them, the rest is places."""
    words = [text.split() if text else [] for text in texts.to_pylist()]
    place: dict[str, int] = {}
    which = np.array([place.setdefault(w, len(place)) for some in words for w in some], np.int64)
    codes = [encoder.raw(w) for w in place]
    sizes = np.array([len(c) for c in codes], np.int64)
    table = np.concatenate([*codes, np.zeros(0, np.int32)])
    long = sizes[which] if len(which) else which
    ids = table[np.repeat(batches.ends(sizes)[:-1][which], long) + batches.places(long)] if len(which) else table
    per_text = np.diff(batches.ends(long)[batches.ends(np.array([len(some) for some in words], np.int64))])
    return batches.lists(ids, per_text, texts.is_null().to_numpy(zero_copy_only=False))


def bpe_decode(df: DataFrame, model: BpeModel, ids: str = "ids", joiner: str = " ") -> DataFrame:
    """Ids to text; without a word-boundary mark the default puts blanks between tokens."""
    return decode_table(df, model.vocab_table(df.sparkSession), ids, joiner)
