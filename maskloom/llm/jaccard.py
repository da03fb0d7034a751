"""Exact n-gram Jaccard join and its connected classes, with a prefix tree for the sets.

1. A shingle that occurs in one text of the corpus cannot be shared. Texts of which too
   many shingles are of that kind are finished (``repeats`` finds them without moving sets).
2. Equal sets become one set. The sets are put in one global order, rare shingles first;
   two sets that link share a shingle among the first ``n - ceil(t n) + 1`` of each.
3. The sets that have such a shingle in common form a bucket. Each bucket compares its
   members with one pivot, the set with the fewest shingles of its own, which is nearest to
   the text that its versions come from; then, round by round, with one pivot among those
   outside its largest class; and at last all members that are still in different classes.
   Pairs inside one class are not needed, since they cannot change it; no other pair is left
   out but those that the lengths and the place of the shingle rule out.
4. The candidates of a pivot are stored in a prefix tree of their ordered sets (frequent
   shingles first, so that versions of a text share long paths). It is walked once with
   the pivot: a shared path is counted once, and a branch ends where the overlap so far
   and the remaining length cannot reach the threshold.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from maskloom.llm import repeats
from maskloom.llm.common import as_fields, carried, components, numbered, saved
from maskloom.llm.words import mixed, read_words, windows

CHUNK = 64
#: rows of 17 bytes that are broadcast at most: about 10 MB as a hash table
BROADCAST_ROWS = 100_000


def shingle_sets(texts: list[bytes | None], size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, A-Z lower-cased. A text of fewer
    words is one shingle, its whole sequence; a text without words has none."""
    words = read_words([None if x is None else x.lower() for x in texts])
    value, _ = windows(words, size)
    short = {}
    out = []
    for low, high in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        n = high - low
        if n >= size:
            out.append(np.unique(value[low : high - size + 1]))
        elif n:
            if n not in short:
                short[n] = windows(words, n)[0]
            out.append(mixed(short[n][low : low + 1] ^ np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def least_overlap(n, percent: int):
    """The smallest overlap of a set of ``n`` with any set it links to."""
    return -(-n * percent // 100)


def tree_overlaps(pivot: np.ndarray, members: list[np.ndarray], percent: int) -> list[bool]:
    """Which members link to the pivot. Sets come in the global order, rare first."""
    base = np.sort(pivot)
    paths = [m[::-1] for m in members]
    order = sorted(range(len(paths)), key=lambda i: paths[i].astype(">u8").tobytes())
    linked = [False] * len(members)
    before, counted = np.zeros(0, np.uint64), np.zeros(1, np.int64)
    for i in order:
        path = paths[i]
        # the part of the path that the tree already holds with its overlaps
        m = min(len(before), len(path), len(counted) - 1)
        differ = np.flatnonzero(before[:m] != path[:m])
        shared = int(differ[0]) if len(differ) else m
        need = -(-percent * (len(pivot) + len(path)) // (100 + percent))
        total = int(counted[shared])
        counts = [counted[: shared + 1]]
        depth = shared
        while depth < len(path) and total + min(len(path) - depth, len(pivot) - total) >= need:
            step = path[depth : depth + 256]
            at = np.minimum(np.searchsorted(base, step), len(base) - 1)
            more = total + np.cumsum(base[at] == step)
            counts.append(more)
            total = int(more[-1])
            depth += len(step)
        linked[i] = depth == len(path) and total >= need
        before, counted = path[:depth], np.concatenate(counts)
    return linked


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a pivot, b) whose sets link, as ``(a, b)``."""
    many = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("m"))
    pairs = pairs.join(many, "a").select(
        "a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("m") / CHUNK)).cast("int").alias("chunk")
    )
    own = pairs.select("a", "chunk").distinct().select("a", "chunk", F.col("a").alias("rep"), F.lit(True).alias("is_pivot"))
    rows = pairs.select("a", "chunk", F.col("b").alias("rep"), F.lit(False).alias("is_pivot")).union(own)
    rows = rows.join(sets.select("rep", "tokens"), "rep")

    def walk(key, table):
        is_pivot = table.column("is_pivot").to_pylist()
        sets_ = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("tokens")]
        reps = table.column("rep").to_pylist()
        at = is_pivot.index(True)
        others = [i for i in range(len(reps)) if i != at]
        linked = tree_overlaps(sets_[at], [sets_[i] for i in others], percent)
        found = [reps[i] for i, ok in zip(others, linked) if ok]
        return pa.table({"a": pa.array([reps[at]] * len(found), pa.binary()), "b": pa.array(found, pa.binary())})

    return rows.groupBy("a", "chunk").applyInArrow(walk, "a binary, b binary")


def _fits(percent: int):
    """Length and position bounds of a pair that shares a shingle of its prefixes."""
    need = F.ceil(F.lit(percent) * (F.col("x.n") + F.col("y.n")) / F.lit(100 + percent))
    left = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
    lengths = F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent
    return lengths & (left >= need)


def _central() -> Column:
    """Order of the candidates for a pivot."""
    return F.struct("lone", (-F.col("n")).alias("less"), "rep")


def _as_pairs(joined: DataFrame) -> DataFrame:
    return joined.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()


def _links(sets: DataFrame, percent: int) -> DataFrame:
    """Links between sets (rep, n, lone, tokens) that are enough to give the classes."""

    def prefixes(batches):
        for batch in batches:
            token, rep, n, alone, place = [], [], [], [], []
            for r, size, lone, raw in zip(*(batch.column(c).to_pylist() for c in ("rep", "n", "lone", "tokens"))):
                own = np.frombuffer(raw, np.int64)[lone : size - least_overlap(size, percent) + 1]
                token.append(own)
                rep += [r] * len(own)
                n += [size] * len(own)
                alone += [lone] * len(own)
                place.append(np.arange(lone, lone + len(own), dtype=np.int32))
            if token:
                yield pa.record_batch(
                    [pa.array(np.concatenate(token)), pa.array(rep, pa.binary()), pa.array(n, pa.int32()), pa.array(alone, pa.int32()), pa.array(np.concatenate(place))],
                    names=["token", "rep", "n", "lone", "place"],
                )

    posted = sets.mapInArrow(prefixes, "token long, rep binary, n int, lone int, place int")
    size = posted.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.min(_central()).alias("c")).where("m > 1")
    posted = saved(posted.join(size.select("token", F.col("c.rep").alias("pivot")), "token"), "prefixes")
    x, y = posted.where("rep = pivot").alias("x"), posted.where("rep != pivot").alias("y")
    pairs = _as_pairs(x.join(y, F.col("x.token") == F.col("y.token")).where(_fits(percent)))
    tested = saved(pairs, "pairs")
    # links stand for the classes: each round replaces them by stars around the classes' roots
    links = _verify(tested, sets, percent)
    used = posted.where("rep = pivot").select("token", "rep")
    posted = posted.drop("pivot")
    while True:
        label = components(links)
        links = label.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        marked = _marked(posted, label)
        outside = marked.where("label != main")
        # one more pivot of each bucket that holds several classes
        fresh = outside.join(used, ["token", "rep"], "left_anti")
        chosen = saved(fresh.groupBy("token").agg(F.min(_central()).alias("c")).select("token", F.col("c.rep").alias("rep")), "pivots")
        pairs = saved(_untested(outside.join(chosen, ["token", "rep"]), marked, tested, percent), "pairs")
        found = saved(_verify(pairs, sets, percent), "links")
        tested, used = tested.union(pairs), used.union(chosen)
        if found.isEmpty():
            break
        links = links.union(found)
    # the classes did not change, so ``marked`` still holds
    return links.union(_verify(_untested(outside, marked, tested, percent), sets, percent))


def _marked(posted: DataFrame, label: DataFrame) -> DataFrame:
    """The members of buckets that hold several classes, with their class and the largest."""
    label = label.withColumnRenamed("node", "rep")
    marked = posted.join(label, "rep", "left").select(
        "token", "rep", "n", "lone", "place", F.coalesce("root", "rep").alias("label")
    )
    parts = marked.groupBy("token", "label").agg(F.count(F.lit(1)).alias("k"))
    main = (
        parts.groupBy("token")
        .agg(F.max(F.struct("k", "label")).alias("top"), F.count(F.lit(1)).alias("labels"))
        .where("labels > 1")
        .select("token", F.col("top.label").alias("main"))
    )
    return saved(marked.join(main, "token"), "marked")


def _untested(some: DataFrame, marked: DataFrame, tested: DataFrame, percent: int) -> DataFrame:
    """Pairs of ``some`` with members of other classes in the same bucket, once each."""
    x, y = some.select("token", "rep", "n", "place", "label").alias("x"), marked.alias("y")
    apart = (F.col("x.token") == F.col("y.token")) & (F.col("x.label") != F.col("y.label"))
    pairs = _as_pairs(x.join(y, apart).where(_fits(percent)))
    turned = tested.select(F.col("b").alias("a"), F.col("a").alias("b"))
    pairs = pairs.join(tested.union(turned), ["a", "b"], "left_anti")
    # a pair that both of its ends ask for is checked once
    ordered = pairs.groupBy(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
    return ordered.agg(F.min("a").alias("a")).select("a", F.when(F.col("a") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("b"))


def classes(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 4, percent: int = 85
) -> DataFrame:
    """Classes of rows whose shingle sets are linked, directly or over other rows.

    Two rows link when ``100 * |intersection| >= percent * |union|``. Returns one row per
    input row: the column ``key``, ``n_shingles``, ``component_id`` (the smallest key in the
    class, its own included), ``in_class`` (number of rows of the class), ``text_key``
    (xxhash64 of the text) and ``first`` (true for the rows that equal
    the first of the class, in the order of key, nulls last, and text key).

    Words are runs of anything but space and the control characters 9 to 13; A-Z count as
    lower case. Null and empty texts have no shingles and form classes of their own, with
    their own key. Rows that repeat are rows of one class. A null key stays null, unless
    another row of its class has one. Other columns of ``docs`` are ignored. An empty table
    gives an empty table. Reads the texts once for the shuffle and writes only the sets that
    share enough shingles with others; nothing but counts reaches the driver.
    """
    total = repeats.text_bytes(docs, text)
    ranges = repeats.ranges_for(total)
    base = numbered(docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")), "row")
    base = base.withColumn("textkey", F.xxhash64("text"))
    laid = repeats.segmented(base, "row", "text", total)

    def as_bytes(table):
        return [None if x is None else x.encode() for x in table.column("text").to_pylist()]

    def send(seg, table):
        sets = shingle_sets(as_bytes(table), size)
        return repeats.packed(np.concatenate(sets), seg[0].as_py(), ranges, False)

    shape = StructType(
        [
            StructField("id", base.schema["id"].dataType),
            StructField("textkey", LongType()),
            StructField("n", LongType()),
            StructField("sig", BinaryType()),
            StructField("lone", IntegerType()),
            StructField("tokens", BinaryType()),
        ]
    )
    target = to_arrow_schema(shape)

    def describe(seg, table, answers):
        sets = shingle_sets(as_bytes(table), size)
        spread = repeats.lookup(answers, np.concatenate(sets) if sets else np.zeros(0, np.uint64), ranges, False)
        at, seen = 0, set()
        n, sig, lone, tokens = [], [], [], []
        for own in sets:
            count = spread[at : at + len(own)]
            at += len(own)
            n.append(len(own))
            alone = int((count == 0).sum())
            if not len(own) or len(own) - alone < least_overlap(len(own), percent):
                sig.append(None), lone.append(None), tokens.append(None)
                continue
            digest = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
            sig.append(digest)
            lone.append(alone)
            # one copy of equal sets is enough
            tokens.append(None if digest in seen else own[np.lexsort((own, count))].tobytes())
            seen.add(digest)
        return pa.table(
            [
                as_fields(table.column("id"), target.field("id").type),
                table.column("textkey"),
                pa.array(n, pa.int64()),
                pa.array(sig, pa.binary()),
                pa.array(lone, pa.int32()),
                pa.array(tokens, pa.binary()),
            ],
            names=target.names,
        )

    sent = laid.groupBy("seg").applyInArrow(send, repeats.SENT)
    answers = repeats.matched(sent, ranges, False)
    signed = saved(laid.groupBy("seg").cogroup(answers.groupBy("seg")).applyInArrow(describe, shape), "signed")
    sets = (
        signed.where("tokens is not null")
        .groupBy(F.col("sig").alias("rep"))
        .agg(F.first("n").cast("int").alias("n"), F.first("lone").alias("lone"), F.first("tokens").alias("tokens"))
    )
    sets = saved(sets, "sets")
    label = components(_links(sets, percent))
    shared = signed.where("sig is not null").select("sig", "id", "textkey")
    shared = shared.join(label.select(F.col("node").alias("sig"), "root"), "sig", "left").select(
        "sig", "id", "textkey", F.coalesce("root", "sig").alias("root")
    )
    lowest = shared.groupBy("root").agg(
        F.min("id").alias("least"),
        F.count(F.lit(1)).alias("in_class"),
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "textkey")).alias("head"),
    )
    of_sig = shared.select("sig", "root").distinct().join(lowest, "root").drop("root")
    alone = signed.where("sig is null").select(
        "id", "n", F.col("id").alias("least"), F.lit(1).cast("long").alias("in_class"), "textkey", F.lit(True).alias("first")
    )
    grouped = (
        signed.where("sig is not null")
        .join(of_sig, "sig")
        .select(
            "id",
            "n",
            "least",
            "in_class",
            "textkey",
            (F.col("id").eqNullSafe(F.col("head.id")) & F.col("textkey").eqNullSafe(F.col("head.textkey"))).alias("first"),
        )
    )
    return alone.union(grouped).select(
        F.col("id").alias(key),
        F.col("n").alias("n_shingles"),
        F.col("least").alias("component_id"),
        "in_class",
        F.col("textkey").alias("text_key"),
        "first",
    )


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, one of each class of near copies (``classes``).

    The one with the smallest key stays, null keys last; of rows equal in key and text, one.
    Rows without words (null and empty texts) are no copies of each other and stay. Columns of
    the caller travel under other names, so they cannot clash. An empty table stays empty.
    """
    rows = classes(docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")), "id", "text", size, percent)
    per_text = rows.where("in_class > 1").groupBy("id", "text_key").agg(F.max("first").alias("first"), F.count(F.lit(1)).alias("copies"))
    # of the rows that are not alone: whether one stays
    gone = saved(per_text.where("not first or copies > 1"), "classes")
    few = gone.count() <= BROADCAST_ROWS
    select, _, names = carried(docs, [])
    own = docs.select(*select)
    same = F.col(names[key]).eqNullSafe(F.col("id")) & F.xxhash64(names[text]).eqNullSafe(F.col("text_key"))
    marked = own.join(F.broadcast(gone) if few else gone, same, "left")
    kept = marked.where("first is null")
    if not gone.where("first").isEmpty():
        kept = kept.unionByName(marked.where("first").dropDuplicates(["id", "text_key"]))
    return kept.select(*[F.col(new).alias(old) for old, new in names.items()])
