import collections
import random
import zlib

import pytest
from pyspark.sql import functions as F
from samples import documents, empty, frame

from maskloom.llm.sharding import assign, bounded, ring


def test_counts_slots_and_sizes(spark):
    for shards in (1, 3, 16, 100):
        rows = assign(frame(spark), shards).collect()
        assert len(rows) == len(documents())
        slots = collections.defaultdict(list)
        for r in rows:
            slots[r.shard].append(r.slot)
        for held in slots.values():
            assert sorted(held) == list(range(len(held)))
        sizes = [len(slots[s]) for s in range(shards)]
        assert max(sizes) - min(sizes) <= 1
    want = collections.Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in documents())
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want


def test_hot_text_and_few_moves(spark):
    hot = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'same', concat('t', id)) as text")
    eight = {r.doc_id: r.shard for r in assign(hot, 8, virtual_nodes=128).collect()}
    nine = {r.doc_id: r.shard for r in assign(hot, 9, virtual_nodes=128).collect()}
    sizes = collections.Counter(nine.values())
    assert max(sizes.values()) - min(sizes.values()) <= 1
    moved = sum(eight[k] != nine[k] for k in eight)
    assert moved < 0.6 * len(eight)
    # a small group of equal texts stays together where there is room
    pairs = spark.range(4000).selectExpr("id as doc_id", "concat('t', id div 2) as text")
    home = collections.defaultdict(set)
    for r in assign(pairs, 8).collect():
        home[r.doc_id // 2].add(r.shard)
    assert sum(len(s) == 1 for s in home.values()) > 0.97 * len(home)


@pytest.mark.parametrize("shards,nodes", [(1, 4), (5, 3), (16, 64)])
def test_same_as_a_plain_ring(spark, shards, nodes):
    """Every row walks the ring by itself: a full shard sends it to the next point. Rows of
    one text are alike, so the shards of each text are compared with their numbers."""
    rng = random.Random(shards)
    rows = [(i, "hot" if i % 3 == 0 else f"t{rng.randrange(300)}") for i in range(1500)] + [(None, None), (7, "hot")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    at = {r.text: r.at for r in docs.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("at")).collect()}
    points = ring(shards, nodes)
    room = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    waiting = [[] for _ in points]
    for _, text in sorted(rows, key=lambda r: at[r[1]]):
        waiting[sum(float(p) <= float(at[text]) for p, _ in points) % len(points)].append(text)
    want = collections.Counter()
    while any(waiting):
        onward = [[] for _ in points]
        for k, texts in enumerate(waiting):
            for text in texts:
                if room[points[k][1]]:
                    room[points[k][1]] -= 1
                    want[text, points[k][1]] += 1
                else:
                    onward[(k + 1) % len(points)].append(text)
        waiting = onward
    named = docs.withColumn("name", F.col("text"))
    got = collections.Counter((r.name, r.shard) for r in assign(named, shards, virtual_nodes=nodes).collect())
    assert got == want


def test_overflow_goes_clockwise():
    owners = [s for _, s in ring(4, 3)]
    moves = bounded([100] + [0] * 11, owners, 4)
    order = [m[3] for m in sorted(moves, key=lambda m: m[1])]
    clockwise = list(dict.fromkeys(owners))
    assert order == clockwise and sum(m[2] - m[1] for m in moves) == 100


def test_empty_table(spark):
    assert assign(empty(spark), 16).count() == 0
