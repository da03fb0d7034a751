import collections
import math
import random
import re

import numpy as np
import pytest
from samples import documents, empty, frame

from maskloom.llm import search as module
from maskloom.llm.search import Heap, Shard, build_index, build_shard, search, search_shard, terms_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(docs, items, k=20):
    """Every document against every item, by the formula."""
    own = [(key, collections.Counter(words(text))) for key, text in docs]
    own = [(key, c, sum(c.values())) for key, c in own if c]
    n, total = len(own), sum(x[2] for x in own)
    df = collections.Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in items:
        rows = []
        for key, c, length in own:
            m = 75 + (25 * length * n) // total
            score = 0
            for t in words(text):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    score += w * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                rows.append((-score, key is None, key))
        out += [(item, rank, key, -s) for rank, (s, _, key) in enumerate(sorted(rows, key=lambda r: (r[0], r[1], r[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def queries(seed=2):
    rng = random.Random(seed)
    items = [(i, " ".join(f"W{rng.randrange(400)}" for _ in range(rng.randrange(1, 40)))) for i in range(25)]
    return [*items, (30, "w1 w1, w1! w2"), (31, None), (32, ""), (33, "nowhere"), (34, "É è-ñ"), (None, "w3 w4"), (1, items[1][1])]


def asked(spark, rows=None):
    return spark.createDataFrame(queries() if rows is None else rows, "item_id long, text string").repartition(2)


@pytest.mark.parametrize("k,shard", [(20, 16 << 20), (3, 4000), (1, 500)])
def test_same_as_brute_force(spark, monkeypatch, k, shard):
    monkeypatch.setattr(module, "SHARD_BYTES", shard)
    got = search(build_index(frame(spark)), asked(spark), k=k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    want = brute([(r[0], r[1]) for r in documents()], queries(), k)
    # equal keys of repeated rows are equal results
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_terms():
    text = "Ab1-cD_é　x\x7f{Z}\n0:9@[`"
    assert [w.decode() for p in terms_of(text) for w in p] == words(text)
    assert list(terms_of(None)) == [] and [w for p in terms_of("--") for w in p] == []
    long = "ab cd " * 500_000
    assert sum(len(p) for p in terms_of(long)) == 1_000_000 and len(list(terms_of(long))) > 1


def shard_of(texts):
    places, terms, parts = build_shard(texts)
    n = len(places)
    total = int(parts["lengths"].sum())
    return Shard(terms, parts, n, total), places


def test_block_maxima_are_exact_and_blocks_unpack():
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefgh") * rng.choice([1, 1, 2]) for _ in range(rng.randrange(1, 300))) for _ in range(900)]
    texts[17] = "a " * 70_000
    shard, _ = shard_of(texts)
    counts = [collections.Counter(words(t)) for t in texts]
    for term in shard.terms:
        p = shard.postings(term)
        packed = p.most.copy()
        p.unpack(np.arange(len(p.last)))
        assert p.docs.tolist() == [d for d, c in enumerate(counts) if c[term.decode()]]
        for b in range(len(p.last)):
            assert p.impacts[p.start[b] : p.start[b + 1]].max() == packed[b]


def test_blocks_are_rejected_before_they_are_unpacked(monkeypatch):
    """A frequent word beside a rare one is not essential, and most of its blocks stay packed."""
    monkeypatch.setattr(module, "RANGE", 256)
    rng = random.Random(6)
    texts = ["common " * rng.randrange(1, 9) + " ".join(f"x{rng.randrange(5000)}" for _ in range(50)) for _ in range(6000)]
    for i in range(0, 200, 8):
        texts[i] += " rare rare"
    shard, _ = shard_of(texts)
    n, total = shard.size, int(shard.lengths.sum())
    df = collections.Counter(t for x in texts for t in set(words(x)))
    query = [(t.encode(), module.weight(n, df[t])) for t in ("common", "rare")]
    heap = Heap(5)
    search_shard(shard, list(range(n)), query, heap)
    assert [(a, -s) for s, _, a in heap.rows] == [(r[2], r[3]) for r in sorted(brute(list(enumerate(texts)), [(0, "common rare")], 5), key=lambda r: r[1])]
    common = shard.postings(b"common")
    assert common.open.mean() < 0.3
    assert total


def test_empty_sides_and_names(spark):
    assert search(build_index(empty(spark)), asked(spark)).count() == 0
    assert search(build_index(frame(spark)), asked(spark, [])).count() == 0
    assert search(build_index(frame(spark, [r for r in documents() if not r[1]])), asked(spark)).count() == 0
    rows = spark.createDataFrame([("a", "one two", 1), ("b", "two", 2)], "id string, body string, score int")
    items = spark.createDataFrame([("q", "two", 5)], "id string, body string, rank int")
    got = search(build_index(rows, "id", "body"), items, "id", "body", key="id")
    assert got.columns == ["id", "rank", "found_id", "score"]
    assert [(r.rank, r.found_id) for r in got.orderBy("rank").collect()] == [(1, "b"), (2, "a")]


def test_groups_of_queries_and_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(module, "QUERY_ITEMS", 7)
    rows = [*documents(), (500, "w1 " * 600_000 + "w2", None, None, 1, "x", 0)]
    got = search(build_index(frame(spark, rows)), asked(spark))
    assert sorted(map(tuple, got.collect()), key=str) == brute([(r[0], r[1]) for r in rows], queries())
