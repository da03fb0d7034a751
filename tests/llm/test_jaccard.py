import collections
import random
import re

import numpy as np
import pytest
from samples import SCHEMA, documents, empty, frame

from maskloom.llm.common import components
from maskloom.llm.jaccard import classes, tree_overlaps

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def brute(rows, size, percent):
    sets = []
    for r in rows:
        w = WORD.findall((r[1] or "").translate(LOWER))
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    group = collections.defaultdict(list)
    for a in range(len(rows)):
        group[find(a)].append(a)
    out = []
    for members in group.values():
        keys = [rows[a][0] for a in members if rows[a][0] is not None]
        out += [(rows[a][0], len(sets[a]), min(keys, default=None), len(members)) for a in members]
    return sorted(out, key=str)


@pytest.mark.parametrize("size,percent", [(4, 85), (1, 50)])
def test_same_as_brute_force(spark, size, percent):
    got = classes(frame(spark), size=size, percent=percent)
    rows = got.select("doc_id", "n_shingles", "component_id", "in_class").collect()
    assert sorted(map(tuple, rows), key=str) == brute(documents(), size, percent)
    heads = got.where("first and in_class > 1").select("component_id", "doc_id").distinct().collect()
    assert all(r.component_id == r.doc_id for r in heads)


def test_chains_of_versions(spark):
    """Versions that drift away from the first: a chain links texts that are not alike."""
    rng = random.Random(5)
    rows, key = [], 0
    for family in range(3):
        now = [f"f{family}w{i}" for i in range(120)]
        for step in range(16):
            rows.append((key, " ".join(now), "en", "a", 1, "", 0))
            key += 1
            for _ in range(rng.randrange(1, 6)):
                now[rng.randrange(120)] = f"n{rng.randrange(10**6)}"
    got = classes(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "n_shingles", "component_id", "in_class").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 4, 85)


def test_empty_table(spark):
    assert classes(empty(spark)).count() == 0


def test_tree_walk_counts_like_sets():
    rng = np.random.default_rng(3)
    for _ in range(30):
        order = rng.permutation(80).astype(np.uint64)
        place = {int(t): i for i, t in enumerate(order)}
        base = rng.random(80) < 0.7
        pick = lambda mask: np.array(sorted(np.flatnonzero(mask), key=lambda t: place[int(t)]), np.uint64)
        pivot = pick(base)
        members = [pick(base ^ (rng.random(80) < rng.choice([0.02, 0.1, 0.4]))) for _ in range(12)]
        members = [m for m in members if len(m)]
        got = tree_overlaps(pivot, members, 70)
        for m, linked in zip(members, got):
            both = len(set(m.tolist()) & set(pivot.tolist()))
            assert linked == (100 * both >= 70 * (len(m) + len(pivot) - both))


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 1), (9, 8), (8, 9), (7, 7), (None, 2), (20, 21), (21, 22), (22, 20)]
    edges += [(100 + i, 101 + i) for i in range(40)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    want = {5: 1, 4: 1, 3: 1, 1: 1, 9: 8, 8: 8, 20: 20, 21: 20, 22: 20, **{i: 100 for i in range(100, 141)}}
    assert got == want
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0
