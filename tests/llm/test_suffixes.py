import collections
import random

import numpy as np
import pytest
from samples import documents, empty, frame

from maskloom.llm import suffixes
from maskloom.llm.suffixes import Names, blocks_of, least, repeated_bytes


def brute(rows, window):
    count = collections.Counter()
    texts = [(r[1] or "").encode() for r in rows]
    for t in texts:
        count.update(t[k : k + window] for k in range(len(t) - window + 1))
    out = []
    for r, t in zip(rows, texts):
        gone = bytearray(len(t))
        for k in range(len(t) - window + 1):
            if count[t[k : k + window]] > 1:
                gone[k : k + window] = b"\1" * window
        spans = []
        for i, g in enumerate(gone):
            if g and (not i or not gone[i - 1]):
                spans.append([i, i])
            if g:
                spans[-1][1] = i + 1
        out.append((r[0], len(t), sum(gone), spans, bytes(b for b, g in zip(t, gone) if not g)))
    return sorted(out, key=str)


def plain(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, [[x.start, x.end] for x in r.spans], bytes(r.kept)) for r in df.collect()), key=str)


@pytest.mark.parametrize("window", [8, 50, 400])
def test_same_as_brute_force(spark, window):
    rows = [(*r[:1], r[1] and r[1][:1500], *r[2:]) for r in documents()]
    got = repeated_bytes(frame(spark, rows), window=window)
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "row", "seg", "n_bytes", "n_removed", "spans", "kept"]
    assert plain(got) == brute(rows, window)


@pytest.mark.parametrize("seed", range(3))
def test_edges_periods_and_near_copies(spark, seed, monkeypatch):
    """Small segments and pieces, strings of exactly the length, one byte less, periodic texts."""
    monkeypatch.setattr(suffixes.repeats, "SEGMENT_BYTES", 3000)
    monkeypatch.setattr(suffixes, "PIECE", 700)
    rng = random.Random(seed)

    def noise(n):
        return "".join(rng.choice("abcdé ") for _ in range(n))

    shared = noise(90)
    rows = []
    for i in range(60):
        text = noise(rng.randrange(0, 300))
        if i % 3 == 0:
            text = noise(30) + shared[rng.randrange(0, 20) : rng.randrange(60, 91)] + noise(20)
        if i % 5 == 1:
            text = "ab" * rng.randrange(10, 100) + "c" * rng.randrange(0, 120)
        if i % 10 == 7:
            text = shared * 20 + noise(3) + shared[:41]
        rows.append((i, text, "en", None, 1, "x", 3))
    for window in (40, 41):
        assert plain(repeated_bytes(frame(spark, rows), window=window)) == brute(rows, window)


def test_equal_windows_pick_equal_places():
    rng = np.random.default_rng(2)
    shared = rng.integers(0, 256, 700, dtype=np.uint8).tobytes()
    data = [rng.integers(0, 256, n, dtype=np.uint8).tobytes() + shared + rng.integers(0, 256, 333, dtype=np.uint8).tobytes() for n in (500, 77)]
    found = [blocks_of(d, [(0, 0, 0, len(d))], 400) for d in data]
    for d, blocks, lead in zip(data, found, (500, 77)):
        assert blocks["n"].sum() == len(d) - 399
        inside = blocks[(blocks["low"] >= lead) & (blocks["low"] + blocks["n"] + 399 <= lead + 700)]
        assert len(inside) and np.isin(inside["core"], found[0]["core"]).all() and np.isin(inside["core"], found[1]["core"]).all()


def test_names_and_least():
    data = b"abcabcabc"
    names = Names(data)
    at = np.array([0, 3, 6])
    assert len(set(names.of(at, at + 3).tolist())) == 1
    assert names.of(at, at + 3)[0] == names.grams(3)[3] != names.of(at, at + 2)[0]
    values = np.random.default_rng(1).integers(0, 99, 50).astype(np.uint64)
    assert least(values, 7).tolist() == [min(values[i : i + 7]) for i in range(44)]


def test_long_text_twice(spark):
    long = " ".join(f"v{i}" for i in range(700_000))
    rows = [(1, long, "en", "a", 1, "x", 0), (2, "y" + long[:5_000_000] + "z", "en", "a", 1, "x", 0), (3, "short", None, None, 1, "x", 0)]
    got = {r[0]: r[1:4] for r in plain(repeated_bytes(frame(spark, rows)))}
    assert got == {1: (len(long), 5_000_000, [[0, 5_000_000]]), 2: (5_000_002, 5_000_000, [[1, 5_000_001]]), 3: (5, 0, [])}


def test_empty_table_and_least_window(spark):
    assert repeated_bytes(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        repeated_bytes(empty(spark), window=7)
