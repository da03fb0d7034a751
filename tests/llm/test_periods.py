import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from samples import documents, empty, frame

from maskloom.llm.periods import PRIME, find_runs, inverse, occurrences, periodic_runs, transform


def smallest(words):
    return next(p for p in range(1, len(words) + 1) if all(words[i] == words[i + p] for i in range(len(words) - p)))


def brute(words, least):
    """Every maximal stretch of every period, with its smallest period."""
    out = set()
    for p in range(1, len(words) // 2 + 1):
        start = 0
        while start < len(words):
            end = start + p
            while end < len(words) and words[end] == words[end - p]:
                end += 1
            if end - start >= max(least, 2 * p) and smallest(words[start : min(end, start + 2 * p)]) == p:
                out.add((start, end, p))
            start = max(start + 1, end - p + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def runs_of(texts, least=12):
    words, of = [], []
    for t, text in enumerate(texts):
        words += [*text, 1000 + t]
        of += [t] * (len(text) + 1)
    return [tuple(r) for r in find_runs(np.array(words), np.array(of), least).tolist()]


def test_transform_round_trip_and_convolution():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, PRIME, (2, 5, 16), dtype=np.uint64)
    assert (inverse(transform(a)) == a).all()
    a[:, 8:] = b[:, 8:] = 0
    product = inverse(transform(a) * transform(b) % np.uint64(PRIME))
    for i in range(5):
        want = [sum(int(a[i, j]) * int(b[i, k - j]) for j in range(k + 1) if k - j < 16) % PRIME for k in range(15)]
        assert product[i, :15].tolist() == want


@pytest.mark.parametrize("b", [2, 4, 16])
def test_occurrences_are_those_without_mismatch(b):
    rng = np.random.default_rng(b)
    low, high = (1 if b == 2 else 2 * b - 1), 4 * b - 2
    x = rng.integers(0, 2, 400).astype(np.uint64)
    x[120 : 120 + 100] = x[100:200]
    squares = np.concatenate([[0], np.cumsum(x * x)]).astype(np.uint64)
    at = np.arange(0, 300, b)
    place, step = occurrences(x, squares, at, b, low, high)
    want = [(i, d) for i in at.tolist() for d in range(low, high + 1) if (x[i : i + b] == x[i + d : i + d + b]).all()]
    assert list(zip(place.tolist(), step.tolist())) == want


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_same_as_brute_force(data):
    letters = data.draw(st.integers(1, 4))
    parts = data.draw(
        st.lists(st.tuples(st.lists(st.integers(0, letters), min_size=1, max_size=12), st.integers(1, 7)), max_size=6)
    )
    text = [w for part, times in parts for w in part * times]
    assert runs_of([text]) == brute(text, 12)
    assert runs_of([text], 6) == brute(text, 6)


def test_special_words():
    a, b = [0], [0, 1]
    while len(b) < 300:
        a, b = b, b + a
    for text in (b, [0] * 500, [0] * 100 + [1] + [0] * 100, [0, 1, 2] * 80 + [0, 1] * 40, list(range(40)) * 5):
        assert runs_of([text]) == brute(text, 12)


def test_runs_do_not_cross_texts():
    texts = [[0] * 10, [0] * 10, [0, 1] * 8, [1, 0] * 8, []]
    assert runs_of(texts) == [(22, 38, 2), (39, 55, 2)]


def test_one_word_a_hundred_thousand_times():
    assert runs_of([[7] * 100_000]) == [(0, 100_000, 1)]
    long = list(range(900)) * 60
    assert runs_of([long]) == [(0, len(long), 900)]


def collapsed(words, least=12):
    gone = {i for s, e, p in brute(words, least) for i in range(s + p, e)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_texts(spark):
    rng = random.Random(4)
    rows = [r for r in documents() if len(r[1] or "") < 3000]
    for i in range(40):
        unit = [f"u{rng.randrange(3)}" for _ in range(rng.randrange(1, 30))]
        text = " \n".join([*rng.sample(["a", "b", "c"], 2), *unit * rng.randrange(2, 9), *unit[: rng.randrange(9)]])
        rows.append((1000 + i, text, "en", None, 1, "x", 2))
    got = periodic_runs(frame(spark, rows))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "row", "seg", "n_words", "runs", "collapsed"]
    found = sorted(
        ((r.doc_id, r.n_words, [(x.start, x.start + x.length, x.period) for x in r.runs], r.collapsed) for r in got.collect()), key=str
    )
    want = []
    for r in rows:
        words = (r[1] or "").split()
        want.append((r[0], len(words), brute(words, 12), collapsed(words)))
    assert found == sorted(want, key=str)
    assert sum(len(x[2]) for x in found) > 30


def test_long_text_and_clashing_names(spark):
    text = "\t".join(["x"] * 400_000 + [f"w{i % 7000}" for i in range(21_000)])
    table = spark.createDataFrame([(1, text, "own", 3)], "id int, text string, runs string, counted int")
    got = periodic_runs(table).first()
    assert [tuple(r) for r in got.runs] == [(0, 400_000, 1), (400_000, 21_000, 7000)]
    assert got.n_words == 421_000 and got.collapsed == "x " + " ".join(f"w{i}" for i in range(7000))
    assert got.counted == 3 and got.id == 1


def test_empty_table_and_least_length(spark):
    assert periodic_runs(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        find_runs(np.zeros(9, np.int64), np.zeros(9, np.int64), 5)
