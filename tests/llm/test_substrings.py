import collections
import hashlib
import re

import pytest
from samples import documents, empty, frame

from maskloom.llm import repeats
from maskloom.llm.substrings import _candidates, levels, repeated_words
from maskloom.llm.words import read_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    count = collections.Counter()
    for r in rows:
        w = WORD.findall(r[1] or "")
        count.update(tuple(w[k : k + window]) for k in range(len(w) - window + 1))
    out = []
    for r in rows:
        w = WORD.findall(r[1] or "")
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if count[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((r[0], len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window,first", [(35, 18), (20, 5), (6, 6), (7, 1)])
def test_same_as_brute_force(spark, window, first):
    got = repeated_words(frame(spark), window=window, first=first, output="sha256")
    rows = got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, rows), key=str) == brute(documents(), window)
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "row", "seg", "kept_sha256", "n_words", "n_removed"]


def test_few_words_in_a_segment():
    """A segment of fewer words than a level adds has no candidates left."""
    sizes = levels(18, 35)
    nothing = repeats._FOUND.empty_table()
    for n in range(1, 35):
        words = read_words([b" ".join(b"w%d" % i for i in range(n))])
        live = _candidates(words, 1, sizes, [])
        assert live.sum() == max(0, n - 17)
        assert not _candidates(words, 1, sizes, [nothing]).any()
        assert not _candidates(words, 1, sizes, [nothing, nothing]).any()


@pytest.mark.parametrize("n", [10, 17])
def test_one_short_text(spark, n):
    rows = [(1, " ".join(f"w{i}" for i in range(n)), "en", "a", 5, "x", 0)]
    got = repeated_words(frame(spark, rows), output="sha256").select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == brute(rows, 35)


def test_huge_text_beside_short_ones(spark):
    long = " ".join(f"v{i}" for i in range(400_000))
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(10 + i)), "en", "a", 5, "x", 0) for i in range(3)]
    rows.append((9, long, "en", "a", 5, "x", 0))
    rows.append((10, long, "en", "a", 5, "x", 0))
    got = {r.doc_id: (r.n_words, r.n_removed) for r in repeated_words(frame(spark, rows), output="spans").collect()}
    assert got == {0: (10, 0), 1: (11, 0), 2: (12, 0), 9: (400_000, 400_000), 10: (400_000, 400_000)}


def test_texts_and_spans(spark):
    rows = frame(spark)
    texts = {(r.doc_id, r.row, r.n_removed): r.text for r in repeated_words(rows).collect()}
    before = {(r.doc_id, r.row): r.text for r in rows.collect()}
    for (key, row, removed), text in texts.items():
        assert removed or text == before[key, row]
        if removed:
            assert len(WORD.findall(text)) == len(WORD.findall(before[key, row])) - removed
    for r in repeated_words(rows, output="spans").collect():
        assert sum(b - a for a, b in r.removed) == r.n_removed


def test_empty_table_and_levels(spark):
    assert repeated_words(empty(spark)).count() == 0
    assert levels(5, 35) == [5, 10, 20, 35] and levels(35, 35) == [35]
    with pytest.raises(ValueError):
        levels(36, 35)
