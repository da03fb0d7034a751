import random

import numpy as np
import pytest
from samples import documents, empty, frame, words

from maskloom.llm import decontaminate
from maskloom.llm.decontaminate import OVERLAP, Index, leaks, question_and_answer, shingles, tokens, without_leaks

ITEMS = "item_id long, text string"


def planted():
    rng = random.Random(9)
    items = [(i, " ".join(words(rng, 40)) + "?\n" + " ".join(words(rng, rng.randrange(1, 9)))) for i in range(30)]
    items += [(30, "one short"), (31, None), (32, "  "), (33, items[0][1])]
    rows, want = documents(), set()
    for i in range(12):
        host = words(rng, 300)
        text = items[i][1].upper() if i % 2 else items[i][1].replace(" ", ", ")
        if i % 3 == 0:
            parts = text.split(" ")
            parts[7] = "changed"
            text = " ".join(parts)
        host[rng.randrange(300)] += " " + text + " "
        rows.append((1000 + i, " ".join(host), "en", "a", 1, "", 0))
        want.add((1000 + i, i))
        if i == 0:
            want.add((1000, 33))
    return rows, items, want


def test_finds_planted_items_and_nothing_else(spark):
    rows, items, want = planted()
    table = spark.createDataFrame(items, ITEMS)
    got = leaks(frame(spark, rows), table)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    clean = without_leaks(frame(spark, rows), table)
    assert clean.columns == frame(spark).columns
    assert sorted(str(r[0]) for r in clean.collect()) == sorted(str(r[0]) for r in rows if (r[0] or 0) < 1000)


@pytest.mark.parametrize("limit,value", [("INDEX_ITEMS", 9), ("INDEX_BYTES", 2000)])
def test_parts_score_like_one_index(spark, monkeypatch, limit, value):
    """Neither the number of indexes nor the partitions of the items change a result."""
    rows, items, _ = planted()
    docs = frame(spark, rows)
    whole = sorted(map(tuple, leaks(docs, spark.createDataFrame(items, ITEMS)).collect()))
    left = sorted(str(r[0]) for r in without_leaks(docs, spark.createDataFrame(items, ITEMS)).collect())
    monkeypatch.setattr(decontaminate, limit, value)
    table = spark.createDataFrame(items, ITEMS).repartition(3)
    assert len(decontaminate._parts(table, "item_id", "text")) > 2
    assert sorted(map(tuple, leaks(docs, table).collect())) == whole
    assert sorted(str(r[0]) for r in without_leaks(docs, table).collect()) == left


def plain_scores(index, words):
    """Items and scores of a passage by the plain sum over all postings."""
    ids = sorted({index.vocabulary[w] for w in words if w in index.vocabulary})
    score = {}
    for v in ids:
        for k in range(index.first[v], index.first[v + 1]):
            i = int(index.item[k])
            score[i] = score.get(i, 0.0) + index.weight[k]
    return {i: s for i, s in score.items() if s >= 1 - 1e-9}


@pytest.mark.parametrize("block,cells", [(4, 1 << 21), (1, 40), (7, 9)])
def test_pivots_and_block_maxima_lose_nothing(monkeypatch, block, cells):
    """Every passage and item that reaches the threshold by the plain sum comes back."""
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    monkeypatch.setattr(decontaminate, "CELLS", cells)
    rows, items, _ = planted()
    index = Index([x for x in items if x[1]])
    texts = [tokens(r[1]) for r in rows]
    ids = np.array([index.vocabulary.get(w, len(index.vocabulary)) for t in texts for w in t], np.int64)
    got = {(t, low): dict(hits) for t, low, hits in index.passages([len(t) for t in texts], ids)}
    want = {}
    for t, words in enumerate(texts):
        for low in range(0, max(1, len(words) - index.longest), index.longest):
            hits = plain_scores(index, words[low : low + 2 * index.longest])
            if hits:
                want[t, low] = hits
    assert got == want and len(want) > 12


def test_dead_blocks_are_skipped():
    """Cursors jump over blocks that the block maxima rule out."""
    rows, items, _ = planted()
    index = Index([x for x in items if x[1]])
    ids = np.array(sorted({index.vocabulary[w] for w in tokens(items[3][1])}))
    alive = index.alive(np.zeros(len(ids), np.int64), ids, 1)[0]
    assert 0 < alive.sum() < len(alive)
    assert [i for i, _ in index.retrieve(ids, np.flatnonzero(alive).tolist())] == [3]
    assert index.retrieve(ids, []) == []


def test_same_as_brute_force_on_shingles(spark):
    """Items of which a text holds nearly all shingles are those that are found."""
    rows, items, _ = planted()
    want = set()
    for r in rows:
        grams = shingles(tokens(r[1]))
        for key, text in items:
            own = shingles(tokens(text))
            if len(tokens(text)) >= 5 and len(own & grams) >= OVERLAP * len(own):
                want.add((r[0], key))
    assert {(r.doc_id, r.item_id) for r in leaks(frame(spark, rows), spark.createDataFrame(items, ITEMS)).collect()} == want


def test_parts_and_empty_tables(spark):
    assert question_and_answer("a b?\nc") == ("a b?", "c")
    assert question_and_answer("A b. C d.") == ("A b.", "C d.")
    assert question_and_answer("only one") == ("only one", "")
    items = spark.createDataFrame([(1, "a b c")], ITEMS)
    none = spark.createDataFrame([], ITEMS)
    assert leaks(empty(spark), items).count() == 0 and leaks(frame(spark), none).count() == 0
    assert without_leaks(frame(spark), none).count() == len(documents())
