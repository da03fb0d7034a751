"""The exchange of keys over hubs, as it runs where the ranges outnumber what a segment sends."""

import collections
import contextlib
import io

import numpy as np
import pytest
import test_jaccard
import test_substrings
import test_suffixes
from samples import documents, empty, frame

from maskloom.llm import repeats
from maskloom.llm.jaccard import classes
from maskloom.llm.substrings import repeated_words
from maskloom.llm.suffixes import repeated_bytes


@pytest.fixture
def hubs(monkeypatch):
    """Three rows a segment, segments of a few texts."""
    monkeypatch.setattr(repeats, "SEGMENT_BYTES", 2000)
    monkeypatch.setattr(repeats, "ranges_for", lambda size: repeats.Ranges(8, 3))


def test_words(spark, hubs):
    got = repeated_words(frame(spark), output="sha256").select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == test_substrings.brute(documents(), 35)
    assert repeated_words(empty(spark)).count() == 0


def test_bytes(spark, hubs):
    rows = [(*r[:1], r[1] and r[1][:1500], *r[2:]) for r in documents()]
    for window in (50, 400):
        assert test_suffixes.plain(repeated_bytes(frame(spark, rows), window=window)) == test_suffixes.brute(rows, window)


def test_classes(spark, hubs):
    got = classes(frame(spark), size=4, percent=85).select("doc_id", "n_shingles", "component_id", "in_class").collect()
    assert sorted(map(tuple, got), key=str) == test_jaccard.brute(documents(), 4, 85)


def test_every_key_and_segment(spark):
    """Answers over hubs against plain counting, for narrow and wide keys."""
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 63, 400, dtype=np.uint64) * np.uint64(2)
    held = {seg: rng.choice(pool, rng.integers(0, 60)) for seg in range(23)}
    count = collections.Counter(k for keys in held.values() for k in keys.tolist())
    ranges = repeats.Ranges(16, 4)
    for wide in (False, True):
        parts = [repeats.packed(keys, seg, ranges, wide) for seg, keys in held.items()]
        assert max(p.num_rows for p in parts) <= 4
        rows = [tuple(r.values()) for p in parts for r in p.to_pylist()]
        sent = spark.createDataFrame(rows, repeats.SENT)
        answers = repeats.matched(sent, ranges, wide).toArrow()
        for seg, keys in held.items():
            own = answers.filter(np.array(answers.column("seg")) == seg)
            assert ((repeats.lookup(own, keys, ranges, wide) > 0) == [count[k] > 1 for k in keys.tolist()]).all()


@pytest.mark.parametrize("gb", [0.5, 5, 30, 100, 10_000, 200_000])
def test_rows_follow_the_corpus(gb):
    """Rows that segments and hubs send per segment stay below one bound at every size."""
    size = int(gb * 1e9)
    ranges, segments = repeats.ranges_for(size), -(-size // repeats.SEGMENT_BYTES)
    if not ranges.hubs:
        assert ranges.count <= repeats.FAN
        return
    assert ranges.fan < 1.1 * repeats.FAN and ranges.coarse <= ranges.fan
    hubs = -(-segments // ranges.fan) * ranges.fan
    assert segments * ranges.fan + hubs * ranges.coarse <= 2.3 * repeats.FAN * max(segments, ranges.fan)
    assert hubs < 1 << 31 and ranges.coarse * ranges.fan >= ranges.count


def test_texts_and_sent_keys_move_once(spark, hubs):
    """What the hubs read twice is exchanged once."""
    found = repeated_words(frame(spark), window=20, first=20, output="sha256")
    found.collect()
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        found.explain()
    final = out.getvalue().split("Initial Plan")[0]
    reused = [line for line in final.splitlines() if "ReusedExchange" in line]
    assert any("hub#" in line for line in reused) and any("text#" in line for line in reused), final
