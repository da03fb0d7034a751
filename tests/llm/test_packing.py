import collections
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from samples import documents, empty, frame
from tokenizers import Tokenizer

from maskloom.llm.packing import Encoder, added_tokens, cut, find_places, pack, rounds

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def reference():
    loaded = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    loaded.encode_special_tokens = True
    return lambda text: loaded.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab c\n\tÉé'st1  ., 日", max_size=30))
def test_encoder_is_the_tokenizer(reference, text):
    assert np.frombuffer(Encoder(PATH, PATTERN)(text), "<u4").tolist() == reference(text)


@lru_cache
def as_loaded():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@lru_cache
def encoder():
    return Encoder(PATH, PATTERN, added_tokens(public_tokenizers.path("byte_bpe_50k.json")))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|endof", "text|>", "a", " ", "b c", "\n", "  ", "É", "<|"]), max_size=9).map("".join))
def test_added_tokens_have_their_ids(text):
    """As the file is loaded, without another setting."""
    want = as_loaded().encode(text, add_special_tokens=False).ids if text else []
    assert np.frombuffer(encoder()(text), "<u4").tolist() == want


def test_query_counts_added_tokens(spark):
    from maskloom.llm import queries
    from maskloom.session import scratch_path

    folder, text = scratch_path(spark, "added"), "a <|endoftext|> b"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    docs.write.parquet(f"{folder}/documents.parquet")
    row = queries.QUERIES["op1_best_fit_packing"](spark, folder).first()
    assert row["length"] == 5 and row["ids_crc32"] == zlib.crc32(np.array([64, 220, 50256, 275, 2], "<u4").tobytes())


def test_pieces(spark, reference):
    got = collections.Counter()
    for r in cut(frame(spark), PATH, PATTERN, 64, 2).collect():
        assert r.length == len(r.ids)
        got[r.doc_id, r.piece, r.start, tuple(r.ids)] += 1
    want = collections.Counter()
    for r in documents():
        ids = reference(r[1] or "") + [2]
        first = (len(ids) - 1) % 64 + 1
        at = [0, *range(first, len(ids) + 1, 64)]
        for k, (a, b) in enumerate(zip(at, at[1:])):
            want[r[0], k, a, tuple(ids[a:b])] += 1
    assert got == want
    digest = cut(frame(spark), PATH, PATTERN, 64, 2, payload="crc32").collect()
    assert collections.Counter(r.ids_crc32 for r in digest) == collections.Counter(
        zlib.crc32(np.array(k[3], "<u4").tobytes()) for k in want.elements()
    )


def check_packed(rows, capacity):
    by = collections.defaultdict(list)
    for sequence, offset, length in rows:
        by[sequence].append((offset, length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def best_fit(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is None:
            gaps.append(capacity - n)
        else:
            gaps[gaps.index(fit)] -= n
    return len(gaps)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=300))
def test_rounds(lengths):
    taken, left = rounds(collections.Counter(lengths), 50)
    seen, rank = collections.Counter(), []
    for n in lengths:
        rank.append(seen[n])
        seen[n] += 1
    sequence, offset = find_places(np.array(lengths), np.array(rank), taken, left, 50)
    used = check_packed(zip(sequence.tolist(), offset.tolist(), lengths), 50)
    assert used <= 1.15 * best_fit(lengths, 50) + 2


def test_packs_every_piece_densely(spark):
    pieces = cut(frame(spark), PATH, PATTERN, 64, 2, payload="crc32")
    rows = pack(pieces, 64).select("sequence_id", "offset", "length", "doc_id", "piece").collect()
    assert len(rows) == pieces.count()
    used = check_packed([r[:3] for r in rows], 64)
    assert used <= 1.05 * best_fit([r.length for r in rows], 64) + 1


def test_one_length_and_empty(spark):
    same = spark.range(1000).selectExpr("id", "cast(7 as int) as length", "id as offset")
    rows = pack(same, 64).collect()
    assert check_packed([(r.sequence_id, r.offset, r.length) for r in rows], 64) == -(-1000 // 9)
    assert pack(cut(empty(spark), PATH, PATTERN), 1024).count() == 0
    with pytest.raises(ValueError):
        pack(spark.range(1).selectExpr("65 as length"), 64)
