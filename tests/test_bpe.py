import random
from collections import Counter

import numpy as np
import pytest

from maskloom.operators import bpe, merging, tokens as tk

tokenizers = pytest.importorskip("tokenizers")


def library(texts, vocab_size, min_frequency=2):
    tok = tokenizers.Tokenizer(tokenizers.models.BPE())
    n = tokenizers.normalizers
    tok.normalizer = n.Sequence([n.NFD(), n.Lowercase(), n.StripAccents()])
    tok.pre_tokenizer = tokenizers.pre_tokenizers.WhitespaceSplit()
    tok.train_from_iterator(
        texts,
        tokenizers.trainers.BpeTrainer(
            vocab_size=vocab_size,
            min_frequency=min_frequency,
            special_tokens=tk.BPE_SPECIALS,
            show_progress=False,
        ),
    )
    return tok


def corpus(seed, letters, words, longest):
    rng = random.Random(seed)
    return [
        " ".join(
            "".join(rng.choice(letters) for _ in range(rng.randint(1, longest)))
            for _ in range(words)
        )
        for _ in range(12)
    ]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def trained(spark, texts, vocab_size, **kw):
    return bpe.bpe_train(tk.word_counts(frame(spark, texts)), vocab_size, **kw)


@pytest.mark.parametrize(
    "seed, letters, longest",
    [(1, "ab", 12), (2, "a", 40), (3, "abc", 6), (4, "abcdefgh", 5), (5, "aabé漢", 9), (6, "ab", 30)],
)
def test_same_as_library(spark, seed, letters, longest):
    import json

    texts = corpus(seed, letters, 25, longest)
    model = trained(spark, texts, 45)
    tok = library(texts, 45)
    told = json.loads(tok.to_str())["model"]
    vocab = sorted(told["vocab"], key=told["vocab"].get)
    assert model.tokens == vocab
    got = [(model.tokens[a], model.tokens[b]) for a, b, _ in model.merges]
    assert got == [tuple(m) for m in told["merges"]]
    assert model.rounds <= len(model.merges)
    rows = bpe.bpe_encode(frame(spark, texts), model).orderBy("doc_id").collect()
    assert [r["ids"] for r in rows] == [
        tok.encode(t, add_special_tokens=False).ids for t in texts
    ]


def greedy(words, merges):
    """One merge at a time over the word table, most frequent first, ties by ids."""
    alphabet = sorted({c for w in words for c in w})
    names = [*tk.BPE_SPECIALS, *alphabet]
    table = {w: [names.index(c) for c in w] for w in words}
    out = []
    for _ in range(merges):
        counts = Counter()
        for w, ids in table.items():
            for pair in zip(ids, ids[1:]):
                counts[pair] += words[w]
        best = min(counts, key=lambda p: (-counts[p], p), default=None)
        if best is None or counts[best] < 2:
            break
        text = names[best[0]] + names[best[1]]
        if text not in names:
            names.append(text)
        new = names.index(text)
        out.append((*best, new))
        for w, ids in table.items():
            i, done = 0, []
            while i < len(ids):
                if tuple(ids[i : i + 2]) == best:
                    done.append(new)
                    i += 2
                else:
                    done.append(ids[i])
                    i += 1
            table[w] = done
    return out


@pytest.mark.parametrize("seed", range(4))
def test_rounds_equal_single_merges(spark, seed):
    texts = corpus(seed + 50, "abcd" if seed % 2 else "aab", 20, 8)
    words = Counter(w for t in texts for w in t.split())
    model = trained(spark, texts, 40)
    assert model.merges == greedy(words, len(model.merges))


def test_checkpoints_and_few_candidates(spark, monkeypatch):
    texts = corpus(9, "abcdef", 30, 7)
    whole = trained(spark, texts, 60)
    monkeypatch.setattr(bpe, "PENDING_ROUNDS", 3)
    assert trained(spark, texts, 60, candidates=2).merges == whole.merges


def test_min_frequency(spark):
    assert trained(spark, ["ab ab cd"], 100).merges == [(7, 8, 11)]
    assert trained(spark, ["ab ab cd"], 100, min_frequency=3).merges == []


def test_unknown_characters(spark):
    model = trained(spark, ["ab ab ab"], 100)
    df = frame(spark, ["axb", None])
    drop = bpe.bpe_encode(df, model).orderBy("doc_id").collect()
    keep = bpe.bpe_encode(df, model, unk="unk").orderBy("doc_id").collect()
    assert drop[0]["ids"] == [9] and drop[1]["ids"] is None
    assert keep[0]["ids"] == [7, 1, 8]
    decoded = bpe.bpe_decode(bpe.bpe_encode(df, model), model).orderBy("doc_id").first()
    assert decoded["decoded"] == "ab"
    with pytest.raises(ValueError):
        bpe.bpe_encode(df, model, unk="other")


def test_pairs_keep_id_order():
    ids = np.array([0, 1, 7, 255, 65535, 70000])
    pairs = [(a, b) for a in ids for b in ids]
    keys = [int(merging.pair_key(np.array([a]), np.array([b]))[0]) for a, b in pairs]
    assert keys == sorted(keys) and len(set(keys)) == len(pairs)
    assert [(k >> 32, k & 0xFFFFFFFF) for k in keys] == [(int(a), int(b)) for a, b in pairs]


def counted(table, weights):
    out = Counter()
    for w, ids in table.items():
        for a, b in zip(ids, ids[1:]):
            out[a << 32 | b] += weights[w]
    return {k: n for k, n in out.items() if n}


def replaced(ids, left, right, new):
    i, done = 0, []
    while i < len(ids):
        if tuple(ids[i : i + 2]) == (left, right):
            done.append(new)
            i += 2
        else:
            done.append(ids[i])
            i += 1
    return done


@pytest.mark.parametrize("seed", range(6))
def test_differences_of_a_shard(seed):
    """Counts after merges are the counts before and the differences, for any merges."""
    rng = random.Random(seed)
    words = {w: [rng.randrange(3) for _ in range(rng.randrange(1, 12))] for w in range(40)}
    weights = {w: rng.randrange(1, 9) for w in words}
    flat = np.array([x for ids in words.values() for x in [*ids, merging.SEPARATOR]], np.int32)
    shard = merging.Shard(flat.tobytes(), np.array(list(weights.values()), np.int64).tobytes())
    before = dict(zip(*(v.tolist() for v in shard.pairs())))
    assert before == counted(words, weights)
    after = Counter(before)
    batches = [[(rng.randrange(3), rng.randrange(3), 3)], [(rng.randrange(4), rng.randrange(4), 4)], [(0, 1, 5), (2, 1, 6), (0, 3, 7)], [(4, 4, 8)]]
    for batch in batches:
        keys, change = shard.differences(batch)
        for merge in batch:
            words = {w: replaced(ids, *merge) for w, ids in words.items()}
        for k, n in zip(keys.tolist(), change.tolist()):
            after[k] += n
        assert {k: n for k, n in after.items() if n} == counted(words, weights)
    assert [x for ids in words.values() for x in [*ids, merging.SEPARATOR]] == shard.x.tolist()


def test_leading_pairs_and_their_border():
    lead = merging.Leading([(5, 9), (7, 9), (2, 4)], whole=False)
    assert lead.border == (-4, 2)
    key = lambda a, b: a << 32 | b
    # an unknown pair of old symbols stays out, one of a new symbol comes in, what falls behind goes
    lead.change(np.array([1, 5, key(9, 1), key(9, 2)]), np.array([8, -6, 5, 3]), {9})
    assert lead.top(9) == [(7, 9), (key(9, 1), 5), (2, 4)]
    assert merging.Leading([(1, 1)], whole=True).inside(99, 1)


@pytest.mark.parametrize("seed", range(2))
def test_many_shards_few_candidates_and_long_words(spark, monkeypatch, seed):
    texts = [*corpus(seed + 70, "abc", 40, 30), "ab" * 400 + " " + "a" * 999]
    words = Counter(w for t in texts for w in t.split())
    monkeypatch.setattr(merging, "SHARD_WORDS", 20)
    monkeypatch.setattr(merging, "DIRECT_SHARDS", 3)
    monkeypatch.setattr(bpe, "PENDING_ROUNDS", 4)
    model = trained(spark, texts, 60, candidates=9)
    assert model.merges == greedy(words, len(model.merges)) and len(model.tokens) == 60


def plain_merge(encoder, text):
    """The lowest rank first, the leftmost of equal ones, by looking at all pairs each time."""
    ids = [i for i in (encoder.single.get(c, encoder.unk) for c in text) if i is not None]
    while True:
        options = [(encoder.rank[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in encoder.rank]
        if not options:
            return ids
        _, i = min(options)
        ids[i : i + 2] = [encoder.rank[ids[i], ids[i + 1]][1]]


@pytest.mark.parametrize("letters", ["ab", "abcdef", "a"])
def test_heap_merges_like_plain_search(spark, letters):
    model = trained(spark, corpus(5, letters, 40, 12), 50)
    encoder = bpe._Encoder(model, "drop")
    rng = random.Random(3)
    for _ in range(300):
        word = "".join(rng.choice(letters + "z") for _ in range(rng.randrange(0, 60)))
        assert encoder._merge(word) == plain_merge(encoder, word)
    assert len(encoder._merge(letters * 20_000)) > 0


def test_no_words(spark):
    assert trained(spark, ["", None], 50).merges == []
    assert trained(spark, ["a b c"], 50).tokens[-3:] == ["a", "b", "c"]


def test_save_and_load(spark, tmp_path):
    texts = corpus(3, "abc", 20, 6)
    model = trained(spark, texts, 40)
    model.save(spark, f"{tmp_path}/model")
    again = bpe.BpeModel.load(spark, f"{tmp_path}/model")
    assert (again.tokens, again.merges, again.mark()) == (model.tokens, model.merges, model.mark())
    df = frame(spark, texts)
    assert bpe.bpe_encode(df, again).collect() == bpe.bpe_encode(df, model).collect()


def test_words_are_normalized_once(spark):
    from pyspark.sql import functions as F

    from maskloom.functions.text import norm_bpe, split_whitespace

    texts = ["Éa éA\u00a0ea", "\u0301 \u0301x X", "ΑΣ ας αΣ", "İ i\u0307 a\u2003b"]
    df = frame(spark, texts)
    whole = df.select(F.explode(split_whitespace(norm_bpe(F.col("text")))).alias("w")).groupBy("w").count()
    assert {tuple(r) for r in tk.word_counts(df).collect()} == {tuple(r) for r in whole.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_words_cut_at_pairs_that_are_not_merged(spark, monkeypatch, seed):
    """With shards in Spark, cut again and again, and with a border that is too high at times."""
    rng = random.Random(seed)
    parts = ["ab", "ra", "ca", "dab", "xyz", "q", "aa"]
    texts = [" ".join("".join(rng.choices(parts, [9, 7, 5, 3, 2, 1, 2], k=rng.randint(1, 5))) for _ in range(60)) for _ in range(12)]
    words = Counter(w for t in texts for w in t.split())
    want = greedy(words, 60)
    cut, plain, worth = [], merging.compacted, bpe._worth_keeping
    monkeypatch.setattr(merging, "HELD_SYMBOLS", 0)
    monkeypatch.setattr(bpe, "PENDING_ROUNDS", 2)
    monkeypatch.setattr(bpe, "NEAR_ROUNDS", 2)
    monkeypatch.setattr(merging, "compacted", lambda *a: cut.append(1) or plain(*a))

    def high(known, missing, floor):
        # of the pairs that are needed few
        return worth(known, missing // 20, floor)

    monkeypatch.setattr(bpe, "_worth_keeping", high if seed else lambda known, missing, floor: worth(known, 2, floor))
    size = len({c for w in words for c in w}) + len(tk.BPE_SPECIALS) + 40
    model = trained(spark, texts, size)
    assert model.merges == want[: len(model.merges)] and len(model.tokens) == size and cut


def test_few_symbols_take_no_job_a_round(spark, monkeypatch):
    texts = corpus(4, "abcdef", 40, 8)
    asked, plain = [], merging._answers
    monkeypatch.setattr(merging, "_answers", lambda *a: asked.append(1) or plain(*a))
    held = trained(spark, texts, 90)
    assert held.rounds > 9 and not asked
    monkeypatch.setattr(merging, "HELD_SYMBOLS", 0)
    assert trained(spark, texts, 90).merges == held.merges and asked


@pytest.mark.parametrize("seed", range(4))
def test_pieces_of_a_shard(seed):
    rng = random.Random(seed)
    words = [([rng.randrange(4) for _ in range(rng.randrange(1, 9))], rng.randrange(1, 5)) for _ in range(60)]
    live = {(rng.randrange(4), rng.randrange(4)) for _ in range(7 if seed else 0)}
    flat = np.array([x for ids, _ in words for x in [*ids, merging.SEPARATOR]], np.int32)
    shard = merging.Shard(flat.tobytes(), np.array([n for _, n in words], np.int64).tobytes())
    want = Counter()
    for ids, n in words:
        run = ids[:1]
        for pair in zip(ids, ids[1:]):
            if pair in live:
                run.append(pair[1])
            else:
                want[tuple(run)] += n
                run = [pair[1]]
        want[tuple(run)] += n
    got = merging.pieces(shard, np.array(sorted(a << 32 | b for a, b in live), np.int64)).to_pydict()
    found = {tuple(np.frombuffer(s, np.int32).tolist()): n for s, n in zip(got["symbols"], got["n"])}
    assert found == {k: n for k, n in want.items() if len(k) > 1} and len(found) == len(got["n"])


def test_registered_training_ends_with_the_pairs(spark):
    """No small vocabulary ends it: on the small tables it goes on until no pair occurs twice."""
    from compare import DATA

    from maskloom.plans import QUERIES
    from maskloom.plans.tokens import VOCABULARY, words

    folder = f"{DATA}/sf0.001"
    assert VOCABULARY == 32000
    rows = QUERIES["bpe_train"](spark, folder).select("left", "right", "merged").collect()
    size = max(r["merged"] for r in rows) + 1
    assert 10_000 < size < VOCABULARY
    model = bpe.bpe_train(words(spark, folder), vocab_size=size + 1000)
    assert len(model.merges) == len(rows) and len(model.tokens) == size
