"""Work on tokens in Arrow batches against the plain expressions."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from maskloom.functions import batches
from maskloom.functions.rand import uniform, uniform_each, uniforms
from maskloom.operators import bpe, corrupt, merging, metrics as mt, sequence as sq, tokens as tk
from maskloom.plans import streams
from maskloom.plans.registry import joined, joined_batch


def test_digests_of_any_length():
    keys, lengths = ["1|5", "é", "", "k" * 54, "k" * 70], [1205, 3, 12, 11, 2]
    found = batches.digests(pa.array(keys), np.array(lengths))
    want = [hashlib.md5(f"{k}|{i}".encode()).hexdigest() for k, n in zip(keys, lengths) for i in range(n)]
    assert ["".join(f"{x:08x}" for x in column) for column in found.T.tolist()] == want


def test_code_points():
    texts = pa.array(["x", "aé😀", None, "", "b"])[1:]
    values, lengths = batches.code_points(texts)
    assert values.tolist() == [97, 233, 128512, 98] and lengths.tolist() == [3, 0, 0, 1]


def test_draws_equal_the_expressions(spark):
    df = spark.range(40).select("id", (F.col("id") * 7).cast("int").alias("n"))
    one = df.select("id", F.posexplode(uniform_each("s", ["id"], F.col("n"))).alias("i", "u"))
    assert one.where(F.col("u") != uniform("s", "id", "i")).count() == 0 and one.count() == 7 * 39 * 20
    ids = F.transform(F.sequence(F.lit(1), "n"), lambda i: i + 10)
    rows = df.where("n > 0").select("id", ids.alias("ids"), (F.col("id") / 40).alias("p"))
    want = F.zip_with("ids", uniforms(3, ["id"], F.size("ids")), lambda x, u: F.when(u < F.col("p"), 4).otherwise(x))
    assert rows.where(corrupt.mask_tokens(F.col("ids"), F.col("p"), 4, 3, "id") != want).count() == 0


def test_words_counted_in_tasks(spark, monkeypatch):
    texts = ["A b  b\u2003é", None, "", " \t", "a\x1cB b", "e\u0301 É"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
    monkeypatch.setattr(tk, "HELD_WORDS", 1)
    assert {tuple(r) for r in tk.word_counts(df).collect()} == {("a", 2), ("b", 4), ("e", 3)}
    # a row for each word of the text no longer leaves the task
    assert "Generate" not in tk.word_counts(df)._jdf.queryExecution().optimizedPlan().toString()


def test_rounds_repeat_few_others(spark, monkeypatch):
    """A round never applies more than a few earlier batches again."""
    repeated, plain = [], merging.differences

    def seen(state, done, *rest):
        repeated.append(len(done))
        return plain(state, done, *rest)

    monkeypatch.setattr(merging, "differences", seen)
    words = spark.createDataFrame([("ab" * i + "cd" * (i % 3), 50 - i) for i in range(1, 40)], "word string, n long")
    bpe.bpe_train(words, vocab_size=30)
    assert len(repeated) > bpe.NEAR_ROUNDS and max(repeated) < bpe.NEAR_ROUNDS


def test_odd_rows(spark):
    rows = [(0, None), (1, []), (2, [5, None, 3, 3]), (3, [99, -1, 9, 8])]
    df = spark.createDataFrame(rows, "i int, ids array<int>")
    ids = F.col("ids")
    got = df.select(
        tk.decode_ids(ids, tk.CHAR_VOCAB), sq.first_eos_mask(ids, 3), sq.first_eos_mask(ids, 3, True), corrupt.mask_tokens(ids, F.lit(1.0), 4, 1, "i")
    )
    assert [tuple(r) for r in got.collect()] == [
        (None, None, None, None),
        ("", [], [], []),
        ("[PAD][EOS][EOS]", [1, 0, 1, 0], [1, 1, 1, 0], [4, 4, 4, 4]),
        ("ba", [1, 1, 1, 1], [1, 1, 1, 1], [4, 4, 4, 4]),
    ]


@pytest.mark.parametrize("name", ["encode", "decode", "mask", "joined", "entropy", "eos", "windows"])
def test_no_lambda_per_token(spark, name):
    df = spark.createDataFrame([(1, "ab", [8, 9], [-1.0, -2.0])], "id long, t string, ids array<int>, lps array<double>")
    ids = F.col("ids")
    made = {
        "encode": lambda: df.select(tk.char_encode(F.col("t"))),
        "decode": lambda: df.select(tk.decode_ids(ids, tk.CHAR_VOCAB)),
        "mask": lambda: df.select(corrupt.mask_tokens(ids, F.lit(0.5), 4, 1, "id")),
        "joined": lambda: df.select(joined("ids")),
        "entropy": lambda: mt.sample_entropy(df, "ids"),
        "eos": lambda: df.select(sq.first_eos_mask(ids, 3)),
        "windows": lambda: mt.window_ppl(df, "ids", 3),
    }[name]()
    assert "lambda" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_packing_moves_no_ids_again(spark):
    """Whole blocks are made where the text was brought; an Arrow function would undo that."""
    from maskloom.plans.tokens import packed

    plan = packed(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" not in plan


@pytest.mark.parametrize("kind", ["int", "long"])
def test_ends_and_joins_in_batches(spark, monkeypatch, kind):
    monkeypatch.setattr(batches, "SLICE_ROWS", 2)
    rows = [(0, [5, -7, 12]), (1, None), (2, []), (3, [None, 4]), (4, [None]), (5, [3] * 700), (6, [])]
    df = spark.createDataFrame(rows, f"id long, ids array<{kind}>").coalesce(1)
    ended = tk.append_eos_batch(F.col("ids"), 3, df.schema["ids"].dataType)
    pairs = [(ended, tk.append_eos(F.col("ids"), 3)), (joined_batch("ids"), joined("ids")), (joined_batch(ended), joined(tk.append_eos(F.col("ids"), 3)))]
    for found, want in pairs:
        same = df.select(found.alias("found"), want.alias("want")).collect()
        assert len(same) == 7 and all(r["found"] == r["want"] for r in same)
    empty = batches.in_slices(pa.array([], pa.list_(pa.int32())), batches.joined)
    assert empty.type == pa.string() and not len(empty)
    whole = batches.in_slices(pa.array([x for _, x in rows], pa.list_(pa.int32())), batches.joined)
    assert whole.to_pylist() == [None if x is None else " ".join(str(i) for i in x if i is not None) for _, x in rows]


def test_stream_tokenize_keeps_ids_in_arrow(spark, monkeypatch):
    """Ids are ended and joined in the step that makes them; they never become Spark's arrays."""
    monkeypatch.setattr(streams, "stream", lambda df, key, path: df)
    monkeypatch.setattr(streams, "finished", lambda df, path: df)
    plan = streams.stream_tokenize(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "array_join" not in plan


def test_parts_of_a_stream(spark):
    from maskloom.session import scratch_path

    keys = [None, 1, 1, 2, 3, 5, 8, 13, 21, None, 34]
    for rows in ([(k, str(i)) for i, k in enumerate(keys)], []):
        path = scratch_path(spark, "parts")
        streams.stream(spark.createDataFrame(rows, "k long, v string"), "k", path)
        parts = [spark.read.schema("k long, v string").parquet(f"{path}/in/{p}").collect() for p in range(streams.PARTS)]
        assert sorted(r["v"] for part in parts for r in part) == sorted(v for _, v in rows)
        spans = [[r["k"] for r in part if r["k"] is not None] for part in parts]
        assert all(max(a) < min(b) for a, b in zip(spans, spans[1:]) if a and b)
        assert all(r["k"] is not None for part in parts[1:] for r in part)
