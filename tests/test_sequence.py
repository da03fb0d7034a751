import random

import pytest
from pyspark.sql import functions as F

from maskloom.operators import order, sequence as sq


def documents(seed, n, longest, empty=0.1):
    rng = random.Random(seed)
    rows, token = [], 100
    for i in range(n):
        size = 0 if rng.random() < empty else rng.randint(1, longest)
        rows.append((i * 3, list(range(token, token + size))))
        token += size
    return rows


def naive(rows, body):
    flat = [t for _, ids in sorted(rows) for t in ids]
    return [[2, *flat[i : i + body], 3] for i in range(0, len(flat) // body * body, body)]


def frame(spark, rows, parts):
    return spark.createDataFrame(rows, "id long, ids array<int>").repartition(parts)


@pytest.mark.parametrize("seed, n, longest, size", [(1, 60, 9, 6), (2, 40, 100, 10), (3, 5, 4, 64), (4, 30, 3, 3)])
@pytest.mark.parametrize("parts", [1, 4, 32])
def test_global_packing(spark, seed, n, longest, size, parts):
    rows = documents(seed, n, longest)
    out = sq.pack_blocks_global(frame(spark, rows, parts), "id", "ids", size, 2, 3)
    got = [r["input_ids"] for r in out.orderBy("block_id").collect()]
    assert got == naive(rows, size - 2)
    assert all(r["attention_mask"] == [1] * size for r in out.collect())


def test_one_document_holds_most_tokens(spark):
    rows = documents(5, 50, 5) + [(1000, list(range(5000)))] + [(2000 + i, [i, i]) for i in range(20)]
    out = sq.pack_blocks_global(frame(spark, rows, 4), "id", "ids", 18, 2, 3)
    assert [r["input_ids"] for r in out.orderBy("block_id").collect()] == naive(rows, 16)


@pytest.mark.parametrize("group", [1, 7, 1000])
def test_group_packing(spark, group):
    rows = documents(6, 45, 12)
    out = sq.pack_blocks(frame(spark, rows, 4), "id", "ids", 7, 2, 3, group_size=group)
    got = [r["input_ids"] for r in out.orderBy("group_id", "block_id").collect()]
    want = [b for i in range(0, len(rows), group) for b in naive(rows[i : i + group], 5)]
    assert got == want


def test_tokens_move_once(spark):
    """The wide rows are exchanged once and that exchange is shared."""
    rows = documents(7, 100, 30)
    out = sq.pack_blocks_global(frame(spark, rows, 4), "id", "ids", 12, 2, 3)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("size, train_size, drop", [(5, None, True), (4, 8, False), (7, 14, True), (1, None, True)])
def test_char_chunks(spark, size, train_size, drop):
    rng = random.Random(size)
    texts = ["".join(rng.choice("ab c\né😀") for _ in range(rng.randint(0, 30))) for _ in range(40)]
    stream = "".join(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(5)
    out = sq.char_chunks(df, "id", "text", size, 200, 260, train_size, drop)
    want = {}
    for name, part, width in (
        ("train", stream[:200], train_size or size),
        ("validation", stream[200:260], size),
        ("test", stream[260:], size),
    ):
        for i in range(0, len(part), width):
            if not drop or len(part[i : i + width]) == width:
                want[(name, i // width)] = part[i : i + width]
    assert {(r["split"], r["chunk_id"]): r["text"] for r in out.collect()} == want


def test_windows_and_shifts(spark):
    df = spark.createDataFrame([(1, list(range(10, 20))), (2, []), (3, [5])], "id long, ids array<int>")
    cut = sq.context_split(df, "ids", 4).orderBy("id", "window_id").collect()
    assert [r["ids"] for r in cut] == [[10, 11, 12, 13], [14, 15, 16, 17], [18, 19], [5]]
    shifted = df.where("id = 1").select(sq.shift_ar(F.col("ids"), F.col("ids")).alias("s")).first()["s"]
    assert shifted["input_ids"] == list(range(10, 19))
    assert shifted["target_ids"] == shifted["target_mask"] == list(range(11, 20))


def test_crop(spark):
    df = spark.createDataFrame([(1, list(range(16)), 3), (2, list(range(16)), 7)], "id long, ids array<int>, s int")
    out = sq.crop_window(df, "ids", F.col("s"), 8, -1, -2).orderBy("id").collect()
    assert out[0]["input_ids"] == [-1, 4, 5, 6, 7, 8, 9, 10]
    assert out[0]["output_ids"] == [4, 5, 6, 7, 8, 9, 10, -2]
    assert out[1]["output_ids"] == [8, 9, 10, 11, 12, 13, 14, -2]


def test_eos_masks(spark):
    df = spark.createDataFrame([(1, [3, 5, 3, 6, 3]), (2, [5, 6]), (3, [])], "id long, ids array<int>")
    ids = F.col("ids")
    rows = df.orderBy("id").select(
        sq.first_eos_mask(ids, 3).alias("a"),
        sq.first_eos_mask(ids, 3, until_first_eos=True).alias("b"),
        sq.length_to_eos(ids, 3).alias("n"),
    ).collect()
    assert [r["a"] for r in rows] == [[1, 1, 0, 1, 0], [1, 1], []]
    assert [r["b"] for r in rows] == [[1, 0, 0, 0, 0], [1, 1], []]
    assert [r["n"] for r in rows][:2] == [1, 1]


def test_strides(spark):
    df = spark.createDataFrame([(1, 0, [1]), (1, 1, [2, 3]), (1, 2, []), (2, 0, [9])], "s long, t long, ids array<int>")
    out = sq.stride_prefixes(df, "s", "t", "ids").orderBy("strides").collect()
    assert [r["ids"] for r in out] == [[1, 2, 3], [1, 2, 3]]


@pytest.mark.parametrize("per_bucket", [1, 3, 10, 10_000])
def test_bucket_size_does_not_change_blocks(spark, monkeypatch, per_bucket):
    rows = documents(8, 80, 20)
    monkeypatch.setattr(
        sq, "ranges", lambda df, key: order.ranges(df, key, per_bucket, coarse_buckets=8)
    )
    df = frame(spark, rows, 3)
    out = sq.pack_blocks_global(df, "id", "ids", 9, 2, 3)
    assert [r["input_ids"] for r in out.orderBy("block_id").collect()] == naive(rows, 7)
    for group in (1, 6, 25, 100):
        out = sq.pack_blocks(df, "id", "ids", 9, 2, 3, group_size=group)
        got = [r["input_ids"] for r in out.orderBy("group_id", "block_id").collect()]
        assert got == [b for i in range(0, len(rows), group) for b in naive(rows[i : i + group], 7)]
