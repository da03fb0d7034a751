import math
import random

import pytest
from pyspark.sql import functions as F

from maskloom.operators import splits as sp
from maskloom.operators.order import dealt, ranges, ranked, shuffled


def ids(spark, values, parts=3):
    return spark.createDataFrame([(v,) for v in values], "id long").repartition(parts)


CLUSTERED = list(range(50)) + [10**12 + i for i in range(200)] + [2**60 + 7 * i for i in range(30)]


@pytest.mark.parametrize("values", [[5], list(range(100)), CLUSTERED, [-3, 0, 9, 2**62]])
@pytest.mark.parametrize("rows_per_bucket", [1, 7, 10_000])
def test_rank_and_prefix(spark, values, rows_per_bucket):
    df = ids(spark, values)
    buckets = ranges(df, "id", rows_per_bucket, coarse_buckets=16)
    out = ranked(df, "id", weight=F.col("id") % 5 + 5, buckets=buckets).orderBy("id").collect()
    total = 0
    for rank, (value, row) in enumerate(zip(sorted(values), out)):
        assert (row["id"], row["rank"], row["before"]) == (value, rank, total)
        total += (value % 5 if value >= 0 else -(-value % 5)) + 5


def test_empty(spark):
    df = ids(spark, [1]).where("id > 1")
    assert ranked(df, "id").collect() == []


def test_null_groups_are_ranked(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "x") for i in range(20)], "id long, g string")
    for out in (ranked(df, "id", by=["g"]), shuffled(df, 1, "id", by=["g"])):
        rows = out.collect()
        assert sorted(r["rank"] for r in rows if r["g"] is None) == list(range(10))
        assert len(rows) == 20


def test_hot_group_is_spread(spark):
    rows = [(i, 0 if i % 3 else i) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, g long")
    buckets = ranges(df, "id", 50)
    placed = ranked(df, "id", by=["g"], buckets=buckets, keep_buckets=True)
    hot = placed.where("g = 0")
    assert hot.select("_bucket").distinct().count() > 16
    got = {r["id"]: r["rank"] for r in hot.collect()}
    want = sorted(i for i, g in rows if g == 0)
    assert got == {v: i for i, v in enumerate(want)}


@pytest.mark.parametrize("buckets", [1, 5, 1 << 16])
def test_shuffle_is_a_permutation_of_its_own(spark, buckets):
    runs = [
        {r["id"]: r["rank"] for r in shuffled(ids(spark, range(300), parts), 4, "id", buckets=buckets).collect()}
        for parts in (1, 4, 32)
    ]
    assert runs[0] == runs[1] == runs[2]
    assert sorted(runs[0].values()) == list(range(300))
    other = {r["id"]: r["rank"] for r in shuffled(ids(spark, range(300)), 5, "id").collect()}
    assert other != runs[0]


def test_random_split_is_exact(spark):
    for n in (1, 10, 101):
        out = sp.split_random_exact(ids(spark, range(n)), "id").collect()
        assert len(out) == n
        assert sum(r["split"] == "validation" for r in out) == math.ceil(0.1 * n)


def test_tail_split(spark):
    out = sp.split_tail(ids(spark, range(100)), "id", 7).collect()
    assert sorted(r["id"] for r in out if r["split"] == "validation") == list(range(93, 100))


@pytest.mark.parametrize("n", [1, 7, 8, 100, 101])
@pytest.mark.parametrize("replicas", [1, 3, 8])
def test_shards(spark, n, replicas):
    order = shuffled(ids(spark, range(n)), 1, "id")
    sequence = [r["id"] for r in order.orderBy("rank").collect()]
    padded = sp.shard(order, replicas).collect()
    size = -(-n // replicas) * replicas
    filled = (sequence * size)[:size] if n < size else sequence
    got = {(r["replica"], r["position"]): r["id"] for r in padded}
    assert len(padded) == size
    assert got == {(p % replicas, p // replicas): v for p, v in enumerate(filled)}
    dropped = sp.shard(order, replicas, drop_last=True).collect()
    assert len(dropped) == n // replicas * replicas


def test_resume(spark):
    order = ranked(ids(spark, range(40)), "id")
    left = sp.resume(sp.shard(order, 4), 6)
    assert left.count() == 4 * 4


def test_eval_batches(spark):
    df = ids(spark, range(10))
    assert sp.eval_batches(df, "id", 4).count() == 10
    assert sp.eval_batches(df, "id", 4, drop_remainder=True).count() == 8
    assert sp.eval_batches(df, "id", 100, drop_remainder=True).count() == 10
    assert sp.eval_batches(df.where("id < 0"), "id", 4, drop_remainder=True).count() == 0


def test_limit_batches(spark):
    batched = sp.assign_batches(ids(spark, range(10)), "id", 3)
    assert sp.limit_batches(batched, 3, 0.5).count() == 6
    assert sp.limit_batches(batched, 3, 2).count() == 6
    assert sp.limit_batches(batched, 3, 1.0).count() == 10


def test_rows_are_dealt_when_asked(spark):
    df = spark.range(100, numPartitions=1)
    assert dealt(df, "id") is df
    spark.conf.set("spark.maskloom.inputPartitions", "5")
    try:
        assert dealt(df, "id").rdd.getNumPartitions() == 5
    finally:
        spark.conf.unset("spark.maskloom.inputPartitions")


@pytest.mark.parametrize("files", [10, 300, 3000])
def test_buckets_are_even_for_ids_with_gaps(spark, files):
    """Ids of rows numbered per file, with a wide gap between files."""
    rows, wanted = 60_000, 10
    per_file = rows // files
    df = spark.range(rows).select(
        (F.floor(F.col("id") / per_file) * (1 << 40) + F.col("id") % per_file).cast("long").alias("id")
    )
    cut = ranges(df, "id", wanted).add(df, "id", "b")
    sizes = cut.groupBy("b").count().agg(F.max("count"), F.count("b")).first()
    assert sizes[0] <= 4 * wanted and sizes[1] >= rows // wanted // 4


def test_batch_plan(spark):
    plan = sp.batch_plan(
        spark.createDataFrame([(512, 512), (511, 3)], "g long, e long"), "g", "e", 1, 2, 4
    ).collect()
    assert [r["batch_size"] for r in plan] == [64, 63]
    assert [r["reaches_global"] for r in plan] == [True, False]
    assert [r["eval_divides"] for r in plan] == [True, False]


def test_select_modes(spark):
    rows = [(c, s) for c in ("text8", "ptb", "lambada") for s in ("train", "validation", "test")]
    df = spark.createDataFrame(rows, "corpus string, split string")
    got = {(r[0], r[1]) for r in sp.split_select(df, "valid").collect()}
    assert got == {("text8", "test"), ("ptb", "validation")} | {
        ("lambada", s) for s in ("train", "validation", "test")
    }
    assert sp.split_select(df, "train").count() == 5


def test_random_order_is_fair(spark):
    random.seed(1)
    ranks = [r["rank"] for r in shuffled(ids(spark, range(2000)), 9, "id").orderBy("id").collect()]
    first_half = sum(ranks[:1000]) / 1000
    assert abs(first_half - 999.5) < 4 * 2000 / math.sqrt(12 * 1000)
