"""Selection without ranking, and orders by a keyed permutation."""

import random

import pytest
from pyspark.sql import functions as F

from maskloom.operators import permute as pm
from maskloom.operators.select import first_rows, kth
from maskloom.operators.splits import shard, split_random_exact, split_tail


@pytest.mark.parametrize(
    "values",
    [
        [3, 1, 2, 2, 2, 9, -5],
        [7] * 20,
        [2**60 + i for i in range(40)] + [-(2**60)],
        [0.0, 1e-300, 1e300, -1e300, 0.5, 0.5],
        [2.0**i for i in range(-40, 40, 7)],
        [None, 4, None, 1],
    ],
)
def test_kth_of_any_values(spark, values):
    kind = "double" if isinstance(values[0], float) else "long"
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}").repartition(3)
    ordered = sorted(v for v in values if v is not None)
    for k in {1, len(ordered) // 2 + 1, len(ordered)}:
        want = ordered[k - 1]
        assert kth(df, "v", k, buckets=16) == (want, sum(v < want for v in ordered), ordered.count(want))
    with pytest.raises(ValueError):
        kth(df, "v", len(ordered) + 1)


@pytest.mark.parametrize("k", [0, 1, 17, 50, 99, 100])
def test_first_rows_with_ties(spark, k):
    rng = random.Random(k)
    rows = [(rng.randrange(4), i * 3) for i in range(100)]
    df = spark.createDataFrame(rows, "v int, id long").repartition(4)
    got = {tuple(r) for r in df.where(first_rows(df, ["v", "id"], k)).collect()}
    assert got == set(sorted(rows)[:k])


@pytest.mark.parametrize("n", [0, 1, 9, 10, 101])
def test_exact_splits(spark, n):
    df = spark.createDataFrame([(i * i - 7, "x") for i in range(n)], "id long, text string")
    parts = {r["split"]: r["n"] for r in split_random_exact(df, "id").groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert parts.get("validation", 0) == -(-n // 10) and sum(parts.values()) == n
    tail = split_tail(df, "id", 7)
    assert tail.columns == ["id", "text", "split"]
    held = sorted(r["id"] for r in tail.where("split = 'validation'").collect())
    assert held == [i * i - 7 for i in range(max(0, n - 7), n)]


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_permutation_meets_every_place_once(spark, n):
    got = [r[0] for r in spark.range(n).select(pm.permuted(F.col("id"), F.lit(n), "seed|1")).collect()]
    assert sorted(got) == list(range(n))
    if n >= 97:
        assert got != [r[0] for r in spark.range(n).select(pm.permuted(F.col("id"), F.lit(n), "seed|2")).collect()]


def moved(p, n, seed, rounds=pm.ROUNDS):
    """The same rounds in plain numbers."""
    x = p
    for o, a, b, c in pm.round_keys(seed, rounds):
        other = (o - x) % n
        top = max(x, other)
        y = ((top & pm.PRIME) * a + (top >> 31) * b + c) % pm.PRIME
        if ((y * y + c) % pm.PRIME) >> 9 & 1:
            x = other
    return x


def test_permutation_spreads():
    """Over many keys each place goes everywhere about equally often, and neighbours part."""
    n, keys = 8, 1500
    rows = [[moved(p, n, f"k|{k}") for p in range(n)] for k in range(keys)]
    for place in range(n):
        counts = [sum(r[place] == t for r in rows) for t in range(n)]
        assert sum((c - keys / n) ** 2 / (keys / n) for c in counts) < 30
    apart = sum((r[1] - r[0]) % n == 1 for r in rows)
    assert abs(apart / keys - 1 / (n - 1)) < 0.05


def test_plain_python_permutation(spark):
    """The expression against plain numbers, at places above 2 ** 31."""
    n, places = 3 * 2**33 + 1, [0, 1, 5, 2**31, 2**34 + 7, 3 * 2**33]
    got = [r[1] for r in spark.createDataFrame([(p,) for p in places], "p long").select("p", pm.permuted(F.col("p"), F.lit(n), 9)).collect()]
    assert got == [moved(p, n, 9) for p in places]


def files_read(df):
    """Files that the scan of a plan without exchange has opened."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().executedPlan().executeCollect()
    return plan.collectLeaves().head().metrics().get("numFiles").get().value()


def test_resuming_skips_files(spark, tmp_path):
    rows = spark.range(4000).select((F.col("id") * 3).alias("id"))
    order = pm.epoch_order(rows, "id", 5, 2)
    dealt = shard(order, 4, False).select("id", "replica", "position")
    path = f"{tmp_path}/epoch"
    pm.write_epoch(dealt, path, 100)
    everything = sorted(map(tuple, dealt.collect()))
    opened = []
    for counter in (0, 100, 250, 990, 5000):
        left = pm.resumed(spark, path, counter, 100)
        assert sorted(map(tuple, left.select("id", "replica", "position").collect())) == [r for r in everything if r[2] >= counter]
        opened.append(files_read(left))
    assert opened == [10, 9, 8, 1, 0]
