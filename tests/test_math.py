import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskloom.functions import draws, losses, noise, scores as sc
from maskloom.functions.arrays import argmax
from maskloom.functions.rand import hex_lanes, hex_threshold, uniform, uniforms
from maskloom.operators import corrupt, topk
from maskloom.operators.table import to_long

GRID = [i / 100 for i in range(101)]
SCHEDULES = [
    noise.LogLinear(),
    noise.Cosine(),
    noise.CosineSquared(),
    noise.Linear(1e-3, 7.0),
    noise.Geometric(1e-3, 1.0),
]


def over(spark, column, values=GRID):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, t double")
    return [r["o"] for r in df.select("i", column(F.col("t")).alias("o")).orderBy("i").collect()]


@pytest.mark.parametrize("schedule", SCHEDULES, ids=lambda s: type(s).__name__)
def test_rate_is_the_slope(spark, schedule):
    step = 1e-6
    inner = GRID[1:-1]
    rate = over(spark, schedule.rate, inner)
    up = over(spark, schedule.sigma, [t + step for t in inner])
    down = over(spark, schedule.sigma, [t - step for t in inner])
    slope = [(a - b) / (2 * step) for a, b in zip(up, down)]
    assert rate == pytest.approx(slope, rel=1e-4)


def test_closed_values(spark):
    ll = noise.LogLinear()
    assert over(spark, ll.sigma, [0.0]) == [0.0]
    assert over(spark, ll.move_chance) == pytest.approx([0.999 * t for t in GRID])
    assert ll.sigma_max == pytest.approx(-math.log(1e-3))
    assert over(spark, lambda t: noise.discretize_t(t, 10), [0.0, 0.05, 0.95]) == pytest.approx([0.1, 0.1, 1.0])
    assert over(spark, lambda t: noise.discretize_t(t, 0), [0.37]) == [0.37]
    assert over(spark, lambda t: noise.antithetic(t, F.lit(3), F.lit(4)), [0.0, 0.9]) == pytest.approx([0.75, 0.975])


def test_importance_transform_ends(spark):
    linear = noise.Linear(1e-3, 7.0)
    assert over(spark, linear.importance, [0.0, 1.0]) == pytest.approx([0.0, 1.0])
    mid = over(spark, linear.importance)
    assert mid == sorted(mid)


def test_schedule_names():
    assert noise.schedule("cosine", eps=0.1) == noise.Cosine(0.1)
    with pytest.raises(ValueError):
        noise.schedule("polynomial")


def test_learning_rates(spark):
    steps = [0, 50, 100, 1000]
    assert over(spark, lambda s: noise.lr_warmup_constant(s, 2.0, 100), steps) == [0, 1, 2, 2]
    got = over(spark, lambda s: noise.lr_cosine_warmup(s, 1.0, 100, 200, 0.0, 0.0), [0, 50, 100, 200, 300, 400])
    assert got == pytest.approx([0, 0.5, 1, 0.5, 0, 0])


def rows(spark, seed=0, n=40, vocab=9, mask=8):
    rng = np.random.default_rng(seed)
    data = [
        (i, rng.normal(size=vocab).tolist(), int(rng.integers(0, vocab - 1)), bool(rng.random() < 0.5), float(rng.uniform(0.05, 3)))
        for i in range(n)
    ]
    data = [(i, s, x, mask if hit else x, sig) for i, s, x, hit, sig in data]
    df = spark.createDataFrame(data, "i int, s array<double>, x0 int, xt int, sigma double")
    return data, df


def values(df, column):
    return [r["o"] for r in df.select("i", column.alias("o")).orderBy("i").collect()]


def softmax(x):
    e = np.exp(np.asarray(x) - np.max(x))
    return e / e.sum()


def test_parameterizations(spark):
    data, df = rows(spark)
    s, xt, sigma = F.col("s"), F.col("xt"), F.col("sigma")
    subs = values(df, sc.subs(s, xt, 8))
    sedd = values(df, sc.parameterize("sedd", s, 8, xt, sigma))
    ar = values(df, sc.parameterize("ar", s, 8))
    plain = values(df, sc.parameterize("d3pm", s, 8))
    for (i, raw, x0, x, sig), a, b, c, d in zip(data, subs, sedd, ar, plain):
        assert np.exp(a).sum() == pytest.approx(1)
        if x == 8:
            assert np.exp(a)[:8] == pytest.approx(softmax(raw[:8]))
            assert a[8] < -9e5
        else:
            assert a[x] == 0 and sum(v == -1e6 for v in a) == 8
        want = np.array(raw) - math.log(math.expm1(sig)) - math.log(8)
        want[x] = 0
        assert b == pytest.approx(want)
        assert np.exp(c)[:8] == pytest.approx(softmax(raw[:8]))
        assert np.exp(d) == pytest.approx(softmax(raw))
    assert values(df, sc.parameterize("other", s, 8)) == [r[1] for r in data]


def test_stable_for_large_scores(spark):
    df = spark.createDataFrame([(0, [1e4, 1e4 - 1, -1e4])], "i int, s array<double>")
    assert np.exp(values(df, sc.log_softmax(F.col("s")))[0]) == pytest.approx(softmax([1, 0, -2e4]))


def test_transition_rows_and_stagger(spark):
    data, df = rows(spark)
    edge = values(df, sc.transition(F.col("xt"), F.col("sigma"), 9, 8))
    stag = values(df, sc.staggered(F.transform("s", F.exp), F.col("sigma"), 8))
    for (i, raw, x0, x, sig), e, g in zip(data, edge, stag):
        want = np.zeros(9)
        want[x] = math.exp(-sig)
        if x == 8:
            want += 1 - math.exp(-sig)
        assert e == pytest.approx(want)
        r = np.exp(raw)
        keep = r * math.exp(sig)
        keep[8] += (1 - math.exp(sig)) * r.sum()
        assert g == pytest.approx(keep)


def test_d3pm_loss_at_the_first_step(spark):
    df = spark.createDataFrame([(0, math.log(0.4), math.log(0.1), 0.1), (1, math.log(0.4), math.log(0.1), 0.5)], "i int, p double, m double, t double")
    loss = losses.loss_d3pm(F.col("p"), F.col("m"), F.lit(8), F.col("t"), 10, 8)
    got = values(df, loss)
    now = math.log(0.9 * 0.1 / 0.1 + 1)
    assert got[0] == pytest.approx(10 * (now - math.log(0.4)))
    now, before = math.log(0.5 * 0.1 / 0.5 + 1), math.log(0.6 * 0.1 / 0.4 + 1)
    assert got[1] == pytest.approx(10 * (0.2 * (now - math.log(0.4)) + 0.8 * (now - before)))


def test_score_entropy_is_zero_at_the_truth(spark):
    # the exact ratio has q at the target and 0 elsewhere, where the loss vanishes
    sigma = 0.7
    q = 1 / math.expm1(sigma)
    df = spark.createDataFrame([(0, [-1e6, math.log(q), -1e6, 0.0])], "i int, s array<double>")
    got = values(df, losses.score_entropy(F.col("s"), F.lit(1), F.lit(3), F.lit(sigma), 3))
    assert got[0] == pytest.approx(0, abs=1e-9)
    assert values(df, losses.score_entropy(F.col("s"), F.lit(1), F.lit(1), F.lit(sigma), 3)) == [0]


def test_zero_noise_has_no_weight(spark):
    df = spark.createDataFrame([(0, 0.0)], "i int, sigma double")
    assert values(df, losses.weight(F.col("sigma"), F.lit(1.0))) == [None]


def test_lane_threshold_equals_comparison(spark):
    df = spark.range(300).withColumn("p", uniform("p", "id"))
    u = uniforms("s", ["id"], F.lit(7))
    h = hex_lanes("s", ["id"], F.lit(7))
    for chance in (F.col("p"), F.lit(0.0), F.lit(1.0), F.lit(1e-12)):
        off = df.where(
            F.transform(u, lambda x: x < chance) != F.transform(h, lambda x: x < hex_threshold(chance))
        )
        assert off.count() == 0


@pytest.mark.parametrize("chance", [0.02, 0.5, 0.97])
def test_mask_rate(spark, chance):
    n, size = 400, 250
    df = spark.range(n).withColumn("ids", F.array_repeat(F.lit(1), size))
    masked = df.select(
        F.sum(F.size(F.filter(corrupt.mask_tokens(F.col("ids"), F.lit(chance), 9, 1, "id"), lambda x: x == 9)))
    ).first()[0]
    error = math.sqrt(chance * (1 - chance) / (n * size))
    assert abs(masked / (n * size) - chance) < 4 * error


def test_corruption_ignores_partitioning(spark):
    df = spark.range(50).withColumn("ids", F.sequence(F.lit(1), F.lit(33)))
    runs = []
    for parts in (1, 4, 32):
        job = corrupt.corruption_job(df.repartition(parts), "id", "ids", 99, noise.LogLinear(), 3)
        runs.append([tuple(r["xt"]) for r in job.orderBy("id").collect()])
    assert runs[0] == runs[1] == runs[2]


@pytest.mark.parametrize("sampler", [draws.draw, draws.draw_race, draws.gumbel])
def test_categorical_frequencies(spark, sampler):
    p = [0.0, 0.5, 0.3, 0.15, 0.05]
    n = 20000
    shown = [math.log(max(x, 1e-30)) if sampler is draws.gumbel else x for x in p]
    df = spark.range(n).select(sampler(F.array(*[F.lit(x) for x in shown]), 5, "id").alias("x"))
    counts = {r["x"]: r["count"] for r in df.groupBy("x").count().collect()}
    assert 0 not in counts
    for token, chance in enumerate(p):
        assert abs(counts.get(token, 0) / n - chance) <= 4 * math.sqrt(chance * (1 - chance) / n)


@pytest.mark.parametrize("size", [1, 5, 256, 257, 1000])
def test_inverse_walk(spark, size):
    rng = np.random.default_rng(size)
    data = []
    for i in range(60):
        p = rng.random(size) * (rng.random(size) < 0.6)
        p[rng.integers(0, size)] = 1.0
        if i % 5 == 0:
            p[0] = -1.0 if size > 1 and p.sum() - p[0] > 0 else p[0]
        data.append((i, p.tolist(), float([1e-9, 0.5, 1 - 1e-16, *rng.random(5)][i % 8])))
    df = spark.createDataFrame(data, "i int, s array<double>, u double")
    for (i, p, u), got in zip(data, values(df, draws.inverse(F.col("s"), F.array("u"))[0])):
        w = np.maximum(p, 0)
        upto = np.cumsum(w)
        assert w[got] > 0
        assert upto[got] >= u * w.sum() * (1 - 1e-9)
        assert upto[got] - w[got] <= u * w.sum() * (1 + 1e-9)


def test_gaussian_moments(spark):
    row = F.array(*[F.lit(2.0)] * 4, *[F.lit(0.5)] * 4)
    df = spark.range(5000).select(F.explode(draws.gaussian(row, 1, "id")).alias("x"))
    mean, sd = df.agg(F.avg("x"), F.stddev("x")).first()
    want = math.sqrt(math.log1p(math.exp(0.5)))
    assert mean == pytest.approx(2.0, abs=4 * want / math.sqrt(20000))
    assert sd == pytest.approx(want, rel=0.03)


def test_steps_keep_visible_tokens(spark):
    data, df = rows(spark)
    p = F.transform(sc.subs(F.col("s"), F.col("xt"), 8), F.exp)
    token = draws.step_ddpm(p, F.col("xt"), F.lit(0.8), F.lit(0.4), 8, 1, "i")
    for (i, s, x0, xt, sig), new in zip(data, values(df, token)):
        assert new == xt if xt != 8 else 0 <= new <= 8
    ratio = sc.ratio(sc.subs(F.col("s"), F.col("xt"), 8), F.col("xt"), F.col("sigma"), 8)
    clean = values(df, draws.step_denoise(ratio, F.col("xt"), F.col("sigma"), 8, 2, "i"))
    assert all(new != 8 for new in clean)


def test_topk(spark):
    df = spark.createDataFrame([(0, [1.0, 5.0, 3.0, 5.0])], "i int, s array<double>")
    assert values(df, draws.topk_hard(F.col("s"), 1)) == [[0, 1, 0, 1]]
    assert values(df, draws.topk_hard(F.col("s"), 3)) == [[0, 1, 1, 1]]
    soft = values(df, draws.topk_soft(F.col("s")))[0]
    assert sum(soft) == pytest.approx(0) and np.linalg.norm(soft) == pytest.approx(1)
    assert values(df, argmax(F.col("s"))) == [1]


def test_topk_noise(spark):
    df = spark.range(200).withColumn("s", F.array_repeat(F.lit(0.0), 50))
    runs = [
        topk.topk_noise(df.repartition(parts), ["id"], "s", 5, 1).orderBy("id").collect()
        for parts in (1, 7)
    ]
    assert runs[0] == runs[1]
    flat = np.concatenate([r["noisy"] for r in runs[0]])
    # mean of the weighted gamma sum: sum over i of (i / k) * (1 / k)
    want = (55 / 25 - math.log(10)) / 5
    assert flat.mean() == pytest.approx(want, abs=0.01)


def test_long_form_of_a_large_vocabulary(spark):
    df = spark.range(1).select("id", F.transform(F.sequence(F.lit(1), F.lit(70_000)), lambda i: i.cast("double")).alias("s"))
    assert to_long(df, ["id"], "s").count() == 70_000
