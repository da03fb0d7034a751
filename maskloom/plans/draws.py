"""Weighted draws and one-step updates on the score table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from maskloom.functions import draws as dr, scores as sc
from maskloom.functions.arrays import argmax
from maskloom.functions.rand import uniform
from maskloom.operators import candidates as cd, metrics as mt
from maskloom.operators.topk import topk_noise as gamma_noise
from maskloom.plans.registry import query, r6, s6, sql_lane, sql_u, sql_u_open, table
from maskloom.plans.scores import (
    BASE_SQL,
    HALVED_SQL,
    KEYS,
    LONG_SQL,
    MASK,
    SCHEDULE,
    STAG_SQL,
    SUBS,
    both_models,
    long_form,
    positions,
    ratio_scores,
    side_sql,
    subs_scores,
)

TINY = "0.0000000001::DOUBLE"


def race(p: str, seed: str, *keys: str) -> str:
    """SQL weight whose arg-max is the drawn token."""
    return f"{p} / ({TINY} - ln({sql_lane(seed, 'tok', *keys)} + {TINY}))"


def winner(source: str, weight: str, extra: str = "") -> str:
    """SQL of the token with the largest weight per position, the smallest id on ties."""
    return (
        f"SELECT seq_id, pos{extra}, arg_max(tok, w) AS token FROM "
        f"(SELECT *, {weight} AS w FROM {source}) GROUP BY seq_id, pos{extra}"
    )


def reached(source: str, weight: str, seed: str, *keys: str, extra: str = "") -> str:
    """SQL of a draw with one uniform: the first token whose running sum reaches its share."""
    by = f"seq_id, pos{extra}"
    return (
        f"SELECT {by}, min(tok) FILTER (WHERE w > 0 AND upto >= u * whole) AS token FROM "
        f"(SELECT *, sum(w) OVER (PARTITION BY {by} ORDER BY tok) AS upto, sum(w) OVER (PARTITION BY {by}) AS whole, "
        f"{sql_u_open(seed, *keys)} AS u FROM (SELECT *, greatest({weight}, 0) AS w FROM {source})) GROUP BY {by}"
    )


def drawn(spark: SparkSession, folder: str, token: Column) -> DataFrame:
    return positions(spark, folder).select(*KEYS, token.alias("token"))


@query("draw_categorical", f"WITH {LONG_SQL} {winner('lf', race('exp(x - z)', 'cat', 'seq_id', 'pos'))}")
def draw_categorical(spark: SparkSession, folder: str) -> DataFrame:
    return drawn(spark, folder, dr.draw_race(sc.softmax(F.col("s")), "cat", *KEYS))


@query(
    "draw_k_candidates",
    f"""WITH {LONG_SQL}, k AS (SELECT *, unnest(range(3))::INTEGER AS cand_id FROM lf)
    {reached('k', 'exp(x - z)', 'cand', 'seq_id', 'pos', 'cand_id', extra=', cand_id')}""",
)
def draw_k_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return cd.draw_candidates(positions(spark, folder), KEYS, sc.softmax(F.col("s")), 3, "cand")


@query(
    "draw_gumbel",
    f"WITH {LONG_SQL} " + winner("lf", f"x - ln(-ln({sql_lane('gum', 'tok', 'seq_id', 'pos')}))"),
)
def draw_gumbel(spark: SparkSession, folder: str) -> DataFrame:
    return drawn(spark, folder, dr.gumbel(F.col("s"), "gum", *KEYS))


# three candidates per sequence from the substituted probabilities, with their energies
RESAMPLE_SQL = (
    LONG_SQL
    + f""", {HALVED_SQL}, k AS (SELECT *, unnest(range(3))::INTEGER AS cand_id FROM lf),
  cand AS ({reached('k', f'exp({SUBS})', 'cand', 'seq_id', 'pos', 'cand_id', extra=', cand_id')}),
  cells AS (SELECT hs.*, cand_id, token::INTEGER AS y FROM hs JOIN cand USING (seq_id, pos)),
  en AS (SELECT seq_id, cand_id, sum(e) AS energy FROM (SELECT seq_id, cand_id, {side_sql('y').replace('PARTITION BY seq_id', 'PARTITION BY seq_id, cand_id')} AS e FROM cells) GROUP BY ALL),
  mx AS (SELECT *, exp(energy - max(energy) OVER (PARTITION BY seq_id)) AS w FROM en),
  pr AS (SELECT *, sum(w) OVER (PARTITION BY seq_id ORDER BY cand_id) / sum(w) OVER (PARTITION BY seq_id) AS upto,
         {sql_u('pick', 'seq_id')} AS u FROM mx),
  pick AS (SELECT seq_id, min(cand_id) AS cand_id FROM pr WHERE upto >= u OR cand_id = 2 GROUP BY seq_id)"""
)


@query(
    "energy_resample",
    f"WITH {RESAMPLE_SQL} SELECT seq_id, pos, cand_id, token FROM pick JOIN cand USING (seq_id, cand_id)",
)
def energy_resample(spark: SparkSession, folder: str) -> DataFrame:
    rows = positions(spark, folder)
    drawn_ = dr.draw_many(F.transform(subs_scores(), F.exp), 3, "cand", *KEYS)
    cells = rows.select(*KEYS, "xt", drawn_.alias("tokens"))
    found = mt.sequence_energy(both_models(rows), cells, "seq_id", "pos", MASK)
    energy = found.select("seq_id", F.posexplode("energies").alias("cand_id", "energy"))
    picked = cd.energy_resample(energy, "seq_id", "energy", 1.0, "pick")
    return cells.join(picked, "seq_id").select(*KEYS, "cand_id", F.get("tokens", F.col("cand_id")).alias("token"))


@query(
    "is_window",
    f"""WITH {BASE_SQL} SELECT DISTINCT seq_id, {s6('t')} AS t FROM sc WHERE t BETWEEN 0.4 AND 0.6 AND xt = {MASK}""",
)
def is_window(spark: SparkSession, folder: str) -> DataFrame:
    rows = positions(spark, folder).withColumn("cached", F.col("xt") != MASK)
    return cd.in_window(rows, "t", "cached", 0.6, 0.4).select("seq_id", r6("t").alias("t")).distinct()


# one reverse step from t to 0.9 t; plain and cached forms differ in the masking chance for loglinear noise
CHANCE_T, CHANCE_S = "(0.999::DOUBLE * t)", "(0.999::DOUBLE * (0.9::DOUBLE * t))"


def step_sql(chance_t: str, chance_s: str, seed: str) -> str:
    p = f"CASE WHEN tok = {MASK} THEN {chance_s} ELSE exp({SUBS}) * ({chance_t} - {chance_s}) END"
    return f"""n AS ({reached('lf', p, seed, 'seq_id', 'pos', extra=', xt')}),
    step AS (SELECT seq_id, pos, xt, CASE WHEN xt <> {MASK} THEN xt ELSE token END::INTEGER AS token FROM n)"""


@query(
    "step_ddpm",
    f"""WITH {LONG_SQL}, {step_sql('(1 - exp(ln(1 - 0.999::DOUBLE * t)))', '(1 - exp(ln(1 - 0.999::DOUBLE * (0.9::DOUBLE * t))))', 'ddpm')}
    SELECT seq_id, pos, token FROM step""",
)
def step_ddpm(spark: SparkSession, folder: str) -> DataFrame:
    now = SCHEDULE.move_chance(F.col("t"))
    then = SCHEDULE.move_chance(F.col("t") * 0.9)
    probs = F.transform(subs_scores(), F.exp)
    return drawn(spark, folder, dr.step_ddpm(probs, F.col("xt"), now, then, MASK, "ddpm", *KEYS))


CACHED_SQL = step_sql("t", "(0.9::DOUBLE * t)", "cached")


def cached_step(rows: DataFrame) -> Column:
    """The cached form takes p(x0) as input; its masking chance is t itself."""
    return dr.step_ddpm(F.col("p"), F.col("xt"), F.col("t"), F.col("t") * 0.9, MASK, "cached", *KEYS)


def with_probs(spark: SparkSession, folder: str) -> DataFrame:
    return positions(spark, folder).withColumn("p", F.transform(subs_scores(), F.exp))


@query("step_ddpm_cached", f"WITH {LONG_SQL}, {CACHED_SQL} SELECT seq_id, pos, token FROM step")
def step_ddpm_cached(spark: SparkSession, folder: str) -> DataFrame:
    rows = with_probs(spark, folder)
    return rows.select(*KEYS, cached_step(rows).alias("token"))


@query(
    "carry_over",
    f"""WITH {LONG_SQL}, n AS ({reached('lf', 'exp(x - z)', 'cat', 'seq_id', 'pos', extra=', xt')})
    SELECT seq_id, pos, CASE WHEN xt <> {MASK} THEN xt ELSE token END::INTEGER AS token FROM n""",
)
def carry_over(spark: SparkSession, folder: str) -> DataFrame:
    new = dr.draw(sc.softmax(F.col("s")), "cat", *KEYS)
    return drawn(spark, folder, dr.carry_over(F.col("xt"), new, MASK))


@query(
    "cache_valid",
    f"""WITH {LONG_SQL}, {CACHED_SQL} SELECT seq_id, bool_and(token = xt) AS unchanged, count(*) FILTER (token <> xt) AS changed
    FROM step GROUP BY seq_id""",
)
def cache_valid(spark: SparkSession, folder: str) -> DataFrame:
    rows = with_probs(spark, folder)
    stepped = rows.select(*KEYS, "xt", cached_step(rows).alias("token"))
    return cd.cache_valid(stepped, "seq_id", "xt", "token")


@query("step_analytic", f"WITH {STAG_SQL} {reached('st', 'stag * edge', 'ana', 'seq_id', 'pos')}")
def step_analytic(spark: SparkSession, folder: str) -> DataFrame:
    rows = positions(spark, folder).withColumn("r", ratio_scores())
    token = dr.step_analytic(F.col("r"), F.col("xt"), F.col("sigma") / 2, MASK, "ana", *KEYS)
    return rows.select(*KEYS, token.alias("token"))


DENOISE_SQL = STAG_SQL.replace("(sigma / 2)", "sigma")


@query(
    "step_denoise",
    f"""WITH {DENOISE_SQL} {reached('st', f'CASE WHEN tok = {MASK} THEN 0 ELSE stag * edge END', 'den', 'seq_id', 'pos')}""",
)
def step_denoise(spark: SparkSession, folder: str) -> DataFrame:
    rows = positions(spark, folder).withColumn("r", ratio_scores())
    token = dr.step_denoise(F.col("r"), F.col("xt"), F.col("sigma"), MASK, "den", *KEYS)
    return rows.select(*KEYS, token.alias("token"))


@query("argmax_denoise", f"WITH {LONG_SQL} {winner('lf', SUBS)}")
def argmax_denoise(spark: SparkSession, folder: str) -> DataFrame:
    return drawn(spark, folder, argmax(subs_scores()))


@query(
    "topk_mask_hard",
    f"""WITH {LONG_SQL} SELECT seq_id, pos, tok AS token_id,
    (rank() OVER (PARTITION BY seq_id, pos ORDER BY x DESC) <= 5)::INTEGER::DOUBLE AS score FROM lf""",
)
def topk_mask_hard(spark: SparkSession, folder: str) -> DataFrame:
    return long_form(positions(spark, folder), dr.topk_hard(F.col("s"), 5))


@query(
    "topk_soft",
    f"""WITH {LONG_SQL}, c AS (SELECT seq_id, pos, tok, x - avg(x) OVER (PARTITION BY seq_id, pos) AS d FROM lf)
    SELECT seq_id, pos, tok AS token_id, {s6('d / sqrt(sum(d * d) OVER (PARTITION BY seq_id, pos))')} AS score FROM c""",
)
def topk_soft(spark: SparkSession, folder: str) -> DataFrame:
    return long_form(positions(spark, folder), dr.topk_soft(F.col("s")))


@query("topk_noise")
def topk_noise(spark: SparkSession, folder: str) -> DataFrame:
    rows = positions(spark, folder).select(*KEYS, "s")
    noisy = gamma_noise(rows, KEYS, "s", k=5, seed=11)
    return long_form(noisy, F.col("noisy"))


NOISY = f"x - ln({TINY} - ln({sql_lane('gs', 'tok', 'seq_id', 'pos')} + {TINY}))"


@query(
    "gumbel_softmax",
    f"""WITH {LONG_SQL}, g AS (SELECT seq_id, pos, tok, {NOISY} AS n FROM lf),
    m AS (SELECT *, exp(n / 0.5::DOUBLE - max(n / 0.5::DOUBLE) OVER w) AS e, max(n) OVER w AS top FROM g WINDOW w AS (PARTITION BY seq_id, pos))
    SELECT seq_id, pos, tok AS token_id, {s6('e / sum(e) OVER (PARTITION BY seq_id, pos)')} AS soft, (n = top)::INTEGER AS hard FROM m""",
)
def gumbel_softmax(spark: SparkSession, folder: str) -> DataFrame:
    rows = positions(spark, folder).select(
        *KEYS, dr.gumbel_softmax(F.col("s"), 0.5, "gs", *KEYS).alias("g")
    )
    flat = rows.select(*KEYS, F.col("g.hard").alias("winner"), F.col("g.soft").alias("soft"))
    return flat.select(*KEYS, "winner", F.posexplode("soft").alias("token_id", "soft")).select(
        *KEYS,
        "token_id",
        r6("soft").alias("soft"),
        F.when(F.col("token_id") == F.col("winner"), 1).otherwise(0).alias("hard"),
    )


def gumbel_sql(seed: str) -> str:
    return f"(-ln({TINY} - ln({sql_u_open(seed, 'o_orderkey')} + {TINY})))"


@query(
    "draw_bernoulli_relaxed",
    f"""WITH o AS (SELECT o_orderkey, {sql_u('p', 'o_orderkey')} AS p, exp({gumbel_sql('b-')} - {gumbel_sql('b+')}) AS d FROM orders)
    SELECT o_orderkey, CASE WHEN p * (1 + d) > 1 THEN 1::DOUBLE ELSE 0::DOUBLE END AS hard, {s6('p / (p + (1 - p) * d)')} AS soft FROM o""",
)
def draw_bernoulli_relaxed(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").select("o_orderkey", uniform("p", "o_orderkey").alias("p"))
    return rows.select(
        "o_orderkey", dr.bernoulli_relaxed(F.col("p"), "b", "o_orderkey").alias("b")
    ).select("o_orderkey", F.col("b.hard").alias("hard"), r6("b.soft").alias("soft"))


@query(
    "draw_gaussian",
    f"""WITH {BASE_SQL}, g AS (SELECT seq_id, pos, unnest(s[1:32]) AS mu, unnest(s[33:64]) AS raw, unnest(range(32)) AS tok FROM sc)
    SELECT seq_id, pos, tok::INTEGER AS token_id, {s6(f'''mu + sqrt(ln(1 + exp(raw))) * sqrt(-2 * ln({sql_lane('gau', 'tok', 'seq_id', 'pos')}))
    * cos(2 * pi() * {sql_lane('gav', 'tok', 'seq_id', 'pos')})''')} AS score FROM g""",
)
def draw_gaussian(spark: SparkSession, folder: str) -> DataFrame:
    return long_form(positions(spark, folder), dr.gaussian(F.col("s"), "ga", *KEYS))


@query(
    "sign_discretize",
    f"""WITH {LONG_SQL} SELECT seq_id, pos, tok AS token_id, sign(x)::DOUBLE AS hard,
    {s6('x / sqrt(sum(x * x) OVER (PARTITION BY seq_id, pos))')} AS soft FROM lf""",
)
def sign_discretize(spark: SparkSession, folder: str) -> DataFrame:
    rows = positions(spark, folder).select(*KEYS, dr.sign_discretize(F.col("s")).alias("d"))
    return rows.select(
        *KEYS, F.posexplode(F.arrays_zip("d.hard", "d.soft")).alias("token_id", "c")
    ).select(*KEYS, "token_id", F.col("c.hard").alias("hard"), r6("c.soft").alias("soft"))
