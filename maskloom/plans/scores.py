"""Score-table transforms and losses. Every embedding row is one position's logits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from maskloom.functions import draws as dr, losses as ls, noise, scores as sc
from maskloom.functions.rand import uniform
from maskloom.operators import metrics as mt
from maskloom.operators.table import join_scores, to_long
from maskloom.plans.registry import query, r6, s6, sql_u, sql_u_open, table

LENGTH, VOCAB, MASK = 16, 64, 63
SCHEDULE = noise.LogLinear()
KEYS = ["seq_id", "pos"]

# seq_id, pos, target x0, noisy xt, time t, sigma, rate, and 64 logits s with their log-sum-exp z
BASE_SQL = f"""e AS (SELECT vec_id // {LENGTH} AS seq_id, vec_id % {LENGTH} AS pos, label::INTEGER AS x0,
    list_transform(embedding, lambda v: v::DOUBLE * 8) AS s FROM embeddings),
  et AS (SELECT *, 0.999::DOUBLE * {sql_u('t', 'seq_id')} + 0.001::DOUBLE AS t FROM e),
  es AS (SELECT *, -ln(1 - 0.999::DOUBLE * t) AS sigma, 0.999::DOUBLE / (1 - 0.999::DOUBLE * t) AS rate, list_max(s) AS top FROM et),
  sc AS (SELECT *, CASE WHEN {sql_u('x', 'seq_id', 'pos')} < 1 - exp(-sigma) THEN {MASK} ELSE x0 END::INTEGER AS xt,
    top + ln(list_sum(list_transform(s, lambda v: exp(v - top)))) AS z FROM es)"""
# the same in long form, one row per token; sz is the log-sum-exp without the mask column
LONG_SQL = (
    BASE_SQL
    + f""", sy AS (SELECT *, top + ln(list_sum(list_transform(s[1:{VOCAB - 1}], lambda v: exp(v - top)))) AS sz FROM sc),
  lf AS (SELECT seq_id, pos, x0, xt, t, sigma, rate, z, sz, unnest(s) AS x, (generate_subscripts(s, 1) - 1)::INTEGER AS tok FROM sy)"""
)
# log-probabilities after substitution: masked positions renormalized without MASK, visible ones fixed
SUBS = f"""CASE WHEN xt = {MASK} THEN CASE WHEN tok = {MASK} THEN x - 1000000 - sz ELSE x - sz END
    WHEN tok = xt THEN 0::DOUBLE ELSE -1000000::DOUBLE END"""


def positions(spark: SparkSession, folder: str) -> DataFrame:
    """The score table with targets, noisy tokens and noise levels."""
    rows = table(spark, folder, "embeddings").select(
        F.floor(F.col("vec_id") / F.lit(LENGTH)).cast("long").alias("seq_id"),
        (F.col("vec_id") % LENGTH).alias("pos"),
        F.col("label").cast("int").alias("x0"),
        F.transform("embedding", lambda v: v.cast("double") * 8).alias("s"),
    )
    timed = rows.withColumn("t", noise.spread_t(uniform("t", "seq_id")))
    noisy = timed.withColumn("sigma", SCHEDULE.sigma(F.col("t"))).withColumn(
        "rate", SCHEDULE.rate(F.col("t"))
    )
    hit = uniform("x", "seq_id", "pos") < noise.move_chance(F.col("sigma"))
    return noisy.withColumn("xt", F.when(hit, F.lit(MASK)).otherwise(F.col("x0")))


def long_form(df: DataFrame, values: Column, keys: list[str] | None = None) -> DataFrame:
    keys = keys or KEYS
    return to_long(df.select(*keys, values.alias("_s")), keys, "_s").withColumn("score", r6("score"))


def _register(name: str, expression: str, build) -> None:
    @query(
        name,
        f"WITH {LONG_SQL} SELECT seq_id, pos, tok AS token_id, {s6(expression)} AS score FROM lf",
    )
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return long_form(positions(spark, folder), build())


def subs_scores() -> Column:
    return sc.subs(F.col("s"), F.col("xt"), MASK)


_register("score_logsoftmax", "x - z", lambda: sc.log_softmax(F.col("s")))
_register("score_subs", SUBS, subs_scores)
_register(
    "score_d3pm",
    f"CASE WHEN tok = {MASK} THEN x - 1000000 - sz ELSE x - sz END",
    lambda: sc.d3pm(F.col("s"), MASK, subs_masking=True),
)
SEDD = f"CASE WHEN tok = xt THEN 0::DOUBLE ELSE x - ln(exp(sigma) - 1) - ln({VOCAB - 1}) END"
_register("score_sedd", SEDD, lambda: sc.sedd(F.col("s"), F.col("xt"), F.col("sigma")))
_register(
    "score_ar",
    f"CASE WHEN tok = {MASK} THEN -1000 - sz ELSE x - sz END",
    lambda: sc.ar(F.col("s"), MASK),
)
RATIO = f"""exp(CASE WHEN xt = {MASK} THEN CASE WHEN tok = {MASK} THEN 0::DOUBLE ELSE x - sz - ln(exp(sigma) - 1) END
    WHEN tok = {MASK} THEN ln(exp(sigma) - 1) WHEN tok = xt THEN 0::DOUBLE ELSE -1000000::DOUBLE END)"""


def ratio_scores() -> Column:
    return sc.ratio(subs_scores(), F.col("xt"), F.col("sigma"), MASK)


_register("score_ratio", RATIO, ratio_scores)

# a half step of noise for the staggered score and the transition
DSIGMA = "(sigma / 2)"
STAG_SQL = (
    LONG_SQL
    + f""", ra AS (SELECT *, {RATIO} AS r FROM lf), rt AS (SELECT *, sum(r) OVER (PARTITION BY seq_id, pos) AS total FROM ra),
  st AS (SELECT *, r * exp({DSIGMA}) + CASE WHEN tok = {MASK} THEN (1 - exp({DSIGMA})) * total ELSE 0 END AS stag,
   CASE WHEN tok = xt THEN exp(-{DSIGMA}) ELSE 0 END + CASE WHEN xt = {MASK} THEN 1 - exp(-{DSIGMA}) ELSE 0 END AS edge FROM rt)"""
)


@query(
    "score_staggered",
    f"WITH {STAG_SQL} SELECT seq_id, pos, tok AS token_id, {s6('stag')} AS score FROM st",
)
def score_staggered(spark: SparkSession, folder: str) -> DataFrame:
    return long_form(positions(spark, folder), sc.staggered(ratio_scores(), F.col("sigma") / 2, MASK))


@query(
    "transp_transition",
    f"WITH {STAG_SQL} SELECT seq_id, pos, tok AS token_id, {s6('edge')} AS score FROM st",
)
def transp_transition(spark: SparkSession, folder: str) -> DataFrame:
    return long_form(
        positions(spark, folder), sc.transition(F.col("xt"), F.col("sigma") / 2, VOCAB, MASK)
    )


@query(
    "score_dispatch",
    f"""WITH {LONG_SQL}, k AS (SELECT *, list_extract(['subs', 'sedd', 'd3pm', 'ar'], (seq_id % 4)::INTEGER + 1) AS kind FROM lf)
    SELECT seq_id, pos, kind, tok AS token_id, {s6(f'''CASE kind WHEN 'subs' THEN {SUBS} WHEN 'sedd' THEN {SEDD}
    WHEN 'd3pm' THEN x - z ELSE CASE WHEN tok = {MASK} THEN -1000 - sz ELSE x - sz END END''')} AS score FROM k""",
)
def score_dispatch(spark: SparkSession, folder: str) -> DataFrame:
    kinds = ["subs", "sedd", "d3pm", "ar"]
    rows = positions(spark, folder).withColumn(
        "kind", F.get(F.array(*[F.lit(k) for k in kinds]), (F.col("seq_id") % 4).cast("int"))
    )
    chosen = F.lit(None).cast("array<double>")
    for kind in kinds:
        value = sc.parameterize(kind, F.col("s"), MASK, F.col("xt"), F.col("sigma"))
        chosen = F.when(F.col("kind") == kind, value).otherwise(chosen)
    return long_form(rows, chosen, ["seq_id", "pos", "kind"])


@query("gather_target", f"WITH {BASE_SQL} SELECT seq_id, pos, {s6('s[x0 + 1] - z')} AS log_p FROM sc")
def gather_target(spark: SparkSession, folder: str) -> DataFrame:
    log_p = sc.log_prob(F.col("s"), F.col("x0"))
    return positions(spark, folder).select(*KEYS, r6(log_p).alias("log_p"))


@query(
    "clamp_ids",
    "SELECT doc_id, greatest(0, least(n_chars % 97, 63))::BIGINT AS token FROM documents",
)
def clamp_ids(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        "doc_id", sc.clamp(F.col("n_chars") % 97, 64).alias("token")
    )


# per-position log-probability of the target under substitution
P_SQL = (
    LONG_SQL
    + f""", lp AS (SELECT seq_id, pos, x0, xt, t, sigma, rate, {SUBS} AS log_p FROM lf WHERE tok = x0)"""
)


def target_log_p(spark: SparkSession, folder: str) -> DataFrame:
    return positions(spark, folder).withColumn("log_p", sc.gather(subs_scores(), F.col("x0")))


@query(
    "loss_subs",
    f"WITH {P_SQL} SELECT seq_id, pos, {s6('-log_p * (rate / (exp(sigma) - 1))')} AS loss FROM lp",
)
def loss_subs(spark: SparkSession, folder: str) -> DataFrame:
    loss = ls.loss_subs(F.col("log_p"), F.col("sigma"), F.col("rate"))
    return target_log_p(spark, folder).select(*KEYS, r6(loss).alias("loss"))


COV = math.log1p(-math.exp(-SCHEDULE.sigma_min))


@query("loss_weight_cov", f"WITH {P_SQL} SELECT seq_id, pos, {s6(f'log_p * ({COV!r}::DOUBLE)')} AS loss FROM lp")
def loss_weight_cov(spark: SparkSession, folder: str) -> DataFrame:
    loss = ls.loss_cov(F.col("log_p"), SCHEDULE.sigma_min)
    return target_log_p(spark, folder).select(*KEYS, r6(loss).alias("loss"))


STEPS = 100
D3PM_SQL = (
    LONG_SQL
    + f""", g AS (SELECT *, floor(t * {STEPS}) / {STEPS} + 1::DOUBLE / {STEPS} AS grid, 1::DOUBLE / {STEPS} AS dt FROM lf),
  h AS (SELECT seq_id, pos, xt, dt, least(greatest(grid, 0), 1 - 0.0001::DOUBLE) AS u, max(x - z) FILTER (tok = x0) AS lx,
    max(x - z) FILTER (tok = {MASK}) AS lm FROM g GROUP BY ALL),
  n AS (SELECT *, ln((1 - u) * exp(lm) / u + 1) AS now FROM h)"""
)
D3PM = f"""{STEPS} * CASE WHEN xt = {MASK} THEN dt / u * (now - lx) + CASE WHEN abs(u - dt) < 1e-12 THEN 0
    ELSE (1 - dt / u) * (now - ln((1 - (u - dt)) * exp(lm) / (u - dt) + 1)) END ELSE 0 END"""


@query("loss_d3pm", f"WITH {D3PM_SQL} SELECT seq_id, pos, {s6(D3PM)} AS loss FROM n")
def loss_d3pm(spark: SparkSession, folder: str) -> DataFrame:
    rows = positions(spark, folder).withColumn("lp", sc.d3pm(F.col("s"), MASK))
    log_mask = sc.gather(F.col("lp"), F.lit(MASK))
    grid = noise.discretize_t(F.col("t"), STEPS)
    loss = ls.loss_d3pm(sc.gather(F.col("lp"), F.col("x0")), log_mask, F.col("xt"), grid, STEPS, MASK)
    return rows.select(*KEYS, r6(loss).alias("loss"))


@query(
    "loss_reconstruction",
    f"WITH {BASE_SQL} SELECT seq_id, pos, {s6('-(s[x0 + 1] - z)')} AS loss FROM sc",
)
def loss_reconstruction(spark: SparkSession, folder: str) -> DataFrame:
    log_p = sc.gather(sc.d3pm(F.col("s"), MASK), F.col("x0"))
    return positions(spark, folder).select(*KEYS, r6(-log_p).alias("loss"))


@query(
    "loss_score_entropy",
    f"""WITH {LONG_SQL}, d AS (SELECT seq_id, pos, xt, sigma, rate, sum(CASE WHEN tok = {MASK} THEN 0 ELSE exp({SEDD}) END) AS p,
    max({SEDD}) FILTER (tok = x0) AS n, 1 / (exp(sigma) - 1) AS q FROM lf GROUP BY ALL)
    SELECT seq_id, pos, {s6(f'CASE WHEN xt = {MASK} THEN rate * (p - q * n + q * (ln(q) - 1)) ELSE 0 END')} AS loss FROM d""",
)
def loss_score_entropy(spark: SparkSession, folder: str) -> DataFrame:
    log_score = sc.sedd(F.col("s"), F.col("xt"), F.col("sigma"))
    rows = positions(spark, folder).withColumn("ls", log_score)
    entropy = ls.score_entropy(F.col("ls"), F.col("x0"), F.col("xt"), F.col("sigma"), MASK)
    return rows.select(*KEYS, r6(F.col("rate") * entropy).alias("loss"))


@query(
    "loss_ar",
    f"""WITH {LONG_SQL}, nx AS (SELECT seq_id, pos, lead(x0) OVER (PARTITION BY seq_id ORDER BY pos) AS y FROM sc)
    SELECT seq_id, pos, {s6(f'-(CASE WHEN tok = {MASK} THEN -1000 - sz ELSE x - sz END)')} AS loss FROM lf JOIN nx USING (seq_id, pos) WHERE tok = y""",
)
def loss_ar(spark: SparkSession, folder: str) -> DataFrame:
    rows = positions(spark, folder)
    # the target of a position is the token of the next one: an equi-join on the shifted position
    targets = rows.select("seq_id", (F.col("pos") - 1).alias("pos"), F.col("x0").alias("y")).where("pos >= 0")
    log_p = sc.gather(sc.ar(F.col("s"), MASK), F.col("y"))
    return join_scores(rows.select(*KEYS, "s"), targets, KEYS).select(*KEYS, r6(-log_p).alias("loss"))


# targets with some to be ignored, and a weight per position
CE_SQL = (
    BASE_SQL
    + """, ce AS (SELECT seq_id, CASE WHEN x0 = 3 THEN -100 ELSE x0 END AS y, s[x0 + 1] - z AS log_p, (1 + pos)::DOUBLE AS w FROM sc)"""
)


def ce_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = positions(spark, folder)
    return rows.select(
        "seq_id",
        F.when(F.col("x0") == 3, -100).otherwise(F.col("x0")).alias("y"),
        sc.log_prob(F.col("s"), F.col("x0")).alias("log_p"),
        (F.col("pos") + 1).cast("double").alias("w"),
    )


@query(
    "cross_entropy_ignore",
    f"WITH {CE_SQL} SELECT seq_id, {s6('avg(-log_p)')} AS loss FROM ce WHERE y <> -100 GROUP BY seq_id",
)
def cross_entropy_ignore(spark: SparkSession, folder: str) -> DataFrame:
    out = mt.cross_entropy(ce_rows(spark, folder), "log_p", "y", ["seq_id"])
    return out.select("seq_id", r6("loss").alias("loss"))


@query(
    "cross_entropy_weighted",
    f"""WITH {CE_SQL} SELECT seq_id, {s6('sum(-log_p * w) FILTER (y <> -100) / sum(w) FILTER (y <> -100)')} AS loss FROM ce GROUP BY seq_id""",
)
def cross_entropy_weighted(spark: SparkSession, folder: str) -> DataFrame:
    out = mt.cross_entropy_weighted(ce_rows(spark, folder), "log_p", "y", "w", ["seq_id"])
    return out.select("seq_id", r6("loss").alias("loss"))


# Energies of the target sequence (p) and of one drawn from the substituted probabilities (n).
# The diffusion side scores a position's own token, visible ones with probability one. The
# autoregressive model has halved logits; its position scores the next token, without the mask.
DRAWN_SQL = f"""ng AS (SELECT seq_id, pos, min(tok) FILTER (WHERE w > 0 AND upto >= u * whole) AS yn FROM
    (SELECT *, sum(w) OVER (PARTITION BY seq_id, pos ORDER BY tok) AS upto, sum(w) OVER (PARTITION BY seq_id, pos) AS whole,
     {sql_u_open('neg', 'seq_id', 'pos')} AS u FROM (SELECT seq_id, pos, tok, exp({SUBS}) AS w FROM lf)) GROUP BY seq_id, pos)"""


def side_sql(token: str) -> str:
    """SQL of one position's part of the energy for the candidate in column ``token``."""
    own = f"CASE WHEN xt = {MASK} THEN s[{token} + 1] - sz ELSE CASE WHEN {token} = xt THEN 0::DOUBLE ELSE -1000000::DOUBLE END END"
    after = f"lead({token}) OVER (PARTITION BY seq_id ORDER BY pos)"
    seen = "lead(xt) OVER (PARTITION BY seq_id ORDER BY pos)"
    following = f"""CASE WHEN {seen} = {MASK} THEN s[{after} + 1] / 2 - hz WHEN {seen} IS NULL THEN 0
      WHEN {after} = {seen} THEN 0::DOUBLE ELSE -1000000::DOUBLE END"""
    return f"({own}) - ({following})"


HALVED_SQL = f"""hs AS (SELECT *, top / 2 + ln(list_sum(list_transform(s[1:{VOCAB - 1}], lambda v: exp((v - top) / 2)))) AS hz,
    top + ln(list_sum(list_transform(s[1:{VOCAB - 1}], lambda v: exp(v - top)))) AS sz FROM sc)"""
ENERGY_SQL = (
    LONG_SQL
    + f""", {DRAWN_SQL}, {HALVED_SQL}, cand AS (SELECT hs.*, yn::INTEGER AS yn FROM hs JOIN ng USING (seq_id, pos)),
  pt AS (SELECT seq_id, {side_sql('x0')} AS p, {side_sql('yn')} AS n FROM cand),
  en AS (SELECT seq_id, sum(p) AS pos_e, sum(n) AS neg_e, count(*) AS n FROM pt GROUP BY seq_id)"""
)


def both_models(rows: DataFrame) -> DataFrame:
    """Raw scores of the two models: the diffusion logits and, halved, the autoregressive ones."""
    return rows.select(*KEYS, F.col("s").alias("diffusion"), F.transform("s", lambda v: v / 2).alias("ar"))


def energies(spark: SparkSession, folder: str) -> DataFrame:
    """``pos_e`` of the target sequence, ``neg_e`` of a drawn one, ``n`` and ``missing``."""
    rows = positions(spark, folder)
    negative = dr.draw(F.transform(subs_scores(), F.exp), "neg", *KEYS)
    cells = rows.select(*KEYS, "xt", F.array("x0", negative).alias("tokens"))
    found = mt.sequence_energy(both_models(rows), cells, "seq_id", "pos", MASK)
    return found.select(
        "seq_id", F.col("energies")[0].alias("pos_e"), F.col("energies")[1].alias("neg_e"), "n", "missing"
    )


@query("energy_residual", f"WITH {ENERGY_SQL} SELECT seq_id, {s6('pos_e')} AS energy, 0::BIGINT AS missing FROM en")
def energy_residual(spark: SparkSession, folder: str) -> DataFrame:
    return energies(spark, folder).select("seq_id", r6("pos_e").alias("energy"), "missing")


@query(
    "loss_nce",
    f"""WITH {ENERGY_SQL} SELECT seq_id, {s6('-(ln(1 / (1 + exp(pos_e)) + 1e-8) + ln(1 / (1 + exp(-neg_e)) + 1e-8))')} AS loss FROM en""",
)
def loss_nce(spark: SparkSession, folder: str) -> DataFrame:
    loss = ls.loss_nce(F.col("pos_e"), F.col("neg_e"))
    return energies(spark, folder).select("seq_id", r6(loss).alias("loss"))


WEIGHT_SQL = "(rate / (exp(sigma) - 1))"
# in discrete time the substituted mask entry has no probability, so only the first term is left
U_SQL = f"least(floor(t * {STEPS}) / {STEPS} + 1::DOUBLE / {STEPS}, 1 - 0.0001::DOUBLE)"
DISCRETE_SQL = f"(CASE WHEN xt = {MASK} THEN -log_p / ({U_SQL}) ELSE 0 END)"


def _nll_energy(name: str, theta_sql: str, out_sql: str, theta, sigma_min: float | None) -> None:
    """Losses with a normalized energy (ar) and with a learned one, which is compared with
    that of a drawn sequence (pair)."""
    value = lambda gain: s6(out_sql.format(f"({theta_sql} + ({gain}) / n)"))

    @query(
        name,
        f"""WITH {ENERGY_SQL}, lp AS (SELECT seq_id, pos, xt, t, sigma, rate, {SUBS} AS log_p FROM lf WHERE tok = x0)
        SELECT seq_id, pos, {value('neg_e - pos_e')} AS pair_nll, {value('-pos_e')} AS ar_nll FROM lp JOIN en USING (seq_id)""",
    )
    def run(spark: SparkSession, folder: str) -> DataFrame:
        rows = target_log_p(spark, folder).withColumn("theta", theta()).select(*KEYS, "theta", "sigma", "rate")
        both = rows.join(energies(spark, folder), "seq_id", "left")
        paired = ls.energy_log_p(F.col("theta"), F.col("n"), F.col("pos_e"), F.col("neg_e"))
        single = ls.energy_log_p(F.col("theta"), F.col("n"), F.col("pos_e"))
        loss = lambda log_p: r6(ls.energy_nll(log_p, F.col("sigma"), F.col("rate"), sigma_min))
        return both.select(*KEYS, loss(paired).alias("pair_nll"), loss(single).alias("ar_nll"))


def discrete_loss() -> Column:
    grid = noise.discretize_t(F.col("t"), STEPS)
    log_mask = sc.gather(subs_scores(), F.lit(MASK))
    return ls.loss_d3pm(F.col("log_p"), log_mask, F.col("xt"), grid, STEPS, MASK)


PLAIN_SQL, COV_SQL = f"-({{}}) * {WEIGHT_SQL}", f"({{}}) * ({COV!r}::DOUBLE)"
_nll_energy("nll_energy", "log_p", PLAIN_SQL, lambda: F.col("log_p"), None)
_nll_energy("nll_energy_even", "log_p", COV_SQL, lambda: F.col("log_p"), SCHEDULE.sigma_min)
_nll_energy(
    "nll_energy_discrete",
    f"(-{DISCRETE_SQL} / {WEIGHT_SQL})",
    PLAIN_SQL,
    lambda: ls.theta_log_p(discrete_loss(), F.col("sigma"), F.col("rate")),
    None,
)
_nll_energy(
    "nll_energy_discrete_even",
    f"({DISCRETE_SQL} / ({COV!r}::DOUBLE))",
    COV_SQL,
    lambda: ls.theta_log_p(discrete_loss(), F.col("sigma"), F.col("rate"), SCHEDULE.sigma_min),
    SCHEDULE.sigma_min,
)
