"""Noise schedules over order rows and corruption of packed blocks."""

from __future__ import annotations



from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from maskloom.functions import noise
from maskloom.functions.rand import uniform
from maskloom.operators import corrupt, tokens as tk
from maskloom.plans.registry import joined, query, r6, s6, sql_lane, sql_u, table
from maskloom.plans.tokens import ENC, PACKED, encoded, packed

T_SQL = f"o AS (SELECT o_orderkey, {sql_u('t', 'o_orderkey')} AS t FROM orders)"


def timed(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with a uniform time in [0, 1)."""
    return table(spark, folder, "orders").select("o_orderkey", uniform("t", "o_orderkey").alias("t"))


SCHEDULE_SQL = {
    "loglinear": ("-ln(1 - 0.999::DOUBLE * t)", "0.999::DOUBLE / (1 - 0.999::DOUBLE * t)"),
    "cosine": (
        "-ln(0.001::DOUBLE + 0.999::DOUBLE * cos(t * pi() / 2))",
        "pi() / 2 * 0.999::DOUBLE * sin(t * pi() / 2) / (0.999::DOUBLE * cos(t * pi() / 2) + 0.001::DOUBLE)",
    ),
    "cosinesqr": (
        "-ln(0.001::DOUBLE + 0.999::DOUBLE * cos(t * pi() / 2) ** 2)",
        "pi() / 2 * 0.999::DOUBLE * sin(t * pi()) / (0.999::DOUBLE * cos(t * pi() / 2) ** 2 + 0.001::DOUBLE)",
    ),
    "linear": ("0.001::DOUBLE + t * (7::DOUBLE - 0.001::DOUBLE)", "7::DOUBLE - 0.001::DOUBLE"),
    "geometric": (
        "pow(0.001::DOUBLE, 1 - t) * pow(1::DOUBLE, t)",
        "pow(0.001::DOUBLE, 1 - t) * pow(1::DOUBLE, t) * (ln(1::DOUBLE) - ln(0.001::DOUBLE))",
    ),
}
SCHEDULES = {
    name: noise.schedule(name, **({"sigma_min": 1e-3, "sigma_max": 7.0} if name == "linear" else {}))
    for name in SCHEDULE_SQL
}


def _register(name: str) -> None:
    sigma, rate = SCHEDULE_SQL[name]

    @query(
        f"noise_{name}",
        f"WITH {T_SQL} SELECT o_orderkey, {s6(sigma)} AS sigma, {s6(rate)} AS rate FROM o",
    )
    def build(spark: SparkSession, folder: str) -> DataFrame:
        t = F.col("t")
        return timed(spark, folder).select(
            "o_orderkey",
            r6(SCHEDULES[name].sigma(t)).alias("sigma"),
            r6(SCHEDULES[name].rate(t)).alias("rate"),
        )


for _name in SCHEDULE_SQL:
    _register(_name)

NAMES = list(SCHEDULE_SQL)


@query(
    "noise_dispatch",
    "WITH o AS (SELECT o_orderkey, o_custkey % 5 AS kind, "
    + sql_u("t", "o_orderkey")
    + " AS t FROM orders) SELECT o_orderkey, CASE kind "
    + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(NAMES))
    + " END AS schedule, CASE kind "
    + " ".join(f"WHEN {i} THEN {s6(SCHEDULE_SQL[n][0])}" for i, n in enumerate(NAMES))
    + " END AS sigma FROM o",
)
def noise_dispatch(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").select(
        "o_orderkey", (F.col("o_custkey") % 5).alias("kind"), uniform("t", "o_orderkey").alias("t")
    )

    def pick(values: list[Column]) -> Column:
        chosen = F.when(F.col("kind") == 0, values[0])
        for i, value in enumerate(values[1:], 1):
            chosen = chosen.when(F.col("kind") == i, value)
        return chosen

    return rows.select(
        "o_orderkey",
        pick([F.lit(n) for n in NAMES]).alias("schedule"),
        pick([r6(SCHEDULES[n].sigma(F.col("t"))) for n in NAMES]).alias("sigma"),
    )


def _keep(sigma: float) -> str:
    return f"ln(1 - exp(-({sigma!r}::DOUBLE)))"


_LL = noise.LogLinear()
_EVEN = "(-ln(1 - exp(t * {end} + (1 - t) * {start})))"


@query(
    "is_transform",
    f"""WITH {T_SQL}, s AS (SELECT o_orderkey,
    {_EVEN.format(end=_keep(_LL.sigma_max), start=_keep(_LL.sigma_min))} AS ll,
    {_EVEN.format(end=_keep(7.0), start=_keep(0.001))} AS li FROM o)
    SELECT o_orderkey, {s6('(1 - exp(-ll)) / 0.999::DOUBLE')} AS loglinear,
    {s6('(li - 0.001::DOUBLE) / 6.999::DOUBLE')} AS linear FROM s""",
)
def is_transform(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("t")
    return timed(spark, folder).select(
        "o_orderkey",
        r6(SCHEDULES["loglinear"].importance(t)).alias("loglinear"),
        r6(SCHEDULES["linear"].importance(t)).alias("linear"),
    )


@query(
    "move_chance",
    f"""WITH {T_SQL} SELECT o_orderkey, {s6('1 - exp(ln(1 - 0.999::DOUBLE * t))')} AS loglinear,
    {s6(f"1 - exp(-({SCHEDULE_SQL['cosine'][0]}))")} AS cosine FROM o""",
)
def move_chance(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("t")
    return timed(spark, folder).select(
        "o_orderkey",
        r6(SCHEDULES["loglinear"].move_chance(t)).alias("loglinear"),
        r6(SCHEDULES["cosine"].move_chance(t)).alias("cosine"),
    )


@query(
    "move_chance_cov",
    f"""WITH {T_SQL} SELECT o_orderkey,
    {s6(f"exp({_keep(_LL.sigma_min)} + t * ({_keep(_LL.sigma_max)} - {_keep(_LL.sigma_min)}))")} AS chance FROM o""",
)
def move_chance_cov(spark: SparkSession, folder: str) -> DataFrame:
    return timed(spark, folder).select(
        "o_orderkey",
        r6(noise.move_chance_cov(F.col("t"), _LL.sigma_min, _LL.sigma_max)).alias("chance"),
    )


@query(
    "sample_t",
    f"""WITH o AS (SELECT o_orderkey, o_orderkey // 64 AS b, {sql_u('t', 'o_orderkey')} AS u FROM orders),
    n AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY b) AS n FROM o)
    SELECT o_orderkey, {s6('0.999::DOUBLE * u + 0.001::DOUBLE')} AS plain,
    {s6('0.999::DOUBLE * ((u / n + i / n) % 1::DOUBLE) + 0.001::DOUBLE')} AS antithetic FROM n""",
)
def sample_t(spark: SparkSession, folder: str) -> DataFrame:
    rows = timed(spark, folder).withColumn("batch_id", F.floor(F.col("o_orderkey") / F.lit(64)))
    # a batch has a fixed number of rows
    batch = Window.partitionBy("batch_id")
    index = F.row_number().over(batch.orderBy("o_orderkey")) - 1
    n = F.count(F.lit(1)).over(batch)
    return rows.withColumn("i", index).withColumn("n", n).select(
        "o_orderkey",
        r6(noise.spread_t(F.col("t"))).alias("plain"),
        r6(noise.spread_t(noise.antithetic(F.col("t"), F.col("i"), F.col("n")))).alias("antithetic"),
    )


@query(
    "discretize_t",
    f"WITH {T_SQL} SELECT o_orderkey, {s6('floor(t * 1000) / 1000 + 0.001::DOUBLE')} AS t FROM o",
)
def discretize_t(spark: SparkSession, folder: str) -> DataFrame:
    return timed(spark, folder).select("o_orderkey", r6(noise.discretize_t(F.col("t"), 1000)).alias("t"))


@query(
    "timestep_grid",
    f"""WITH c AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id),
    g AS (SELECT conv_id, n, unnest(range(n + 1)) AS i FROM c)
    SELECT conv_id, i::INTEGER AS i, {s6('1 - i * (0.99999::DOUBLE / n)')} AS t, {s6('0.99999::DOUBLE / n')} AS dt FROM g""",
)
def timestep_grid(spark: SparkSession, folder: str) -> DataFrame:
    steps = table(spark, folder, "conversations").groupBy("conv_id").agg(
        F.count(F.lit(1)).cast("int").alias("n")
    )
    return noise.timestep_grid(steps, "n").select("conv_id", "i", r6("t").alias("t"), r6("dt").alias("dt"))


@query(
    "lr_warmup_constant",
    "SELECT event_id, round(0.0003::DOUBLE * least(1::DOUBLE, event_id / 2500::DOUBLE), 9) AS lr FROM events",
)
def lr_warmup_constant(spark: SparkSession, folder: str) -> DataFrame:
    lr = noise.lr_warmup_constant(F.col("event_id"), 3e-4, 2500)
    return table(spark, folder, "events").select("event_id", F.round(lr, 9).alias("lr"))


@query(
    "lr_cosine_warmup",
    """SELECT event_id, round(CASE WHEN event_id < 500 THEN 0.000001::DOUBLE + event_id * ((0.0003::DOUBLE - 0.000001::DOUBLE) / 500)
    WHEN event_id - 500 < 4500 THEN 0.000001::DOUBLE + 0.5::DOUBLE * (0.0003::DOUBLE - 0.000001::DOUBLE) * (1 + cos(pi() * (event_id - 500) / 4500))
    ELSE 0.000001::DOUBLE END, 9) AS lr FROM events""",
)
def lr_cosine_warmup(spark: SparkSession, folder: str) -> DataFrame:
    lr = noise.lr_cosine_warmup(F.col("event_id"), 3e-4, 500, 4500)
    return table(spark, folder, "events").select("event_id", F.round(lr, 9).alias("lr"))


def _masked(ids: str, chance: str, seed: object, *keys: str) -> str:
    return (
        f"list_transform({ids}, lambda x, i: CASE WHEN {sql_lane(seed, '(i - 1)', *keys)} < {chance} THEN 4 ELSE x END)"
    )


@query(
    "corrupt_mask",
    f"""WITH {ENC} SELECT doc_id, array_to_string({_masked('ids', '0.3::DOUBLE', 'mask', 'doc_id')}, ' ') AS xt FROM enc""",
)
def corrupt_mask(spark: SparkSession, folder: str) -> DataFrame:
    xt = corrupt.mask_tokens(F.col("ids"), F.lit(0.3), tk.CHAR_MASK, "mask", "doc_id")
    return encoded(spark, folder).select("doc_id", joined(xt).alias("xt"))


@query(
    "prior_mask",
    f"WITH {ENC} SELECT doc_id, array_to_string(list_transform(ids, lambda x: 4), ' ') AS xt FROM enc",
)
def prior_mask(spark: SparkSession, folder: str) -> DataFrame:
    return encoded(spark, folder).select(
        "doc_id", joined(corrupt.prior_mask(F.size("ids"), tk.CHAR_MASK)).alias("xt")
    )


# times of a job: one stratum per row of a batch of 512 blocks unless drawn plainly
PLAIN_U = sql_u("1t", "block_id")
STRATUM_U = f"(({PLAIN_U} / 512 + (block_id % 512) / 512::DOUBLE) % 1::DOUBLE)"
EVEN_T = f"(1 - exp(-({_EVEN.format(end=_keep(_LL.sigma_max), start=_keep(_LL.sigma_min)).replace('t *', 'u *').replace('- t', '- u')}))) / 0.999::DOUBLE"
EVEN_WEIGHT = f"-({_keep(_LL.sigma_min)})"


def job_sql(u: str = STRATUM_U, t: str = "u", chance: str = "1 - exp(-sigma)", weight: str = "dsigma / (exp(sigma) - 1)") -> str:
    return (
        PACKED
        + f""", uu AS (SELECT block_id, ids, 0.999::DOUBLE * {u} + 0.001::DOUBLE AS u FROM blocks),
    tt AS (SELECT block_id, ids, {t} AS t FROM uu),
    ss AS (SELECT *, -ln(1 - 0.999::DOUBLE * t) AS sigma, 0.999::DOUBLE / (1 - 0.999::DOUBLE * t) AS dsigma FROM tt),
    mm AS (SELECT *, {chance} AS chance, {weight} AS weight FROM ss),
    job AS (SELECT *, {_masked('ids', 'chance', '1x', 'block_id')} AS xt FROM mm)"""
    )


JOB_SQL = job_sql()


def corrupted(spark: SparkSession, folder: str, **options) -> DataFrame:
    return corrupt.corruption_job(
        packed(spark, folder), "block_id", "input_ids", tk.CHAR_MASK, SCHEDULES["loglinear"], seed=1, **options
    )


def _job(name: str, sql: str, **options) -> None:
    @query(
        name,
        f"""WITH {sql} SELECT block_id, {s6('t')} AS t, {s6('sigma')} AS sigma, {s6('dsigma')} AS dsigma,
        {s6('chance')} AS move_chance, {s6('weight')} AS weight, array_to_string(xt, ' ') AS xt FROM job""",
    )
    def run(spark: SparkSession, folder: str) -> DataFrame:
        numbers = ["t", "sigma", "dsigma", "move_chance", "weight"]
        job = corrupted(spark, folder, **options)
        return job.select("block_id", *[r6(c).alias(c) for c in numbers], joined("xt").alias("xt"))


_job("corruption_job", JOB_SQL)
_job("corruption_plain", job_sql(PLAIN_U), batch_size=None)
_job("corruption_importance", job_sql(t=EVEN_T, weight=EVEN_WEIGHT), importance=True)
# the last of 1000 grid points has no noise left to add, so the rate stays finite
_job("corruption_discrete", job_sql(t="floor(u * 1000) / 1000 + 0.001::DOUBLE"), steps=1000)
_job(
    "corruption_even",
    job_sql(chance=f"exp({_keep(_LL.sigma_min)} + t * ({_keep(_LL.sigma_max)} - {_keep(_LL.sigma_min)}))", weight=EVEN_WEIGHT),
    change_of_variables=True,
)


@query(
    "mask_share_by_decile",
    f"""WITH {JOB_SQL}, c AS (SELECT floor(t * 10)::BIGINT AS decile, len(ids) AS n,
    len(list_filter(xt, lambda x: x = 4)) AS m FROM job)
    SELECT decile, count(*) AS blocks, sum(n)::BIGINT AS tokens, {s6('sum(m) / sum(n)')} AS mask_share FROM c GROUP BY decile""",
)
def mask_share_by_decile(spark: SparkSession, folder: str) -> DataFrame:
    """Flagship: encode, pack, corrupt, and compare the masked share with t."""
    job = corrupted(spark, folder)
    masked = F.size(F.filter("xt", lambda x: x == tk.CHAR_MASK))
    return job.groupBy(F.floor(F.col("t") * 10).alias("decile")).agg(
        F.count(F.lit(1)).alias("blocks"),
        F.sum(F.size("xt")).alias("tokens"),
        r6(F.sum(masked) / F.sum(F.size("xt"))).alias("mask_share"),
    )
