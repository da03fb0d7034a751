"""Metrics over loss rows made from lineitem, events and packed blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from maskloom.functions import batches
from maskloom.functions.rand import uniform_each
from maskloom.operators import ema, evaluate as ev, metrics as mt, tokens as tk
from maskloom.operators.config import config_violations
from maskloom.plans.registry import joined, query, r6, s6, sql_u, table
from maskloom.plans.tokens import PACKED, SQL_DECODE, packed
from maskloom.session import saved

# one loss row per line item: split, epoch, a loss with some NaN, and a mask
LOSS_SQL = """x AS (SELECT l_orderkey, l_linenumber, l_linestatus AS split, year(l_shipdate)::INTEGER AS epoch,
    CASE WHEN l_linenumber = 7 THEN 'nan'::DOUBLE ELSE l_quantity / 10 + l_discount END AS nll,
    CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS mask FROM lineitem)"""


def loss_rows(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_linestatus").alias("split"),
        F.year("l_shipdate").alias("epoch"),
        F.when(F.col("l_linenumber") == 7, F.lit(float("nan")))
        .otherwise(F.col("l_quantity") / 10 + F.col("l_discount"))
        .alias("nll"),
        F.when(F.col("l_returnflag") == "R", 0).otherwise(1).alias("mask"),
    )


MEAN_SQL = LOSS_SQL + ", m AS (SELECT split, sum(nll * mask) / sum(mask) AS v FROM x WHERE NOT isnan(nll) GROUP BY split)"


@query("metric_nll", f"WITH {MEAN_SQL} SELECT split, {s6('v')} AS nll FROM m")
def metric_nll(spark: SparkSession, folder: str) -> DataFrame:
    return mt.metric_nll(loss_rows(spark, folder), "nll", "mask", ["split"]).select("split", r6("nll").alias("nll"))


@query("metric_bpd", f"WITH {MEAN_SQL} SELECT split, {s6('v / ln(2)')} AS bpd FROM m")
def metric_bpd(spark: SparkSession, folder: str) -> DataFrame:
    return mt.metric_bpd(loss_rows(spark, folder), "nll", "mask", ["split"]).select("split", r6("bpd").alias("bpd"))


@query("metric_ppl", f"WITH {MEAN_SQL} SELECT split, {s6('exp(v)')} AS ppl FROM m")
def metric_ppl(spark: SparkSession, folder: str) -> DataFrame:
    return mt.metric_ppl(loss_rows(spark, folder), "nll", "mask", ["split"]).select("split", r6("ppl").alias("ppl"))


@query(
    "metric_epoch",
    f"""WITH {LOSS_SQL}, m AS (SELECT split, epoch, sum(nll * mask) / sum(mask) AS v FROM x WHERE NOT isnan(nll)
    GROUP BY ROLLUP (split, epoch)) SELECT split, epoch, {s6('v')} AS nll, {s6('v / ln(2)')} AS bpd, {s6('exp(v)')} AS ppl FROM m""",
)
def metric_epoch(spark: SparkSession, folder: str) -> DataFrame:
    out = mt.metric_epoch(loss_rows(spark, folder), "nll", "mask", "split", "epoch")
    return out.select("split", "epoch", r6("nll").alias("nll"), r6("bpd").alias("bpd"), r6("ppl").alias("ppl"))


@query(
    "masked_batch_loss",
    f"""WITH {LOSS_SQL} SELECT l_orderkey // 16 AS batch_id, CASE WHEN sum(mask) > 0 THEN {s6('sum(nll * mask) / sum(mask)')} END AS loss
    FROM (SELECT l_orderkey, mask, CASE WHEN isnan(nll) THEN 0 ELSE nll END AS nll FROM x) GROUP BY 1""",
)
def masked_batch_loss(spark: SparkSession, folder: str) -> DataFrame:
    rows = loss_rows(spark, folder).withColumn("nll", F.nanvl("nll", F.lit(0.0))).withColumn(
        "batch_id", F.floor(F.col("l_orderkey") / F.lit(16)).cast("long")
    )
    return mt.masked_batch_loss(rows, "nll", "mask", ["batch_id"]).select("batch_id", r6("loss").alias("loss"))


# generated samples: packed blocks decoded to text, encoded as code points, cut at 256, padded
# with 0 to the longest of 8, read in windows of 64
RETOKENIZED_SQL = (
    PACKED
    + f""", coded AS (SELECT block_id, block_id // 8 AS batch_id, list_slice(list_transform(list_filter(string_split({SQL_DECODE.format('ids')}, ''),
      lambda c: c <> ''), lambda c: unicode(c)), 1, 256) AS f FROM blocks),
    wide AS (SELECT *, max(len(f)) OVER (PARTITION BY batch_id) AS w FROM coded),
    ret AS (SELECT block_id, batch_id, len(f) AS used, list_concat(f, list_transform(range(w - len(f)), lambda x: 0)) AS ids FROM wide)"""
)
# a log-probability per counted position; some are missing and some are NaN
SCORED_SQL = (
    RETOKENIZED_SQL
    + f""", win AS (SELECT block_id, k AS window_id, list_slice(ids, k * 64 + 1, k * 64 + 64) AS ids FROM
      (SELECT block_id, ids, unnest(range((len(ids) - 1) // 64 + 1)) AS k FROM ret)),
    cells AS (SELECT block_id, window_id, unnest(ids) AS id, generate_subscripts(ids, 1) - 1 AS i, list_position(ids, 0) - 1 AS f FROM win),
    kept AS (SELECT *, {sql_u('score', 'block_id', 'window_id', 'i')} AS u FROM cells WHERE i > 0 AND (id <> 0 OR i = f)),
    scored AS (SELECT CASE WHEN u >= 0.02 THEN -5 * u END AS lp FROM kept)"""
)


def samples(blocks: DataFrame) -> DataFrame:
    batch = F.floor(F.col("block_id") / F.lit(8)).cast("long")
    return ev.retokenized(
        blocks.select("block_id", batch.alias("batch_id"), "ids"),
        "ids",
        "batch_id",
        lambda ids: tk.decode_ids(ids, tk.CHAR_VOCAB),
        tk.code_points,
        256,
        0,
    )


def generated(spark: SparkSession, folder: str) -> DataFrame:
    """The blocks that stand for a model's samples; an id of the characters takes a byte."""
    return packed(spark, folder).select("block_id", F.col("input_ids").cast("array<tinyint>").alias("ids"))


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _some_missing(draws: pa.Array) -> pa.Array:
    values, lengths, null = batches.flat(draws)
    u = values.to_numpy(zero_copy_only=False)
    return batches.lists(pa.array(np.where(u < 0.02, np.nan, u * -5), mask=u < 0.01), lengths, null)


def score_table(windows: DataFrame) -> tuple[DataFrame, Column]:
    """What a model would give: every window in one row, and the log-probabilities made of it."""
    scores = windows.select("block_id", "window_id", F.size("counts").alias("n"))
    return scores, _some_missing(uniform_each("score", ["block_id", "window_id"], F.col("n")))


def evaluated(blocks: DataFrame) -> DataFrame:
    # windows are a table: samples are retokenized once
    windows = saved(ev.context_windows(samples(blocks), "block_id", "ids", 64, 0), "windows")
    scores, lps = score_table(windows)
    return ev.gen_ppl(windows, "block_id", scores, lps)


@query(
    "retokenize",
    f"""WITH {RETOKENIZED_SQL} SELECT block_id, batch_id, array_to_string(ids, ' ') AS ids, used::INTEGER AS used, len(ids)::INTEGER AS width FROM ret""",
)
def retokenize(spark: SparkSession, folder: str) -> DataFrame:
    used = F.aggregate("attention_mask", F.lit(0), lambda acc, x: acc + x)
    return samples(generated(spark, folder)).select(
        "block_id", "batch_id", joined("ids").alias("ids"), used.alias("used"), F.size("ids").alias("width")
    )


@query(
    "gen_ppl",
    f"""WITH {SCORED_SQL} SELECT count(lp) AS tokens, {s6('exp(-avg(lp))')} AS gen_ppl, count(*) - count(lp) AS unscored FROM scored""",
)
def gen_ppl(spark: SparkSession, folder: str) -> DataFrame:
    # packed once for the sizes and the ids of the samples
    blocks = saved(generated(spark, folder), "blocks")
    return evaluated(blocks).select("tokens", r6("gen_ppl").alias("gen_ppl"), "unscored")


@query(
    "sample_entropy",
    f"""WITH {PACKED}, c AS (SELECT block_id, id, count(*) AS n FROM (SELECT block_id, unnest(ids) AS id FROM blocks) GROUP BY block_id, id),
    e AS (SELECT block_id, -sum(n / 128 * log2(n / 128)) AS e FROM c GROUP BY block_id)
    SELECT {s6('avg(e)')} AS entropy FROM e""",
)
def sample_entropy(spark: SparkSession, folder: str) -> DataFrame:
    return mt.sample_entropy(packed(spark, folder), "input_ids").select(r6("entropy").alias("entropy"))


@query(
    "metric_time",
    f"""SELECT event_type, {s6("avg(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6::DOUBLE")} AS seconds
    FROM events GROUP BY event_type""",
)
def metric_time(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").withColumn("start", F.lit("2024-01-01").cast("timestamp_ntz"))
    return mt.metric_time(events, "start", "ts", ["event_type"]).select(
        "event_type", r6("seconds").alias("seconds")
    )


@query(
    "nan_report",
    f"""WITH {LOSS_SQL}, c AS (SELECT count(*) AS rows, count(*) FILTER (isnan(nll)) AS a FROM x)
    SELECT 'nll' AS name, a AS nans, a > 0 AS any_nan, rows FROM c UNION ALL SELECT 'mask', 0, false, rows FROM c""",
)
def nan_report(spark: SparkSession, folder: str) -> DataFrame:
    rows = loss_rows(spark, folder).withColumn("mask", F.col("mask").cast("double"))
    return mt.nan_report(rows, ["nll", "mask"])


@query(
    "topk_checkpoints",
    """WITH b AS (SELECT event_id, value FROM events ORDER BY value, event_id LIMIT 10),
    l AS (SELECT event_id, value FROM events ORDER BY event_id DESC LIMIT 1)
    SELECT event_id, value FROM b UNION SELECT event_id, value FROM l""",
)
def topk_checkpoints(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select("event_id", "value")
    return mt.topk_checkpoints(rows, "value", "event_id")


@query("every_n", "SELECT event_id, value FROM events WHERE event_id % 500 = 0")
def every_n(spark: SparkSession, folder: str) -> DataFrame:
    return mt.every_n(table(spark, folder, "events").select("event_id", "value"), "event_id")


EMA_SQL = """r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k FROM events),
    e AS (SELECT user_id, k, value AS shadow FROM r WHERE k = 0
    UNION ALL SELECT r.user_id, r.k, e.shadow - (1 - least(0.9999::DOUBLE, (1 + r.k) / (10 + r.k))) * (e.shadow - r.value)
    FROM e JOIN r ON r.user_id = e.user_id AND r.k = e.k + 1)"""


@query("ema_warmup", f"WITH RECURSIVE {EMA_SQL} SELECT user_id, k, {s6('shadow')} AS shadow FROM e")
def ema_warmup(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    return ema.ema_warmup(events, ["user_id"], "event_id", "value").select(
        "user_id", "k", r6("shadow").alias("shadow")
    )


@query(
    "config_validate",
    """WITH r AS (SELECT o_orderkey, list_extract(['subs', 'sedd', 'd3pm', 'ar'], (o_custkey % 4)::INTEGER + 1) AS p,
    CASE WHEN o_orderstatus = 'O' THEN 1000 ELSE 0 END AS t, o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' AS i,
    o_orderpriority LIKE '2%' OR o_orderpriority LIKE '3%' AS c, o_orderpriority LIKE '4%' AS s FROM orders)
    SELECT o_orderkey, array_to_string(list_filter([CASE WHEN c AND i THEN 'one_variance_reduction' END,
    CASE WHEN p = 'sedd' AND (i OR c) THEN 'sedd_plain' END, CASE WHEN p = 'd3pm' AND t <= 0 THEN 'd3pm_discrete' END,
    CASE WHEN t > 0 AND p NOT IN ('d3pm', 'subs') THEN 'discrete_kinds' END,
    CASE WHEN s AND p <> 'd3pm' THEN 'subs_masking_d3pm' END], lambda v: v IS NOT NULL), ',') AS violations FROM r""",
)
def config_validate(spark: SparkSession, folder: str) -> DataFrame:
    rank = F.substring("o_orderpriority", 1, 1)
    kinds = F.array(*[F.lit(k) for k in ("subs", "sedd", "d3pm", "ar")])
    runs = table(spark, folder, "orders").select(
        "o_orderkey",
        F.get(kinds, (F.col("o_custkey") % 4).cast("int")).alias("parameterization"),
        F.when(F.col("o_orderstatus") == "O", 1000).otherwise(0).alias("T"),
        rank.isin("1", "2").alias("importance_sampling"),
        rank.isin("2", "3").alias("change_of_variables"),
        (rank == "4").alias("subs_masking"),
    )
    return config_violations(runs).select(
        "o_orderkey", F.array_join("violations", ",").alias("violations")
    )
