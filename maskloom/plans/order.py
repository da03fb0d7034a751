"""Splits, row order, shards, batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from maskloom.functions.rand import uniform
from maskloom.operators import permute as pm, splits as sp
from maskloom.operators.order import row_total
from maskloom.plans.registry import query, sql_u, table
from maskloom.plans.text import SQL_CORPUS, corpus_of
from maskloom.session import scratch_path

SEED, EPOCH, REPLICAS, BATCH = 5, 3, 7, 64


def orders(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select("o_orderkey")


@query(
    "split_tail",
    """SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) > count(*) OVER () - 150 THEN 'validation' ELSE 'train' END AS split
    FROM documents""",
)
def split_tail(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id")
    return sp.split_tail(docs, "doc_id", 150).select("doc_id", "split")


@query(
    "split_random_exact",
    f"""SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {sql_u(42, 'doc_id')}, doc_id) <= ceil(0.1 * (count(*) OVER ()))
    THEN 'validation' ELSE 'train' END AS split FROM documents""",
)
def split_random_exact(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id")
    return sp.split_random_exact(docs, "doc_id").select("doc_id", "split")


SPLIT_SQL = (
    f"d AS (SELECT doc_id, {SQL_CORPUS} AS corpus, CASE WHEN {sql_u('split', 'doc_id')} < 0.8 THEN 'train' "
    f"WHEN {sql_u('split', 'doc_id')} < 0.9 THEN 'validation' ELSE 'test' END AS split FROM documents)"
)


@query(
    "split_select",
    f"""WITH {SPLIT_SQL} SELECT doc_id, corpus, split FROM d
    WHERE corpus IN ('lambada', 'openwebtext-train', 'openwebtext-valid')
       OR split = CASE WHEN corpus IN ('text8', 'lm1b', 'ag_news') THEN 'test' ELSE 'validation' END""",
)
def split_select(spark: SparkSession, folder: str) -> DataFrame:
    u = uniform("split", "doc_id")
    label = F.when(u < 0.8, "train").when(u < 0.9, "validation").otherwise("test")
    docs = table(spark, folder, "documents").select(
        "doc_id", corpus_of(F.col("source")).alias("corpus"), label.alias("split")
    )
    return sp.split_select(docs, "valid")


SHUFFLE_SQL = (
    f"s AS (SELECT o_orderkey, row_number() OVER (ORDER BY {sql_u(SEED + EPOCH, 'o_orderkey')}, o_orderkey) - 1 AS rank, "
    "count(*) OVER () AS n FROM orders)"
)


@query("epoch_shuffle", f"WITH {SHUFFLE_SQL} SELECT o_orderkey, rank FROM s")
def epoch_shuffle(spark: SparkSession, folder: str) -> DataFrame:
    return sp.epoch_shuffle(orders(spark, folder), "o_orderkey", SEED, EPOCH).select("o_orderkey", "rank")


def shards(spark: SparkSession, folder: str, drop_last: bool) -> DataFrame:
    order = sp.epoch_shuffle(orders(spark, folder), "o_orderkey", SEED, EPOCH)
    rows = row_total(orders(spark, folder))
    return sp.shard(order, REPLICAS, drop_last, rows).select("o_orderkey", "replica", "position")


PAD_SQL = (
    SHUFFLE_SQL
    + f""", p AS (SELECT o_orderkey, unnest(range(rank, ceil(n / {REPLICAS})::BIGINT * {REPLICAS}, n)) AS place FROM s),
    sh AS (SELECT o_orderkey, (place % {REPLICAS})::INTEGER AS replica, place // {REPLICAS} AS position FROM p)"""
)


@query("shard_pad", f"WITH {PAD_SQL} SELECT o_orderkey, replica, position FROM sh")
def shard_pad(spark: SparkSession, folder: str) -> DataFrame:
    return shards(spark, folder, False)


@query(
    "shard_drop_last",
    f"""WITH {SHUFFLE_SQL} SELECT o_orderkey, (rank % {REPLICAS})::INTEGER AS replica, rank // {REPLICAS} AS position
    FROM s WHERE rank < n // {REPLICAS} * {REPLICAS}""",
)
def shard_drop_last(spark: SparkSession, folder: str) -> DataFrame:
    return shards(spark, folder, True)


@query(
    "resume_from_counter",
    f"WITH {PAD_SQL} SELECT o_orderkey, replica, position FROM sh WHERE position >= 96",
)
def resume_from_counter(spark: SparkSession, folder: str) -> DataFrame:
    return sp.resume(shards(spark, folder, False), 3 * 32)


def permuted_sql(place: str, n: str, seed: object) -> str:
    """The keyed permutation of ``permute.permuted``, step by step over its round keys."""
    keys = ", ".join("{" + ", ".join(f"'{c}': {v}::BIGINT" for c, v in zip("xoabc", (0, *key))) + "}" for key in pm.round_keys(seed))
    top = "greatest(s.x, t)"
    y = f"((({top} & {pm.PRIME}) * k.a + ({top} >> 31) * k.b + k.c) % {pm.PRIME})"
    other = f"(((k.o - s.x) % {n} + {n}) % {n})"
    swap = f"CASE WHEN (((({y} * {y} + k.c) % {pm.PRIME}) >> 9) & 1) = 1 THEN t ELSE s.x END".replace("t)", f"{other})").replace("THEN t", f"THEN {other}")
    first = f"{{'x': {place}, 'o': 0::BIGINT, 'a': 0::BIGINT, 'b': 0::BIGINT, 'c': 0::BIGINT}}"
    return f"list_reduce(list_concat([{first}], [{keys}]), lambda s, k: {{'x': {swap}, 'o': k.o, 'a': k.a, 'b': k.b, 'c': k.c}}).x"


ORDER_SQL = (
    "r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place, count(*) OVER () AS n FROM documents), "
    f"s AS (SELECT doc_id, {permuted_sql('place', 'n', f'{SEED}|{EPOCH}')} AS rank, n FROM r)"
)
#: positions that each replica has consumed, and positions of a folder of a written epoch
COUNTER, SPAN = 16, 4096


def document_ids(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id")


@query("epoch_order", f"WITH {ORDER_SQL} SELECT doc_id, rank FROM s")
def epoch_order(spark: SparkSession, folder: str) -> DataFrame:
    return pm.epoch_order(document_ids(spark, folder), "doc_id", SEED, EPOCH).select("doc_id", "rank")


def epoch_shards(spark: SparkSession, folder: str) -> DataFrame:
    rows = document_ids(spark, folder)
    order = pm.epoch_order(rows, "doc_id", SEED, EPOCH)
    return sp.shard(order, REPLICAS, False, row_total(rows)).select("doc_id", "replica", "position")


DEALT_SQL = PAD_SQL.replace(SHUFFLE_SQL, ORDER_SQL).replace("o_orderkey", "doc_id")


@query("epoch_order_shards", f"WITH {DEALT_SQL} SELECT doc_id, replica, position FROM sh")
def epoch_order_shards(spark: SparkSession, folder: str) -> DataFrame:
    return epoch_shards(spark, folder)


@query("resume_epoch_table", f"WITH {DEALT_SQL} SELECT doc_id, replica, position FROM sh WHERE position >= {COUNTER}")
def resume_epoch_table(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "epoch")
    pm.write_epoch(epoch_shards(spark, folder), path, SPAN)
    return pm.resumed(spark, path, COUNTER, SPAN).select("doc_id", "replica", "position")


@query(
    "batch_plan",
    """WITH g AS (SELECT source, count(*) AS global_batch, count(DISTINCT lang) AS eval_batch FROM documents GROUP BY source)
    SELECT source, global_batch, eval_batch, global_batch // 8 AS batch_size, global_batch // 8 * 8 AS effective,
    ceil(global_batch / 4)::BIGINT AS per_machine, global_batch // 8 * 8 = global_batch AS reaches_global,
    global_batch % 4 = 0 AS train_divides, eval_batch % 2 = 0 AS eval_divides FROM g""",
)
def batch_plan(spark: SparkSession, folder: str) -> DataFrame:
    sizes = table(spark, folder, "documents").groupBy("source").agg(
        F.count(F.lit(1)).alias("global_batch"), F.countDistinct("lang").alias("eval_batch")
    )
    return sp.batch_plan(sizes, "global_batch", "eval_batch", nodes=2, devices=2, accumulate=2)


@query(
    "assign_batches",
    f"""SELECT 'sequential' AS kind, o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // {BATCH} AS batch_id FROM orders
    UNION ALL SELECT 'shuffled', o_orderkey, (row_number() OVER (ORDER BY {sql_u(9, 'o_orderkey')}, o_orderkey) - 1) // {BATCH} FROM orders""",
)
def assign_batches(spark: SparkSession, folder: str) -> DataFrame:
    rows = orders(spark, folder)
    return (
        sp.assign_batches(rows, "o_orderkey", BATCH)
        .select(F.lit("sequential").alias("kind"), "o_orderkey", "batch_id")
        .unionByName(
            sp.assign_batches(rows, "o_orderkey", BATCH, seed=9).select(
                F.lit("shuffled").alias("kind"), "o_orderkey", "batch_id"
            )
        )
    )


@query(
    "limit_batches",
    f"""WITH b AS (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // {BATCH} AS batch_id, count(*) OVER () AS n FROM orders)
    SELECT 'share' AS kind, o_orderkey, batch_id FROM b WHERE batch_id < floor(0.5 * ceil(n / {BATCH}))
    UNION ALL SELECT 'sanity', o_orderkey, batch_id FROM b WHERE batch_id < 2""",
)
def limit_batches(spark: SparkSession, folder: str) -> DataFrame:
    batched = sp.assign_batches(orders(spark, folder), "o_orderkey", BATCH)
    parts = [
        sp.limit_batches(batched, BATCH, limit, row_total(orders(spark, folder))).select(F.lit(kind).alias("kind"), "o_orderkey", "batch_id")
        for kind, limit in (("share", 0.5), ("sanity", 2))
    ]
    return parts[0].unionByName(parts[1])
