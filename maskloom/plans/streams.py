"""Streams over the given tables, run to the end of their input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from maskloom.functions.text import detok_for
from maskloom.operators import tokens as tk
from maskloom.plans.metrics import EMA_SQL
from maskloom.plans.registry import joined, joined_batch, query, r6, s6, table
from maskloom.plans.text import SPACED, SQL_CORPUS, corpus_of, sql_lambada, sql_lm1b, sql_ptb, sql_wikitext
from maskloom.plans.tokens import BLOCK, CHARS_SQL, PACKED, packed_ids, token_count
from maskloom.session import scratch_path
from maskloom.streaming import jobs


PARTS = 4
#: a part is written as so many rows a file, at most a file per shuffle partition
ROWS_PER_FILE = 2000


def stream(df: DataFrame, key: str, path: str) -> DataFrame:
    """A table as a stream of ``PARTS`` micro-batches in key order, so that state is carried.

    The parts are written one after the other, as files would arrive, each in the same number
    of files; a micro-batch reads the files of one part at a time, and in parallel.
    """
    spark = df.sparkSession
    row = df.select(F.count(F.lit(1)).alias("n"), F.percentile_approx(key, [i / PARTS for i in range(1, PARTS)]).alias("cuts")).first()
    cuts = row["cuts"] or []
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = max(1, min(tasks, row["n"] // PARTS // ROWS_PER_FILE))
    for part in range(PARTS):
        # plain bounds, by which Parquet leaves out what lies in other parts
        inside = F.lit(bool(cuts) or not part)
        if part and cuts:
            inside = F.col(key) > F.lit(cuts[part - 1])
        if part < len(cuts):
            inside &= F.col(key) <= F.lit(cuts[part])
        rows = df.where(inside if part else F.col(key).isNull() | inside)
        rows = rows.coalesce(1) if files == 1 else rows.repartition(files)
        rows.write.parquet(f"{path}/in/{part}")
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files)
    return source.parquet(f"{path}/in/*")


def finished(df: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Write a stream to files until its input is used up, then read them."""
    running = (
        df.writeStream.format("parquet")
        .option("compression", "zstd")
        .outputMode(mode)
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start(f"{path}/data")
    )
    running.awaitTermination()
    return df.sparkSession.read.parquet(f"{path}/data")


@query(
    "stream_tokenize",
    f"""WITH d AS (SELECT doc_id, {SQL_CORPUS} AS corpus, {SPACED} AS t FROM documents),
    x AS (SELECT doc_id, CASE WHEN corpus LIKE 'wikitext%' THEN {sql_wikitext('t')} WHEN corpus = 'ptb' THEN {sql_ptb('t')}
        WHEN corpus = 'lm1b' THEN {sql_lm1b('t')} WHEN corpus = 'lambada' THEN {sql_lambada('t')}
        WHEN corpus LIKE 'scientific_papers%' THEN {sql_lm1b(sql_wikitext('t'))} ELSE t END AS text FROM d)
    SELECT doc_id, array_to_string(list_concat({CHARS_SQL.format('text')}, [3]), ' ') AS ids FROM x""",
)
def stream_tokenize(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "stream-tokenize")
    docs = stream(table(spark, folder, "documents").select("doc_id", "source", "text"), "doc_id", path).select(
        "doc_id",
        corpus_of(F.col("source")).alias("corpus"),
        F.regexp_replace("text", r"[.,:;!?()\[\]]", " $0 ").alias("text"),
    )
    coded = jobs.stream_tokenize(docs, "doc_id", "text", tk.CHAR_EOS, corpus="corpus")
    # a text costs a fraction of an array to write and to read
    return finished(coded.select("doc_id", joined_batch("ids").alias("ids")), path)


@query("stream_pack", f"WITH {PACKED} SELECT block_id, array_to_string(ids, ' ') AS input_ids FROM blocks")
def stream_pack(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "stream-pack")
    docs = stream(table(spark, folder, "documents").select("doc_id", "text"), "doc_id", path)
    jobs.stream_pack(
        docs, "doc_id", packed_ids(), BLOCK, path, f"{path}/checkpoint", length=token_count()
    ).awaitTermination()
    blocks = jobs.packed_blocks(spark, path, BLOCK, tk.CHAR_BOS, tk.CHAR_EOS)
    return blocks.select("block_id", joined("input_ids").alias("input_ids"))


INGEST_SQL = f"""x AS (SELECT doc_id, source, CASE WHEN corpus LIKE 'wikitext%' THEN {sql_wikitext('t')} WHEN corpus = 'ptb' THEN {sql_ptb('t')}
        WHEN corpus = 'lm1b' THEN {sql_lm1b('t')} WHEN corpus = 'lambada' THEN {sql_lambada('t')}
        WHEN corpus LIKE 'scientific_papers%' THEN {sql_lm1b(sql_wikitext('t'))} ELSE t END AS text
      FROM (SELECT doc_id, source, {SQL_CORPUS} AS corpus, {SPACED} AS t FROM documents)),
    enc AS (SELECT doc_id, source, list_concat({CHARS_SQL.format('text')}, [3]) AS ids FROM x),
    toks AS (SELECT doc_id, source, unnest(ids) AS id, generate_subscripts(ids, 1) AS i FROM enc),
    num AS (SELECT source, id, row_number() OVER (PARTITION BY source ORDER BY doc_id, i) - 1 AS g FROM toks)"""


@query(
    "stream_ingest",
    f"""WITH {INGEST_SQL} SELECT source, g // 126 AS block_id, '2 ' || array_to_string(list(id ORDER BY g), ' ') || ' 3' AS input_ids
    FROM num GROUP BY 1, 2 HAVING count(*) = 126""",
)
def stream_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """Detokenize, encode and pack a stream, with a remainder for each source."""
    path = scratch_path(spark, "stream-ingest")
    docs = stream(table(spark, folder, "documents").select("doc_id", "source", "text"), "doc_id", path)
    spaced = F.regexp_replace("text", r"[.,:;!?()\[\]]", " $0 ")
    # the text travels, ids are made behind the exchange
    plain = docs.select("doc_id", "source", detok_for(corpus_of(F.col("source")), spaced).alias("text"))
    jobs.stream_pack_groups(
        plain, "source", "doc_id", packed_ids(), BLOCK, path, f"{path}/checkpoint", length=token_count()
    ).awaitTermination()
    done = jobs.packed_blocks(spark, path, BLOCK, tk.CHAR_BOS, tk.CHAR_EOS, by="source")
    return done.select("source", "block_id", joined("input_ids").alias("input_ids"))


@query(
    "stream_metrics",
    f"""WITH m AS (SELECT date_trunc('day', ts) AS epoch, sum(value * mask) / sum(mask) AS v FROM
    (SELECT ts, value / 10 AS value, CASE WHEN event_type = 'view' THEN 0 ELSE 1 END AS mask FROM events) GROUP BY 1)
    SELECT epoch, {s6('v')} AS nll, {s6('v / ln(2)')} AS bpd, {s6('exp(v)')} AS ppl FROM m""",
)
def stream_metrics(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "stream-metrics")
    rows = stream(table(spark, folder, "events").select("ts", "value", "event_type"), "ts", path).select(
        # the zone-less time is UTC whatever the session's zone is
        F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("ts")).cast("timestamp").alias("ts"),
        (F.col("value") / 10).alias("nll"),
        F.when(F.col("event_type") == "view", 0).otherwise(1).alias("mask"),
    )
    jobs.run_metrics(
        jobs.stream_metrics(rows, "nll", "mask", "ts", "1 day", "1 day"), path, f"{path}/checkpoint"
    ).awaitTermination()
    return jobs.latest_metrics(spark, path).select(
        F.convert_timezone(None, F.lit("UTC"), F.col("epoch").cast("timestamp_ntz")).alias("epoch"),
        r6("nll").alias("nll"),
        r6("bpd").alias("bpd"),
        r6("ppl").alias("ppl"),
    )


@query("stream_ema", f"WITH RECURSIVE {EMA_SQL} SELECT user_id, k, {s6('shadow')} AS shadow FROM e")
def stream_ema(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "stream-ema")
    rows = stream(table(spark, folder, "events").select("user_id", "event_id", "value"), "event_id", path)
    jobs.stream_ema(
        rows, ["user_id"], "event_id", "value", path, f"{path}/checkpoint"
    ).awaitTermination()
    series = spark.read.parquet(f"{path}/series")
    return series.select("user_id", "k", r6("shadow").alias("shadow"))
