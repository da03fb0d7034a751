"""Sources, catalog, cache and sinks, all fed from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from maskloom.operators import metrics as mt, sequence as sq, tokens as tk
from maskloom.plans.metrics import LOSS_SQL, loss_rows
from maskloom.plans.registry import joined, query, r6, s6, table
from maskloom.plans.text import SQL_CORPUS, corpus_of, sql_strip
from maskloom.plans.tokens import CHARS_SQL, ENC, PACKED, SQL_DECODE, encoded, packed
from maskloom.session import scratch_path
from maskloom.sources import corpora, strings

TRAIN_END, VALID_END, CHUNK = 300_000, 400_000, 256


@query(
    "src_text_lines",
    f"""SELECT text FROM (SELECT {sql_strip('line')} AS text FROM
    (SELECT unnest(string_split_regex(text, '\\r\\n|\\n|\\r')) AS line FROM documents)) WHERE text <> ''""",
)
def src_text_lines(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "lines")
    table(spark, folder, "documents").select("text").write.text(path)
    return corpora.read_text_lines(spark, path, "*.txt").select("text")


@query("src_jsonl", "SELECT (props->>'$.k')::BIGINT AS k FROM events")
def src_jsonl(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "jsonl")
    table(spark, folder, "events").select("props").write.text(path)
    return corpora.read_jsonl(spark, path, "k long")


def _ranges_sql(train_size: int, text: str = "text") -> str:
    return f"""c AS (SELECT doc_id, unnest(string_split({text}, '')) AS ch, generate_subscripts(string_split({text}, ''), 1) AS i FROM documents),
    g AS (SELECT ch, row_number() OVER (ORDER BY doc_id, i) - 1 AS g FROM c),
    s AS (SELECT ch, g, CASE WHEN g < {TRAIN_END} THEN 'train' WHEN g < {VALID_END} THEN 'validation' ELSE 'test' END AS split FROM g),
    o AS (SELECT ch, g, split, CASE split WHEN 'train' THEN 0 WHEN 'validation' THEN {TRAIN_END} ELSE {VALID_END} END AS low,
          CASE split WHEN 'train' THEN {train_size} ELSE {CHUNK} END AS width FROM s)
    SELECT split, (g - low) // width AS chunk_id, string_agg(ch, '' ORDER BY g) AS text FROM o
    GROUP BY split, width, 2"""


@query("src_char_chunks", f"WITH {_ranges_sql(CHUNK)} HAVING count(*) = width")
def src_char_chunks(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return sq.char_chunks(docs, "doc_id", "text", CHUNK, TRAIN_END, VALID_END)


@query("chunk_chars", f"WITH {_ranges_sql(2 * CHUNK)}")
def chunk_chars(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return sq.char_chunks(
        docs, "doc_id", "text", CHUNK, TRAIN_END, VALID_END, train_size=2 * CHUNK, drop_last=False
    )


@query("src_string_file", f"WITH {_ranges_sql(CHUNK, "text || ' '")}")
def src_string_file(spark: SparkSession, folder: str) -> DataFrame:
    """The texts as one string in files, each text closed by a blank, read by byte ranges."""
    path = scratch_path(spark, "string")
    table(spark, folder, "documents").orderBy("doc_id").select("text").write.text(path, lineSep=" ")
    pieces = strings.with_places(strings.read_string(spark, path))
    return sq.char_chunks(
        pieces, "piece", "text", CHUNK, TRAIN_END, VALID_END, drop_last=False, before="before"
    )


# written out by hand, so that the comparison does not follow the catalog
CATALOG_SQL = """cat(name, path, config, text_column, drops, holdout, detokenizer, wrap, streaming, validated_on) AS (VALUES
    ('wikitext103', 'wikitext', 'wikitext-103-raw-v1', 'text', 'text', 'validation', 'wikitext', true, false, NULL),
    ('wikitext2', 'wikitext', 'wikitext-2-raw-v1', 'text', 'text', 'validation', 'wikitext', true, false, NULL),
    ('ptb', 'ptb_text_only', NULL, 'sentence', 'sentence', 'validation', 'ptb', true, false, NULL),
    ('lambada', 'lambada_test.jsonl', NULL, 'text', 'text', 'validation', 'lambada', true, false, NULL),
    ('text8', 'text8', NULL, 'text', 'text', 'test', NULL, true, false, NULL),
    ('text8-crop', 'text8', NULL, 'text', 'text', 'validation', NULL, true, false, 'text8'),
    ('lm1b', 'lm1b', NULL, 'text', 'text', 'test', 'lm1b', false, false, NULL),
    ('lm1b-gpt2', 'lm1b', NULL, 'text', 'text', 'test', 'lm1b', true, false, NULL),
    ('lm1b-streaming', 'lm1b', NULL, 'text', 'text', 'test', 'lm1b', false, true, NULL),
    ('openwebtext', 'openwebtext', NULL, 'text', 'text', 'validation', NULL, true, false, 'wikitext103'),
    ('openwebtext-streaming', 'openwebtext', NULL, 'text', 'text', 'validation', NULL, true, true, 'wikitext103'),
    ('openwebtext-train', 'openwebtext', NULL, 'text', 'text', 'validation', NULL, true, false, 'openwebtext-valid'),
    ('openwebtext-valid', 'openwebtext', NULL, 'text', 'text', 'validation', NULL, true, false, NULL),
    ('scientific_papers_arxiv', 'scientific_papers', 'arxiv', 'article', 'article,abstract,section_names', 'validation', 'scientific_papers', true, false, NULL),
    ('scientific_papers_pubmed', 'scientific_papers', 'pubmed', 'article', 'article,abstract,section_names', 'validation', 'scientific_papers', true, false, NULL),
    ('ag_news', 'ag_news', NULL, 'text', 'text,label', 'test', NULL, true, false, NULL),
    ('babylm', '*.train', NULL, 'text', 'text', 'validation', NULL, true, false, NULL))"""


@query(
    "corpus_catalog",
    f"""WITH {CATALOG_SQL}, d AS (SELECT doc_id, {SQL_CORPUS} AS corpus FROM documents)
    SELECT doc_id, corpus, coalesce(path, corpus) AS path, config, coalesce(text_column, 'text') AS text_column,
    coalesce(drops, 'text') AS drop, coalesce(holdout, 'validation') AS holdout, detokenizer, coalesce(wrap, true) AS wrap,
    coalesce(streaming, false) AS streaming, coalesce(validated_on, corpus) AS validated_on
    FROM d LEFT JOIN cat ON name = corpus""",
)
def corpus_catalog(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", corpus_of(F.col("source")).alias("corpus"))
    return corpora.describe(docs).select(
        "doc_id", "corpus", "path", "config", "text_column", "drop", "holdout", "detokenizer", "wrap", "streaming", "validated_on"
    )


@query(
    "project_text",
    f"""SELECT doc_id, corpus, CASE WHEN corpus = 'ptb' THEN 'S ' || text WHEN corpus LIKE '%scientific_papers%' THEN 'A ' || text
    ELSE text END AS text FROM (SELECT doc_id, text, {SQL_CORPUS} AS corpus FROM documents)""",
)
def project_text(spark: SparkSession, folder: str) -> DataFrame:
    columns = {
        "text": F.col("text"),
        "sentence": F.concat(F.lit("S "), F.col("text")),
        "article": F.concat(F.lit("A "), F.col("text")),
    }
    docs = table(spark, folder, "documents").withColumn("corpus", corpus_of(F.col("source")))
    return docs.select(
        "doc_id", "corpus", corpora.project_text(F.col("corpus"), columns).alias("text")
    )


@query(
    "drop_source_columns",
    f"""SELECT doc_id, lang, source, n_chars, len({CHARS_SQL.format('text')})::INTEGER AS n FROM documents""",
)
def drop_source_columns(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").withColumn("label", F.length("lang"))
    coded = docs.withColumn("n", F.size(tk.char_encode(F.col("text"))))
    return corpora.drop_source_columns(coded, "ag_news")


@query("dataset_cache", f"WITH {ENC} SELECT doc_id, array_to_string(ids, ' ') AS ids FROM enc")
def dataset_cache(spark: SparkSession, folder: str) -> DataFrame:
    where = scratch_path(spark, "cache")
    source = corpora.content_of(spark, f"{folder}/documents.parquet")
    name = corpora.cache_name("documents", "train", 128, True, "characters", source)

    def build() -> DataFrame:
        return encoded(spark, folder).select("doc_id", "ids")

    corpora.cached(spark, where, name, build)
    again = corpora.cached(spark, where, name, build)
    return again.select("doc_id", joined("ids").alias("ids"))


@query(
    "sink_samples",
    """SELECT 500::BIGINT AS global_step, text AS "Generated Samples" FROM conversations
    WHERE role = 'assistant' ORDER BY conv_id * 1000 + turn LIMIT 2""",
)
def sink_samples(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "samples")
    samples = table(spark, folder, "conversations").where("role = 'assistant'")
    keyed = samples.withColumn("sample_id", F.col("conv_id") * 1000 + F.col("turn"))
    corpora.sink_samples(keyed, "sample_id", "text", 500).write.parquet(path)
    return spark.read.parquet(path)


@query(
    "sink_metrics",
    f"""WITH {LOSS_SQL}, m AS (SELECT split, epoch, sum(nll * mask) / sum(mask) AS v FROM x WHERE NOT isnan(nll) GROUP BY split, epoch)
    SELECT split, epoch, {s6('v')} AS nll, {s6('v / ln(2)')} AS bpd, {s6('exp(v)')} AS ppl FROM m""",
)
def sink_metrics(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "metrics")
    rows = mt.metrics(loss_rows(spark, folder), "nll", "mask", ["split", "epoch"])
    mt.sink_metrics(rows, path)
    return spark.read.parquet(path).select(
        "split", "epoch", r6("nll").alias("nll"), r6("bpd").alias("bpd"), r6("ppl").alias("ppl")
    )


@query(
    "preview_batch",
    f"""WITH {PACKED}, f AS (SELECT * FROM blocks ORDER BY block_id LIMIT 1)
    SELECT block_id, len(ids)::INTEGER AS length, {SQL_DECODE.format('list_slice(ids, 1, 64)')} AS first_text,
    {SQL_DECODE.format('list_slice(ids, 65, 128)')} AS last_text FROM f""",
)
def preview_batch(spark: SparkSession, folder: str) -> DataFrame:
    out = corpora.preview_batch(packed(spark, folder), "block_id", "input_ids")
    return out.select(
        "block_id",
        "length",
        tk.decode_ids(F.col("first_ids"), tk.CHAR_VOCAB).alias("first_text"),
        tk.decode_ids(F.col("last_ids"), tk.CHAR_VOCAB).alias("last_text"),
    )
