"""Tokenizers, vocabularies and sequence building."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from maskloom.functions.rand import uniform
from maskloom.operators import bpe, sequence as sq, splits as sp, tokens as tk
from maskloom.operators.order import dealt
from maskloom.plans.registry import joined, query, sql_u, table
from maskloom.plans.text import WS

BLOCK = 128
CHARS_SQL = (
    "list_transform(list_filter(string_split(lower({0}), ''), lambda c: c <> ''), "
    "lambda c: CASE WHEN unicode(c) BETWEEN 97 AND 122 THEN unicode(c) - 89 WHEN c = ' ' THEN 34 ELSE 7 END)"
)
ENC = f"enc AS (SELECT doc_id, list_concat({CHARS_SQL.format('text')}, [3]) AS ids FROM documents)"
PACKED = (
    ENC
    + """, toks AS (SELECT doc_id, unnest(ids) AS id, generate_subscripts(ids, 1) AS i FROM enc),
    num AS (SELECT id, row_number() OVER (ORDER BY doc_id, i) - 1 AS g FROM toks),
    blocks AS (SELECT g // 126 AS block_id, list_concat([2], list_concat(list(id ORDER BY g), [3])) AS ids
               FROM num GROUP BY 1 HAVING count(*) = 126)"""
)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return dealt(table(spark, folder, "documents").select("doc_id", "text"), "doc_id")


def token_ids() -> Column:
    """Character ids with EOS."""
    return tk.append_eos(tk.char_encode(F.col("text")), tk.CHAR_EOS)


def packed_ids() -> Column:
    """The same for packing."""
    return tk.append_eos(tk.char_encode_inline(F.col("text")), tk.CHAR_EOS)


def token_count() -> Column:
    """Their number, without making them."""
    return F.length(F.lower("text")) + 1


def encoded(spark: SparkSession, folder: str) -> DataFrame:
    """Character ids with EOS per document."""
    return documents(spark, folder).withColumn("ids", token_ids())


def packed(spark: SparkSession, folder: str, block: int = BLOCK) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return sq.pack_blocks_global(
        docs, "doc_id", packed_ids(), block, tk.CHAR_BOS, tk.CHAR_EOS, length=token_count()
    )


@query("char_encode", f"SELECT doc_id, array_to_string({CHARS_SQL.format('text')}, ' ') AS ids FROM documents")
def char_encode(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select(
        "doc_id", joined(tk.char_encode(F.col("text"))).alias("ids")
    )


SQL_DECODE = (
    "array_to_string(list_transform({0}, lambda i: list_extract(["
    + ", ".join(f"'{token}'" for token in tk.CHAR_VOCAB)
    + "], i + 1)), '')"
)


@query("char_decode", f"WITH {ENC} SELECT doc_id, {SQL_DECODE.format('ids')} AS text FROM enc")
def char_decode(spark: SparkSession, folder: str) -> DataFrame:
    return encoded(spark, folder).select(
        "doc_id", tk.decode_ids(F.col("ids"), tk.CHAR_VOCAB).alias("text")
    )


@query(
    "decode_ids",
    f"WITH {PACKED} SELECT block_id, {SQL_DECODE.format('ids')} AS decoded FROM blocks",
)
def decode_ids(spark: SparkSession, folder: str) -> DataFrame:
    vocab = spark.createDataFrame(list(enumerate(tk.CHAR_VOCAB)), "id int, token string")
    blocks = packed(spark, folder).select("block_id", "input_ids")
    return tk.decode_table(blocks, vocab, "input_ids").select("block_id", "decoded")


WORDS_SQL = (
    f"words AS (SELECT word, count(*) AS n FROM (SELECT unnest(string_split_regex("
    f"strip_accents(lower(text)), '{WS}+')) AS word FROM documents) WHERE word <> '' GROUP BY word)"
)
SPECIALS_SQL = ", ".join(f"('{token}', {i})" for i, token in enumerate(tk.BPE_SPECIALS))
ALPHABET_SQL = (
    WORDS_SQL
    + f""", vocab AS (SELECT * FROM (VALUES {SPECIALS_SQL}) AS s(token, id)
    UNION ALL SELECT token, (row_number() OVER (ORDER BY unicode(token)) + 6)::INTEGER AS id
    FROM (SELECT DISTINCT unnest(string_split(word, '')) AS token FROM words))"""
)


def words(spark: SparkSession, folder: str) -> DataFrame:
    return tk.word_counts(documents(spark, folder))


@query("word_counts", f"WITH {WORDS_SQL} SELECT word, n FROM words")
def word_counts(spark: SparkSession, folder: str) -> DataFrame:
    return words(spark, folder)


@query("char_alphabet", f"WITH {ALPHABET_SQL} SELECT token, id FROM vocab")
def char_alphabet(spark: SparkSession, folder: str) -> DataFrame:
    return tk.char_alphabet(words(spark, folder))


@query(
    "pair_counts",
    f"""WITH {WORDS_SQL}, cells AS (SELECT word, n, unnest(range(1, length(word)::BIGINT)) AS i FROM words)
    SELECT substr(word, i, 1) AS left, substr(word, i + 1, 1) AS right, sum(n)::BIGINT AS n
    FROM cells GROUP BY 1, 2 HAVING sum(n) >= 2""",
)
def pair_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tk.pair_counts(words(spark, folder))


def merges_sql(vocab_size: int) -> str:
    """Greedy training as a recursive query. Its one row holds all words as strings of one
    code point per symbol, so that a merge is a replacement, and grows by a merge per step."""
    return f"""{ALPHABET_SQL},
    sym AS (SELECT word, n, string_agg(chr((id + 1)::INTEGER), '' ORDER BY i) AS s FROM (SELECT word, n,
      unnest(string_split(word, '')) AS token, generate_subscripts(string_split(word, ''), 1) AS i FROM words) JOIN vocab USING (token) GROUP BY word, n),
    st AS (SELECT 0 AS step, (SELECT list({{'word': word, 's': s, 'n': n}}) FROM sym) AS w, (SELECT list(token ORDER BY id) FROM vocab) AS tokens,
        NULL::VARCHAR AS pair, NULL::INTEGER AS new
      UNION ALL SELECT step + 1, list_transform(w, lambda x: {{'word': x.word, 's': replace(x.s, best.pair, chr((known + 1)::INTEGER)), 'n': x.n}}),
        CASE WHEN known < len(tokens) THEN tokens ELSE list_append(tokens, text) END, best.pair, known::INTEGER
      FROM (SELECT *, coalesce(list_position(tokens, text) - 1, len(tokens)) AS known FROM
        (SELECT st.*, b AS best, tokens[unicode(b.pair)] || tokens[unicode(b.pair[2:2])] AS text FROM st, LATERAL
          (SELECT {{'pair': pair, 'c': sum(n)}} AS b FROM (SELECT substr(x.s, i, 2) AS pair, x.n AS n FROM
            (SELECT unnest(st.w) AS x), LATERAL (SELECT unnest(range(1, length(x.s))) AS i)) GROUP BY pair ORDER BY sum(n) DESC, pair LIMIT 1) AS q
        WHERE len(tokens) < {vocab_size} AND b.c >= 2)))"""


def rounds_sql(vocab_size: int) -> str:
    """The same training with a step for all leading pairs that one merge at a time would take
    next: up to a pair that shares a symbol with an earlier one, other end to end, or to a
    doubled symbol or a text that is a token already. ``pairs`` and ``news`` are its merges."""
    return f"""{ALPHABET_SQL},
    sym AS (SELECT n, string_agg(chr((id + 1)::INTEGER), '' ORDER BY i) AS s FROM (SELECT word, n,
      unnest(string_split(word, '')) AS token, generate_subscripts(string_split(word, ''), 1) AS i FROM words) JOIN vocab USING (token) GROUP BY word, n),
    st AS (SELECT 0 AS step, (SELECT list({{'s': s, 'n': n}}) FROM sym WHERE length(s) > 1) AS w, (SELECT list(token ORDER BY id) FROM vocab) AS tokens,
        []::VARCHAR[] AS pairs, []::INTEGER[] AS news
      UNION ALL SELECT step + 1, list_filter(list_transform(w, lambda x: {{'s': list_reduce(
          list_prepend(x.s, list_transform(range(1, cut + 1), lambda k: t[k] || chr((ids[k] + 1)::INTEGER))),
          lambda s, m: replace(s, m[1:2], m[3:3])), 'n': x.n}}), lambda x: length(x.s) > 1),
        list_concat(tokens, list_filter(texts[1:cut], lambda text, k: ids[k] = len(tokens) + k - 1)), t[1:cut], ids[1:cut]
      FROM (SELECT *, (SELECT min(k) FROM (SELECT unnest(range(1, len(t) + 2)) AS k) WHERE k > len(t) OR len(tokens) + k - 1 >= {vocab_size}
            OR list_contains(list_transform(t[1:k - 1], lambda p: p[2:2]), t[k][1:1]) OR list_contains(list_transform(t[1:k - 1], lambda p: p[1:1]), t[k][2:2])
            OR (k > 1 AND (t[k - 1][1:1] = t[k - 1][2:2] OR ids[k - 1] <> len(tokens) + k - 2))) - 1 AS cut FROM
        (SELECT *, list_transform(texts, lambda text, k: (coalesce(list_position(tokens, text), list_position(texts[1:k - 1], text) + len(tokens), len(tokens) + k) - 1)::INTEGER) AS ids FROM
          (SELECT *, list_transform(t, lambda p: tokens[unicode(p)] || tokens[unicode(p[2:2])]) AS texts FROM (SELECT st.*, q.t FROM st, LATERAL
            (SELECT list(pair ORDER BY c DESC, pair) AS t FROM (SELECT pair, sum(n) AS c FROM (SELECT substr(x.s, i, 2) AS pair, x.n AS n FROM
              (SELECT unnest(st.w) AS x), LATERAL (SELECT unnest(range(1, length(x.s))) AS i)) GROUP BY pair HAVING sum(n) >= 2 ORDER BY c DESC, pair LIMIT 64)) AS q
            WHERE len(st.tokens) < {vocab_size} AND len(q.t) > 0)))))"""


#: entries of a vocabulary by default
VOCABULARY = 32000


@query(
    "bpe_train",
    f"""WITH RECURSIVE {rounds_sql(VOCABULARY)}, m AS (SELECT step, unnest(pairs) AS pair, unnest(news) AS new, generate_subscripts(pairs, 1) AS k FROM st),
    last AS (SELECT tokens FROM st ORDER BY step DESC LIMIT 1)
    SELECT (row_number() OVER (ORDER BY step, k) - 1)::INTEGER AS rank, (unicode(pair) - 1)::INTEGER AS "left", (unicode(pair[2:2]) - 1)::INTEGER AS "right",
    new AS merged, tokens[unicode(pair)] AS left_token, tokens[unicode(pair[2:2])] AS right_token FROM m, last""",
)
def bpe_train(spark: SparkSession, folder: str) -> DataFrame:
    model = bpe.bpe_train(words(spark, folder), vocab_size=VOCABULARY)
    vocab = model.vocab_table(spark)
    left = vocab.select(F.col("id").alias("left"), F.col("token").alias("left_token"))
    right = vocab.select(F.col("id").alias("right"), F.col("token").alias("right_token"))
    return model.merge_table(spark).join(left, "left").join(right, "right")


@query(
    "bpe_encode",
    f"""WITH RECURSIVE {merges_sql(200)}, done AS (SELECT unnest(w, recursive := true) FROM (SELECT w FROM st ORDER BY step DESC LIMIT 1)),
    d AS (SELECT doc_id, unnest(l) AS word, generate_subscripts(l, 1) AS i FROM
      (SELECT doc_id, string_split_regex(strip_accents(lower(text)), '{WS}+') AS l FROM documents)),
    e AS (SELECT doc_id, string_agg(s, '' ORDER BY i) AS s FROM d JOIN done USING (word) GROUP BY doc_id)
    SELECT doc_id, coalesce(array_to_string(list_transform(list_filter(string_split(s, ''), lambda c: c <> ''), lambda c: unicode(c) - 1), ' '), '') AS ids
    FROM documents LEFT JOIN e USING (doc_id)""",
)
def bpe_encode(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    model = bpe.bpe_train(tk.word_counts(docs), vocab_size=200)
    return bpe.bpe_encode(docs, model).select("doc_id", joined("ids").alias("ids"))


#: entries of the registered large models; a recursive query over all words is too slow for them
LARGE, LARGE_ENCODED = 8000, 4000


@query("bpe_train_large", None)
def bpe_train_large(spark: SparkSession, folder: str) -> DataFrame:
    """Merges of a vocabulary of production size."""
    return bpe.bpe_train(words(spark, folder), vocab_size=LARGE).merge_table(spark)


@query("bpe_encode_large", None)
def bpe_encode_large(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    model = bpe.bpe_train(tk.word_counts(docs), vocab_size=LARGE_ENCODED)
    return bpe.bpe_encode(docs, model).select("doc_id", joined("ids").alias("ids"))


@query("append_eos", f"WITH {ENC} SELECT doc_id, array_to_string(ids, ' ') AS ids FROM enc")
def append_eos(spark: SparkSession, folder: str) -> DataFrame:
    return encoded(spark, folder).select("doc_id", joined("ids").alias("ids"))


@query(
    "encode_padded",
    f"""WITH {ENC}, cut AS (SELECT doc_id, list_concat([0], list_concat(list_slice(ids, 1, 126), [1])) AS f FROM enc)
    SELECT doc_id, array_to_string(list_concat(f, list_transform(range(128 - len(f)), lambda x: 5)), ' ') AS input_ids,
    len(f)::INTEGER AS used, 0 AS types FROM cut""",
)
def encode_padded(spark: SparkSession, folder: str) -> DataFrame:
    out = encoded(spark, folder).select(
        "doc_id", tk.encode_padded(F.col("ids"), BLOCK, 0, 1, tk.CHAR_PAD).alias("e")
    )
    add = lambda acc, x: acc + x
    return out.select(
        "doc_id",
        joined("e.input_ids").alias("input_ids"),
        F.aggregate("e.attention_mask", F.lit(0), add).alias("used"),
        F.aggregate("e.token_type_ids", F.lit(0), add).alias("types"),
    )


@query("add_specials", f"WITH {ENC} SELECT doc_id, '0 ' || array_to_string(ids, ' ') || ' 1' AS ids FROM enc")
def add_specials(spark: SparkSession, folder: str) -> DataFrame:
    return encoded(spark, folder).select("doc_id", joined(tk.add_specials(F.col("ids"), 0, 1)).alias("ids"))


@query(
    "special_token_resolve",
    f"""WITH {ALPHABET_SQL}, s AS (SELECT max(id) FILTER (token = '[CLS]') AS cls, max(id) FILTER (token = '[SEP]') AS sep,
    max(id) FILTER (token = '[PAD]') AS pad, max(id) FILTER (token = '[MASK]') AS mask, count(*) AS n FROM vocab)
    SELECT 'token' AS rule, cls AS bos_id, sep AS eos_id, pad AS pad_id, mask AS mask_id, n AS vocab_size FROM s
    UNION ALL SELECT 'first_encoded', cls, cls, pad, mask, n FROM s""",
)
def special_token_resolve(spark: SparkSession, folder: str) -> DataFrame:
    vocab = tk.char_alphabet(words(spark, folder))
    both = [
        tk.special_token_resolve(vocab, rule).withColumn("rule", F.lit(rule))
        for rule in ("token", "first_encoded")
    ]
    return both[0].unionByName(both[1])


@query(
    "vocab_resize",
    f"""WITH {WORDS_SQL}, letters AS (SELECT token, (row_number() OVER (ORDER BY unicode(token)) - 1)::INTEGER AS id
    FROM (SELECT DISTINCT unnest(string_split(word, '')) AS token FROM words))
    SELECT token, id FROM letters UNION ALL SELECT '[MASK]', count(*)::INTEGER FROM letters""",
)
def vocab_resize(spark: SparkSession, folder: str) -> DataFrame:
    return tk.vocab_resize(tk.char_alphabet(words(spark, folder), specials=[]))


@query(
    "tokenizer_report",
    f"""WITH {ALPHABET_SQL}, {ENC}, trips AS (SELECT count(*) AS texts, sum(len(e.ids))::BIGINT AS tokens,
    count(*) FILTER (lower(d.text) || '[EOS]' <> {SQL_DECODE.format('e.ids')}) AS mismatches
    FROM enc e JOIN documents d USING (doc_id))
    SELECT 2 AS bos_id, 3 AS eos_id, 0 AS pad_id, 4 AS mask_id, (SELECT count(*) FROM vocab) AS vocab_size,
    texts, tokens, mismatches FROM trips""",
)
def tokenizer_report(spark: SparkSession, folder: str) -> DataFrame:
    trips = encoded(spark, folder).select(
        "ids",
        F.concat(F.lower("text"), F.lit("[EOS]")).alias("wanted"),
        tk.decode_ids(F.col("ids"), tk.CHAR_VOCAB).alias("got"),
    )
    vocab = tk.char_alphabet(words(spark, folder))
    return tk.tokenizer_report(trips, vocab, "wanted", "ids", "got")


@query(
    "pack_blocks",
    "WITH "
    + ENC
    + """, toks AS (SELECT doc_id, unnest(ids) AS id, generate_subscripts(ids, 1) AS i FROM enc),
    docs AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 100 AS group_id FROM documents),
    num AS (SELECT group_id, id, row_number() OVER (PARTITION BY group_id ORDER BY doc_id, i) - 1 AS g
            FROM toks JOIN docs USING (doc_id))
    SELECT group_id, g // 126 AS block_id, '2 ' || array_to_string(list(id ORDER BY g), ' ') || ' 3' AS input_ids
    FROM num GROUP BY 1, 2 HAVING count(*) = 126""",
)
def pack_blocks(spark: SparkSession, folder: str) -> DataFrame:
    out = sq.pack_blocks(
        table(spark, folder, "documents").select("doc_id", "text"),
        "doc_id",
        packed_ids(),
        BLOCK,
        tk.CHAR_BOS,
        tk.CHAR_EOS,
        group_size=100,
        length=token_count(),
    )
    return out.select("group_id", "block_id", joined("input_ids").alias("input_ids"))


@query(
    "pack_blocks_global",
    f"WITH {PACKED} SELECT block_id, array_to_string(ids, ' ') AS input_ids FROM blocks",
)
def pack_blocks_global(spark: SparkSession, folder: str) -> DataFrame:
    return packed(spark, folder).select("block_id", joined("input_ids").alias("input_ids"))


@query(
    "attention_mask",
    f"WITH {PACKED} SELECT block_id, array_to_string(list_transform(ids, lambda x: 1), ' ') AS attention_mask FROM blocks",
)
def attention_mask(spark: SparkSession, folder: str) -> DataFrame:
    return packed(spark, folder).select("block_id", joined("attention_mask").alias("attention_mask"))


@query(
    "crop_window",
    f"""WITH {PACKED}, s AS (SELECT block_id, ids, floor({sql_u(7, '(block_id // 8)')} * 64)::INTEGER AS st FROM blocks)
    SELECT block_id, st AS start, '2 ' || array_to_string(list_slice(ids, st + 2, st + 64), ' ') AS input_ids,
    array_to_string(list_slice(ids, st + 2, st + 64), ' ') || ' 3' AS output_ids FROM s""",
)
def crop_window(spark: SparkSession, folder: str) -> DataFrame:
    batch = F.floor(F.col("block_id") / F.lit(8)).cast("long")
    start = F.floor(uniform(7, batch) * 64).cast("int")
    blocks = packed(spark, folder).select("block_id", F.col("input_ids").alias("ids"), start.alias("start"))
    out = sq.crop_window(blocks, "ids", F.col("start"), 64, tk.CHAR_BOS, tk.CHAR_EOS)
    return out.select(
        "block_id", "start", joined("input_ids").alias("input_ids"), joined("output_ids").alias("output_ids")
    )


@query(
    "shift_ar",
    f"""WITH {PACKED} SELECT block_id, array_to_string(list_slice(ids, 1, 127), ' ') AS input_ids,
    array_to_string(list_slice(ids, 2, 128), ' ') AS target_ids, 127 AS mask_size FROM blocks""",
)
def shift_ar(spark: SparkSession, folder: str) -> DataFrame:
    out = packed(spark, folder).select(
        "block_id", sq.shift_ar(F.col("input_ids"), F.col("attention_mask")).alias("s")
    )
    return out.select(
        "block_id",
        joined("s.input_ids").alias("input_ids"),
        joined("s.target_ids").alias("target_ids"),
        F.size("s.target_mask").alias("mask_size"),
    )


@query(
    "context_split",
    f"""WITH {ENC}, w AS (SELECT doc_id, ids, unnest(range((len(ids) - 1) // 256 + 1)) AS k FROM enc)
    SELECT doc_id, k::INTEGER AS window_id, array_to_string(list_slice(ids, k * 256 + 1, k * 256 + 256), ' ') AS ids FROM w""",
)
def context_split(spark: SparkSession, folder: str) -> DataFrame:
    docs = encoded(spark, folder).select("doc_id", "ids")
    return sq.context_split(docs, "ids", 256).select("doc_id", "window_id", joined("ids").alias("ids"))


@query(
    "eval_batches",
    """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS rank, count(*) OVER () AS n FROM orders)
    SELECT 'keep' AS rule, o_orderkey, rank // 64 AS batch_id FROM r
    UNION ALL SELECT 'drop', o_orderkey, rank // 64 FROM r WHERE rank < (n // least(64, n)) * least(64, n)""",
)
def eval_batches(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey")
    parts = [
        sp.eval_batches(orders, "o_orderkey", 64, drop).select(
            F.lit(rule).alias("rule"), "o_orderkey", "batch_id"
        )
        for rule, drop in (("keep", False), ("drop", True))
    ]
    return parts[0].unionByName(parts[1])


@query(
    "length_to_eos",
    f"""WITH {PACKED} SELECT block_id, CASE WHEN list_position(list_slice(ids, 2, 128), 3) > 0
    THEN list_position(list_slice(ids, 2, 128), 3) - 1 ELSE 127 END::BIGINT AS length FROM blocks""",
)
def length_to_eos(spark: SparkSession, folder: str) -> DataFrame:
    return packed(spark, folder).select(
        "block_id", sq.length_to_eos(F.col("input_ids"), tk.CHAR_EOS).alias("length")
    )


@query(
    "stride_prefixes",
    f"""WITH s AS (SELECT conv_id, turn, {CHARS_SQL.format('text')} AS ids FROM conversations),
    p AS (SELECT conv_id, row_number() OVER w AS strides, flatten(list(ids) OVER w) AS ids FROM s
          WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))
    SELECT conv_id, strides::INTEGER AS strides, array_to_string(ids, ' ') AS ids FROM p WHERE strides >= 2""",
)
def stride_prefixes(spark: SparkSession, folder: str) -> DataFrame:
    strides = table(spark, folder, "conversations").select(
        "conv_id", "turn", tk.char_encode(F.col("text")).alias("ids")
    )
    return sq.stride_prefixes(strides, "conv_id", "turn", "ids").select(
        "conv_id", "strides", joined("ids").alias("ids")
    )


@query(
    "first_eos_mask",
    f"""WITH {PACKED}, p AS (SELECT block_id, ids, list_position(ids, 3) AS f FROM blocks)
    SELECT block_id, array_to_string(list_transform(ids, lambda x, i: CASE WHEN x <> 3 OR i = f THEN 1 ELSE 0 END), '') AS mask,
    array_to_string(list_transform(ids, lambda x, i: CASE WHEN i <= f THEN 1 ELSE 0 END), '') AS until_first FROM p""",
)
def first_eos_mask(spark: SparkSession, folder: str) -> DataFrame:
    def text(mask):
        return F.array_join(mask.cast("array<string>"), "")

    ids = F.col("input_ids")
    return packed(spark, folder).select(
        "block_id",
        text(sq.first_eos_mask(ids, tk.CHAR_EOS)).alias("mask"),
        text(sq.first_eos_mask(ids, tk.CHAR_EOS, until_first_eos=True)).alias("until_first"),
    )
