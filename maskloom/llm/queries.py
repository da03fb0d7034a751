"""The registered queries of the subpackage, one per operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from maskloom.llm import chat, decontaminate, html, jaccard, language, packing, periods, quality, search, sharding, substrings, suffixes, urls
from maskloom.llm.common import saved

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

URL_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
VOCABULARY = "byte_bpe_50k.tiktoken"


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_best_fit_packing")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    added = packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = packing.cut(
        docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, 1024, 2, payload="crc32", added_ids=added
    )
    return packing.pack(pieces, 1024)


# words of a text, as the operators read them
WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
LOWER = f"translate({{0}}, '{urls.UPPER}', '{urls.LOWER}')"

JACCARD_SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format(LOWER.format("coalesce(text, '')"))} AS w FROM documents),
  sh AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN w ELSE list_slice(w, k, k + 3) END AS s FROM
    (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
  n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
  both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
  links AS (SELECT x, y FROM both_ JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * o >= 85 * (nx.n + ny.n - o)),
  reach AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT y, r FROM reach JOIN links ON x = reach.doc_id)
  SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(r) AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN reach USING (doc_id) GROUP BY ALL"""


@query("op2_ngram_jaccard_join", JACCARD_SQL)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return jaccard.classes(docs, "doc_id", "text", 4, 85).select("doc_id", "n_shingles", "component_id")


@query("op3_hash_ring_sharding")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return sharding.assign(docs, 16).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query("op4_language_id")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    trees = language.fit(docs.where(~language.held_out("doc_id")), "lang", "text", "doc_id")
    return language.predict(docs.select("doc_id", "text"), trees).select(
        "doc_id", language.held_out("doc_id").alias("held_out"), "lang_pred", "score"
    )


REPEATS_SQL = f"""WITH d AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
  win AS (SELECT doc_id, k, list_slice(w, k, k + 34) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS k FROM d)),
  rep AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
  gone AS (SELECT DISTINCT doc_id, k + j AS i, true AS cut FROM win JOIN rep USING (s), range(0, 35) AS t(j)),
  cells AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
  kept AS (SELECT doc_id, count(cut) AS n, string_agg(x, ' ' ORDER BY i) FILTER (WHERE cut IS NULL) AS t FROM cells LEFT JOIN gone USING (doc_id, i) GROUP BY doc_id)
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""


@query("op5_substring_dedup", REPEATS_SQL)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return substrings.repeated_words(docs, window=35, first=18, output="sha256").select(
        "doc_id", "n_words", "n_removed", "kept_sha256"
    )


@query("op6_benchmark_decontamination")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def _quantiles_sql(name: str, by: str, source: str) -> str:
    picked = ", ".join(f"min(CASE WHEN seen >= ceil(whole * {share}) THEN v END) AS {q}" for q, share in quality.QUANTILES.items())
    return f"""{name} AS (SELECT {by} feature, max(whole) AS n, {picked} FROM
    (SELECT *, CASE WHEN bucket IS NULL THEN 0 ELSE pow({quality.GAMMA!r}::DOUBLE, bucket) * 2 / (1 + {quality.GAMMA!r}::DOUBLE) END AS v,
      sum(n) OVER (PARTITION BY {by} feature ORDER BY bucket NULLS FIRST) AS seen, sum(n) OVER (PARTITION BY {by} feature) AS whole
     FROM (SELECT {by} feature, bucket, sum(n) AS n FROM {source} GROUP BY ALL)) GROUP BY ALL)"""


_NEAR = ", ".join(f"CASE WHEN a.n >= {quality.LEAST_ROWS} THEN a.{q} WHEN b.n >= {quality.LEAST_ROWS} THEN b.{q} ELSE c.{q} END AS {q}" for q in quality.QUANTILES)
_WIDE = ", ".join(f"CASE WHEN b.n >= {quality.LEAST_ROWS} THEN b.{q} ELSE c.{q} END AS wide_{q}" for q in quality.QUANTILES)


def _fence_sql(feature: str) -> str:
    low, high = quality.TAILS[feature]
    own, broad = f"({high} + {quality.TAIL_REACH} * ({high} - {low}))", f"(wide_{high} + {quality.TAIL_REACH} * (wide_{high} - wide_{low}))"
    return f"max(CASE WHEN {low} <= {broad} THEN least({own}, {broad}) ELSE {own} END) FILTER (feature = '{feature}') AS high_{feature}"


def _within_sql(feature: str) -> str:
    unit, total = quality.UNITS[feature]
    return f"{feature} <= greatest(high_{feature} * {quality.GAMMA!r}::DOUBLE, {unit} / greatest({total}, 1))"


_SPREAD = "greatest(q75 - q25, wide_q75 - wide_q25)"

QUALITY_SQL = f"""WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
  tri AS (SELECT doc_id, k, list_slice(w, k, k + 2) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS k FROM d)),
  twice AS (SELECT doc_id, s FROM tri GROUP BY ALL HAVING count(*) > 1),
  hit AS (SELECT doc_id, count(DISTINCT k + j) AS n FROM tri JOIN twice USING (doc_id, s), range(0, 3) AS t(j) GROUP BY doc_id),
  l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
  m AS (SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(hit.n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines FROM d JOIN l USING (doc_id) LEFT JOIN hit USING (doc_id)),
  f AS (SELECT *, n_symbols / greatest(word_chars, 1) AS symbols, n_dup_lines / greatest(n_lines, 1) AS lines,
    n_repeat_words / greatest(n_words, 1) AS repeats, word_chars / greatest(n_words, 1) AS length FROM m),
  sk AS (SELECT lang, source, feature, CASE WHEN v > 0 THEN ceil(ln(v) / ln({quality.GAMMA!r}::DOUBLE)) END AS bucket, count(*) AS n FROM
    (UNPIVOT (SELECT lang, source, symbols, lines, repeats, length FROM f WHERE n_words >= 50 AND 100 * n_repeat_words <= 50 * n_words)
      ON symbols, lines, repeats, length INTO NAME feature VALUE v) GROUP BY ALL),
  {_quantiles_sql('a', 'lang, source,', 'sk')}, {_quantiles_sql('b', 'lang,', 'sk')}, {_quantiles_sql('c', '', 'sk')},
  p AS (SELECT a.lang, a.source, a.feature, {_NEAR}, {_WIDE}
    FROM a JOIN b ON a.lang IS NOT DISTINCT FROM b.lang AND a.feature = b.feature JOIN c ON a.feature = c.feature),
  g AS (SELECT lang, source, {', '.join(_fence_sql(k) for k in quality.TAILS)},
    max(q75 + {quality.REACH} * {_SPREAD}) FILTER (feature = 'length') AS high_length,
    max(q25 - {quality.REACH} * {_SPREAD}) FILTER (feature = 'length') AS low_length FROM p GROUP BY ALL)
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND coalesce({' AND '.join(_within_sql(k) for k in quality.TAILS)}
      AND length BETWEEN low_length / {quality.GAMMA!r}::DOUBLE AND high_length * {quality.GAMMA!r}::DOUBLE, true) AS kept
  FROM f LEFT JOIN g ON f.lang IS NOT DISTINCT FROM g.lang AND f.source IS NOT DISTINCT FROM g.source"""


@query("op7_quality_rules", QUALITY_SQL)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    return quality.rules(docs, keep_text=False).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _url_rule_sql(order: list[tuple[str, str]], value: int) -> str:
    cases = []
    for rule in order:
        name, slash, rest = rule[1].partition("/")
        cases.append(f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{slash}{rest}') THEN '{rule[value]}'")
    return f"CASE {' '.join(cases)} END"


_ORDERED_RULES = sorted(URL_RULES, key=lambda r: (-len(r[1]), r[0] != "allow", r[1]))
_REST = r"coalesce(regexp_extract({0}, '(?s)^.*?://(.*)$', 1), '')"


def _url_parts_sql(url: str) -> str:
    rest = _REST.format(url)
    host = LOWER.format(f"regexp_extract({rest}, '^[^/?#]*')")
    after = f"regexp_extract({rest}, '^[^/?#]*([^#]*)', 1)"
    return f"{host} AS host, regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) AS path, CASE WHEN {host} <> '' THEN {host} || {after} END AS node"


#: absolute canonical links, the only kind of edge that a generated page could have
URL_SQL = f"""WITH RECURSIVE p AS (SELECT page_id, {_url_parts_sql('url')}, html FROM pages),
  t AS (SELECT node AS a, unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\\b.*?</script\\s*>', '', 'g'),
    '(?is)<link\\b[^>]*\\srel\\s*=\\s*"?canonical"?[^>]*>')) AS tag FROM p),
  e AS (SELECT a, node AS b FROM (SELECT a, {_url_parts_sql("replace(regexp_extract(tag, '(?is)href\\s*=\\s*\"([^\"]*)\"', 1), '&amp;', '&')")} FROM t)
    WHERE a IS NOT NULL AND node IS NOT NULL),
  links AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
  reach AS (SELECT a AS node, a AS other FROM links UNION SELECT reach.node, b FROM reach JOIN links ON a = other),
  judged AS (SELECT reach.node, {_url_rule_sql(_ORDERED_RULES, 0)} AS v FROM reach, LATERAL (SELECT {_url_parts_sql("('://' || other)")}) AS o(host, path, n)),
  alias AS (SELECT node, bool_or(coalesce(v = 'block', false)) AND NOT bool_or(coalesce(v = 'allow', false)) AS blocked FROM judged GROUP BY node)
  SELECT page_id, host, path, {_url_rule_sql(_ORDERED_RULES, 1)} AS rule,
    coalesce({_url_rule_sql(_ORDERED_RULES, 0)}, CASE WHEN blocked THEN 'block' END, 'allow') AS verdict FROM p LEFT JOIN alias USING (node)"""


@query("op8_url_filters", URL_SQL)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return urls.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


@query("op9_html_extraction")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return html.extract(pages).select("page_id", "url", "text", "n_chars")


def _controls(column: str) -> str:
    """SQL of the number of control strings; escaping makes each one character longer."""
    return f"len(regexp_extract_all({column}, '{chat.CONTROL}'))"


CHAT_SQL = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
  s AS (SELECT *, length('{chat.OPEN}{chat.MIDDLE}{chat.CLOSE}') + length(role) + length(text) + {_controls('role')} + {_controls('text')} AS n,
    CASE WHEN role = 'assistant' THEN text ELSE '' END AS learned FROM t)
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
    sum(length(learned))::BIGINT AS loss_chars, sha256(string_agg(learned, '' ORDER BY turn)) AS loss_sha256, sum(n)::BIGINT AS formatted_chars FROM s GROUP BY conv_id"""


@query("op10_chat_formatting", CHAT_SQL)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    # a conversation made of control strings, which the template has to give back
    hard = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    turns = turns.unionByName(added).withColumn("parts", chat.text_part(F.col("text")))
    return chat.read_back(chat.format_turns(turns)).withColumnRenamed("conversation", "conv_id")


TERMS = f"regexp_extract_all({LOWER.format('{0}')}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

SEARCH_SQL = f"""WITH d AS (SELECT doc_id, unnest({TERMS.format("coalesce(text, '')")}) AS t FROM documents),
  tf AS (SELECT doc_id, t, count(*) AS tf FROM d GROUP BY ALL), len AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY ALL),
  whole AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM len),
  w AS (SELECT t, floor(1000 * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, whole GROUP BY t),
  m AS (SELECT doc_id, 75 + (25 * n * big_n) // big_l AS m FROM len, whole),
  q AS (SELECT item_id, unnest({TERMS.format("coalesce(text, '')")}) AS t FROM benchmark),
  s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM q JOIN w USING (t) JOIN tf USING (t) JOIN m USING (doc_id) GROUP BY ALL)
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0
  QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20"""


@query("op11_lexical_search", SEARCH_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    index = saved(search.build_index(table(spark, folder, "documents")), "index")
    return search.search(index, table(spark, folder, "benchmark"), k=20)


@query("op12_suffix_dedup")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return suffixes.repeated_bytes(docs, window=400).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


# crc32 of the decimal doc_id, byte by byte and bit by bit
CRC_SQL = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length({0}) + 1), lambda i: ascii({0}[i])::BIGINT)),
    lambda c, x: list_reduce(list_concat([xor(c, x)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda a, b: xor(a >> 1, (a & 1) * 3988292384))))"""

#: words q apart that are equal, joined to stretches without a gap; the smallest q of a stretch is its period
PERIODS_SQL = f"""WITH d AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w, {CRC_SQL.format('CAST(doc_id AS VARCHAR)')} AS h FROM documents),
  a AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a, h // 10 AS g FROM d),
  x AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) END AS w FROM a),
  c AS (SELECT doc_id, unnest(range(n)) AS i, unnest(w) AS v FROM x),
  same AS (SELECT p.doc_id, p.i, q.i - p.i AS d FROM c p JOIN c q ON p.doc_id = q.doc_id AND p.v = q.v AND q.i > p.i JOIN x ON x.doc_id = p.doc_id WHERE 2 * (q.i - p.i) <= n),
  isle AS (SELECT doc_id, d, min(i) AS s, count(*) + d AS len FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, d ORDER BY i) AS k FROM same) GROUP BY doc_id, d, k),
  runs AS (SELECT doc_id, s, len, min(d) AS p FROM isle WHERE len >= greatest(12, 2 * d) GROUP BY ALL),
  gone AS (SELECT DISTINCT doc_id, unnest(range(s + p, s + len)) AS i, true AS cut FROM runs),
  kept AS (SELECT doc_id, string_agg(v, ' ' ORDER BY i) FILTER (WHERE cut IS NULL) AS t FROM c LEFT JOIN gone USING (doc_id, i) GROUP BY doc_id),
  r AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || len || ',' || p || chr(10), '' ORDER BY s, p) AS listed, max({{'l': len, 's': -s, 'p': -p}}) AS top FROM runs GROUP BY doc_id)
  SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, -top.s AS start, top.l AS length, -top.p AS period, (1000 * top.l) // -top.p AS exponent_milli,
    sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256 FROM d LEFT JOIN r USING (doc_id) LEFT JOIN kept USING (doc_id)"""


@query("op13_periodic_runs", PERIODS_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    # the rows that the contract makes periodic: the words from a on repeat the first p of them
    h = F.crc32(F.col("doc_id").cast("string"))
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("w"))
    rows = rows.withColumn("n", F.size("w").cast("long")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    made = F.expr("array_join(slice(concat(slice(w, 1, int(a)), flatten(array_repeat(slice(w, int(a + 1), int(p)), 10))), 1, int(n)), ' ')")
    rows = rows.select("doc_id", F.when(F.col("a").isNotNull(), made).otherwise(F.col("text")).alias("text"))
    found = periods.periodic_runs(rows)
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    top = F.expr("array_max(transform(runs, r -> struct(r.length as l, -r.start as s, -r.period as p)))")
    found = found.withColumn("top", top)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("top.s")).alias("start"),
        F.col("top.l").alias("length"),
        (-F.col("top.p")).alias("period"),
        F.expr("(1000 * top.l) div -top.p").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
