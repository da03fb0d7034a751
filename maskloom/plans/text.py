"""Text functions over documents with spaced punctuation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from maskloom.functions import text as tx
from maskloom.operators.order import dealt
from maskloom.plans.registry import query, table

# the same white space and word classes for the SQL engine's regular expressions
WS = (
    r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
WORD = r"[\pL\pN_]"

SPACED = r"regexp_replace(text, '([.,:;!?()\[\]])', ' \1 ', 'g')"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return dealt(table(spark, folder, "documents").select("doc_id", "source", "text"), "doc_id")


def spaced(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with blanks around punctuation, so that every rule has work."""
    text = F.regexp_replace("text", r"[.,:;!?()\[\]]", " $0 ")
    return documents(spark, folder).select("doc_id", "source", text.alias("text"))


def quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_literals(text: str, rules: list[tuple[str, str]]) -> str:
    for search, new in rules:
        text = f"replace({text}, {quote(search)}, {quote(new)})"
    return text


def sql_regex(text: str, pattern: str, new: str) -> str:
    return f"regexp_replace({text}, {quote(pattern)}, {quote(new)}, 'g')"


def sql_wikitext(text: str) -> str:
    text = sql_literals(text, [("s '", "s'")])
    text = sql_regex(text, "/' [0-9]/", "/'[0-9]/")
    text = sql_literals(text, tx.WIKI_SEPARATORS + tx.WIKI_PUNCTUATION)
    for opening, closing, left, right in tx.WIKI_PAIRS:
        text = sql_regex(
            text, f"{opening}{WS}*([^{closing}]*?){WS}*{closing}", f"{left}\\1{right}"
        )
    return sql_literals(text, tx.WIKI_MISC)


def sql_ptb(text: str) -> str:
    return sql_literals(text, tx.PTB_FIRST + [(" N ", " 1 ")] * 10 + tx.PTB_LAST)


def sql_lm1b(text: str) -> str:
    text = sql_literals(text, [("http : / / ", "http://"), ("https : / / ", "https://")])
    text = sql_regex(text, f" '({WORD}+)", r"'\1")
    text = sql_regex(text, rf" ({WORD}+) \. ", r" \1. ")
    text = sql_regex(text, rf" ({WORD}+) \.(\n?)$", r" \1.\2")
    for mark in "?!":
        text = sql_literals(text, [(f" {mark} ", f"{mark} ")])
        text = sql_regex(text, rf" \{mark}(\n?)$", rf"{mark}\1")
    text = sql_literals(text, tx.LM1B_MIDDLE)
    text = sql_regex(text, r'" ([^"]+) "', r'"\1"')
    text = sql_regex(text, r"' ([^']+) '", r"'\1'")
    text = sql_regex(text, r"\( ([^\(\)]+) \)", r"(\1)")
    text = sql_regex(text, r"\[ ([^\[\]]+) \]", r"[\1]")
    return sql_literals(text, [("$ ", "$"), ("£ ", "£")])


def sql_strip(text: str) -> str:
    return sql_regex(text, f"^{WS}+|{WS}+$", "")


def sql_lambada(text: str) -> str:
    return f"chr(10) || {sql_strip(sql_literals(text, [('“', chr(34)), ('”', chr(34))]))}"


def _register(name: str, column, sql) -> None:
    @query(name, f"SELECT doc_id, {sql('t')} AS text FROM (SELECT doc_id, {SPACED} AS t FROM documents)")
    def build(spark: SparkSession, folder: str) -> DataFrame:
        return spaced(spark, folder).select("doc_id", column(F.col("text")).alias("text"))


_register("detok_wikitext", tx.detok_wikitext, sql_wikitext)
_register("detok_ptb", tx.detok_ptb, sql_ptb)
_register("detok_lm1b", tx.detok_lm1b, sql_lm1b)
_register("detok_lambada", tx.detok_lambada, sql_lambada)
_register("detok_scientific", tx.detok_scientific, lambda t: sql_lm1b(sql_wikitext(t)))

# corpus names given to the source labels src0, src1, ... of the documents
SOURCE_CORPORA = [
    "wikitext103",
    "wikitext2",
    "ptb",
    "lambada",
    "text8",
    "text8-crop",
    "lm1b",
    "openwebtext",
    "openwebtext-train",
    "openwebtext-valid",
    "scientific_papers_arxiv",
    "scientific_papers_pubmed",
    "ag_news",
    "babylm",
]


def corpus_of(source: Column) -> Column:
    index = F.substring(source, 4, 9).cast("int")
    names = F.array(*[F.lit(name) for name in SOURCE_CORPORA])
    return F.coalesce(F.get(names, index), source)


SQL_CORPUS = (
    "coalesce(list_extract(["
    + ", ".join(quote(name) for name in SOURCE_CORPORA)
    + "], substr(source, 4)::INTEGER + 1), source)"
)


@query(
    "detok_dispatch",
    f"""SELECT doc_id, corpus, CASE WHEN corpus LIKE 'wikitext%' THEN {sql_wikitext('t')}
        WHEN corpus = 'ptb' THEN {sql_ptb('t')} WHEN corpus = 'lm1b' THEN {sql_lm1b('t')}
        WHEN corpus = 'lambada' THEN {sql_lambada('t')}
        WHEN corpus LIKE 'scientific_papers%' THEN {sql_lm1b(sql_wikitext('t'))} ELSE t END AS text
        FROM (SELECT doc_id, {SQL_CORPUS} AS corpus, {SPACED} AS t FROM documents)""",
)
def detok_dispatch(spark: SparkSession, folder: str) -> DataFrame:
    corpus = corpus_of(F.col("source"))
    return spaced(spark, folder).select("doc_id", corpus.alias("corpus"), "text").select(
        "doc_id", "corpus", tx.detok_for(F.col("corpus"), F.col("text")).alias("text")
    )


@query(
    "strip_lines",
    f"""SELECT doc_id, text FROM (SELECT doc_id, {sql_strip('line')} AS text
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)) WHERE text <> ''""",
)
def strip_lines(spark: SparkSession, folder: str) -> DataFrame:
    lines = documents(spark, folder).select(
        "doc_id", F.explode(F.split("text", "\n")).alias("line")
    )
    return lines.select("doc_id", tx.strip(F.col("line")).alias("text")).where("text <> ''")


@query("norm_bpe", "SELECT doc_id, strip_accents(lower(text)) AS text FROM documents")
def norm_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select("doc_id", tx.norm_bpe(F.col("text")).alias("text"))


@query(
    "split_whitespace",
    f"""SELECT doc_id, array_to_string(list_filter(string_split_regex(text, '{WS}+'), lambda w: w <> ''), '|') AS words,
        len(list_filter(string_split_regex(text, '{WS}+'), lambda w: w <> ''))::INTEGER AS n FROM documents""",
)
def split_whitespace(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select(
        "doc_id", tx.split_whitespace(F.col("text")).alias("w")
    ).select("doc_id", F.array_join("w", "|").alias("words"), F.size("w").alias("n"))
