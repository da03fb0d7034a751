import unicodedata

import pytest
from pyspark.sql import functions as F

from maskloom.functions import text as tx

WIKI = [
    ("the dogs ' bone", "the dogs' bone"),
    ("/' 7/", "/'[0-9]/"),
    ("well @-@ known 1 @,@ 000 3 @.@ 5", "well-known 1,000 3.5"),
    ("a : b ; c . d ! e ? f , g", "a: b; c. d! e? f, g"),
    ("( a ) [ b ] { c }", "(a) [b] {c}"),
    ('say " hello there " now', 'say "hello there" now'),
    ("an ' inner ' one", "an 'inner' one"),
    ("= = = = t = = = =", "==== t ===="),
    ("= = s = =", "== s =="),
    ("20 ° C", "20°C"),
    ("a \n b", "a\nb"),
    ("about N people", "about 1 people"),
    ("it 's", "it's"),
    ("( é )", "(é)"),
    ("( a ( b ) )", "(a ( b) )"),
]
PTB = [
    ("it 's n't", "it'sn't"),
    ("the dogs ' bone", "the dogs' bone"),
    ("do n't", "don't"),
    ("a \n b", "a\nb"),
    ("and\\/or", "and/or"),
    (" N N N ", " 1 1 1 "),
    ("$ N # N ", "$1 #1 "),
    ("<unk> x", "? x"),
]
LM1B = [
    ("http : / / a https : / / b", "http://a https://b"),
    ("it 's café 'éa", "it's café'éa"),
    ("the end . Next", "the end. Next"),
    ("the end .", "the end."),
    ("the end .\n", "the end.\n"),
    ("the end .\r", "the end .\r"),
    ("the é .", "the é."),
    ("a ? b ! c ?", "a? b! c?"),
    ("end ?\n", "end?\n"),
    ("end ?\r", "end ?\r"),
    ("a , b : c ; d / e", "a, b: c; d/e"),
    ('" q " ( r ) [ s ]', '"q" (r) [s]'),
    ("x ' q ' y", "x 'q' y"),
    ("$ 5 £ 6", "$5 £6"),
]
LAMBADA = [("  “hi” there 　", '\n"hi" there')]


def run(spark, function, strings):
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(strings)], "i int, s string")
    return [r["o"] for r in rows.select("i", function(F.col("s")).alias("o")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "function, cases",
    [
        (tx.detok_wikitext, WIKI),
        (tx.detok_ptb, PTB),
        (tx.detok_lm1b, LM1B),
        (tx.detok_lambada, LAMBADA),
    ],
)
def test_rules(spark, function, cases):
    assert run(spark, function, [a for a, _ in cases]) == [b for _, b in cases]


def test_scientific_is_both(spark):
    strings = [a for a, _ in WIKI + LM1B]
    once = run(spark, tx.detok_wikitext, strings)
    assert run(spark, tx.detok_scientific, strings) == run(spark, tx.detok_lm1b, once)


def test_strip_is_python_strip(spark):
    spaces = [chr(c) for c in range(0x3100) if chr(c).isspace()]
    strings = [f"{c}a{c}b{c}" for c in spaces] + ["", "​x​", "x\n"]
    assert run(spark, tx.strip, strings) == [s.strip() for s in strings]


def test_split_is_python_split(spark):
    strings = ["", " ", "a", " a b c\x1cd ", "x\ny\tz"]
    assert run(spark, tx.split_whitespace, strings) == [s.split() for s in strings]


def test_norm(spark):
    strings = ["Élan Vital", "plain", "ΣΑΣ", "İx", "한국", "ａＢ", None]
    got = run(spark, tx.norm_bpe, strings)
    assert got[:3] == ["elan vital", "plain", "σασ"]
    assert got[3] == "ix"
    assert got[4] == unicodedata.normalize("NFD", "한국")
    assert got[5:] == ["ａｂ", None]


def test_dispatch_by_prefix(spark):
    rows = spark.createDataFrame(
        [("wikitext2",), ("scientific_papers_arxiv",), ("ag_news",), ("ptb",)], "c string"
    )
    out = {
        r["c"]: r["t"]
        for r in rows.select("c", tx.detok_for(F.col("c"), F.lit("a , b \\/ $ 5")).alias("t")).collect()
    }
    assert out == {
        "wikitext2": "a, b \\/ $ 5",
        "scientific_papers_arxiv": "a, b \\/ $5",
        "ag_news": "a , b \\/ $ 5",
        "ptb": "a , b / $ 5",
    }
