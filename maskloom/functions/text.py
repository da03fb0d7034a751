"""Detokenizers and normalizers as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# The characters Python's str.strip() and \s treat as white space.
WHITESPACE = (
    r"[\x09-\x0d\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)

# Fixed value: what counts as a word character.
WORD = r"[\p{L}\p{N}_]"

# Literal (search, replacement) pairs, in the order they apply.
WIKI_SEPARATORS = [(" @-@ ", "-"), (" @,@ ", ","), (" @.@ ", ".")]
WIKI_PUNCTUATION = [
    (" : ", ": "),
    (" ; ", "; "),
    (" . ", ". "),
    (" ! ", "! "),
    (" ? ", "? "),
    (" , ", ", "),
]
WIKI_MISC = [
    ("= = = =", "===="),
    ("= = =", "==="),
    ("= =", "=="),
    (" ° ", "°"),
    (" \n", "\n"),
    ("\n ", "\n"),
    (" N ", " 1 "),
    (" 's", "'s"),
]
PTB_FIRST = [(" 's", "'s"), ("s ' ", "s' "), (" n't", "n't"), (" \n ", "\n"), ("\\/", "/")]
PTB_LAST = [("$ 1", "$1"), ("# 1", "#1"), ("<unk>", "?")]
LM1B_MIDDLE = [(" , ", ", "), (" : ", ": "), (" ; ", "; "), (" / ", "/")]

# Enclosing pairs whose inner white space goes away.
WIKI_PAIRS = [("\\(", "\\)", "(", ")"), ("\\[", "\\]", "[", "]"), ("\\{", "\\}", "{", "}"),
              ('"', '"', '"', '"'), ("'", "'", "'", "'")]


def _literals(text: Column, rules: list[tuple[str, str]]) -> Column:
    for search, new in rules:
        text = F.replace(text, F.lit(search), F.lit(new))
    return text


def _regex(text: Column, pattern: str, new: str) -> Column:
    # (?d) lets $ match before a final \n only, not before \r
    return F.regexp_replace(text, "(?d)" + pattern, new)


def detok_wikitext(text: Column) -> Column:
    text = _literals(text, [("s '", "s'")])
    # the slashes are part of the pattern and the replacement is literal
    text = _regex(text, "/' [0-9]/", "/'[0-9]/")
    text = _literals(text, WIKI_SEPARATORS + WIKI_PUNCTUATION)
    for opening, closing, left, right in WIKI_PAIRS:
        inner = f"{WHITESPACE}*([^{closing}]*?){WHITESPACE}*"
        text = _regex(text, opening + inner + closing, f"{left}$1{right}")
    return _literals(text, WIKI_MISC)


def detok_ptb(text: Column) -> Column:
    text = _literals(text, PTB_FIRST)
    # neighbouring matches share a blank, so one pass cannot reach them all
    text = _literals(text, [(" N ", " 1 ")] * 10)
    return _literals(text, PTB_LAST)


def detok_lm1b(text: Column) -> Column:
    text = _literals(text, [("http : / / ", "http://"), ("https : / / ", "https://")])
    # a blank is no word character, so a word needs no second, shorter try
    text = _regex(text, f" '({WORD}++)", "'$1")
    text = _regex(text, rf" ({WORD}++) \. ", " $1. ")
    text = _regex(text, rf" ({WORD}++) \.$", " $1.")
    for mark in "?!":
        text = _literals(text, [(f" {mark} ", f"{mark} ")])
        text = _regex(text, rf" \{mark}$", mark)
    text = _literals(text, LM1B_MIDDLE)
    text = _regex(text, r'" ([^"]+) "', '"$1"')
    text = _regex(text, r"' ([^']+) '", "'$1'")
    text = _regex(text, r"\( ([^\(\)]+) \)", "($1)")
    text = _regex(text, r"\[ ([^\[\]]+) \]", "[$1]")
    return _literals(text, [("$ ", "$"), ("£ ", "£")])


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WHITESPACE}+|{WHITESPACE}+\\z", "")


def detok_lambada(text: Column) -> Column:
    return F.concat(F.lit("\n"), strip(F.translate(text, "“”", '""')))


def detok_scientific(text: Column) -> Column:
    return detok_lm1b(detok_wikitext(text))


def detok_for(corpus: Column, text: Column) -> Column:
    """Pick the detokenizer by corpus name; unknown corpora pass through."""
    return (
        F.when(corpus.startswith("wikitext"), detok_wikitext(text))
        .when(corpus == "ptb", detok_ptb(text))
        .when(corpus == "lm1b", detok_lm1b(text))
        .when(corpus == "lambada", detok_lambada(text))
        .when(corpus.startswith("scientific_papers"), detok_scientific(text))
        .otherwise(text)
    )


class _Unmarked(dict):
    """A translation table that drops combining marks and learns a character when it sees it."""

    def __missing__(self, code: int) -> int | None:
        self[code] = None if unicodedata.category(chr(code)) == "Mn" else code
        return self[code]


_UNMARKED = _Unmarked()


def plain(value: str | None) -> str | None:
    if value is None:
        return None
    apart = unicodedata.normalize("NFD", value)
    # lower case per character: word-final sigma is not special here
    lowered = "".join(c.lower() for c in apart) if "\u03a3" in apart else apart.lower()
    return lowered.translate(_UNMARKED)


@F.pandas_udf(T.StringType())
def _decompose(text: pd.Series) -> pd.Series:
    return text.map(plain)


def norm_bpe(text: Column) -> Column:
    """NFD, lower case, no combining marks; ASCII rows stay in the JVM."""
    # the UDF sees an empty string for ASCII rows, so only the others are shipped and decomposed
    ascii_only = ~text.rlike(r"[^\x00-\x7f]")
    return F.when(ascii_only, F.lower(text)).otherwise(
        _decompose(F.when(ascii_only, F.lit("")).otherwise(text))
    )


def split_whitespace(text: Column) -> Column:
    return F.filter(F.split(text, f"{WHITESPACE}+"), lambda w: w != "")
