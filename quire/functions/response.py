"""Formatting of generated answers as Column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.text import LINE_BREAK, SPACE, strip

NO_ANSWER = "dont have an answer"

# Typographic characters with one plain counterpart, in pairs.
TYPO_FROM = "“”„‟‹›«»‘’‚‛–—―‒\u00a0″′‵‶•‣◦†‰×÷−ªº"
TYPO_TO = "\"\"\"\"<>\"\"''''---- \"''\"---+%x/-ao"
# Characters that vanish.
TYPO_DROP = "\u200b\u200c\u200d\ufeff"
# Characters with a longer counterpart.
TYPO_LONG = {"…": "...", "‡": "++", "±": "+/-"}

# Fixed value: opening phrases a model puts before the answer proper.
CHATTER = (
    rf"^(?:(?:certainly|sure|yes|absolutely)[.,!]*[{SPACE}]*)?"
    r"(?:here(?: is|'s)?(?: the| your)? (?:answer|response|information|explanation)"
    r"|based on (?:the )?(?:provided )?context"
    r"|according to (?:the )?(?:provided )?(?:context|text|document|book)"
    r"|to answer (?:the|your) question"
    rf"|as stated in).*?[:\-,]?[{SPACE}]*\n*"
)
# What counts as a markdown link and as a raw address.
MD_LINK = rf"\[([^\]]+)\]\((https?://[^{SPACE})]+)\)"
URL_CHARS = r"[a-zA-Z0-9\-._~:/?#\[\]@!$&'()*+,;=%]+"
RAW_URL = rf"(?<!\]\()(https?://{URL_CHARS})"


def once(c: Column, step: Callable[[Column], Column]) -> Column:
    """``step(c)`` with ``c`` computed once, however often ``step`` reads it."""
    return F.element_at(F.transform(F.array(c), step), 1)


def strip_chatter(c: Column) -> Column:
    return strip(F.regexp_replace(c, "(?i)" + CHATTER, ""))


def typographic_map(c: Column) -> Column:
    c = F.translate(c, TYPO_FROM + TYPO_DROP, TYPO_TO)
    for ch, plain in TYPO_LONG.items():
        c = F.replace(c, F.lit(ch), F.lit(plain))
    return c


@F.pandas_udf(T.StringType())
def nfkc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Unicode compatibility normalisation; Spark has no such function."""
    for s in texts:
        yield s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def remove_control_chars(c: Column) -> Column:
    return F.regexp_replace(c, r"[\p{C}&&[^\n\r\t]]", "")


def group_links(c: Column) -> Column:
    """Markdown links become their text, raw addresses go; all are listed once at the end."""
    def grouped(c: Column, body: Column) -> Column:
        urls = F.array_distinct(F.concat(
            F.regexp_extract_all(c, F.lit(MD_LINK), 2),
            F.regexp_extract_all(body, F.lit(RAW_URL), 1),
        ))
        bare = F.regexp_replace(body, RAW_URL, "")
        return once(urls, lambda urls: F.when(F.size(urls) > 0, F.concat(
            strip(bare), F.lit("\n\nREFERENCES:\n"),
            F.array_join(F.transform(urls, lambda u: F.concat(F.lit("- "), u)), "\n"))).otherwise(bare))
    return once(c, lambda c: once(F.regexp_replace(c, MD_LINK, "$1"), lambda body: grouped(c, body)))


def clean_spacing(c: Column) -> Column:
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return strip(F.regexp_replace(c, r"[ \t]+(?=\n|\z)", ""))


def list_layout(c: Column) -> Column:
    """``*``, ``+`` and bullet markers become ``- ``; ``1)`` becomes ``1. ``."""
    def one(line: Column) -> Column:
        line = F.regexp_replace(
            line, rf"^([{SPACE}]*)[*+\x{{2022}}] [{SPACE}]*(.*?)[{SPACE}]*$", "$1- $2")
        return F.regexp_replace(
            line, rf"^([{SPACE}]*)(\p{{Nd}}+)[.)][{SPACE}]+(.*?)[{SPACE}]*$", "$1$2. $3")
    return strip(F.array_join(F.transform(F.split(c, LINE_BREAK), one), "\n"))


def finish_response(normalised: Column, intent: Column) -> Column:
    """The steps after NFKC: punctuation, links, spacing, lists, refusal and header."""
    c = typographic_map(normalised)
    c = remove_control_chars(c)
    c = list_layout(clean_spacing(group_links(c)))
    def headed(c: Column) -> Column:
        full = F.when(intent.isin("medical", "book") & ~c.startswith("### "),
                      F.concat(F.lit("### Direct Answer\n"), c)).otherwise(c)
        return F.when(F.contains(F.lower(c), F.lit(NO_ANSWER)), F.lit(NO_ANSWER)).otherwise(strip(full))
    return once(c, headed)


def format_response(c: Column, intent: Column) -> Column:
    """Full clean-up of one generated answer; blank or null gives an empty string."""
    out = finish_response(nfkc(strip_chatter(strip(c))), intent)
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit("")).otherwise(out)
