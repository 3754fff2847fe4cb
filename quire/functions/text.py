"""Text cleaning as Column expressions: everything stays inside the JVM.

Character classes are spelled out, because Java, Python and RE2 disagree about what ``\\s`` and
``\\w`` cover.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Unicode counts as white space.
SPACE_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
               "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
# The same set as the body of a regex character class.
SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# Separators other than the plain space.
NO_BREAK = r"\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
WORD = r"\p{L}\p{N}_"
# What stands between words.
NO_WORD = r"[^\p{L}\p{N}]+"
# Unicode word boundary.
EDGE = rf"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"

# Dashes, quotes and the no-break space folded to plain characters.
UNICODE_FROM = "–—“”‘’\u00a0"
UNICODE_TO = "--\"\"'' "


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(SPACE_CHARS))


def strip_right(c: Column) -> Column:
    return F.rtrim(c, F.lit(SPACE_CHARS))


def strip_left(c: Column) -> Column:
    return F.ltrim(c, F.lit(SPACE_CHARS))


def remove_non_printable(c: Column) -> Column:
    # Plain ASCII is passed over before the classes are asked.
    return F.regexp_replace(c, rf"[[^ -~]&&[\p{{C}}{NO_BREAK}]]", "")


def fix_hyphenation(c: Column) -> Column:
    """Join ``word- word``. A word that was joined on is not joined again (``a- b- c`` gives
    ``ab- c``), which ``\\G``, the end of the match before, takes care of."""
    return F.regexp_replace(c, rf"-(?<=[{WORD}]-)(?<!\G-)[{SPACE}]+([{WORD}]+)", "$1")


def remove_dotted_leaders(c: Column) -> Column:
    return F.regexp_replace(c, r"\.{2,}", " ")


def remove_repeated_symbols(c: Column) -> Column:
    return F.regexp_replace(c, r"[-_]{2,}", " ")


def normalize_whitespace(c: Column) -> Column:
    # Single spaces, by far the most, are passed over.
    return strip(F.regexp_replace(c, rf" [{SPACE}]+|[{SPACE}&&[^ ]][{SPACE}]*", " "))


def single_spaces(c: Column) -> Column:
    """:func:`normalize_whitespace` of printable text, which has no white space but the plain space."""
    return strip(F.regexp_replace(c, "  +", " "))


def aggressive_cleanup(c: Column) -> Column:
    c = F.regexp_replace(c, rf"{EDGE}[^a-zA-Z0-9{SPACE}]{{1,2}}{EDGE}", " ")
    c = F.regexp_replace(c, r"[!?]{2,}", ".")
    return F.regexp_replace(c, rf"{EDGE}[a-zA-Z]{EDGE}", " ")


def clean_text(c: Column, *, aggressive: bool = False, newline_to_space: bool = False) -> Column:
    """Printable filter, hyphen repair, leaders, symbol runs, white space, in that order.

    The printable filter takes newlines out, which glues lines; ``newline_to_space`` keeps the
    word break instead.
    """
    if newline_to_space:
        c = F.regexp_replace(c, LINE_BREAK, " ")
    c = remove_non_printable(c)
    c = fix_hyphenation(c)
    c = remove_dotted_leaders(c)
    c = remove_repeated_symbols(c)
    c = single_spaces(c)
    if aggressive:
        c = single_spaces(aggressive_cleanup(c))
    return c


def clean_list(c: Column, **options) -> Column:
    return F.transform(F.filter(c, lambda x: x.isNotNull()), lambda x: clean_text(x, **options))


def clean_unicode(c: Column) -> Column:
    return strip(F.translate(F.coalesce(c, F.lit("")), UNICODE_FROM, UNICODE_TO))


def text_preview(c: Column, limit: int = 500) -> Column:
    return clean_unicode(F.substring(c, 1, limit))


def is_hex_doc_id(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9a-fA-F]{16}$"), F.lit(False))


def is_hex(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9a-fA-F]+$"), F.lit(False))


def strip_fake_citations(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"\[\p{Nd}+\]", "")


def format_bullets(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), clean_unicode(x))), "\n")


def drop_null_fields(m: Column) -> Column:
    return F.map_filter(m, lambda _, v: v.isNotNull())


def ocr_confidence(c: Column) -> Column:
    """Share of letters and white space, two decimals, ties to even; 0 for blank text."""
    good = F.length(F.regexp_replace(c, rf"[^\p{{L}}{SPACE}]", ""))
    share = F.least(F.lit(1.0), good / F.greatest(F.length(c), F.lit(1)))
    return F.when(strip(c) == "", F.lit(0.0)).otherwise(F.bround(share, 2))


def short_text(c: Column, limit: int = 300) -> Column:
    """Page text when it is short enough to caption an image, else an empty string."""
    t = strip(c)
    return F.when(F.length(t) < limit, t).otherwise("")


def content_id(content: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the content."""
    return F.substring(F.sha2(content, 256), 1, 16)


def tokens(c: Column) -> Column:
    """Lower-case letter/digit runs."""
    return F.filter(F.split(F.lower(c), NO_WORD), lambda t: t != "")
