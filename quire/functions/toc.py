"""Contents-page rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import SPACE, strip

# Patterns that define what a contents row looks like.
ROMAN = "[ivxlcdmIVXLCDM]+"
LABEL_END = rf"({ROMAN}|[0-9]+)$"
NUMBERED = r"^[0-9]+(\.[0-9]+)*"
SECTION_LINES = rf"(?m)^[{SPACE}]*[0-9]+(\.[0-9]+)*[:{SPACE}]"
TRAILING_NUMBERS = rf"(?m)[{SPACE}]+[0-9]+[{SPACE}]*$"
BULLETS = rf"[\x{{2022}}\-][{SPACE}]+"
SPACED_CONTENTS = f"[{SPACE}]*".join("contents")

LEVELS = ("chapter", "section", "subsection", "unknown")
# What one entry adds to the confidence of its contents page.
LEVEL_POINTS = {"chapter": 3, "section": 2, "subsection": 2, "unknown": -1}
ROMAN_DIGITS = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}

ENTRY = "struct<title:string,page_label:string,level:string>"


def page_features(text: Column) -> dict[str, Column]:
    low = F.lower(text)
    return {
        "has_contents": F.contains(low, F.lit("contents")) | low.rlike(SPACED_CONTENTS),
        # (?d): only a newline ends a line.
        "n_sections": F.regexp_count(text, F.lit("(?d)" + SECTION_LINES)),
        "n_trailing": F.regexp_count(text, F.lit("(?d)" + TRAILING_NUMBERS)),
        "n_bullets": F.regexp_count(text, F.lit(BULLETS)),
    }


def page_type(page_index: Column, text: Column) -> Column:
    f = page_features(text)
    return (
        F.when(f["n_trailing"] >= 5, "OFFSET_TOC")
        .when(f["has_contents"] & ((f["n_sections"] >= 5) | (f["n_bullets"] >= 5)), "STRUCTURE_TOC")
        .when((f["n_sections"] >= 10) & (page_index <= 3), "STRUCTURE_TOC")
    )


def row_points(row: Column) -> Column:
    """1 each for a trailing label, a leading number and a leading ``chapter``."""
    tests = (row.rlike(LABEL_END), row.rlike(NUMBERED), F.lower(row).startswith("chapter"))
    return sum((t.cast("int") for t in tests[1:]), tests[0].cast("int"))


def line_points(line: Column) -> Column:
    """The raw-text variant: lines under five characters count nothing."""
    line = strip(line)
    low = F.lower(line)
    tests = (low.rlike(rf"[{SPACE}]([0-9]+|[ivxlcdm]+)$"), line.rlike(r"^[0-9]+(\.[0-9]+)+"),
             low.startswith("chapter"))
    points = sum((t.cast("int") for t in tests[1:]), tests[0].cast("int"))
    return F.when(F.length(line) < 5, 0).otherwise(points)


def level(title: Column) -> Column:
    t = F.lower(strip(title))
    return (
        F.when(t.startswith("chapter"), "chapter").when(t.rlike(r"^[0-9]+\.[0-9]+"), "section")
        .when(t.rlike(r"^[0-9]+\."), "subsection").otherwise("unknown")
    )


def entry(row: Column) -> Column:
    """Title, label and level of one row; null when the row carries no label or a short title."""
    line = F.regexp_replace(strip(row), r"\.{2,}", " ")
    label = F.regexp_extract(line, LABEL_END, 1)
    title = strip(F.regexp_replace(line, LABEL_END, ""))
    made = F.struct(title.alias("title"), label.alias("page_label"), level(title).alias("level"))
    return F.when((label != "") & (F.length(title) >= 3), made)


def parse_entries(raw: Column) -> Column:
    """Entries out of generated text: from the first ``[`` to the last ``]``, with elided tails and
    trailing commas taken out; an empty array when that is no JSON."""
    body = F.regexp_extract(raw, r"(?s)\[.*\]", 0)
    body = F.regexp_replace(body, r"\.\.\.[^\n]*", "")
    body = F.regexp_replace(body, rf",[{SPACE}]*\]", "]")
    return F.coalesce(F.from_json(body, f"array<{ENTRY}>"), F.array().cast(f"array<{ENTRY}>"))


def roman_to_int(word: Column, strict: bool = True) -> Column:
    """Value of a roman numeral, read from the right.

    ``strict``: null on a foreign letter, and a subtracted digit does not become the one to beat.
    lenient: a foreign letter counts 0, and every digit becomes the one to beat.
    """
    digit_map = F.create_map(*[F.lit(x) for kv in ROMAN_DIGITS.items() for x in kv])
    letters = F.reverse(F.filter(F.split(F.lower(word), ""), lambda ch: ch != ""))
    zero = F.struct(F.lit(0).alias("total"), F.lit(0).alias("prev"))

    def step(acc, ch):
        v = F.coalesce(F.element_at(digit_map, ch), F.lit(0))
        less = v < acc["prev"]
        total = F.when(less, acc["total"] - v).otherwise(acc["total"] + v)
        prev = F.when(less, acc["prev"]).otherwise(v) if strict else v
        return F.struct(total.alias("total"), prev.alias("prev"))

    value = F.aggregate(letters, zero, step, lambda acc: acc["total"])
    return F.when(F.lower(word).rlike("^[ivxlcdm]*$"), value) if strict else value


def label_to_int(label: Column) -> Column:
    t = strip(label)
    return F.when(t.rlike("^[0-9]+$"), t.try_cast("int")) \
        .when(F.coalesce(label, F.lit("")) != "", roman_to_int(t))


def label_sort_key(label: Column) -> Column:
    """Roman labels first, then leading numbers, then everything else."""
    group = F.when(label.rlike(f"^{ROMAN}$"), 0).when(label.rlike("^[0-9]"), 1).otherwise(2)
    value = F.when(group == 0, roman_to_int(label, strict=False).cast("long")).when(
        group == 1, F.regexp_extract(label, "^([0-9]+)", 1).try_cast("long"))
    return F.struct(group.alias("label_group"), value.alias("label_value"))


def strategy(toc_type: Column, confidence: Column) -> Column:
    return F.when((toc_type == "STRUCTURE_TOC") | (confidence != "HIGH"), "fallback").otherwise("rule")


def number_candidates(text: Column, page_count: Column) -> Column:
    """Page numbers a text box may show: 1-3 digit numbers in range, then roman words up to 50."""
    edge = r"[\p{L}\p{N}_]"
    digits = F.transform(F.regexp_extract_all(text, F.lit(rf"(?<!{edge})[0-9]{{1,3}}(?!{edge})"), 0),
                         lambda w: w.cast("int"))
    romans = F.transform(
        F.regexp_extract_all(text, F.lit(rf"(?<!{edge})[ivxlcdmIVXLCDM]{{1,6}}(?!{edge})"), 0),
        lambda w: roman_to_int(w))
    return F.concat(F.filter(digits, lambda n: (n >= 1) & (n <= page_count + 10)),
                    F.filter(romans, lambda n: (n != 0) & (n <= 50)))
