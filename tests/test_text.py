import itertools
import string
import unicodedata

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import response as R
from quire.functions import text as T
from quire.sources import views as V

NASTY = st.text(st.sampled_from(list("aéZ_9-. \n\t\r,!?•*+–“ ​ \u0085\x0b\x1c漢́()[]")), max_size=40)


def apply(spark, texts, fn):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("t"))).collect()]


def word(c):
    return c.isalnum() or c == "_"


def run_end(t, i, test):
    """End of the run of characters from ``i`` on that pass the test."""
    return next((k for k in range(i, len(t)) if not test(t[k])), len(t))


def shorten(t, chars, least, by):
    """Every run of at least ``least`` of the characters becomes ``by``."""
    runs = ((own, "".join(g)) for own, g in itertools.groupby(t, lambda c: c in chars))
    return "".join(by if own and len(g) >= least else g for own, g in runs)


def rejoined(t):
    """Words parted by a hyphen and white space in one; each word is used once."""
    out, i = [], 0
    while i < len(t):
        end = max(run_end(t, i, word), i + 1)
        out.append(t[i:end])
        gap = run_end(t, end + 1, str.isspace) if word(t[i]) and t[end:end + 1] == "-" else end
        i = run_end(t, gap, word) if gap > end + 1 else end
        if i > gap > end:
            out.append(t[gap:i])
        else:
            i = end
    return "".join(out)


def blanked(t, test, longest):
    """Runs of up to ``longest`` characters that pass the test and have a word edge on both sides, as a space."""
    def edge(i):
        return (i > 0 and word(t[i - 1])) != (i < len(t) and word(t[i]))
    out, i = [], 0
    while i < len(t):
        size = next((n for n in range(longest, 0, -1) if i + n <= len(t) and edge(i) and edge(i + n)
                     and all(map(test, t[i:i + n]))), 0)
        out.append(" " if size else t[i])
        i += size or 1
    return "".join(out)


def latin(c):
    return c in string.ascii_letters


def scan_aggressive(t):
    t = blanked(t, lambda c: not (latin(c) or c in string.digits or c.isspace()), 2)
    return blanked(shorten(t, "!?", 2, "."), latin, 1)


def scan_clean(t):
    t = rejoined("".join(filter(str.isprintable, t)))
    return " ".join(shorten(shorten(t, ".", 2, " "), "-_", 2, " ").split())


BRUTE = {
    "strip": (T.strip, str.strip),
    "printable": (T.remove_non_printable, lambda t: "".join(c for c in t if c.isprintable())),
    "hyphen": (T.fix_hyphenation, rejoined),
    "space": (T.normalize_whitespace, lambda t: " ".join(t.split())),
    "aggressive": (T.aggressive_cleanup, scan_aggressive),
    "clean": (T.clean_text, scan_clean),
    "control": (R.remove_control_chars, lambda t: "".join(
        c for c in t if c in "\n\r\t" or unicodedata.category(c)[0] != "C")),
    "nfkc": (R.nfkc, lambda t: unicodedata.normalize("NFKC", t)),
    "trailing": (R.clean_spacing, lambda t: "\n".join(x.rstrip(" \t") for x in shorten(t, "\n", 3, "\n\n").split("\n")).strip()),
}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(NASTY, min_size=40, max_size=40))
def test_against_plain_python(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i")
    got = df.select("t", *[spark_fn(F.col("t")).alias(name) for name, (spark_fn, _) in BRUTE.items()]).collect()
    for row in got:
        for name, (_, plain) in BRUTE.items():
            assert row[name] == plain(row["t"]), (name, row["t"])


def test_aggressive_cleanup_on_whole_documents(spark, sf_dir):
    for row in V.noisy(spark, sf_dir).select("text", T.aggressive_cleanup(F.col("text")).alias("r")).collect():
        assert row.r == scan_aggressive(row.text)


def test_goldens(spark):
    assert apply(spark, ["für- ähn"], T.fix_hyphenation) == ["fürähn"]
    assert apply(spark, ["foo\nbar ..... 12"], T.clean_text) == ["foobar 12"]
    assert apply(spark, ["foo\nbar"], lambda c: T.clean_text(c, newline_to_space=True)) == ["foo bar"]
    assert apply(spark, ["ab 1", "  ", ""], T.ocr_confidence) == [0.75, 0.0, 0.0]
    assert apply(spark, ["abcde111", "abc11111", "a1111111"], T.ocr_confidence) == [0.62, 0.38, 0.12]
    assert apply(spark, ["  a ", "b" * 300], T.short_text) == ["a", ""]
    assert apply(spark, ["a [1] b[12]"], T.strip_fake_citations) == ["a  b"]
    assert apply(spark, [None, "—x "], T.clean_unicode) == ["", "-x"]


def test_list_layout(spark):
    assert apply(spark, ["  * one \n+ two\n• three\n 4)  four\n5. five\n6.six"], R.list_layout) == [
        "- one\n- two\n- three\n 4. four\n5. five\n6.six"]


def test_links(spark):
    text = "See [doc](https://a.example/x?q=1) and https://b.example/y, again https://a.example/x?q=1"
    assert apply(spark, [text, "none "], R.group_links) == [
        "See doc and  again\n\nREFERENCES:\n- https://a.example/x?q=1\n- https://b.example/y,", "none "]


def test_format_response(spark):
    sample = ("Certainly! Here is your explanation:\n\nHens lay ‚best’ in spring – the days grow…   \n"
              "More in [our guide](https://hens.example/lay?y=2) or at https://eggs.example/faq.\n\n\n\nBell\x07 rung.")
    want = ("### Direct Answer\nHens lay 'best' in spring - the days grow...\nMore in our guide or at\n\nBell rung.\n\n"
            "REFERENCES:\n- https://hens.example/lay?y=2\n- https://eggs.example/faq.")
    refused = "Well, I DONT have an answer to that"
    assert apply(spark, [refused, "", None], lambda c: R.format_response(c, F.lit("book"))) == [R.NO_ANSWER, "", ""]


def test_response_steps_read_a_text_once(spark):
    """a step that reads its input several times does not repeat the steps before it."""
    df = spark.createDataFrame([("[a](http://x.y) see http://z.w * b", "book"), (None, "book")], "t string, i string")
    done = df.select(R.finish_response(F.col("t"), F.col("i")).alias("r"))
    assert done._jdf.queryExecution().optimizedPlan().toString().count("translate(") == 1
    assert [r.r for r in done.collect()] == ["### Direct Answer\na see  * b\n\nREFERENCES:\n- http://x.y\n- http://z.w", None]


def test_cleaning_passes_over_plain_text(spark):
    """every character of the basic plane is cleaned as before, and white space of printable text is the plain space alone."""
    every = [chr(i) for i in range(1, 0x10000) if not 0xD800 <= i < 0xE000]
    texts = [" a".join(every[i:i + 500]) for i in range(0, len(every), 500)] + ["  x \u00a0 y-  z ..  -- _", "a- b  c", "", None]
    for options in ({}, {"newline_to_space": True}, {"aggressive": True}):
        def plain(c, options=options):
            if options.get("newline_to_space"):
                c = F.regexp_replace(c, T.LINE_BREAK, " ")
            c = F.regexp_replace(c, rf"[\p{{C}}{T.NO_BREAK}]", "")
            c = T.normalize_whitespace(T.remove_repeated_symbols(T.remove_dotted_leaders(T.fix_hyphenation(c))))
            return T.normalize_whitespace(T.aggressive_cleanup(c)) if options.get("aggressive") else c
        assert apply(spark, texts, lambda c: T.clean_text(c, **options)) == apply(spark, texts, plain)
    plan = spark.createDataFrame([("",)], "t string").select(T.clean_text(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "  +" in plan and "&&[^ ]" not in plan
