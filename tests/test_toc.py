from pyspark.sql import functions as F

from quire.functions import toc as TF
from quire.operators import toc as T


def col(spark, values, fn):
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("t"))).collect()]


def test_roman(spark):
    words = ["xiv", "iix", "xq", "MCMXC"]
    assert col(spark, words, TF.roman_to_int) == [14, 8, None, 1990]
    assert col(spark, words, lambda c: TF.roman_to_int(c, strict=False)) == [14, 10, 10, 1990]
    assert col(spark, ["12", "iv", "", None, "x1", "99999999999"], TF.label_to_int) == [12, 4, None, None, None, None]


def test_entry_and_level(spark):
    rows = ["Chapter social", "1.2 Alpha ..... 12", "1. Beta 3", "1 Gamma 4", "ab 5", "No label!"]
    got = col(spark, rows, TF.entry)
    assert [g and tuple(g) for g in got] == [
        ("Chapter socia", "l", "chapter"), ("1.2 Alpha", "12", "section"), ("1. Beta", "3", "subsection"),
        ("1 Gamma", "4", "unknown"), None, None]


def test_confidence(spark):
    rows = [("a", f"Chapter {i}", "1", "chapter") for i in range(7)] + [("b", "x", None, "unknown")] * 4
    df = spark.createDataFrame(rows, "doc_id string, title string, page_label string, level string")
    got = {r.doc_id: (r.score, r.level) for r in T.toc_confidence(df).collect()}
    assert got == {"a": (42, "HIGH"), "b": (0, "LOW")}


def test_label_sort(spark):
    rows = [("d", i, f"t{i}", lab, "unknown") for i, lab in enumerate(["3", "iv", "A", None, "12b"])]
    df = spark.createDataFrame(rows, "doc_id string, pos long, title string, page_label string, level string")
    assert [r.page_label for r in T.toc_label_sort(df).orderBy("rank").collect()] == ["iv", "3", "12b", "A", None]


def test_parse(spark):
    raws = ['noise [{"title":"A","page_label":"1","level":"chapter"}, ] tail', '[...\n{"title":"B"}]', "no list", "[broken", "[{]"]
    got = col(spark, raws, TF.parse_entries)
    assert [[e.title for e in g] for g in got] == [["A"], ["B"], [], [], []]


def test_streak_skips_pages_without_numbers(spark):
    # Pages 0-9 print p+1 (offset 0), but pages 3 and 4 show nothing; page 20 shows noise.
    rows = [("d", p, 0, p + 1) for p in range(10) if p not in (3, 4)] + [("d", 20, 0, 3)]
    df = spark.createDataFrame(rows, "doc_id string, phys long, pos int, printed int")
    assert [tuple(r) for r in T.offset_streak(df).collect()] == [("d", 0, 8)]
    short = spark.createDataFrame(rows[:4], df.schema)
    assert T.offset_streak(short).count() == 0


def test_page_run_stops_at_first_failure(spark):
    scored = spark.createDataFrame([("d", p, p not in (0, 4)) for p in range(8)], "doc_id string, page_index int, is_toc boolean")
    starts = spark.createDataFrame([("d", 1)], "doc_id string, toc_page_index int")
    assert sorted(r.page_index for r in T.toc_page_run(scored, starts).collect()) == [1, 2, 3]
    assert sorted(r.page_index for r in T.toc_page_run(scored, starts, max_pages=2).collect()) == [1, 2]
