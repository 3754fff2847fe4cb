import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.operators import chunking as C


def greedy(lengths, limit, carry=0):
    """The fill, one unit at a time."""
    closed, n, size = [], 0, carry
    for x in lengths:
        size += x
        closed.append(n)
        if size >= limit:
            n, size = n + 1, 0
    return closed, size


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(2, 60), min_size=1, max_size=80), st.integers(5, 90))
def test_block_fill_and_carry_map(lengths, limit):
    arr = np.array(lengths)
    table = C.carry_map(arr, limit)
    for carry in range(limit):
        closed, left = greedy(lengths, limit, carry)
        got, got_left = C.fill_starts(arr, limit, carry)
        assert got.tolist() == closed and got_left == left and table[carry] == left


def units(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, unit_no long, type string, text string, page int")


@pytest.fixture(scope="module")
def book(spark):
    """One document with a heading-less start, headings, and one very long section."""
    rows = [("d", i, "body", "x" * (i % 17 + 1), i // 10 + 1) for i in range(40)]
    rows += [("d", 40, "heading", "Head", 5), ("d", 41, "subheading", "Sub", 5)]
    rows += [("d", i, "body", f"w{i} " * (i % 9 + 1), i // 10 + 1) for i in range(42, 900)]
    rows += [("e", 0, "body", "  ", 1), ("e", 1, "body", "only", 1)]
    return units(spark, rows)


@pytest.mark.parametrize("short,pages", [(10_000, 4096), (5, 4096), (5, 1), (5, 7)])
def test_long_sections_fill_like_short_ones(book, short, pages):
    want = C.chunk_accumulate(book, limit=100).orderBy("doc_id", "chunk_no").collect()
    got = C.chunk_accumulate(book, limit=100, short=short, pages=pages).orderBy("doc_id", "chunk_no").collect()
    assert got == want and len(want) > 50


def test_fill_rules(spark):
    rows = [("d", 0, "body", "intro", 3), ("d", 1, "heading", "H", 4), ("d", 2, "subheading", "S", 4),
            ("d", 3, "body", "a" * 30, 5), ("d", 4, "body", "b" * 30, 6), ("d", 5, "body", "tail", 7)]
    got = C.chunk_accumulate(units(spark, rows), limit=40).orderBy("chunk_no").collect()
    assert [(r.chapter, r.subheading, r.page_physical, r.text) for r in got] == [
        (None, None, 3, "intro"),
        ("H", None, 4, "H"),
        ("H", "S", 4, "H\nS\n" + "a" * 30 + "\n" + "b" * 30),
        ("H", "S", 4, "tail"),
    ]


def three(spark):
    return spark.createDataFrame([("d", 0, "A"), ("d", 1, "B"), ("d", 2, "C")], "doc_id string, chunk_no long, text string")


def texts(df):
    return [r.text for r in df.orderBy("chunk_no").collect()]


def test_overlap(spark):
    once = C.chunk_overlap(three(spark))
    assert texts(once) == ["A\nB", "A\nB\nC", "B\nC"]
    assert texts(C.chunk_overlap(once, (" ",))) == texts(C.chunk_overlap(three(spark), ("\n", " "))) == ["A\nB A\nB\nC", "A\nB A\nB\nC B\nC", "A\nB\nC B\nC"]
    sizes = C.overlap_sizes(three(spark)).orderBy("chunk_no").select("overlap.*").collect()
    assert [tuple(r) for r in sizes] == [(0, 300), (300, 300), (300, 0)]


def test_overlap_in_small_blocks(spark):
    df = spark.createDataFrame([("d", i, f"<{i}>" * (i % 5 + 1)) for i in range(40)], "doc_id string, chunk_no long, text string")
    want = texts(C.chunk_overlap(df, ("\n", " "), chars=7))
    assert texts(C.chunk_overlap(df, ("\n", " "), chars=7, size=4)) == want
    assert texts(C.chunk_overlap(C.chunk_overlap(df, ("\n",), chars=7, size=3), (" ",), chars=7, size=5)) == want


def test_overlap_is_bounded(spark):
    df = spark.createDataFrame([("d", i, "z" * (i * 97 % 900)) for i in range(30)], "doc_id string, chunk_no long, text string")
    grown = C.chunk_overlap(df).join(df.withColumnRenamed("text", "was"), ["doc_id", "chunk_no"])
    assert grown.where(F.length("text") > F.length("was") + 602).count() == 0


def test_next_links_skip_gaps_and_copies(spark):
    df = spark.createDataFrame([("d", 0, "a"), ("d", 5, "b"), ("d", 9, "b"), ("d", 5000, "c"), ("e", 1, "x")],
                               "doc_id string, chunk_no long, chunk_id string")
    assert sorted((r.src, r.dst) for r in C.next_links(df).collect()) == [("a", "b"), ("b", "c")]


def test_sizes_round_ties_to_even_and_headers_of_whole_documents(spark):
    from quire.operators import layout as L
    rows = [("d", p, n, s, t, size, y, y + 12.0, 792.0) for p in range(1, 31) for n, s, t, size, y in [
        (0, 0, "Head", 10.25, 10.0), (1, 0, f"body {p} ", 10.25, 300.0), (1, 1, "end", 10.5, 300.0)]]
    spans = spark.createDataFrame(rows, "doc_id string, page int, line_no int, span_no int, text string, size double, "
                                        "y0 double, y1 double, page_height double")
    assert {r["size"]: r.n for r in L.font_stats(spans, None).collect()} == {10.2: 60, 10.5: 30}
    lines = {r.text: r.font_size for r in L.line_units(spans).where("page = 1").collect()}
    assert lines == {"Head": 10.2, "body 1 end": 10.4}  # mean of 10.2 and 10.5 is 10.35
    assert [tuple(r) for r in L.header_footer_detect(spans, None).collect()] == [("d", "head", 30)]
    assert L.header_footer_detect(spans, 62).count() == 0
    assert L.styled_units(spans, None).where("text = 'Head'").count() == 0


def spans_of(spark, rows):
    """Rows (doc_id, page, text, size) as spans, one line a row."""
    return spark.createDataFrame([(d, p, n, 0, t, s, 300.0, 312.0, 792.0) for n, (d, p, t, s) in enumerate(rows)],
                                 "doc_id string, page int, line_no int, span_no int, text string, size double, "
                                 "y0 double, y1 double, page_height double")


def test_lines_are_dealt_out_once(spark):
    """styles, sections and the fill work on lines where the first shuffle put them."""
    from quire.operators import layout as L
    df = spans_of(spark, [("d", p, f"text {p}", 10.0 + p % 3) for p in range(9)])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sections = C._sections(C._pieces(C.section_ids(L.styled_units(df))), 100, 5)
        plan = sections._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning(doc_id" in line and (
        "line_no" in line or "section" in line)]
    assert "REPARTITION_BY_COL" in plan and not moved


def test_sections_over_the_edge_of_a_page_block(spark):
    """Sections that go on in the next block of pages, one over three blocks, fill as those of a plain recursion do."""
    from quire.operators import layout as L
    size, rows = C.PAGES_PER_BLOCK, []
    for p in (1, 2, size - 2, size - 1, size, size + 5, 2 * size + 1, 3 * size, 3 * size + 1):
        rows += [("d", p, f"p{p} " + "x" * (p % 7), 10.0), ("d", p, f"q{p}", 10.0)]
    rows.insert(2, ("d", 2, "Head", 18.0))
    rows[8:8] = [("d", size - 1, f"Sub {i}", 14.0) for i in range(3)]
    rows += [("d", 3 * size + 2, "Last", 18.0), ("e", 1, "only", 10.0)]
    units = C.section_ids(L.styled_units(spans_of(spark, rows), None)).orderBy("doc_id", "unit_no").collect()
    want = {}
    for u in units:
        key = (u.doc_id, u.section)
        piece = f"{u.chapter}\n{u.text}" if u.type == "subheading" and u.chapter else u.text
        parts = want.setdefault(key, [[]])
        if sum(len(x) + 1 for x in parts[-1]) >= 30:
            parts.append([])
        parts[-1].append(piece)
    texts_of = [(d, "\n".join(part)) for (d, _), parts in sorted(want.items()) for part in parts]
    assert {u.section for u in units if u.doc_id == "d"} == set(range(6))
    for short in (1000, 2):
        got = C.chunk_accumulate(L.styled_units(spans_of(spark, rows), None), limit=30, short=short).orderBy("doc_id", "chunk_no").collect()
        assert [(r.doc_id, r.text) for r in got] == texts_of
        assert [r.chunk_no for r in got] == [i for d in "de" for i in range(sum(x == d for x, _ in texts_of))]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(2, 60), min_size=1, max_size=80), st.integers(5, 90))
def test_carry_steps_are_the_carry_map(lengths, limit):
    """a block's steps, of which there are never more than its units, say what the whole map does."""
    upto, after, total = C.carry_steps(np.array(lengths), limit)
    assert len(upto) == len(after) <= min(len(lengths), limit)
    assert [C.carry_after(upto, after, total, limit, c) for c in range(limit)] == C.carry_map(np.array(lengths), limit).tolist()


def test_small_blocks_go_through_python_together(book):
    """no Python call per block."""
    plan = C.chunk_accumulate(book, limit=100, short=5, pages=1)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan
