import datetime as dt

from pyspark.sql import functions as F

from quire.operators import memory as M
from quire.operators import stats as ST

MSG = "user_id string, thread_id string, seq long, role string, content string"


def test_qa_window(spark):
    rows = [("u", "t", 0, "user", "q1"), ("u", "t", 1, "user", "q2"), ("u", "t", 2, "assistant", "a2")]
    got = M.qa_window(spark.createDataFrame(rows, MSG)).first().qa_text
    assert got == "Q1: q1\nA1: \n\nQ2: q2\nA2: a2"


def test_qa_window_sees_the_last_turns_only(spark):
    rows = [("u", "t", i, "user" if i % 2 == 0 else "assistant", f"m{i}") for i in range(20)]
    got = M.qa_window(spark.createDataFrame(rows, MSG).repartition(4), 2).first().qa_text
    assert got == "Q1: m16\nA1: m17\n\nQ2: m18\nA2: m19"


def test_resolve_thread_in_small_blocks(spark):
    rows = [("u", 1, None), ("u", 2, ""), ("u", 3, "t9"), ("u", 4, " "), ("u", 5, "New"), ("u", 6, None), ("v", 7, "")]
    df = spark.createDataFrame(rows, "user_id string, seq long, thread_id string")
    for block in (1, 3, 1 << 20):
        got = {r.seq: r.resolved for r in M.resolve_thread(df, block).collect()}
        assert got[1] == got[2] != got[5] and got[3] == "t9" and got[4] == " " and got[5] == got[6] != got[7]


def test_trailing_hour(spark):
    base = dt.datetime(2024, 1, 1)
    secs = [0, 0, 30, 3599, 3600, 3601, 7199, 7200, 7201, 10800]
    rows = [(i, "u", base + dt.timedelta(seconds=s)) for i, s in enumerate(secs)]
    df = spark.createDataFrame(rows, "event_id int, user_id string, ts timestamp_ntz")
    want = [sum(1 for x in secs if s - 3600 <= x <= s) - 1 for s in secs]
    for slots in (1, 4, 60):
        got = M.trailing_hour_limit(df, slots=slots).orderBy("event_id").collect()
        assert [r.recent for r in got] == want and [r.blocked for r in got] == [w >= 3 for w in want]


def test_inject_without_memory_is_the_query(spark):
    asks = spark.createDataFrame([("u", "t", "hello")], "user_id string, thread_id string, query string")
    none = spark.createDataFrame([], MSG)
    entries = spark.createDataFrame([], "user_id string, seq long, content string, category string")
    assert M.memory_inject(asks, entries, none).first().enriched_query == "hello"
    assert M.transform_query_text(asks, none).first().enriched_query == M.NOTHING_TO_TRANSFORM


def test_roles(spark):
    roles = ["admin", "user", "guest", "other"]
    df = spark.createDataFrame([(a, b) for a in roles for b in roles], "a string, b string")
    got = {(r.a, r.b) for r in df.where(ST.has_permission(F.col("a"), F.col("b"))).collect()}
    assert got == {("admin", "admin"), ("admin", "user"), ("admin", "guest"), ("user", "user"), ("user", "guest"), ("guest", "guest")}
