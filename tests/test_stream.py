"""Several micro-batches must end where one batch over everything does."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quire.catalog import streams as SQ
from quire.catalog.memory import requests
from quire.operators import memory as M
from quire.sources import views as V
from quire.streaming import jobs as J
from quire.streaming import memory as SM
from quire.streaming.run import append_all, table_stream
from quire.streaming.windows import add_up, from_runs, sliding_counts, to_runs


@pytest.fixture()
def pieces(spark, sf_dir, tmp_path):
    """Messages in four files, read one file per batch."""
    def write(df, name):
        path = str(tmp_path / name)
        df.repartitionByRange(4, "seq").write.parquet(path)
        return table_stream(spark, path, maxFilesPerTrigger=1)
    return write


def rows(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


def test_stm(spark, sf_dir, pieces):
    cols = ["user_id", "thread_id", "seq", "role", "content"]
    messages = V.messages(spark, sf_dir).select(*cols)
    with SQ.rocksdb(spark):
        got = SQ.keyed_result(spark, SM.stream_stm(pieces(messages, "m"), 3), M.THREAD, "seq")
    assert rows(got.select(*cols)) == rows(M.stm_window(messages, 3).select(*cols))


def test_active_thread(spark, sf_dir, pieces):
    asked = requests(spark, sf_dir)
    with SQ.rocksdb(spark):
        got = SQ.keyed_result(spark, SM.stream_active_thread(pieces(asked, "r")), ["user_id"], "seq")
    want = M.resolve_thread(asked).groupBy("user_id").agg(F.max_by("resolved", "seq").alias("thread_id"))
    assert rows(got.select("user_id", "thread_id")) == rows(want)


HOUR = 3_600_000


def stamped(spark, tmp_path, rows, schema, last):
    """One file, and so one batch, per hour; a last file far ahead moves the watermark on."""
    df = spark.createDataFrame([*rows, last], schema).withColumn("ts", F.timestamp_millis((F.col("hour") + 1000) * HOUR)).drop("hour")
    hours = sorted({r[-1] for r in [*rows, last]})
    for h in hours:
        df.where(F.col("ts") == F.timestamp_millis(F.lit((h + 1000) * HOUR))).coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
    return table_stream(spark, str(tmp_path / "t"), maxFilesPerTrigger=1)


def test_threads_come_back_before_and_after_they_expire(spark, tmp_path):
    schema = "user_id string, thread_id string, seq long, role string, content string, hour long"
    rows = [("u", "before", 1, "user", "a", 0), ("u", "after", 2, "user", "b", 0), ("u", "before", 3, "user", "c", 2), ("u", "one batch", 4, "user", "x", 0),
            ("u", "before", 5, "user", "d", 4), ("u", "after", 6, "user", "e", 9), ("u", "after", 7, "user", "f", 10)]
    stream = stamped(spark, tmp_path, rows, schema, ("z", "last", 99, "user", "z", 100))
    with SQ.rocksdb(spark):
        got = SQ.keyed_result(spark, SM.stream_stm(stream, 5, ttl=3 * HOUR, delay="0 seconds"), M.THREAD, "seq").collect()
    windows = {}
    for r in sorted(got, key=lambda r: r.seq):
        windows.setdefault(r.thread_id, []).append(r.content)
    assert windows == {"before": ["a", "c", "d"], "after": ["e", "f"], "one batch": ["x"], "last": ["z"]}


def test_active_threads_expire(spark, tmp_path):
    rows = [("a", "t1", 1, 0), ("b", "t2", 2, 0), ("a", "", 3, 2), ("b", "", 4, 9), ("c", "t3", 5, 1)]
    stream = stamped(spark, tmp_path, rows, "user_id string, thread_id string, seq long, hour long", ("z", "t9", 99, 100))
    with SQ.rocksdb(spark):
        got = SQ.keyed_result(spark, SM.stream_active_thread(stream, ttl=3 * HOUR, delay="0 seconds"), ["user_id"], "seq").collect()
    assert {r.user_id: r.thread_id for r in got} == {"a": "t1", "b": SM._started("b", 4), "c": "t3", "z": "t9"}


def test_expired_state_is_removed(spark, tmp_path):
    schema = "user_id string, thread_id string, seq long, role string, content string, hour long"
    rows = [(f"u{i}", "t", i, "user", "a", 0) for i in range(20)]
    stream = stamped(spark, tmp_path, rows, schema, ("z", "t", 99, "user", "z", 100))
    held = []
    with SQ.rocksdb(spark):
        run = SM.stream_stm(stream, 5, ttl=3 * HOUR, delay="0 seconds").writeStream.outputMode("update").trigger(availableNow=True).option(
            "checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda df, _: df.count() and None).start()
        run.awaitTermination()
        held = [p["stateOperators"][0]["customMetrics"].get("numValueStateVars", 0) and p["stateOperators"][0]["numRowsTotal"] or
                p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress]
    assert max(held) > 10 * held[-1] > 0


def test_dedup_across_batches(spark, sf_dir, tmp_path):
    events = V.load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    for name in ("a", "b"):
        events.coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    stream = table_stream(spark, str(tmp_path / "e"), maxFilesPerTrigger=1)
    out = append_all(J.stream_event_dedup(stream, delay="60 days"))
    assert out.count() == events.count()


def event_files(spark, tmp_path, batches, user="long"):
    """Rows (user, minute) of every batch in a file of their own."""
    for batch in batches:
        batch = [(u, None if m is None else float(m)) for u, m in batch]
        df = spark.createDataFrame(batch, "user_id string, minute double").select(
            F.col("user_id").cast(user).alias("user_id"), F.timestamp_millis((F.col("minute") * 60_000).cast("long") + 1000 * HOUR).alias("ts"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    return table_stream(spark, str(tmp_path / "e"), maxFilesPerTrigger=1)


@pytest.mark.parametrize("user, length, slide", [("long", "1 hour", "5 minutes"), ("string", "50 minutes", "20 minutes")])
def test_windows_take_late_events_until_they_close(spark, tmp_path, user, length, slide):
    """Users and times that are new, late for some windows, late for all, null, and the same twice."""
    rng = random.Random(7)
    batches = [[(rng.choice(["1", "2", str(2**60 + 1), None]), 25 * i + rng.choice([0, 3.5, 5, 9, -12, -30, -47.25, -90])) for _ in range(6)] for i in range(7)]
    batches[2] += [("1", None), ("8", 50.0), ("8", 50.0), ("9", -5.0)]
    batches[4] += [("7", 100 - 12 * k + 0.5) for k in range(8)]
    batches.append([("5", 1000.0)])
    stream = event_files(spark, tmp_path, batches, user)
    w = F.window("ts", length, slide).alias("w")
    plain = stream.withWatermark("ts", "10 minutes").groupBy("user_id", w).agg(F.count(F.lit(1)).alias("n")).select("user_id", "w.start", "w.end", "n")
    got = append_all(J.stream_rate_limit(stream, length, slide))
    assert rows(got) == rows(append_all(plain)) and got.count() > 40
    assert got.schema["user_id"].dataType.simpleString() == {"long": "bigint"}.get(user, user)


def test_window_state_is_a_row_per_bucket(spark, tmp_path):
    """Not one per user and window, of which 600 lone events have 7,200."""
    stream = event_files(spark, tmp_path, [[(str(i), 61.0 * i) for i in range(600)]])
    run = sliding_counts(stream, "1 hour", "5 minutes", "10 minutes", buckets=16).writeStream.format("parquet").trigger(availableNow=True).option(
        "checkpointLocation", str(tmp_path / "c")).start(str(tmp_path / "out"))
    run.awaitTermination()
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress) <= 16
    out = spark.read.parquet(str(tmp_path / "out"))
    assert (out.count(), out.agg(F.max("n")).first()[0]) == (599 * 12 - 2, 1)


def test_runs_of_windows():
    starts = [("a", 0, 1), ("a", 5, 1), ("a", 15, 1), ("a", 20, 2), ("b", 25, 2), ("b", 30, 2)]
    counts = pd.DataFrame([(False, *r) for r in starts], columns=["nobody", "user_id", "start", "n"])
    runs = to_runs(counts, 5)
    assert runs[["first", "windows", "n"]].values.tolist() == [[0, 2, 1], [15, 1, 1], [20, 1, 2], [25, 2, 2]]
    assert from_runs(runs, 5).equals(counts)
    assert add_up([counts, counts]).equals(counts.assign(n=counts["n"] * 2))


def test_ingest_is_idempotent(spark, sf_dir, tmp_path):
    path, docs = str(tmp_path / "chunks"), V.load(spark, sf_dir, "documents").limit(20)
    docs.write.parquet(str(tmp_path / "d"))
    seen = []
    for _ in range(2):
        store = J.stream_ingest(table_stream(spark, str(tmp_path / "d")), SQ.text_spans_of, path, buckets=8)
        counted = store.read("chunks", store.snapshot())
        assert counted.count() == counted.select("doc_id", "chunk_no").distinct().count() > 0
        seen.append(sorted(map(tuple, counted.select("doc_id", "chunk_no", "text").collect())))
    assert seen[0] == seen[1] and store.versions() == [1]  # the replay made no version


def test_batches_are_versions(spark, sf_dir, tmp_path):
    """Three batches into few buckets end where one batch does; every version holds whole batches."""
    docs = V.load(spark, sf_dir, "documents").where("doc_id < 30").select("doc_id", "text")
    docs.repartitionByRange(3, "doc_id").write.parquet(str(tmp_path / "d"))
    many = J.stream_ingest(table_stream(spark, str(tmp_path / "d"), maxFilesPerTrigger=1), SQ.text_spans_of, str(tmp_path / "many"), buckets=4)
    once = J.stream_ingest(table_stream(spark, str(tmp_path / "d")), SQ.text_spans_of, str(tmp_path / "once"), buckets=4)
    cols = ["doc_id", "chunk_no", "text"]
    assert rows(many.read("chunks", many.snapshot()).select(*cols)) == rows(once.read("chunks", once.snapshot()).select(*cols))
    sizes = [many.read("documents", many.snapshot(v)).count() for v in many.versions()]
    assert len(sizes) == 3 and sizes == sorted(sizes) and sizes[-1] == docs.select("text").distinct().count()
