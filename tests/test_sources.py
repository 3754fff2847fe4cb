import hashlib
import json
import os
import re

import pytest

from pyspark.sql import functions as F

from quire.operators import store as S
from quire.operators.graph import graph_delete
from quire.plans.ingest import ingest_documents, write_ingested
from quire.plans.retrieve import load_corpus, retrieve
from quire.sources import files
from quire.sources import views as V


def test_scan_corpus(spark, tmp_path):
    for name, body in {"a.pdf": b"one", "b.PDF": b"two", "c.txt": b"no", "pdf": b"no"}.items():
        (tmp_path / name).write_bytes(body)
    got = {r.path.rsplit("/", 1)[1]: r.doc_id for r in files.scan_corpus(spark, str(tmp_path)).collect()}
    assert got == {n: hashlib.sha256(b).hexdigest()[:16] for n, b in (("a.pdf", b"one"), ("b.PDF", b"two"))}


def test_toc_json_in_both_encodings(spark, tmp_path):
    entries = [{"title": "Über", "page_label": "1", "level": "chapter"}, {"title": "B", "page_label": None, "level": "unknown"}]
    (tmp_path / "a.json").write_text(json.dumps(entries, indent=1), encoding="utf-8")
    (tmp_path / "b.json").write_text(json.dumps(entries[:1], ensure_ascii=False), encoding="utf-16")
    got = files.read_toc_json(spark, str(tmp_path)).collect()
    assert sorted((r.path[-6:], r.title, r.page_label) for r in got) == [
        ("a.json", "B", None), ("a.json", "Über", "1"), ("b.json", "Über", "1")]


def test_merge_table_rewrites_only_what_it_must(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(100).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("v"), F.col("id").alias("x"))
    S.merge_table(spark, path, rows, ["k"], "v", buckets=8)
    before = {p.name for p in (tmp_path / "t").rglob("*.parquet")}
    S.merge_table(spark, path, rows.where("k = '7'").withColumns({"v": F.lit(2), "x": F.lit(-1).cast("long")}), ["k"], "v", buckets=8)
    out = spark.read.parquet(path)
    assert out.count() == 100 and out.where("k = '7'").first().x == -1
    after = {p.name for p in (tmp_path / "t").rglob("*.parquet")}
    assert len(before & after) >= len(before) - 2 and before != after


def test_json_keeps_nulls(spark, tmp_path):
    files.write_json(spark.createDataFrame([("a", None)], "x string, y string"), str(tmp_path / "j"))
    written = "".join(p.read_text() for p in (tmp_path / "j").glob("*.json"))
    assert written.strip() == '{"x":"a","y":null}'


def test_csv_export_appends(spark, tmp_path):
    reg = spark.createDataFrame([("a", "A"), ("b", "B")], "doc_id string, title string")
    path = str(tmp_path / "out")
    files.append_csv(reg.limit(1), path)
    done = spark.read.option("header", True).csv(path)
    files.append_csv(S.new_rows(reg, done), path)
    assert spark.read.option("header", True).csv(path).count() == 2


def test_paginate_clamps(spark):
    df = spark.range(25)
    assert [r.id for r in S.paginate(df, [F.col("id")], 99).orderBy("id").collect()] == [20, 21, 22, 23, 24]
    assert S.paginate(df, [F.col("id")], -1).count() == 10


def test_pages_read_the_same_number_of_ranges(spark):
    df = spark.range(5000).select(((F.col("id") * 7919) % 5000).alias("id"), F.lit("x").alias("_r")).repartition(6)
    listed = S.listing(df, [F.col("id").desc()], range_rows=400)
    assert sum(listed.counts) == 5000 and max(listed.counts) < 1200 and len(listed.counts) == 13
    read = []
    for page in (1, 2, 250, 499, 500, 9999):
        out = listed.page(page)
        at = min(page, 500)
        assert [r.id for r in out.orderBy(F.col("id").desc()).collect()] == [5000 - 10 * (at - 1) - i - 1 for i in range(10)]
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "_range" in plan.split("PartitionFilters: [")[1].split("], Pushed")[0]
        low, high = [int(x) for x in re.findall(r"_range#\d+ [<>]= (\d+)", plan)[:2]]
        read.append(high - low + 1)
    assert max(read) <= 2 and read[0] == 1
    assert listed.page(3, 2000).count() == 1000 and S.listing(df.where("false"), [F.col("id")]).page(4).count() == 0


def test_hub_nodes_take_no_part_in_the_lookup(spark):
    """A third of all edges ends in one shared node."""
    nodes = spark.createDataFrame([("Chunk", f"c{i}", f"d{i % 30}", None) for i in range(300)] + [("Emotion", "Neutral", None, "Neutral")],
                                  "label string, key string, doc_id string, name string")
    edges = spark.createDataFrame([("HAS_EMOTION", f"c{i}", "Neutral") for i in range(300)] + [("NEXT", f"c{i}", f"c{i + 1}") for i in range(299)],
                                  "rel string, src string, dst string")
    left_nodes, left = graph_delete(nodes, edges, spark.createDataFrame([("d3",), ("d4",), ("x",)], "doc_id string"))
    gone = {f"c{i}" for i in range(300) if i % 30 in (3, 4)}
    assert {tuple(r) for r in left.collect()} == {tuple(r) for r in edges.collect() if r.src not in gone and r.dst not in gone}
    assert left.count() == 280 + 299 - 30 and left_nodes.count() == 281


def test_contents_of_many_documents_in_few_files(spark, tmp_path):
    rows = [(f"d{i % 40}/ü", i // 40, f"T{i}", None if i % 3 else str(i), "chapter") for i in range(9000)]
    df = spark.createDataFrame(rows, "doc_id string, pos long, title string, page_label string, level string").repartition(5)
    files.write_toc_lines(df, str(tmp_path / "toc"))
    got = files.read_toc_lines(spark, str(tmp_path / "toc"))
    assert sorted(map(str, got.select(*df.columns).collect())) == sorted(map(str, df.collect()))
    written = [n for n in os.listdir(tmp_path / "toc") if n.startswith("part-")]
    assert len(written) <= 8 and "_SUCCESS" in os.listdir(tmp_path / "toc")
    broken = df.withColumn("title", F.when(F.col("pos") == 100, F.raise_error(F.lit("lost"))).otherwise(F.col("title")))
    with pytest.raises(Exception, match="lost"):
        files.write_toc_lines(broken, str(tmp_path / "broken"))
    assert not os.path.exists(tmp_path / "broken") or not [n for n in os.listdir(tmp_path / "broken") if not n.startswith(("_", "."))]


def test_cascade_and_written_tables(spark, sf_dir, tmp_path):
    spans = V.spans(spark, sf_dir)
    done = ingest_documents(spans)
    write_ingested(done, str(tmp_path))
    n = done.corpus.chunks.count()
    assert spark.read.parquet(f"{tmp_path}/chunks").count() == n == spark.read.parquet(f"{tmp_path}/vectors").count()
    stored, asked = load_corpus(spark, str(tmp_path)), V.queries(spark, sf_dir)
    cols = ["query_id", "rank", "chunk_id", "rerank_score"]
    assert sorted(map(tuple, retrieve(asked, stored).select(*cols).collect())) == sorted(
        map(tuple, retrieve(asked, done.corpus).select(*cols).collect()))
    outcome = spark.createDataFrame([("3", 0, "deleted"), ("none", 1, "document not found")], "doc_id string, pos int, outcome string")
    left = S.cascade_delete(outcome, spark.createDataFrame([("3",), ("4",)], "doc_id string"),
                            done.corpus.vectors, done.nodes, done.edges)
    assert [r.doc_id for r in left["registry"].collect()] == ["4"]
    assert left["vectors"].where("doc_id = '3'").count() == 0 and left["nodes"].where("doc_id = '3'").count() == 0
    keys = left["nodes"].select("key")
    assert left["edges"].join(keys, F.col("src") == F.col("key"), "left_anti").count() == 0
    assert left["nodes"].where("label = 'Emotion'").count() == done.nodes.where("label = 'Emotion'").count()
