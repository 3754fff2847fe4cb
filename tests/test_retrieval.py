import math
import random
import re
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.catalog import retrieval as RQ
from quire.functions.vectors import distance_to_score
from quire.operators import candidates as K
from quire.operators import citations as CI
from quire.operators import nearest
from quire.operators import search as S
from quire.operators.nearest import knn_join
from quire.plans.retrieve import retrieve
from quire.session import materialise


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(60, 8)).round(3)
    # A third of the chunks are copies of one vector.
    rows = [(f"d{i % 5}", f"c{i:03d}", [float(x) for x in (base[0] if i % 3 == 0 else base[i])]) for i in range(60)]
    queries = [(f"q{i}", [float(x) for x in base[i]]) for i in range(12)]
    return (spark.createDataFrame(queries, "query_id string, embedding array<double>"),
            spark.createDataFrame(rows, "doc_id string, chunk_id string, embedding array<double>").repartition(4), queries, rows)


def brute(queries, rows, k, metric):
    out = []
    for qid, q in queries:
        q, scored = np.array(q), []
        for doc, cid, c in rows:
            c = np.array(c)
            s = {"cosine": q @ c / np.linalg.norm(q) / np.linalg.norm(c), "ip": q @ c,
                 "l2": 1 / (1 + ((q - c) ** 2).sum())}[metric]
            scored.append((-round(s, 6), cid))
        out += [(qid, cid, i + 1) for i, (_, cid) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.mark.parametrize("metric", ["cosine", "l2", "ip"])
@pytest.mark.parametrize("block_bytes", [8 << 20, 8 * 8 * 7])
def test_knn_is_exact(vectors, metric, block_bytes):
    """One block, and blocks of seven vectors."""
    q, c, queries, rows = vectors
    got = knn_join(q, c, 4, metric, block_bytes=block_bytes)
    assert sorted((r.query_id, r.chunk_id, r["rank"]) for r in got.collect()) == brute(queries, rows, 4, metric)


def test_knn_without_queries(vectors):
    q, c, _, _ = vectors
    assert knn_join(q.where("false"), c, 3).count() == 0


def test_knn_passes_over_far_blocks(spark):
    """Clusters far apart: almost all queries find their neighbours in one block, and need no other."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(10, 6)) * 50
    x = np.repeat(centres, 40, 0) + rng.normal(size=(400, 6))
    chunks = spark.createDataFrame([("d", f"c{i:03d}", v.tolist()) for i, v in enumerate(x)], "doc_id string, chunk_id string, embedding array<double>")
    queries = spark.createDataFrame([(f"q{i}", (x[i * 7] + 0.1).tolist()) for i in range(50)], "query_id string, embedding array<double>")
    searched, search = [], nearest._search

    def watched(asked, *rest):
        searched.append(asked.count())
        return search(asked, *rest)
    nearest._search = watched
    try:
        got = {(r.query_id, r.chunk_id) for r in knn_join(queries, chunks, 3, "l2", block_bytes=8 * 6 * 20).collect()}
    finally:
        nearest._search = search
    want = {(f"q{i}", f"c{j:03d}") for i in range(50) for j in np.argsort(((x - x[i * 7] - 0.1) ** 2).sum(1))[:3]}
    assert got == want and searched[0] == 50 and sum(searched) < 50 * 20 / 4


def test_knn_zero_vectors(spark):
    rows = [("d", f"c{i}", v) for i, v in enumerate([[0.0, 0.0], [1.0, 0.0], [-1.0, 0.0], [0.0, 2.0], [0.0, 0.0], [3.0, 0.1]])]
    chunks = spark.createDataFrame(rows, "doc_id string, chunk_id string, embedding array<double>")
    queries = spark.createDataFrame([("z", [0.0, 0.0]), ("x", [2.0, 0.0])], "query_id string, embedding array<double>")
    for metric in ("cosine", "l2", "ip"):
        few = knn_join(queries, chunks, 4, metric, block_bytes=32).collect()
        assert sorted(map(tuple, few)) == sorted(map(tuple, knn_join(queries, chunks, 4, metric).collect()))


def test_distance_to_score(spark):
    df = spark.createDataFrame([(0.25, "cosine"), (0.25, "l2"), (0.25, "ip")], "d double, m string")
    assert [r[0] for r in df.select(distance_to_score(F.col("d"), F.col("m"))).collect()] == [0.75, 0.8, 0.25]


def test_score_scale(spark):
    df = spark.createDataFrame([(3.0,), (9.0,), (None,)], "s double")
    assert [round(r[0], 6) for r in df.select(S.fulltext_score_scale(F.col("s"))).collect()] == [0.7, 1.0, 0.6]


def test_keywords_agree_with_brute_force(spark, sf_dir):
    chunks = RQ.corpus(spark, sf_dir).chunks
    words = spark.createDataFrame([(f"q{i % 7}", w) for i, w in enumerate(
        ["the", "eau", "on", "idiot", "ßßß", "tion", "en d", "ing.", "zzz", "ER"])], "query_id string, term string")
    texts = [(r.chunk_id, r.text.lower()) for r in chunks.select("chunk_id", "text").collect()]
    want = {(w.query_id, c) for w in words.collect() for c, t in texts if w.term in t}
    for salt_rows in (1 << 20, 3):
        got = S.keyword_theta_join(words, chunks, salt_rows).select("query_id", "chunk_id").collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_keyword_join_is_a_plan_without_python(spark, sf_dir):
    words = spark.createDataFrame([("q", "fever")], "query_id string, term string")
    plan = S.keyword_theta_join(words, RQ.corpus(spark, sf_dir).chunks)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_keywords_on_odd_texts(spark):
    texts = [("c1", "Aaaa"), ("c2", ""), ("c3", None), ("c4", "x\ny 😀😀z"), ("c5", "ab" * 50_000), ("c5", "ab" * 50_000)]
    terms = [("q1", "aa"), ("q1", "a"), ("q2", "\ny"), ("q2", "😀z"), ("q3", "😀😀z"), ("q4", ""), ("q5", None), ("q6", "bab"), ("q6", "zab"), ("q7", "aaaaa")]
    chunks = spark.createDataFrame([("d", c, t) for c, t in texts], "doc_id string, chunk_id string, text string")
    words = spark.createDataFrame(terms, "query_id string, term string")
    want = {(q, c) for q, w in terms if w for c, t in texts if t and w in t.lower()}
    for salt_rows in (1 << 20, 1):
        got = [(r.query_id, r.chunk_id) for r in S.keyword_theta_join(words, chunks, salt_rows).collect()]
        assert len(got) == len(want) and set(got) == want
    assert S.keyword_theta_join(words.where("false"), chunks).count() == 0 == S.keyword_theta_join(words, chunks.where("false")).count()


def bm25_by_hand(texts, terms, k):
    """Every chunk scored for every query."""
    words = {c: t.lower().split() for _, c, t in texts}
    n, average = len(words), sum(map(len, words.values())) / len(words)
    out = []
    for q in sorted({q for q, _ in terms}):
        scored = []
        for c, ws in words.items():
            score, hit = 0.0, False
            for t in {t for x, t in terms if x == q}:
                df, tf = sum(t in w for w in words.values()), ws.count(t)
                if tf:
                    hit = True
                    score += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / average))
            if hit:
                scored.append((-round(score, 6), c))
        out += [(q, i + 1, c, -s) for i, (s, c) in enumerate(sorted(scored)[:k])]
    return out


@pytest.fixture(scope="module")
def corpus_texts():
    """Common and rare words, many equal texts, and one document with a third of all chunks."""
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    texts = [" ".join(rng.choices(vocabulary, weights, k=rng.randint(3, 25))) for _ in range(400)] + ["w1 w2 w3 w30"] * 200
    return [("big" if i % 3 == 0 else f"d{i % 50}", f"c{i:04d}", t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("block_chunks", [4, 256])
def test_block_max_search_is_exact(spark, corpus_texts, block_chunks):
    terms = [("a", "w1"), ("a", "w30"), ("b", "w59"), ("b", "w0"), ("c", "w2"), ("d", "nowhere"), ("e", "w40"), ("e", "w41"), ("e", "w3"), ("e", "w3")]
    chunks = spark.createDataFrame(corpus_texts, "doc_id string, chunk_id string, text string")
    index = S.stored_index(S.build_index(chunks, block_chunks), spark)
    asked = spark.createDataFrame(terms, "query_id string, term string")
    for k in (1, 7, 250):
        got = sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in S.bm25_search(asked, index, k).collect())
        assert got == sorted(bm25_by_hand(corpus_texts, terms, k))
    every = S.bm25_search(asked, index).collect()
    assert sorted((r.query_id, r.chunk_id, r.score) for r in every) == sorted((q, c, s) for q, _, c, s in bm25_by_hand(corpus_texts, terms, 10_000))


def test_search_reads_few_blocks_and_folders(spark, corpus_texts):
    """A rare word beside a frequent one: most blocks hold the frequent one only and cannot win."""
    texts = [(f"d{i}", f"c{i:05d}", "common " * (1 + i % 3) + f"filler{i % 7} " * 20) for i in range(3000)]
    texts[17] = ("d17", "c00017", "rare rare common")
    texts[1200] = ("d1200", "c01200", "rare common")
    chunks = spark.createDataFrame(texts, "doc_id string, chunk_id string, text string")
    index = S.stored_index(S.build_index(chunks), spark)
    asked = spark.createDataFrame([("q", "rare"), ("q", "common")], "query_id string, term string")
    bounds = S.block_bounds(asked, index, 2)
    first = S.fulltext_overfetch(S._block_hits(bounds.where("first"), index), 2, 1)
    read = bounds.where("first").drop("first").unionByName(S.blocks_left(bounds, first, 2).drop("first"))
    words = read.select("block", F.explode("terms.term").alias("term"))
    rows = index.postings.join(words, ["term", "block"]).count()
    every = index.postings.where("term in ('rare', 'common')").count()
    assert every == 3002 and rows < every / 10
    assert [r.chunk_id for r in S.bm25_search(asked, index, 2).orderBy("rank").collect()] == ["c00017", "c01200"]
    # The scans open the folders of the two terms only.
    pruned = S.for_terms(index, asked)
    for table in (pruned.postings, pruned.maxima):
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"PartitionFilters: \[[^\]]*term_bucket#\d+ (IN \(|= )", plan)
    opened = [f for f in index.postings.inputFiles() if any(f"/term_bucket={r[0]}/" in f for r in asked.select(S.term_bucket()).collect())]
    assert 0 < len(opened) <= 2 < len(index.postings.inputFiles())


@pytest.mark.parametrize("mode", ["vector", "graph", "hybrid"])
def test_modes_and_filters(spark, sf_dir, mode):
    corpus, queries = RQ.corpus(spark, sf_dir), RQ.query_rows(spark, sf_dir)
    out = retrieve(queries, corpus, mode=mode, top_k=4, filters={"page_physical": 1}).collect()
    assert out and all(r.page_physical == 1 and r["rank"] <= 4 for r in out)
    with pytest.raises(ValueError):
        retrieve(queries, corpus, mode="other")


def test_keyword_fallback(spark, sf_dir):
    """A term that is no whole word has no full-text hit and is found as a substring."""
    corpus = RQ.corpus(spark, sf_dir)
    word = max(corpus.chunks.first().text.lower().split(), key=len).strip(".,")[1:-1]
    asked = spark.createDataFrame([("q", word)], "query_id string, query string")
    out = retrieve(asked, corpus, mode="graph").collect()
    assert out and any(r.source == "graph_keyword" for r in out)


def test_dedup_keeps_the_best(spark):
    rows = [("q", "d", "c", 0.5, 1), ("q", "d", "c", 0.9, 2), ("q", "d", "c", 0.9, 3), ("q", None, "c", 1.0, 4), ("q", "", "c", 1.0, 5)]
    df = spark.createDataFrame(rows, "query_id string, doc_id string, chunk_id string, score double, ord int")
    assert [r.ord for r in K.best_per_key(df, order=[F.col("ord")]).collect()] == [2]


def test_rerank_without_scores_keeps_the_order(spark):
    rows = [("q", "x", "d", f"c{i}", 1.0 - i / 10, "t") for i in range(4)]
    df = spark.createDataFrame(rows, "query_id string, query string, doc_id string, chunk_id string, score double, text string")
    out = K.rerank_topk(df, 3, scorer=lambda q, t: F.lit(None).cast("double"))
    assert [r.chunk_id for r in out.orderBy("rank").collect()] == ["c0", "c1", "c2"]


def test_citations(spark):
    rows = [("q", 1, "ab", "c1", "vector", "Ch", "S", None, None, 3), ("q", 2, "ab", "c2", "vector", " ch ", "s", None, None, 3),
            ("q", 3, "zz", "c3", "None", "", "None", None, None, 4), ("q", 4, "", "", "", "", "", "", "", None)]
    df = spark.createDataFrame(rows, "query_id string, rank int, doc_id string, chunk_id string, source string, chapter string,"
                                     "subheading string, emotion string, page_label string, page_physical int")
    registry = spark.createDataFrame([("abcd000000000000", "x/b.pdf"), ("abff000000000000", "x/a.pdf")], "doc_id string, source_path string")
    got = CI.citations(df, registry).first().citations
    assert [(c.id, c.document.name, c.chunk_id, c.source) for c in got] == [
        ("CIT-001", "a.pdf", "c1", "vector"), ("CIT-002", None, "c3", None)]


def test_filtered_search_scores_like_the_whole_index(spark):
    texts = [("d1", "c1", "fever and cough"), ("d1", "c2", "fever"), ("d2", "c3", "rest and tea"), ("d2", "c4", "fever tea rest")]
    chunks = spark.createDataFrame(texts, "doc_id string, chunk_id string, text string")
    terms = spark.createDataFrame([("q", "fever"), ("q", "tea")], "query_id string, term string")
    index = S.build_index(chunks)
    every = {r.chunk_id: r.score for r in S.bm25_search(terms, index).collect()}
    kept = replace(index, within=chunks.where("doc_id = 'd2'").select("chunk_id"))
    some = {r.chunk_id: r.score for r in S.bm25_search(terms, kept).collect()}
    assert set(every) == {"c1", "c2", "c3", "c4"} and some == {c: every[c] for c in ("c3", "c4")}


def test_postings_are_counted_where_the_block_is(spark, corpus_texts):
    """Texts are dealt out by block; counts and postings are not dealt out again, neither by the build nor by a search."""
    chunks = spark.createDataFrame(corpus_texts, "doc_id string, chunk_id string, text string")
    index = S.build_index(chunks)
    for table in (index.grouped, index.postings):
        plan = table._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
        assert re.findall(r"Exchange hashpartitioning\((\w+)#", plan) == ["block"]
    stored = S.stored_index(index, spark)
    assert "chunk_id" not in stored.postings.columns
    asked = spark.createDataFrame([("q", "w1"), ("r", "w1"), ("r", "w2")], "query_id string, term string")
    hits = S._block_hits(materialise(S.block_bounds(asked, stored, None)), stored)
    plan = hits._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert not re.search(r"hashpartitioning\((query_id|doc_id|chunk_id|row)#", plan)


def test_chunk_rows_that_repeat(spark):
    """A chunk that comes twice counts its words twice, and ids may be missing."""
    texts = [("d1", "c1", "fever tea"), ("d1", "c1", "fever tea"), (None, "c2", "fever"), ("d2", None, "tea")]
    chunks = spark.createDataFrame(texts, "doc_id string, chunk_id string, text string")
    index = S.stored_index(S.build_index(chunks), spark)
    assert index.lengths.count() == 4
    assert sorted(r.tf for r in index.postings.where("term = 'fever'").collect()) == [1, 2]


def test_keyword_pairs_move_as_one_row_per_chunk(spark):
    chunks = spark.createDataFrame([("d", f"c{i}", "fever and cough") for i in range(9)], "doc_id string, chunk_id string, text string")
    words = spark.createDataFrame([("q", "fever"), ("q", "cough"), ("r", "ough")], "query_id string, term string")
    got = S.keyword_theta_join(words, chunks)
    assert got.count() == 18 and "collect_set(term" in got._jdf.queryExecution().executedPlan().toString()


def test_knn_blocks_do_not_multiply(spark):
    """Blocks of two vectors would be 300; every query would be copied to most of them."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 8))
    rows = [("d", f"c{i:03d}", v.tolist()) for i, v in enumerate(x)]
    queries = [(f"q{i}", x[i * 9].tolist()) for i in range(20)]
    seen, search = [], nearest._search

    def watched(asked, chunks, *rest):
        seen.append(chunks.select("block").distinct().count())
        return search(asked, chunks, *rest)
    nearest._search = watched
    try:
        got = knn_join(spark.createDataFrame(queries, "query_id string, embedding array<double>"),
                       spark.createDataFrame(rows, "doc_id string, chunk_id string, embedding array<double>"), 4, "l2", block_bytes=2 * 8 * 8).collect()
    finally:
        nearest._search = search
    assert sorted((r.query_id, r.chunk_id, r["rank"]) for r in got) == brute(queries, rows, 4, "l2")
    assert max(seen) <= 2 * nearest.MOST_BLOCKS


def test_lengths_of_the_index_move_without_texts(spark):
    """F2-F22: names and lengths are numbered as the postings are, and no text is dealt out for them."""
    rows = [(f"c{i}", f"d{i % 3}", None, "a " * (i + 1) + f"w{i}") for i in range(20)]
    index = S.build_index(spark.createDataFrame(rows, "chunk_id string, doc_id string, emotion string, text string"), block_chunks=4, buckets=2)
    plan = index.lengths._jdf.queryExecution().optimizedPlan().toString()
    dealt = plan[plan.index("RepartitionByExpression"):].splitlines()[1]
    assert "Project" in dealt and "text" not in dealt.split(" AS ")[-1] and "length" in dealt
    lengths = {(r.block, r.row): r for r in index.lengths.collect()}
    assert sorted((r.chunk_id, r.length) for r in lengths.values()) == sorted((f"c{i}", i + 2) for i in range(20))
    for p in index.postings.where("term <> 'a'").collect():
        assert lengths[p.block, p.row].chunk_id == "c" + p.term[1:] and lengths[p.block, p.row].doc_id == p.doc_id


def test_boosts_read_the_texts_of_hits_only(spark, sf_dir):
    """the chunk table itself takes no part in the last joins."""
    chunks = set(RQ.corpus(spark, sf_dir).chunks.inputFiles())
    assert not chunks & set(RQ.rank_boost(spark, sf_dir).inputFiles())


def test_deletes_read_the_edges_once(spark):
    """neither end repeats the edges; hubs stay, though an edge to one may start in what goes."""
    from quire.operators import graph as G
    nodes = spark.createDataFrame([("Chunk", f"c{i}", f"d{i % 3}", None) for i in range(9)] + [("Emotion", "Joy", None, "Joy")],
                                  "label string, key string, doc_id string, name string")
    edges = spark.createDataFrame([("HAS_EMOTION", f"c{i}", "Joy") for i in range(9)] + [("NEXT", "c0", "c1"), ("NEXT", "c2", "c5"),
                                  ("BACK", "Joy", "c3"), ("BACK", "Joy", "c4"), ("NEXT", "c5", None)], "rel string, src string, dst string")
    kept, left = G.graph_delete(nodes, edges, spark.createDataFrame([("d0",)], "doc_id string"))
    assert {r.key for r in kept.collect()} == {"Joy", *(f"c{i}" for i in range(9) if i % 3)}
    want = [("HAS_EMOTION", f"c{i}", "Joy") for i in range(9) if i % 3] + [("NEXT", "c2", "c5"), ("BACK", "Joy", "c4"), ("NEXT", "c5", None)]
    assert sorted(map(tuple, left.collect()), key=repr) == sorted(want, key=repr)
    assert "Union" not in left._jdf.queryExecution().optimizedPlan().toString()


def test_postings_of_a_term_move_as_one_row(spark):
    """A search deals out a row per term and block, not one per posting, whether the index is grouped or not."""
    chunks = spark.createDataFrame([(f"d{i % 3}", f"c{i}", "fever " * (1 + i % 2) + f"w{i}") for i in range(40)],
                                   "doc_id string, chunk_id string, text string")
    index = S.stored_index(S.build_index(chunks, buckets=1), spark)
    asked = spark.createDataFrame([("q", "fever"), ("r", "fever"), ("r", "w7"), ("r", "none")], "query_id string, term string")
    assert S._found(index).where("term = 'fever'").count() == 1
    flat = replace(index, grouped=None)
    for few in (False, True):
        got = [sorted(S._block_hits(S.block_bounds(asked, i, 2), i, few).collect()) for i in (index, flat)]
        assert got[0] == got[1] and len(got[0]) == 80


def test_tables_between_steps_are_packed(spark, sf_dir):
    """Plain chunks are not written where only the labelled ones are asked for, and what is written is packed."""
    from quire.catalog import checks, layout
    here = f"{sf_dir}/."  # a key of its own
    labelled = checks.emo_chunks(spark, here)
    assert layout.chunks.built(spark, here) is None
    assert all(".zstd." in f for f in labelled.inputFiles())
    plain = layout.chunks(spark, here)
    assert layout.chunks.built(spark, here) is plain and labelled.count() == plain.count()


def test_keywords_meet_texts_by_word(spark):
    """the words of a text move, not its stretches of three characters, and no pair is dealt out to be made distinct."""
    texts = [("d1", "c1", "fever, and cough"), ("d1", "c1", "teapot"), (None, "c2", "Tea - pot"), ("d2", None, "tea"), ("d3", "c3", None), ("d4", "c4", " .. ")]
    chunks = spark.createDataFrame(texts, "doc_id string, chunk_id string, text string")
    whole = spark.createDataFrame([("q", "eve"), ("q", "cough"), ("r", "tea"), ("s", "pot"), ("s", "eapo"), ("t", "zzz")], "query_id string, term string")
    plan = S.keyword_theta_join(whole, chunks)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert "regexp_extract_all" not in plan and not re.search(r"hashpartitioning\([^)]*query_id#", plan)
    got = sorted(map(tuple, S.keyword_theta_join(whole, chunks).collect()), key=repr)
    assert got == sorted([("q", "d1", "c1"), ("r", "d1", "c1"), ("r", None, "c2"), ("s", "d1", "c1"), ("s", None, "c2")], key=repr)
    mixed = spark.createDataFrame([("q", "r, and"), ("r", "tea - p"), ("r", "tea-p"), ("s", ".."), ("t", "teapot"), ("u", " - ")], "query_id string, term string")
    for salt_rows in (1 << 20, 1):
        got = sorted(map(tuple, S.keyword_theta_join(mixed, chunks, salt_rows).collect()), key=repr)
        assert got == sorted([("q", "d1", "c1"), ("r", None, "c2"), ("s", "d4", "c4"), ("t", "d1", "c1"), ("u", None, "c2")], key=repr)


def test_search_keeps_what_is_asked(spark, corpus_texts):
    """F3-F23: postings of other words stay behind, and a task returns a query's best chunks only, ties and emotions in mind."""
    rows = [(d, c, "Joy" if i % 2 else None, t) for i, (d, c, t) in enumerate(corpus_texts)]
    chunks = spark.createDataFrame(rows, "doc_id string, chunk_id string, emotion string, text string")
    index = S.stored_index(S.build_index(chunks, block_chunks=16), spark)
    asked = spark.createDataFrame([("a", "w1", None), ("b", "w0", "Joy"), ("b", "w3", "Joy"), ("b", "none", "Joy")],
                                  "query_id string, term string, query_emotion string")
    held = S.asked_index(index, asked)
    assert {r.term for r in held.grouped.select("term").distinct().collect()} == {"w0", "w1", "w3"}
    assert held.grouped.count() == held.maxima.count() == index.grouped.where("term in ('w0', 'w1', 'w3')").count()
    bounds = materialise(S.block_bounds(asked, held, None))
    every = S._block_hits(bounds, held)
    best = {(r.query_id, r.chunk_id, r.score) for r in S.fulltext_overfetch(every, 5, 1).collect()}
    few = S._block_hits(bounds, held, k=5)
    assert few.count() < every.count() and best <= {(r.query_id, r.chunk_id, r.score) for r in few.collect()}
    assert every.where("query_id = 'b' and emotion is null").isEmpty() and not every.where("query_id = 'a' and emotion is null").isEmpty()
    got = {(r.query_id, r.chunk_id, r.score) for r in S.bm25_search(asked, index, 5).collect()}
    assert got == best
