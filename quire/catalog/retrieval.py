"""Vectors, full text, candidates and retrieval."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from quire.catalog import checks as CK
from quire.catalog import inputs as I
from quire.catalog.base import per_session, query, table
from quire.catalog.checks import emotion_sql, tokens_sql
from quire.functions import vectors as VF
from quire.operators import candidates as K
from quire.operators import search as S
from quire.operators.nearest import knn_join as nearest
from quire.plans import retrieve as P
from quire.session import materialise
from quire.sources import views as V


def embedded_sql(src: str, dst: str, text: str) -> str:
    """``src`` with its vector as ``embedding``."""
    buckets = f"list_transform({tokens_sql(text)}, lambda t: ('0x' || substr(md5(t), 1, 4))::integer % {VF.DIM})"
    return f"""{dst} as (select * exclude (bk, tf, nrm), list_transform(tf, lambda x: (case when nrm > 0 then x / nrm else x end)::float) as embedding
  from (select *, sqrt(list_sum(list_transform(tf, lambda x: x * x))) nrm from (
    select *, list_transform(range({VF.DIM}), lambda d: len(list_filter(bk, lambda b: b = d))::double) tf from (
      select *, {buckets} bk from {src}))))"""


COS = "round(list_cosine_similarity(q.embedding::double[], c.embedding::double[]), 6)"


@query("vector_normalize", """select vec_id, i - 1 as pos, round(x, 6) as value from (select vec_id, unnest(v) x,
  generate_subscripts(v, 1) i from (select vec_id, list_transform(w, lambda e: e / sqrt(list_sum(list_transform(w, lambda y: y * y)))) v
  from (select vec_id, list_transform(embedding, lambda e: e::double * 3) w from embeddings)))""")
def vector_normalize(spark, sf_dir):
    v = F.transform("embedding", lambda e: e.cast("double") * 3)
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.posexplode(VF.vector_normalize(v)).alias("pos", "value")).select(
        "vec_id", F.col("pos").cast("long").alias("pos"), F.round("value", 6).alias("value"))


@query("distance_to_score", """select vec_id, label, pos - 1 as pos, round(case label % 4 when 0 then 1 - d when 1 then 1 / (1 + d)
  when 2 then d else 1 - d end, 6) as score from (select vec_id, label, pos, abs(embedding[pos])::double d
  from (select *, unnest(generate_series(1, len(embedding))) as pos from embeddings))""")
def distance_to_score(spark, sf_dir):
    m = F.col("label") % 4
    metric = F.when(m == 0, "cosine").when(m == 1, "l2").when(m == 2, "ip").otherwise("other")
    d = F.abs(F.col("component")).cast("double")
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("pos", "component")).select(
        "vec_id", "label", F.col("pos").cast("long").alias("pos"), F.round(VF.distance_to_score(d, metric), 6).alias("score"))


@query("knn_join", f"""with {I.QUERY_VECTORS}, {I.CHUNK_VECTORS}, s as (select query_id, doc_id, chunk_id,
    list_distance(q.embedding::double[], c.embedding::double[]) ** 2 d from query_vectors q, chunk_vectors c),
  r as (select query_id, doc_id, chunk_id, round(d, 6) distance, round(1 / (1 + d), 6) score from s)
  select query_id, doc_id, chunk_id, distance, score, cast(k as integer) as rank from (
    select *, row_number() over (partition by query_id order by score desc, chunk_id) k from r) where k <= 20""")
def knn_join(spark, sf_dir):
    # Blocks of 64 vectors.
    return nearest(V.query_vectors(spark, sf_dir), V.chunk_vectors(spark, sf_dir), 20, metric="l2", block_bytes=64 * 64 * 8)


VTOP = f"""{I.QUERY_VECTORS}, {I.CHUNK_VECTORS}, vs as (select query_id, doc_id, chunk_id, {COS} score from query_vectors q, chunk_vectors c),
vtop as (select query_id, doc_id, chunk_id, score, cast(rank as integer) rank from (select *, row_number() over (
  partition by query_id order by score desc, chunk_id) rank from vs) where rank <= 5)"""


@query("vector_topk", f"with {VTOP} select * from vtop")
def vector_topk(spark, sf_dir):
    return nearest(V.query_vectors(spark, sf_dir), V.chunk_vectors(spark, sf_dir), 5).drop("distance")


# Candidate rows with copies, gaps and unreadable scores: every vector's five nearest, twice.
CAND = VTOP + """,
cand as (select query_id, case when rank = 4 and chunk_id like '%3' then null else doc_id end doc_id, chunk_id,
    case when chunk_id like '%7' then 'n/a' else cast(score as varchar) end as score, 'vector' as source,
    case when chunk_id like '%9' then null else 'text ' || chunk_id end as text, rank as ord from vtop
  union all select query_id, doc_id, chunk_id, cast(round(1.2 - score, 6) as varchar), 'graph', 'text ' || chunk_id, rank + 5 from vtop),
valid as (select * replace (try_cast(score as double) as score) from cand where try_cast(score as double) is not null
  and doc_id is not null and text is not null),
best as (select * exclude k from (select *, row_number() over (partition by query_id, doc_id, chunk_id order by score desc, ord) k from valid) where k = 1)"""


def cand(spark, sf_dir):
    v = vector_topk(spark, sf_dir)
    c, r = F.col("chunk_id"), F.col("rank")
    text = F.concat(F.lit("text "), c)
    first = v.select("query_id", F.when(~((r == 4) & c.endswith("3")), F.col("doc_id")).alias("doc_id"), "chunk_id",
                     F.when(c.endswith("7"), "n/a").otherwise(F.col("score").cast("string")).alias("score"),
                     F.lit("vector").alias("source"), F.when(~c.endswith("9"), text).alias("text"), r.alias("ord"))
    again = v.select("query_id", "doc_id", "chunk_id", F.round(1.2 - F.col("score"), 6).cast("string").alias("score"),
                     F.lit("graph").alias("source"), text.alias("text"), (r + 5).alias("ord"))
    return first.unionByName(again)


@query("candidate_schema_filter", f"with {CAND} select * from valid")
def candidate_schema_filter(spark, sf_dir):
    return K.candidate_schema_filter(cand(spark, sf_dir))


@query("best_per_key", f"with {CAND} select * from best")
def best_per_key(spark, sf_dir):
    return K.best_per_key(K.candidate_schema_filter(cand(spark, sf_dir)), order=[F.col("ord")])


@query("score_topk", f"""with {CAND} select query_id, doc_id, chunk_id, score, source, text, cast(rank as integer) rank from (
  select *, row_number() over (partition by query_id order by score desc, doc_id, chunk_id) rank from best) where rank <= 3""")
def score_topk(spark, sf_dir):
    return K.score_topk(cand(spark, sf_dir), 3, order=[F.col("ord")]).drop("ord")


@query("min_score_filter", f"with {CAND} select * from best where score >= 0.5")
def min_score_filter(spark, sf_dir):
    return K.min_score_filter(best_per_key(spark, sf_dir), 0.5)


@query("metadata_filter", f"with {CAND} select * from best where source = 'graph' and doc_id = 'd3'")
def metadata_filter(spark, sf_dir):
    return K.metadata_filter(best_per_key(spark, sf_dir), {"source": "graph", "doc_id": "d3"})


@query("retrieval_stats", f"""with {CAND} select query_id, count(*) result_count, count(distinct doc_id) unique_document_count,
  round_even(avg(score), 6) avg_score, round_even(max(score), 6) max_score, round_even(min(score), 6) min_score from best group by 1""")
def retrieval_stats(spark, sf_dir):
    return K.retrieval_stats(best_per_key(spark, sf_dir))


@query("text_embed", f"""with {embedded_sql('documents', 'e', 'text')} select doc_id, i - 1 as bucket, round(x::double, 6) as weight
  from (select doc_id, unnest(embedding) x, generate_subscripts(embedding, 1) i from e) where x > 0""")
def text_embed(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(VF.text_embed(F.col("text"))).alias("bucket", "w")).where("w > 0").select(
        "doc_id", F.col("bucket").cast("long").alias("bucket"), F.round(F.col("w").cast("double"), 6).alias("weight"))


CONCEPTS = f"""list_distinct(list_filter({tokens_sql('query')}, lambda t: length(t) > 3 and t not in ({", ".join(f"'{w}'" for w in S.STOP_WORDS)})))"""
CLEAN_CONCEPTS = "list_filter(list_transform(concepts, lambda c: regexp_replace(c, '[^a-zA-Z0-9_-]', '', 'g')), lambda c: c <> '')"
ASKED = f"""{I.QUERY_ROWS}, {emotion_sql('query_rows', 'q_emo', 'query')},
asked as (select query_id, query, {CONCEPTS} as concepts, nullif(emotion, 'Neutral') as query_emotion from q_emo)"""


@query("query_concepts", f"with {ASKED} select query_id, unnest(concepts) as concept from asked")
def query_concepts(spark, sf_dir):
    return V.queries(spark, sf_dir).select("query_id", F.explode(S.query_concepts(F.col("query"))).alias("concept"))


@query("concept_set", f"""with {I.QUERY_ROWS}, t as (select query_id, string_split(query, ' ') w from query_rows)
  select query_id, unnest(list_distinct(list_concat(list_transform(list_filter(w[1:8], lambda x: length(x) > 2), lambda x: lower(x)),
    list_transform(list_filter(w, lambda x: length(x) > 3), lambda x: lower(x))))) as concept from t""")
def concept_set(spark, sf_dir):
    w = F.split("query", " ")
    return V.queries(spark, sf_dir).select("query_id", F.explode(S.concept_set(F.slice(w, 1, 8), w)).alias("concept"))


@query("fulltext_terms", f"""with {ASKED} select query_id, array_to_string(list_transform(
  list_sort({CLEAN_CONCEPTS}), lambda c: '"' || c || '"'), ' OR ') as expression from asked""")
def fulltext_terms(spark, sf_dir):
    a = P.with_concepts(V.queries(spark, sf_dir))
    return a.select("query_id", S.fulltext_terms(F.array_sort(S.term_keys(F.col("concepts")))).alias("expression"))


# The corpus: cleaned chunks with emotions, their vectors, links and index. A query builds what it reads.
@per_session
def text_vectors(spark, sf_dir):
    return P.build_vectors(CK.emo_chunks(spark, sf_dir))


@per_session
def chunk_links(spark, sf_dir):
    return P.build_links(CK.emo_chunks(spark, sf_dir))


@per_session
def text_index(spark, sf_dir):
    return P.build_text_index(CK.emo_chunks(spark, sf_dir))


def corpus(spark, sf_dir):
    return replace(graph_corpus(spark, sf_dir), vectors=text_vectors(spark, sf_dir))


def graph_corpus(spark, sf_dir):
    """What a search without vectors reads."""
    return P.Corpus(CK.emo_chunks(spark, sf_dir), None, chunk_links(spark, sf_dir), text_index(spark, sf_dir))


def vector_corpus(spark, sf_dir):
    return P.Corpus(CK.emo_chunks(spark, sf_dir), text_vectors(spark, sf_dir), None, None)


@per_session
def query_rows(spark, sf_dir):
    return materialise(V.queries(spark, sf_dir))


CORPUS = CK.EMO + f""",
{ASKED},
qterms as (select distinct query_id, lower(t) as term from (select query_id, unnest({CLEAN_CONCEPTS}) t from asked)),
scoped as (select * from emo),
toks as (select chunk_id, doc_id, emotion, {tokens_sql('text')} w from emo),
lens as (select count(*) n, avg(len(w)) avgdl from toks),
postings as (select chunk_id, doc_id, emotion, term, dl, count(*) tf from (
   select chunk_id, doc_id, emotion, len(w) dl, unnest(w) term from toks) where term in (select term from qterms) group by 1, 2, 3, 4, 5),
dfs as (select term, count(*) df from postings group by 1),
bm as (select query_id, doc_id, chunk_id, any_value(emotion) emotion, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2
    / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) score
  from postings join dfs using (term) join qterms using (term), lens
  where chunk_id in (select chunk_id from scoped) group by 1, 2, 3),
ft as (select query_id, doc_id, chunk_id, emotion, score, cast(rank as integer) rank from (
  select bm.*, row_number() over (partition by query_id order by score desc, chunk_id) rank
  from bm join asked using (query_id) where query_emotion is null or query_emotion = bm.emotion))"""


@query("bm25_search", f"""with {CORPUS} select query_id, doc_id, chunk_id, score, cast(r as integer) rank from (
  select *, row_number() over (partition by query_id order by score desc, chunk_id) r from bm) where r <= 15""")
def bm25_search(spark, sf_dir):
    terms = P.fulltext_query(P.with_concepts(query_rows(spark, sf_dir))).drop("query_emotion")
    return S.bm25_search(terms, text_index(spark, sf_dir), 15).drop("emotion")


PRIMARY = CORPUS + """,
prim as (select query_id, doc_id, chunk_id, least(1.0, 0.4 + score / 10.0)::double score, 'graph_fulltext' as source, emotion, rank
  from ft where rank <= 45)"""


@query("fulltext_overfetch", f"with {CORPUS} select query_id, doc_id, chunk_id, emotion, score, rank from ft where rank <= 45")
def fulltext_overfetch(spark, sf_dir):
    a = P.with_concepts(query_rows(spark, sf_dir))
    return S.fulltext_overfetch(S.bm25_search(P.fulltext_query(a), text_index(spark, sf_dir), 45), 15).select("query_id", "doc_id", "chunk_id", "emotion", "score", "rank")


@query("fulltext_score_scale", f"with {PRIMARY} select query_id, chunk_id, round(score, 6) as score, source from prim")
def fulltext_score_scale(spark, sf_dir):
    a, c = P.with_concepts(query_rows(spark, sf_dir)), graph_corpus(spark, sf_dir)
    return P.graph_primary(a, c, 15).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "source")


@query("keyword_theta_join", f"""with {CK.EMO}, {ASKED}, words as (select distinct query_id, t as term from (
  select query_id, unnest(concepts) t from asked))
  select distinct query_id, doc_id, chunk_id from emo join words on contains(lower(text), term)""")
def keyword_theta_join(spark, sf_dir):
    a = P.with_concepts(query_rows(spark, sf_dir))
    return S.keyword_theta_join(a.select("query_id", F.explode("concepts").alias("term")), CK.emo_chunks(spark, sf_dir))


GRAPH = PRIMARY + """,
clinks as (select * from (select doc_id, lag(chunk_id) over (partition by doc_id order by chunk_no) src, chunk_id dst from emo) where src in (select chunk_id from scoped) and dst in (select chunk_id from scoped)),
csteps as (select src a, dst b from clinks union select dst, src from clinks),
g_one as (select query_id, chunk_id, b as near_id from prim join csteps on chunk_id = a where rank <= 5),
g_hops as (select * from g_one union select query_id, chunk_id, csteps.b from g_one join csteps on near_id = csteps.a),
g_near as (select distinct query_id, near_id from g_hops where near_id <> chunk_id),
g_exp as (select * from (select query_id, e.doc_id, e.chunk_id, row_number() over (partition by query_id order by e.chunk_id) k
   from g_near join emo e on e.chunk_id = near_id) where k <= 50),
g_all as (select query_id, doc_id, chunk_id, score, source, emotion, 0 as leg, rank from prim union all
  select query_id, doc_id, chunk_id, 0.7::double, 'graph_multihop', null, 1, null from g_exp),
g_merge as (select * exclude k from (select *, row_number() over (partition by query_id, doc_id, chunk_id order by score desc, leg, rank) k
  from g_all) where k = 1),
g_boost as (select m.query_id, m.doc_id, m.chunk_id, m.source, m.emotion, m.score
    + case when contains(lower(e.text), lower(a.query)) then 0.5 else 0 end
    + case when a.query_emotion = m.emotion then 0.6 else 0 end as score
  from g_merge m join emo e using (chunk_id) join asked a using (query_id) where e.text <> ''),
g_top as (select * from (select *, row_number() over (partition by query_id order by score desc, doc_id, chunk_id) rank from g_boost) where rank <= 15)"""


@query("graph_merge", f"with {GRAPH} select query_id, doc_id, chunk_id, round(score, 6) as score, source from g_merge")
def graph_merge(spark, sf_dir):
    a, c = P.with_concepts(query_rows(spark, sf_dir)), graph_corpus(spark, sf_dir)
    return P.graph_merge(a, c, 15).select("query_id", "doc_id", "chunk_id", F.round("score", 6).alias("score"), "source")


@query("rank_boost", f"with {GRAPH} select query_id, doc_id, chunk_id, round(score, 6) as score, source from g_boost")
def rank_boost(spark, sf_dir):
    a, c = P.with_concepts(query_rows(spark, sf_dir)), graph_corpus(spark, sf_dir)
    found = materialise(P.graph_merge(a, c, 15))
    m = found.join(P.fetch(found, c).select("chunk_id", "text"), "chunk_id").join(
        a.select("query_id", "query", "query_emotion"), "query_id")
    return K.rank_boost(m).select("query_id", "doc_id", "chunk_id", F.round("score", 6).alias("score"), "source")


@query("graph_retrieve", f"""with {GRAPH} select query_id, doc_id, chunk_id, round(score, 6) as score, source, emotion,
  cast(rank as integer) rank from g_top""")
def graph_retrieve(spark, sf_dir):
    return P.graph_retrieve(query_rows(spark, sf_dir), graph_corpus(spark, sf_dir), 15).select(
        "query_id", "doc_id", "chunk_id", F.round("score", 6).alias("score"), "source", "emotion", "rank")


def hybrid_sql(k: int) -> str:
    """Hybrid candidates for an initial size of ``k``."""
    base = GRAPH.replace("rank <= 45", f"rank <= {3 * k}").replace("where rank <= 15)", f"where rank <= {k})")
    return base + f""",
{embedded_sql('scoped', 'cvec', 'text')},
{embedded_sql('query_rows', 'qvec', 'query')},
v_top as (select query_id, doc_id, chunk_id, score, 'vector' as source, rank from (select *, row_number() over (
   partition by query_id order by score desc, chunk_id) rank from (
   select q.query_id, c.doc_id, c.chunk_id, {COS} score from qvec q, cvec c)) where rank <= {k}),
a_one as (select query_id, chunk_id, b as near_id from v_top join csteps on chunk_id = a where rank <= 10),
a_hops as (select * from a_one union select query_id, chunk_id, csteps.b from a_one join csteps on near_id = csteps.a),
around as (select distinct query_id, e.doc_id, e.chunk_id from a_hops join emo e on e.chunk_id = near_id where near_id <> a_hops.chunk_id),
h_all as (select query_id, doc_id, chunk_id, score, source, null as emotion, 0 as leg, rank from v_top
  union all select query_id, doc_id, chunk_id, score, source, emotion, 1, rank from g_top
  union all select query_id, doc_id, chunk_id, 0.7::double, 'graph_multihop', null, 2, null from around),
h_merge as (select * exclude k from (select *, row_number() over (partition by query_id, doc_id, chunk_id order by score desc, leg, rank) k
  from h_all) where k = 1)"""


def rerank_sql(k: int) -> str:
    q, t = f"list_distinct({tokens_sql('query')})", tokens_sql("text")
    return f"""r_scored as (select *, case when len({q}) > 0 then round(len(list_intersect({q}, {t})) / len({q})::double, 6)
    else 0.0::double end as rerank_score from (
  select h.query_id, h.doc_id, h.chunk_id, h.score, h.source, h.emotion, e.chapter, e.subheading, e.page_label, e.page_physical,
         substr(e.text, 1, 1024) as text, q.query from h_merge h join emo e using (chunk_id) join query_rows q using (query_id)
  where e.text <> '')),
results as (select * from (select *, row_number() over (partition by query_id order by rerank_score desc, score desc, doc_id, chunk_id) rank
  from r_scored) where rank <= {k})"""


HYBRID = hybrid_sql(15)
RETRIEVED = HYBRID + ",\n" + rerank_sql(8)
RESULT = """query_id, cast(rank as integer) as rank, doc_id, chunk_id, round(score, 6) as score, rerank_score, source, chapter, subheading,
  page_label, page_physical, emotion, text"""


@query("hybrid_merge", f"with {HYBRID} select query_id, doc_id, chunk_id, round(score, 6) as score, source from h_merge")
def hybrid_merge(spark, sf_dir):
    hits, _ = P.hybrid_candidates(query_rows(spark, sf_dir), corpus(spark, sf_dir), 15)
    return hits.select("query_id", "doc_id", "chunk_id", F.round("score", 6).alias("score"), "source")


@query("vector_threshold", f"""with {HYBRID} select query_id, v.doc_id, chunk_id, v.score, v.source, cast(row_number() over (
  partition by query_id order by v.rank) as integer) as rank from v_top v join emo e using (chunk_id) where v.score >= 0.2 and page_physical = 1""")
def vector_threshold(spark, sf_dir):
    """The nearest chunks, of which weak ones and those of later pages go after the search."""
    return P.vector_topk(query_rows(spark, sf_dir), vector_corpus(spark, sf_dir), 15, min_score=0.2, post_filter={"page_physical": 1})


@query("retrieve", f"with {RETRIEVED} select {RESULT} from results")
def retrieve(spark, sf_dir):
    return P.retrieve(query_rows(spark, sf_dir), corpus(spark, sf_dir)).withColumn("score", F.round("score", 6))


@per_session
def retrieved(spark, sf_dir):
    return materialise(retrieve(spark, sf_dir))


@query("retrieve_filtered", f"""with {RETRIEVED.replace('scoped as (select * from emo)', 'scoped as (select * from emo where page_physical = 1)')}
  select {RESULT} from results""")
def retrieve_filtered(spark, sf_dir):
    """The same search over chunks of first pages only."""
    return P.retrieve(query_rows(spark, sf_dir), corpus(spark, sf_dir), filters={"page_physical": 1}).withColumn(
        "score", F.round("score", 6))


@query("rerank_topk", f"with {RETRIEVED} select query_id, cast(rank as integer) as rank, chunk_id, rerank_score from results where rank <= 5")
def rerank_topk(spark, sf_dir):
    hits, texts = P.hybrid_candidates(query_rows(spark, sf_dir), corpus(spark, sf_dir), 15)
    full = hits.join(texts.select("chunk_id", "text"), "chunk_id").join(query_rows(spark, sf_dir), "query_id")
    return K.rerank_topk(full, 5).select("query_id", "rank", "chunk_id", "rerank_score")


@query("result_projection", f"""with {RETRIEVED} select query_id, cast(rank as integer) as rank, chunk_id, doc_id, source,
  round(score, 6) as score, rerank_score, text, substr(text, 1, 360) as preview from results""")
def result_projection(spark, sf_dir):
    return K.result_projection(retrieved(spark, sf_dir))


INTENTS = """q_intents as (select query_id, case cast(query_id as bigint) % 2 when 0 then 'medical' else 'book' end as intent from query_rows)"""


def with_intents(df):
    return df.withColumn("intent", F.when(F.col("query_id").cast("long") % 2 == 0, "medical").otherwise("book"))


@query("rerank_gate", f"""with {RETRIEVED}, {INTENTS} select query_id, intent, max(rerank_score) max_rerank_score,
  max(rerank_score) >= case intent when 'medical' then 0.18 else 0.05 end as passed from results join q_intents using (query_id) group by 1, 2""")
def rerank_gate(spark, sf_dir):
    return K.rerank_gate(with_intents(retrieved(spark, sf_dir)))


@query("has_valid_context", f"""with {RETRIEVED} select query_id, bool_or(rank > 5 and length(text) > 0) as has_context
  from results group by 1""")
def has_valid_context(spark, sf_dir):
    r = retrieved(spark, sf_dir)
    return K.has_valid_context(r.withColumn("text", F.when(F.col("rank") > 5, F.col("text"))))
