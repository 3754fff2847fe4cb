"""Validators and the document graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.catalog import inputs as I
from quire.catalog import layout as LQ
from quire.catalog.base import per_session, query, table
from quire.catalog.text import clean_sql
from quire.functions.emotion import LEXICON, emotion_of, prefix
from quire.functions.text import clean_text
from quire.operators import chunking as C
from quire.operators import classify as K
from quire.operators import graph as G
from quire.operators import validate as X
from quire.session import materialise
from quire.sources import files
from quire.sources import views as V

TOKENS = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


def tokens_sql(e):
    return TOKENS.format(e)


def emotion_sql(src: str, dst: str, text: str = "text") -> str:
    names = list(LEXICON)
    counts = ", ".join("len(list_filter(tok, lambda w: w in (" + ", ".join(f"'{c}'" for c in LEXICON[n]) + f"))) as c{i}"
                       for i, n in enumerate(names))
    top = "greatest(" + ", ".join(f"c{i}" for i in range(len(names))) + ")"
    case = f"case when {top} = 0 then 'Neutral' " + " ".join(
        f"when c{i} = {top} then '{n}'" for i, n in enumerate(names)) + " end"
    return f"""{dst} as (select * exclude (tok, {', '.join(f'c{i}' for i in range(len(names)))}), {case} as emotion
      from (select *, {counts} from (select *, {tokens_sql(f'substr({text}, 1, 800)')} tok from {src})))"""


EMO = LQ.FULL_CHUNKS + f""",
cleaned as (select * replace ({clean_sql('text')} as text) from chunks),
{emotion_sql('cleaned', 'emo')}"""


@per_session
def emo_chunks(spark, sf_dir):
    """The chunk table, cleaned and with emotions, as ingestion leaves it. Where no query has asked for the plain
    chunks they are not written first."""
    chunks = LQ.chunks.built(spark, sf_dir) or LQ.chunk_flow(spark, sf_dir)
    cleaned = chunks.withColumn("text", clean_text(F.col("text")))
    return materialise(K.emotion_label(cleaned))


@query("emotion_label", f"with {emotion_sql('documents', 'emo')} select doc_id, emotion from emo")
def emotion_label(spark, sf_dir):
    return K.emotion_label(table(spark, sf_dir, "documents")).select("doc_id", "emotion")


@query("distinct_classify_join", f"with {emotion_sql('documents', 'emo')} select doc_id, emotion from emo")
def distinct_classify_join(spark, sf_dir):
    return K.distinct_classify_join(table(spark, sf_dir, "documents"), prefix(F.col("text")), emotion_of,
                                    "emotion").select("doc_id", "emotion")


NODES = EMO + """,
named as (select doc_id, chunk_id, coalesce(chapter, 'Unknown') chapter, coalesce(subheading, 'Unknown') subheading,
    coalesce(emotion, 'Neutral') emotion from emo),
nodes as (select distinct * from (
  select 'Document' as label, doc_id as key, doc_id, null::varchar as name from named
  union all select 'Chapter', doc_id || '|' || chapter, doc_id, chapter from named
  union all select 'Subheading', doc_id || '|' || subheading, doc_id, subheading from named
  union all select 'Chunk', chunk_id, doc_id, null from named
  union all select 'Emotion', emotion, null, emotion from named)),
edges as (select distinct * from (
  select 'HAS_CHAPTER' as rel, doc_id as src, doc_id || '|' || chapter as dst from named
  union all select 'HAS_SUBHEADING', doc_id || '|' || chapter, doc_id || '|' || subheading from named
  union all select 'HAS_CHUNK', doc_id || '|' || subheading, chunk_id from named
  union all select 'HAS_EMOTION', chunk_id, emotion from named))"""


@query("graph_build_nodes", f"with {NODES} select * from nodes")
def graph_build_nodes(spark, sf_dir):
    return G.graph_build_nodes(emo_chunks(spark, sf_dir))


@query("graph_build_edges", f"with {NODES} select * from edges")
def graph_build_edges(spark, sf_dir):
    return G.graph_build_edges(emo_chunks(spark, sf_dir))


@query("graph_delete", f"""with {NODES}, gone as (select cast(doc_id as varchar) d from labels where toxic = 1),
  gone_keys as (select key from nodes where doc_id in (select d from gone))
  select 'node' as kind, label as a, key as b, '' as c from nodes where doc_id is null or doc_id not in (select d from gone)
  union all select 'edge', rel, src, dst from edges where src not in (select key from gone_keys)
    and dst not in (select key from gone_keys)""")
def graph_delete(spark, sf_dir):
    c = emo_chunks(spark, sf_dir)
    ids = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("doc_id"))
    nodes, edges = G.graph_delete(G.graph_build_nodes(c), G.graph_build_edges(c), ids)
    return nodes.select(F.lit("node").alias("kind"), F.col("label").alias("a"), F.col("key").alias("b"), F.lit("").alias("c")) \
        .unionByName(edges.select(F.lit("edge").alias("kind"), F.col("rel").alias("a"), F.col("src").alias("b"), F.col("dst").alias("c")))


@query("emotion_left_join", f"""with {NODES} select c.chunk_id, e.dst as emotion from emo c left join (select * from edges
  where rel = 'HAS_EMOTION' and dst <> 'Anger') e on e.src = c.chunk_id""")
def emotion_left_join(spark, sf_dir):
    c = emo_chunks(spark, sf_dir)
    edges = G.graph_build_edges(c).where("dst <> 'Anger'")
    return G.emotion_left_join(c.drop("emotion"), edges).select("chunk_id", "emotion")


LINKS = I.CHUNK_VECTORS + """,
links as (select doc_id, chunk_id as src, lead(chunk_id) over (partition by doc_id order by vec_id) as dst from chunk_vectors),
next_edges as (select * from links where dst is not null)"""


def vec_links(spark, sf_dir):
    v = V.chunk_vectors(spark, sf_dir)
    return C.next_links(v.select("doc_id", F.col("vec_id").alias("chunk_no"), "chunk_id"))


@query("link_endpoint_check", f"""with {I.CHUNK_VECTORS}, l as (select chunk_id src, cast(vec_id + vec_id % 3 * 200 as varchar) dst
  from chunk_vectors) select src, dst from l where src <> dst and dst in (select chunk_id from chunk_vectors)""")
def link_endpoint_check(spark, sf_dir):
    v = V.chunk_vectors(spark, sf_dir)
    links = v.select(F.col("chunk_id").alias("src"),
                     (F.col("vec_id") + F.col("vec_id") % 3 * 200).cast("string").alias("dst"))
    return G.link_endpoint_check(links, v)


STEPS = LINKS + """,
steps as (select src a, dst b from next_edges union select dst, src from next_edges)"""


def vec_chunks(spark, sf_dir):
    return V.chunk_vectors(spark, sf_dir).select("chunk_id", "doc_id", F.concat(F.lit("t"), "chunk_id").alias("text"))


# Every label asks with its own vectors as seeds, in id order.
@query("multihop_expand", f"""with {STEPS}, seeds as (select doc_id as query_id, chunk_id from (select *,
    row_number() over (partition by doc_id order by vec_id) r from chunk_vectors) where r <= 5),
  one as (select query_id, chunk_id, b as near_id from seeds join steps on chunk_id = a),
  hops as (select * from one union select query_id, chunk_id, steps.b from one join steps on near_id = steps.a),
  near as (select distinct query_id, near_id from hops where near_id <> chunk_id),
  r as (select query_id, doc_id, c.chunk_id, 't' || c.chunk_id as text, row_number() over (partition by query_id order by c.chunk_id) k
        from near join chunk_vectors c on c.chunk_id = near_id)
  select query_id, doc_id, chunk_id, text, 0.7::double as score, 'graph_multihop' as source from r where k <= 50""")
def multihop_expand(spark, sf_dir):
    from quire.operators.ordered import first_rows
    v = V.chunk_vectors(spark, sf_dir)
    seeds = first_rows(v, ["doc_id"], [F.col("vec_id")], 5, rank="rank").select(
        F.col("doc_id").alias("query_id"), "chunk_id", "rank")
    return G.multihop_expand(seeds, vec_links(spark, sf_dir), vec_chunks(spark, sf_dir))


@query("expand_chunk_context", f"""with {STEPS}, hits as (select 'q' || vec_id % 9 as query_id, chunk_id from chunk_vectors),
  one as (select query_id, chunk_id, b as near_id from hits join steps on chunk_id = a),
  hops as (select * from one union select query_id, chunk_id, steps.b from one join steps on near_id = steps.a)
  select distinct query_id, c.doc_id, c.chunk_id, 't' || c.chunk_id as text, 0.7::double as score, 'graph_multihop' as source
  from hops h join chunk_vectors s on s.chunk_id = h.chunk_id join chunk_vectors c on c.chunk_id = near_id and c.doc_id = s.doc_id
  where near_id <> h.chunk_id""")
def expand_chunk_context(spark, sf_dir):
    hits = V.chunk_vectors(spark, sf_dir).select(F.concat(F.lit("q"), F.col("vec_id") % 9).alias("query_id"), "chunk_id")
    return G.expand_chunk_context(hits, vec_links(spark, sf_dir), vec_chunks(spark, sf_dir))


STRUCTURE = NODES + """,
structure as (select s.dst as chunk_id, min(cn.name) chapter, min(sn.name) subheading from edges s
  join nodes sn on sn.key = s.src and sn.label = 'Subheading' join edges h on h.dst = s.src and h.rel = 'HAS_SUBHEADING'
  join nodes cn on cn.key = h.src and cn.label = 'Chapter' where s.rel = 'HAS_CHUNK' group by 1)"""


@query("structure_enrich", f"""with {STRUCTURE} select c.chunk_id, coalesce(case when chunk_no % 2 = 0 then c.chapter end, s.chapter) chapter,
  coalesce(case when chunk_no % 3 = 0 then c.subheading end, s.subheading) subheading from emo c left join structure s using (chunk_id)""")
def structure_enrich(spark, sf_dir):
    c = emo_chunks(spark, sf_dir)
    s = G.structure_of(G.graph_build_nodes(c), G.graph_build_edges(c))
    holes = c.select("chunk_id", F.when(F.col("chunk_no") % 2 == 0, F.col("chapter")).alias("chapter"),
                     F.when(F.col("chunk_no") % 3 == 0, F.col("subheading")).alias("subheading"))
    return G.structure_enrich(holes, s).select("chunk_id", "chapter", "subheading")


# Lines with gaps worked in.
FLAWED = I.LINES + """,
flawed as (select doc_id, cast(line_no as bigint) as item, text,
  case when line_no % 10 <> 3 then doc_id || ':' || (line_no - case when line_no % 6 = 5 then 1 else 0 end) end as chunk_id,
  case when line_no % 2 = 0 then 'ch' end as chapter, case when line_no % 5 <> 4 then 's' end as subheading,
  cast(null as varchar) as page_label, case when line_no % 8 = 7 then 'x' else '7' end as page_physical,
  case line_no % 4 when 0 then 'Neutral' when 1 then 'Joy' when 2 then '' end as emotion from lines)"""


def flawed(spark, sf_dir):
    n = F.col("line_no")
    return V.lines(spark, sf_dir).select(
        "doc_id", n.cast("long").alias("item"), "text",
        F.when(n % 10 != 3, F.concat("doc_id", F.lit(":"), n - F.when(n % 6 == 5, 1).otherwise(0))).alias("chunk_id"),
        F.when(n % 2 == 0, "ch").alias("chapter"), F.when(n % 5 != 4, "s").alias("subheading"),
        F.lit(None).cast("string").alias("page_label"),
        F.when(n % 8 == 7, "x").otherwise("7").alias("page_physical"),
        F.when(n % 4 == 0, "Neutral").when(n % 4 == 1, "Joy").when(n % 4 == 2, "").alias("emotion"))


def _list(*cases: str) -> str:
    return "array_to_string(list_filter([" + ", ".join(cases) + "], lambda x: x is not null), '; ')"


MISSING = "list_filter([" + ", ".join(f"case when {f} is null then '{f}' end" for f in X.VECTOR_FIELDS) + "], lambda x: x is not null)"


@query("missing_fields", f"with {FLAWED} select doc_id, item, array_to_string({MISSING}, ',') as missing from flawed")
def missing_fields(spark, sf_dir):
    f = X.missing_fields(X.present_fields(X.VECTOR_FIELDS), X.VECTOR_FIELDS)
    return flawed(spark, sf_dir).select("doc_id", "item", F.array_join(f, ",").alias("missing"))


@query("validate_vector_chunks", f"""with {FLAWED}, f as (select *, min(item) over (partition by chunk_id) fst from flawed)
  select doc_id, item, {_list(f"case when len({MISSING}) > 0 then 'missing required fields: ' || array_to_string({MISSING}, ', ') end",
    "case when chunk_id is null then 'missing chunk_id' end", "case when chunk_id is not null and fst < item then 'duplicate chunk_id' end",
    "case when text = '' then 'invalid text' end")} as errors,
  {_list("case when text <> '' and length(text) < 200 then 'below min_chars (200)' end",
    "case when page_physical = 'x' then 'page_physical not int' end")} as warnings from f""")
def validate_vector_chunks(spark, sf_dir):
    return X.validate_vector_chunks(flawed(spark, sf_dir), "item").select(
        "doc_id", "item", F.array_join("errors", "; ").alias("errors"), F.array_join("warnings", "; ").alias("warnings"))


@query("validate_graph_chunks", f"""with {FLAWED} select doc_id, item,
  {_list("case when coalesce(chunk_id, '') = '' then 'Missing required field: chunk_id' end",
         "case when coalesce(text, '') = '' then 'Missing required field: text' end",
         "case when chunk_id is null then 'chunk_id must be string' end",
         "case when page_physical = 'x' then 'page_physical must be integer' end")} as errors,
  {_list("case when chapter is null then 'Missing chapter' end", "case when subheading is null then 'Missing subheading' end",
         "case when coalesce(emotion, '') = '' then 'Emotion missing' when emotion <> 'Neutral' then 'Emotion not recognized' end",
         "case when chunk_id is not null and doc_id in (select cast(doc_id as varchar) from labels) then 'Document already exists' end")} as warnings,
  chunk_id is not null and text <> '' and page_physical <> 'x' as valid from flawed""")
def validate_graph_chunks(spark, sf_dir):
    known = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("doc_id"))
    return X.validate_graph_chunks(flawed(spark, sf_dir), known).select(
        "doc_id", "item", F.array_join("errors", "; ").alias("errors"),
        F.array_join("warnings", "; ").alias("warnings"), "valid")


@query("validation_report_stage", f"""with {FLAWED}, found as (
  select doc_id, 'style' as stage, 'error' as severity from flawed where subheading is null or chapter is null
  union all select doc_id, 'accumulator', 'warning' from flawed where length(text) < 100
  union all select doc_id, 'overlapper', 'warning' from flawed where length(text) < 150
  union all select doc_id, 'toc', 'error' from flawed where chapter is null
  union all select doc_id, 'toc', 'warning' from flawed where subheading is null
  union all select doc_id, 'toc', 'warning' from flawed group by doc_id having count(*) < 3)
  select stage, doc_id, count(*) filter (severity = 'error') n_errors, count(*) filter (severity = 'warning') n_warnings,
    case when count(*) filter (severity = 'error') > 0 then 'FAIL' else 'PASS' end as status from found group by 1, 2""")
def validation_report_stage(spark, sf_dir):
    f = flawed(spark, sf_dir)
    found = X.stage_findings(f.select("doc_id", "item", F.col("chapter").alias("type"), F.col("subheading").alias("text")),
                             "style", "item")
    for stage in ("accumulator", "overlapper"):
        found = found.unionByName(X.stage_findings(f, stage, "item"))
    toc = f.select("doc_id", "item", F.col("chapter").alias("title"), F.col("subheading").alias("level"))
    return X.validation_report_stage(found.unionByName(X.stage_findings(toc, "toc", "item")))


@query("json_sink", f"""with {I.LINES} select doc_id, line_no, '{{"doc_id":"' || doc_id || '","line_no":' || line_no ||
  ',"label":' || case when line_no % 2 = 0 then 'null' else '"p' || line_no || '"' end || '}}' as json from lines""")
def json_sink(spark, sf_dir):
    d = V.lines(spark, sf_dir).select("doc_id", "line_no", F.when(F.col("line_no") % 2 != 0, F.concat(
        F.lit("p"), "line_no")).alias("label"))
    return files.json_rows(d, ["doc_id", "line_no"])
