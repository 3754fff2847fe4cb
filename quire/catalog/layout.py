"""Layout, chunking and overlap queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.catalog import inputs as I
from quire.catalog.base import per_session, query, table
from quire.catalog.text import strip_sql
from quire.functions.text import SPACE
from quire.operators import chunking as C
from quire.operators import layout as L
from quire.plans.chunks import chunk_documents
from quire.session import materialise
from quire.sources import files
from quire.sources import views as V

STATS = I.SPANS + """,
stats as (select doc_id, size, count(*) n, min(page*1000000+line_no) first_seen from spans
  where """ + strip_sql("text") + """ <> '' and page <= 20 group by 1, 2)"""

SIZES = STATS + """,
ranked as (select *, row_number() over (partition by doc_id order by n desc, first_seen) r from stats),
sizes as (select doc_id, max(size) filter (r = 1) body_size,
   coalesce(max(size) filter (r = 2), max(size) filter (r = 1)) subheading_size,
   max(size) heading_size from ranked group by 1)"""

UNITS = SIZES + """,
heads as (select doc_id, lower(""" + strip_sql("text") + """) k, count(*) n from spans
  where """ + strip_sql("text") + """ <> '' and page <= 20 and (y0 < 80 or y1 > page_height - 80)
  group by 1, 2 having count(*) >= 10),
units as (select doc_id, page, line_no, t as text, size as font_size,
    (cast(page as bigint) << 24) + line_no as unit_no,
    case size when body_size then 'body' when subheading_size then 'subheading'
              when heading_size then 'heading' else 'body' end as type
  from (select *, """ + strip_sql("text") + """ as t from spans) join sizes using (doc_id)
  where t <> '' and (doc_id, lower(t)) not in (select (doc_id, k) from heads))"""

SECTIONS = UNITS + """,
sections as (select *, case when hd.type = 'subheading' then hd.text end as subheading,
    hd.page as section_page from (
  select *, cast(sum(case when type in ('heading','subheading') then 1 else 0 end) over w as bigint) as section,
    last_value(case when type = 'heading' then text end ignore nulls) over w as chapter,
    last_value(case when type in ('heading','subheading') then {'type': type, 'text': text, 'page': page} end
               ignore nulls) over w as hd
  from units window w as (partition by doc_id order by unit_no rows unbounded preceding)))"""

# The fill walks every section unit by unit.
CHUNKS = "recursive " + SECTIONS + """,
pieces as (select doc_id, section, row_number() over (partition by doc_id, section order by unit_no) i,
    chapter, subheading, coalesce(section_page, min(page) over (partition by doc_id, section)) page_physical,
    case when type = 'subheading' and chapter is not null then chapter || chr(10) || text else text end piece
  from sections),
fill as (
  select doc_id, section, i, length(piece) + 1 as len, 0 as part_no from pieces where i = 1
  union all
  select p.doc_id, p.section, p.i, case when f.len >= 1500 then 0 else f.len end + length(p.piece) + 1,
         f.part_no + case when f.len >= 1500 then 1 else 0 end
  from fill f join pieces p on p.doc_id = f.doc_id and p.section = f.section and p.i = f.i + 1),
parts as (select doc_id, section, part_no, max(chapter) chapter, max(subheading) subheading,
    min(page_physical) page_physical, string_agg(piece, chr(10) order by i) as text
  from fill join pieces using (doc_id, section, i) group by 1, 2, 3),
raw_chunks as (select doc_id, row_number() over (partition by doc_id order by coalesce(page_physical, 0),
    section, part_no) - 1 as chunk_no, chapter, subheading, page_physical, text from parts)"""


def overlap_sql(src: str, dst: str, sep: str) -> str:
    return f"""{dst} as (select doc_id, chunk_no, chapter, subheading, page_physical,
  coalesce(right(lag(text) over w, 300) || {sep}, '') || text || coalesce({sep} || left(lead(text) over w, 300), '')
  as text from {src} window w as (partition by doc_id order by chunk_no))"""


FULL_CHUNKS = CHUNKS + ",\n" + overlap_sql("raw_chunks", "pass1", "chr(10)") + ",\n" + \
    overlap_sql("pass1", "pass2", "' '") + """,
chunks as (select doc_id, chunk_no, sha256(doc_id || ':' || chunk_no) chunk_id, chapter, subheading,
    cast(null as varchar) as page_label, page_physical, text from pass2
  where length(""" + strip_sql("text") + ") >= 50)"


def raw_chunks(spark, sf_dir):
    return C.chunk_accumulate(L.styled_units(V.spans(spark, sf_dir)))


@query("font_stats", f"with {STATS} select doc_id, size, n from stats")
def font_stats(spark, sf_dir):
    return L.font_stats(V.spans(spark, sf_dir)).drop("first_seen")


TOC_END = """toc_end as (select cast(doc_id as varchar) doc_id, cast(1 + doc_id % 3 as integer) start_page
  from documents)"""


def toc_end(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"), (F.col("doc_id") % 3 + 1).cast("int").alias("start_page"))


POST_STATS = I.SPANS + ",\n" + TOC_END + """,
stats as (select doc_id, size, count(*) n, min(page*1000000+line_no) first_seen
  from spans join toc_end using (doc_id) where """ + strip_sql("text") + """ <> '' and page >= start_page group by 1, 2)"""


@query("font_stats_post_toc", f"with {POST_STATS} select doc_id, size, n from stats")
def font_stats_post_toc(spark, sf_dir):
    return L.font_stats(V.spans(spark, sf_dir), None, toc_end(spark, sf_dir)).drop("first_seen")


@query("header_footer_detect", f"""with {I.SPANS} select doc_id, lower({strip_sql('text')}) line_key, count(*) n
  from spans where {strip_sql('text')} <> '' and page <= 6 and (y0 < 80 or y1 > page_height - 80)
  group by 1, 2 having count(*) >= 3""")
def header_footer_detect(spark, sf_dir):
    return L.header_footer_detect(V.spans(spark, sf_dir), max_pages=6)


@query("header_footer_filter", f"""with {I.SPANS}, heads as (
  select doc_id, lower({strip_sql('text')}) k from spans where {strip_sql('text')} <> '' and page <= 6
  and (y0 < 80 or y1 > page_height - 80) group by 1, 2 having count(*) >= 3)
  select doc_id, page, line_no, {strip_sql('text')} as text from spans where {strip_sql('text')} <> ''
  and not exists (select 1 from heads where heads.doc_id = spans.doc_id and k = lower({strip_sql('text')}))""")
def header_footer_filter(spark, sf_dir):
    spans = V.spans(spark, sf_dir)
    heads = L.header_footer_detect(spans, max_pages=6)
    lines = L.line_units(spans).withColumn("line_key", F.lower("text"))
    return lines.join(heads, ["doc_id", "line_key"], "left_anti").select("doc_id", "page", "line_no", "text")


@query("page_band_filter", f"""with {I.SPANS} select doc_id, page, line_no, y0, y1 from spans
  where y1 < page_height * 0.2 or y0 > page_height * 0.8""")
def page_band_filter(spark, sf_dir):
    return L.page_band_filter(V.spans(spark, sf_dir)).select("doc_id", "page", "line_no", "y0", "y1")


@query("line_units", f"""with {I.SPLIT_SPANS} select * from (select doc_id, page, line_no,
  {strip_sql("string_agg(text, '' order by span_no)")} as text, round_even(avg(round_even(size, 1)), 1) as font_size
  from split_spans group by 1, 2, 3) where text <> ''""")
def line_units(spark, sf_dir):
    return L.line_units(V.split_spans(spark, sf_dir))


@query("style_sizes", f"with {SIZES} select doc_id, body_size, subheading_size, heading_size from sizes")
def style_sizes(spark, sf_dir):
    return L.style_sizes(L.font_stats(V.spans(spark, sf_dir)))


POST_SIZES = POST_STATS + """,
post_sizes as (select doc_id, max(size) chapter_size, max(size) filter (d = 2) subheading_size,
    max(size) filter (r = 1) body_size from (
  select *, dense_rank() over (partition by doc_id order by size desc) d,
         row_number() over (partition by doc_id order by n desc, first_seen) r from stats)
  group by 1 having count(*) >= 2)"""


@query("style_sizes_post_toc", f"with {POST_SIZES} select doc_id, chapter_size, subheading_size, body_size from post_sizes")
def style_sizes_post_toc(spark, sf_dir):
    return L.style_sizes_post_toc(L.font_stats(V.spans(spark, sf_dir), None, toc_end(spark, sf_dir)))


@query("style_samples", f"""with {POST_SIZES}, s as (
  select *, row_number() over (partition by doc_id, size order by page, line_no) k
  from spans join post_sizes using (doc_id) join toc_end using (doc_id)
  where {strip_sql('text')} <> '' and page >= start_page),
  r as (select *, list_filter(['chapter', 'subheading', 'body'], lambda x: case x when 'chapter' then chapter_size
     when 'subheading' then subheading_size else body_size end = size) roles from s)
  select doc_id, roles[(k-1)//5+1] as role, cast((k-1)%5+1 as integer) as sample_no, page, line_no, text
  from r where (k-1)//5 < len(roles)""")
def style_samples(spark, sf_dir):
    spans, after = V.spans(spark, sf_dir), toc_end(spark, sf_dir)
    sizes = L.style_sizes_post_toc(L.font_stats(spans, None, after))
    return L.style_samples(L.text_spans(spans, after_page=after), sizes)


@query("unit_type", f"with {UNITS} select doc_id, unit_no, page, font_size, type, text from units")
def unit_type(spark, sf_dir):
    return L.styled_units(V.spans(spark, sf_dir)).select("doc_id", "unit_no", "page", "font_size", "type", "text")


@query("section_ids", f"with {SECTIONS} select doc_id, unit_no, section, chapter, subheading from sections")
def section_ids(spark, sf_dir):
    return C.section_ids(L.styled_units(V.spans(spark, sf_dir))).select(
        "doc_id", "unit_no", "section", "chapter", "subheading")


CHUNK_COLS = ["doc_id", "chunk_no", "chapter", "subheading", "page_physical", "text"]


@query("chunk_accumulate", f"with {CHUNKS} select {', '.join(CHUNK_COLS)} from raw_chunks")
def chunk_accumulate(spark, sf_dir):
    return raw_chunks(spark, sf_dir)


@query("chunk_accumulate_blocks", f"with {CHUNKS} select {', '.join(CHUNK_COLS)} from raw_chunks")
def chunk_accumulate_blocks(spark, sf_dir):
    """The same chunks where sections of more than four units are filled in blocks of two pages."""
    return C.chunk_accumulate(L.styled_units(V.spans(spark, sf_dir)), short=4, pages=2)


@query("chunk_page_sort", f"""with {I.SPANS} select doc_id, row_number() over (partition by doc_id
  order by coalesce(p, 0), line_no) - 1 as chunk_no, p as page_physical, text
  from (select *, case when page % 7 <> 0 then page end p from spans)""")
def chunk_page_sort(spark, sf_dir):
    s = V.spans(spark, sf_dir)
    parts = s.select("doc_id", F.lit(None).cast("string").alias("chapter"),
                     F.lit(None).cast("string").alias("subheading"),
                     F.when(F.col("page") % 7 != 0, F.col("page")).alias("page_physical"),
                     F.col("line_no").alias("section"), F.lit(0).alias("part_no"), "text")
    return C.chunk_page_sort(parts).select("doc_id", "chunk_no", "page_physical", "text")


# Lines stand in for chunks where only the neighbourhood matters.
LINE_CHUNKS = I.LINES + """,
line_chunks as (select doc_id, cast(line_no as bigint) chunk_no, cast(null as varchar) chapter,
  cast(null as varchar) subheading, cast(null as integer) page_physical, text from lines)"""


def line_chunks(spark, sf_dir):
    return V.lines(spark, sf_dir).select("doc_id", F.col("line_no").cast("long").alias("chunk_no"), "text")


@query("chunk_overlap", f"with {LINE_CHUNKS}, {overlap_sql('line_chunks', 'o', 'chr(10)')} select doc_id, chunk_no, text from o")
def chunk_overlap(spark, sf_dir):
    return C.chunk_overlap(line_chunks(spark, sf_dir))


@query("chunk_overlap_space", f"""with {LINE_CHUNKS}, {overlap_sql('line_chunks', 'o', 'chr(10)')},
  {overlap_sql('o', 'p', "' '")} select doc_id, chunk_no, text from p""")
def chunk_overlap_space(spark, sf_dir):
    return C.chunk_overlap(line_chunks(spark, sf_dir), ("\n", " "))


@query("overlap_sizes", f"""with {LINE_CHUNKS} select doc_id, chunk_no,
  case when lag(chunk_no) over w is null then 0 else 300 end as pre,
  case when lead(chunk_no) over w is null then 0 else 300 end as post
  from line_chunks window w as (partition by doc_id order by chunk_no)""")
def overlap_sizes(spark, sf_dir):
    return C.overlap_sizes(line_chunks(spark, sf_dir)).select("doc_id", "chunk_no", "overlap.pre", "overlap.post")


@query("chunk_min_length", f"""with {LINE_CHUNKS} select doc_id, chunk_no, length({strip_sql('text')}) >= 50 as valid
  from line_chunks""")
def chunk_min_length(spark, sf_dir):
    return line_chunks(spark, sf_dir).select("doc_id", "chunk_no", C.chunk_min_length(F.col("text")).alias("valid"))


@per_session
def chunks(spark, sf_dir):
    """The chunk table, built once per session as an ingestion run would leave it."""
    return materialise(chunk_documents(V.spans(spark, sf_dir), passes=2))


@query("chunk_flow", f"with {FULL_CHUNKS} select * from chunks")
def chunk_flow(spark, sf_dir):
    return chunk_documents(V.spans(spark, sf_dir), passes=2)


@query("next_links", f"""with {FULL_CHUNKS} select * from (select doc_id, lag(chunk_id) over (
  partition by doc_id order by chunk_no) src, chunk_id as dst from chunks) where src is not null and src <> dst""")
def next_links(spark, sf_dir):
    return C.next_links(chunks(spark, sf_dir))


@query("html_units", r"""select page_id, cast(i - 1 as integer) unit_no,
    case when lower(left(raw, 3)) = '<h1' then 'heading' else 'body' end as type, text
  from (select page_id, i, raw, replace(replace(replace(replace(replace(""" + strip_sql(
    r"regexp_replace(regexp_replace(raw, '(?s)<[^>]*>', ' ', 'g'), '[" + SPACE
    + r"]+', ' ', 'g')") + r""", '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') as text
    from (select page_id, unnest(u) raw, generate_subscripts(u, 1) i from (
      select page_id, regexp_extract_all(regexp_replace(body,
        '(?i)(</?(?:h1|p|article|body|footer|nav|div|ul)\b)', e'\x01\\1', 'g'),
        '(?is)<(?:h1|p)\b[^>]*>[^\x01]*') u from (
        select page_id, regexp_replace(regexp_replace(html,
          '(?is)<nav\b.*?</nav>|<footer\b.*?</footer>|<script\b.*?</script>|<style\b.*?</style>|<head\b.*?</head>|<!--.*?-->',
          ' ', 'g'), e'\x01', '', 'g') body from pages)))) where text <> ''""")
def html_units(spark, sf_dir):
    return files.html_units(table(spark, sf_dir, "pages"))
