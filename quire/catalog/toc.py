"""Table-of-contents queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.catalog import inputs as I
from quire.catalog.base import query, table
from quire.catalog.text import strip_sql
from quire.functions import toc as TF
from quire.functions.text import SPACE
from quire.operators import toc as T
from quire.plans.toc import toc_documents
from quire.sources import views as V

TOC_PAGES = I.TOC_LINES + """,
toc_pages as (select doc_id, page_index, case when page_index % 4 = 0 then 'C o n t e n t s' || chr(10) else '' end
   || string_agg(text || case when page_index % 3 = 1 then ' - ' else '' end, chr(10) order by y0) as text
   from toc_lines group by 1, 2)"""


def toc_pages(spark, sf_dir):
    t = V.toc_lines(spark, sf_dir).groupBy("doc_id", "page_index").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("y0", "text"))), lambda x: x["text"]).alias("l"))
    tail = F.when(F.col("page_index") % 3 == 1, " - ").otherwise("")
    return t.select("doc_id", "page_index", F.concat(
        F.when(F.col("page_index") % 4 == 0, "C o n t e n t s\n").otherwise(""),
        F.array_join(F.transform("l", lambda x: F.concat(x, tail)), "\n")).alias("text"))


FEATURES = f"""features as (select doc_id, page_index,
    contains(lower(text), 'contents') or regexp_matches(lower(text), '{TF.SPACED_CONTENTS}') as has_contents,
    cast(len(regexp_extract_all(text, '{TF.SECTION_LINES}')) as integer) as n_sections,
    cast(len(regexp_extract_all(text, '{TF.TRAILING_NUMBERS}')) as integer) as n_trailing,
    cast(len(regexp_extract_all(text, '{TF.BULLETS}')) as integer) as n_bullets from toc_pages)"""
HITS = f"""{TOC_PAGES}, {FEATURES},
hits as (select * from (select doc_id, page_index, case when n_trailing >= 5 then 'OFFSET_TOC'
    when has_contents and (n_sections >= 5 or n_bullets >= 5) then 'STRUCTURE_TOC'
    when n_sections >= 10 and page_index <= 3 then 'STRUCTURE_TOC' end as toc_type
  from features where page_index < 15) where toc_type is not null)"""


@query("toc_page_features", f"with {TOC_PAGES}, {FEATURES} select * from features")
def toc_page_features(spark, sf_dir):
    return T.toc_page_features(toc_pages(spark, sf_dir))


@query("toc_page_type", f"with {HITS} select doc_id, page_index, toc_type from hits")
def toc_page_type(spark, sf_dir):
    return T.toc_page_type(toc_pages(spark, sf_dir))


@query("toc_first_hit", f"""with {HITS} select doc_id, arg_min(toc_type, page_index) toc_type,
  min(page_index) toc_page_index from hits group by 1""")
def toc_first_hit(spark, sf_dir):
    return T.toc_first_hit(T.toc_page_type(toc_pages(spark, sf_dir)))


ROWS = I.TOC_BLOCKS + f""",
toc_rows as (select doc_id, page_index, round_even(y0 / 4, 0) * 4 as y_key,
   {strip_sql("string_agg(" + strip_sql("text") + ", ' ' order by x0)")} as row_text
   from toc_blocks where {strip_sql('text')} <> '' group by 1, 2, 3)"""
ROW_POINTS = f"""(case when regexp_matches(row_text, '{TF.LABEL_END}') then 1 else 0 end
  + case when regexp_matches(row_text, '{TF.NUMBERED}') then 1 else 0 end
  + case when starts_with(lower(row_text), 'chapter') then 1 else 0 end)"""
SCORED = ROWS + f""",
scored as (select doc_id, page_index, cast(sum({ROW_POINTS}) as bigint) score, sum({ROW_POINTS}) >= 4 is_toc
  from toc_rows group by 1, 2)"""


@query("toc_rows", f"with {ROWS} select * from toc_rows")
def toc_rows(spark, sf_dir):
    return T.toc_rows(V.toc_blocks(spark, sf_dir))


@query("toc_row_score", f"with {SCORED} select * from scored")
def toc_row_score(spark, sf_dir):
    return T.toc_row_score(T.toc_rows(V.toc_blocks(spark, sf_dir)))


TEXT_SCORE = f"""text_score as (select doc_id, page_index, cast(sum(case when length(l) < 5 then 0 else
    case when regexp_matches(lower(l), '[{SPACE}]([0-9]+|[ivxlcdm]+)$') then 1 else 0 end
    + case when regexp_matches(l, '^[0-9]+(\\.[0-9]+)+') then 1 else 0 end
    + case when starts_with(lower(l), 'chapter') then 1 else 0 end end) as integer) score, bool_or(named) named
  from (select doc_id, page_index, contains(lower(text), 'content') named,
               {strip_sql('unnest(string_split(text, chr(10)))')} l from toc_pages) group by 1, 2)"""


@query("toc_text_score", f"with {TOC_PAGES}, {TEXT_SCORE} select doc_id, page_index, score, named or score >= 3 as is_toc from text_score")
def toc_text_score(spark, sf_dir):
    return T.toc_text_score(toc_pages(spark, sf_dir))


# A start page per document and a page test that fails now and then.
@query("toc_page_run", """with p as (select cast(doc_id as varchar) doc_id, cast(unnest(range(0, n)) as integer) page_index,
    doc_id % 3 as s from (select doc_id, len(string_split(text, chr(10))) n from documents)),
  q as (select *, (page_index * 7 + s) % 23 <> 5 as is_toc from p where page_index >= s and page_index < s + 15)
  select doc_id, page_index from (select *, sum(case when is_toc then 0 else 1 end) over (
    partition by doc_id order by page_index) bad from q) where bad = 0""")
def toc_page_run(spark, sf_dir):
    lines = V.lines(spark, sf_dir)
    start = (F.col("doc_id").cast("long") % 3).cast("int")
    scored = lines.select("doc_id", F.col("line_no").alias("page_index"),
                          ((F.col("line_no") * 7 + start) % 23 != 5).alias("is_toc"))
    starts = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"),
        (F.col("doc_id") % 3).cast("int").alias("toc_page_index"))
    return T.toc_page_run(scored, starts)


ENTRIES = ROWS + f""",
entry_lines as (select *, regexp_replace({strip_sql('row_text')}, '\\.{{2,}}', ' ', 'g') as line from toc_rows),
entries as (select *, case when starts_with(lower(title), 'chapter') then 'chapter'
    when regexp_matches(title, '^[0-9]+\\.[0-9]+') then 'section'
    when regexp_matches(title, '^[0-9]+\\.') then 'subsection' else 'unknown' end as level from (
  select doc_id, page_index, y_key, {strip_sql(f"regexp_replace(line, '{TF.LABEL_END}', '')")} as title,
         regexp_extract(line, '{TF.LABEL_END}', 1) as page_label from entry_lines)
  where page_label <> '' and length(title) >= 3)"""


@query("toc_entries", f"with {ENTRIES} select doc_id, page_index, y_key, title, page_label, level from entries")
def toc_entries(spark, sf_dir):
    return T.toc_entries(T.toc_rows(V.toc_blocks(spark, sf_dir)))


@query("toc_level", f"with {ENTRIES} select doc_id, page_index, y_key, level from entries")
def toc_level(spark, sf_dir):
    rows = T.toc_rows(V.toc_blocks(spark, sf_dir))
    return T.toc_entries(rows).select("doc_id", "page_index", "y_key", TF.level(F.col("title")).alias("level"))


def confidence_sql(src: str, key: str) -> str:
    return f"""(select {key}, count(*) total_entries, count(*) filter (level = 'chapter') chapters,
  count(*) filter (level = 'section') sections, count(*) filter (level = 'subsection') subsections,
  count(*) filter (level = 'unknown') unknowns, count(*) filter (page_label <> '') page_labels,
  cast(greatest(sum(1 + case level when 'chapter' then 3 when 'section' then 2 when 'subsection' then 2 else -1 end
     + case when page_label <> '' then 2 else 0 end), 0) as bigint) score from {src} group by {key})"""


BAND = "case when score >= 40 then 'HIGH' when score >= 20 then 'MEDIUM' else 'LOW' end"


@query("toc_confidence", f"""with {ENTRIES}, e as (select *, doc_id || '/' || page_index as page_key from entries ) select *, {BAND} as level from {confidence_sql('e', 'page_key')}""")
def toc_confidence(spark, sf_dir):
    e = T.toc_entries(T.toc_rows(V.toc_blocks(spark, sf_dir)))
    return T.toc_confidence(e.withColumn("page_key", F.concat_ws("/", "doc_id", "page_index")), "page_key")


@query("toc_strategy", f"""with {ENTRIES}, e as (select *, doc_id || '/' || page_index as page_key from entries)
  select page_key, case when page_key like '%7' or {BAND} <> 'HIGH' then 'fallback' else 'rule' end as strategy
  from {confidence_sql('e', 'page_key')}""")
def toc_strategy(spark, sf_dir):
    e = T.toc_entries(T.toc_rows(V.toc_blocks(spark, sf_dir)))
    c = T.toc_confidence(e.withColumn("page_key", F.concat_ws("/", "doc_id", "page_index")), "page_key")
    kind = F.when(F.col("page_key").endswith("7"), "STRUCTURE_TOC").otherwise("OFFSET_TOC")
    return c.select("page_key", TF.strategy(kind, F.col("level")).alias("strategy"))


LABELS = """labelled as (select p_brand doc_id, p_partkey pos, p_name title, case p_partkey % 5 when 0 then null
   when 1 then substr('mdclxvixxviiiiix', p_size % 13 + 1, 3) when 2 then cast(p_size as varchar)
   when 3 then p_size || 'b' else 'A' end as page_label, 'unknown' as level from part)"""


def labelled(spark, sf_dir):
    k, n = F.col("p_partkey") % 5, F.col("p_size")
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("doc_id"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("title"),
        F.when(k == 1, F.substring(F.lit("mdclxvixxviiiiix"), n % 13 + 1, F.lit(3)))
        .when(k == 2, n.cast("string")).when(k == 3, F.concat(n, F.lit("b"))).when(k == 4, "A").alias("page_label"),
        F.lit("unknown").alias("level"))


def roman_sql(word: str, strict: bool) -> str:
    digits = " ".join(f"when '{k}' then {v}" for k, v in TF.ROMAN_DIGITS.items())
    prev = "case when x.p < a.p then a.p else x.p end" if strict else "x.p"
    total = f"""list_reduce(list_transform(list_reverse(string_split(lower({word}), '')),
      lambda ch: {{'t': case ch {digits} else 0 end, 'p': case ch {digits} else 0 end}}),
      lambda a, x: {{'t': a.t + case when x.p < a.p then -x.p else x.p end, 'p': {prev}}}).t"""
    return f"case when regexp_full_match(lower({word}), '[ivxlcdm]*') then {total} end" if strict else total


@query("roman_to_int", f"""with w as (select p_partkey, substr('mdclxvixxviiiqiix', cast(p_partkey % 15 as bigint) + 1,
   p_partkey % 4 + 1) as word from part) select p_partkey, word, cast({roman_sql('word', True)} as integer) as strict,
   cast({roman_sql('word', False)} as integer) as lenient from w""")
def roman_to_int(spark, sf_dir):
    k = F.col("p_partkey")
    word = F.substring(F.lit("mdclxvixxviiiqiix"), (k % 15 + 1).cast("int"), (k % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", word.alias("word"), TF.roman_to_int(word).alias("strict"),
        TF.roman_to_int(word, strict=False).alias("lenient"))


@query("label_to_int", f"""with {LABELS}, l as (select doc_id, pos, page_label,
  case when regexp_full_match(page_label, '[0-9]+') then page_label end as digits from labelled)
  select doc_id, pos, coalesce(cast(digits as integer), case when digits is null and page_label <> '' then
  cast({roman_sql('page_label', True)} as integer) end) as label_value from l""")
def label_to_int(spark, sf_dir):
    return labelled(spark, sf_dir).select("doc_id", "pos", TF.label_to_int(F.col("page_label")).alias("label_value"))


@query("toc_label_sort", f"""with {LABELS}, g as (select *, case when page_label is null then 2
    when regexp_full_match(page_label, '[ivxlcdmIVXLCDM]+') then 0 when regexp_matches(page_label, '^[0-9]') then 1
    else 2 end as grp from labelled), v as (select *, case grp when 0 then {roman_sql('page_label', False)}
    when 1 then try_cast(regexp_extract(page_label, '^[0-9]+') as bigint) end as val from g)
  select doc_id, cast(row_number() over (partition by doc_id order by grp, val nulls first, pos) as integer) as rank,
         title, page_label, level from v""")
def toc_label_sort(spark, sf_dir):
    return T.toc_label_sort(labelled(spark, sf_dir))


@query("logical_pages", f"""with {LABELS}, l as (select doc_id, page_label,
  case when regexp_full_match(page_label, '[0-9]+') then page_label end as digits from labelled)
  select distinct doc_id, v as logical_page from (select doc_id, coalesce(cast(digits as integer),
   case when digits is null and page_label <> '' then cast({roman_sql('page_label', True)} as integer) end) v from l)
  where v <> 0""")
def logical_pages(spark, sf_dir):
    return T.logical_pages(labelled(spark, sf_dir))


RAW = I.TOC_LINES + """,
raw as (select p_brand doc_id, cast((rn // 8) as integer) page_index, 'Entries found: [' ||
    case when (rn // 8) % 3 = 2 then '...skipped' || chr(10) else '' end ||
    string_agg('{"title": "' || p_name || '", "page_label": "' || p_size || '", "level": "chapter' ||
       case when (rn // 8) % 5 = 4 then '' else '"' end || '}', ', ' order by rn) ||
    case when (rn // 8) % 3 = 1 then ', ]' else ']' end || ' end' as raw
  from (select *, row_number() over (partition by p_brand order by p_partkey) - 1 rn from part)
  group by p_brand, rn // 8)"""


def raw(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("doc_id"), "p_partkey", "p_name", "p_size")
    p = V._numbered(p, "doc_id", "p_partkey").withColumn("page_index", F.floor(F.col("rn") / 8).cast("int"))
    page = F.col("page_index")
    item = F.concat(F.lit('{"title": "'), "p_name", F.lit('", "page_label": "'), "p_size",
                    F.lit('", "level": "chapter'), F.when(page % 5 == 4, "").otherwise('"'), F.lit("}"))
    items = p.withColumn("item", item).groupBy("doc_id", "page_index").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rn", "item"))), lambda x: x["item"]).alias("l"))
    return items.select("doc_id", "page_index", F.concat(
        F.lit("Entries found: ["), F.when(page % 3 == 2, "...skipped\n").otherwise(""), F.array_join("l", ", "),
        F.when(page % 3 == 1, ", ]").otherwise("]"), F.lit(" end")).alias("raw"))


PARSED = f"""body as (select doc_id, page_index, regexp_replace(regexp_replace(regexp_extract(raw, '(?s)\\[.*\\]'),
    '\\.\\.\\.[^\n]*', '', 'g'), ',[{SPACE}]*\\]', ']', 'g') b from raw),
parsed as (select doc_id, page_index, cast(i - 1 as integer) i, e.title, e.page_label, e.level from (
  select doc_id, page_index, unnest(l) e, generate_subscripts(l, 1) i from (
    select doc_id, page_index, from_json(b, '[{{"title":"VARCHAR","page_label":"VARCHAR","level":"VARCHAR"}}]') l
    from body where json_valid(b))))"""


@query("toc_json_parse", f"with {RAW}, {PARSED} select * from parsed")
def toc_json_parse(spark, sf_dir):
    return raw(spark, sf_dir).select("doc_id", "page_index", F.posexplode(TF.parse_entries(F.col("raw"))).alias("i", "e")) \
        .select("doc_id", "page_index", "i", "e.*")


CANDIDATES = I.NUMBER_BLOCKS + f""",
counted as (select *, max(page_index) over (partition by doc_id) + 1 as page_count from number_blocks),
cand_lists as (select doc_id, page_index as phys, list_concat(
    list_filter(list_transform(regexp_extract_all(text, '\\b[0-9]{{1,3}}\\b'), lambda w: cast(w as integer)),
                lambda n: n between 1 and page_count + 10),
    list_filter(list_transform(regexp_extract_all(text, '\\b[ivxlcdmIVXLCDM]{{1,6}}\\b'),
                lambda w: {roman_sql('w', True)}), lambda n: n <> 0 and n <= 50)) l
  from counted where y1 < page_height * 0.2 or y0 > page_height * 0.8),
candidates as (select doc_id, phys, cast(i - 1 as integer) pos, cast(printed as integer) printed from (
  select doc_id, phys, unnest(l) printed, generate_subscripts(l, 1) i from cand_lists))"""


@query("page_number_candidates", f"with {CANDIDATES} select * from candidates")
def page_number_candidates(spark, sf_dir):
    return T.page_number_candidates(V.number_blocks(spark, sf_dir))


VOTES = I.PAGE_NUMBERS + """,
shown as (select *, phys - printed + 1 as "offset" from page_numbers),
votes as (select * from (select *, cast(row_number() over (partition by doc_id order by votes desc, f) as integer) as rank
  from (select doc_id, "offset", count(*) votes, min(phys * 1000 + pos) f from shown group by 1, 2)) where rank <= 5)"""
OFFSET_HITS = VOTES + """,
offset_hits as (select distinct s.doc_id, s.phys, s."offset", v.rank from shown s join votes v
  on s.doc_id = v.doc_id and s."offset" = v."offset")"""
STREAKS = OFFSET_HITS + """,
page_ranks as (select doc_id, phys, row_number() over (partition by doc_id order by phys) pr
  from (select distinct doc_id, phys from shown)),
runs as (select doc_id, "offset", rank, count(*) streak from (
  select h.doc_id, "offset", rank, pr - row_number() over (partition by h.doc_id, "offset" order by pr) isl
  from offset_hits h join page_ranks p on p.doc_id = h.doc_id and p.phys = h.phys) group by 1, 2, 3, isl),
best_offset as (select doc_id, "offset", streak from (select *, row_number() over (
  partition by doc_id order by streak desc, rank) k from runs) where k = 1 and streak >= 5 and abs("offset") <= 80)"""


@query("offset_votes", f'with {VOTES} select doc_id, "offset", votes, rank from votes')
def offset_votes(spark, sf_dir):
    return T.offset_votes(V.page_numbers(spark, sf_dir))


@query("offset_join", f"with {OFFSET_HITS} select * from offset_hits")
def offset_join(spark, sf_dir):
    c = V.page_numbers(spark, sf_dir)
    return T.offset_join(c, T.offset_votes(c))


@query("offset_streak", f"with {STREAKS} select * from best_offset")
def offset_streak(spark, sf_dir):
    return T.offset_streak(V.page_numbers(spark, sf_dir))


@query("apply_page_offset", f"""with {STREAKS} select p.doc_id, p.phys, p.pos, p.printed,
  cast(p.phys - b."offset" as varchar) as page_label from page_numbers p left join best_offset b using (doc_id)""")
def apply_page_offset(spark, sf_dir):
    c = V.page_numbers(spark, sf_dir)
    return T.apply_page_offset(c, T.offset_streak(c), "phys")


# Page p of a book prints the number p - 1 (one unnumbered leaf in front).
@query("toc_flow", f"""with {RAW}, {HITS[len(I.TOC_LINES) + 2:]},
{ROWS[len(I.TOC_LINES) + 2:]}, {SCORED[len(ROWS) + 2:]}, {TEXT_SCORE},
firsts as (select doc_id, arg_min(toc_type, page_index) toc_type, min(page_index) s from hits group by 1),
rule_pages as (select * from (select p.doc_id, p.page_index, sum(case when coalesce(is_toc, false) then 0 else 1 end)
    over (partition by p.doc_id order by p.page_index) bad from toc_pages p join firsts f on p.doc_id = f.doc_id
    left join scored c on c.doc_id = p.doc_id and c.page_index = p.page_index
    where p.page_index >= s and p.page_index < s + 15) where bad = 0),
text_pages as (select * from (select p.doc_id, p.page_index, sum(case when named or score >= 3 then 0 else 1 end)
    over (partition by p.doc_id order by p.page_index) bad from text_score p join firsts f on p.doc_id = f.doc_id
    where p.page_index >= s and p.page_index < s + 15) where bad = 0),
{ENTRIES[len(ROWS) + 2:]}, {PARSED},
run_entries as (select e.* from entries e join rule_pages r on r.doc_id = e.doc_id and r.page_index = e.page_index),
conf as (select * from {confidence_sql('run_entries', 'doc_id')}),
rule_list as (select doc_id, string_agg(title || '>' || page_label || '>' || level, '|' order by page_index, y_key) l
  from run_entries group by 1),
fall_list as (select p.doc_id, string_agg(title || '>' || page_label || '>' || level, '|'
    order by try_cast(page_label as bigint), p.page_index, i) l
  from parsed p join text_pages t on t.doc_id = p.doc_id and t.page_index = p.page_index group by 1),
printed as (select doc_id, page_index phys, 0 as pos, page_index as printed from toc_pages where page_index >= 1),
cnt as (select doc_id, count(*) n from printed group by 1)
select f.doc_id, f.toc_type, f.s + 1 as toc_page, {BAND} as confidence,
  case when f.toc_type = 'STRUCTURE_TOC' or {BAND} <> 'HIGH' then 'fallback' else 'rule' end as strategy,
  case when n >= 5 then cast(1 as bigint) end as "offset",
  coalesce(case when f.toc_type = 'STRUCTURE_TOC' or {BAND} <> 'HIGH' then fall_list.l else rule_list.l end, '') as entries
from firsts f left join conf c on c.doc_id = f.doc_id left join rule_list on rule_list.doc_id = f.doc_id
left join fall_list on fall_list.doc_id = f.doc_id left join cnt on cnt.doc_id = f.doc_id""")
def toc_flow(spark, sf_dir):
    pages = toc_pages(spark, sf_dir)
    printed = pages.where("page_index >= 1").select(
        "doc_id", F.col("page_index").alias("phys"), F.lit(0).alias("pos"), F.col("page_index").alias("printed"))
    out = toc_documents(pages, V.toc_blocks(spark, sf_dir), printed, raw(spark, sf_dir))
    return out.select("doc_id", "toc_type", "toc_page", "confidence", "strategy", "offset", F.array_join(
        F.transform("toc_entries", lambda e: F.concat_ws(">", e["title"], e["page_label"], e["level"])), "|")
        .alias("entries"))
