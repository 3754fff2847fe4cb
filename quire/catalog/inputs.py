"""DuckDB twins of :mod:`quire.sources.views`, as common table expressions."""

LINES = """lines as (
  select cast(doc_id as varchar) doc_id, cast(i-1 as integer) line_no, l as text
  from (select doc_id, unnest(string_split(text, chr(10))) l,
               generate_subscripts(string_split(text, chr(10)),1) i from documents))"""

SPANS = LINES + """,
spans as (
  select doc_id, cast(floor(line_no/5) as int)+1 page, line_no, text,
    case when line_no=0 then 18.0::double when length(text)<60 then 14.0::double else 10.0::double end size,
    cast(60+150*(line_no%5) as double) y0, cast(72+150*(line_no%5) as double) y1,
    792.0::double page_height from lines)"""

SPLIT_SPANS = SPANS + """,
split_spans as (
  select doc_id, page, line_no, span_no, size, y0, y1, page_height,
         substring(text, cast(span_no*40+1 as bigint), 40) as text
  from (select *, unnest(range(0, greatest(cast(ceil(length(text)/40.0) as bigint), 1))) span_no from spans))"""

PAGE_TEXTS = """page_texts as (
  select doc_id, cast(p as integer) page_index, array_to_string(list_slice(l, p*5+1, p*5+5), chr(10)) as text
  from (select cast(doc_id as varchar) doc_id, l, unnest(range(0, (len(l)-1)//5+1)) p
        from (select doc_id, string_split(text, chr(10)) l from documents)))"""

TOC_LINES = """toc_lines as (
  with r as (select p_brand doc_id, p_name, p_size,
                    row_number() over (partition by p_brand order by p_partkey)-1 rn from part)
  select doc_id, cast(floor(rn/8) as int) page_index, cast(20*(rn%8) as double) y0, 50.0::double x0,
    case rn%4 when 0 then concat('Chapter ', p_name, ' ..... ', p_size)
              when 1 then concat(rn%9+1, '.', rn%3+1, ' ', p_name, ' .... ', p_size)
              when 2 then concat(rn%9+1, '. ', p_name, ' ', p_size)
              else concat(p_name, ' xiv') end text from r)"""

TOC_BLOCKS = TOC_LINES + """,
toc_blocks as (select doc_id, page_index, 0 as block_no, 400.0::double x0, y0 + 1 as y0,
    regexp_extract(text, '[^ ]+$') as text from toc_lines
  union all select doc_id, page_index, 0, x0, y0, regexp_replace(text, ' [^ ]+$', '') from toc_lines)"""

NUMBER_BLOCKS = """number_blocks as (select cast(c_nationkey as bigint) doc_id,
    row_number() over (partition by c_nationkey order by c_custkey) - 1 as page_index,
    (c_custkey % 10) * 79.2::double as y0, (c_custkey % 10) * 79.2::double + 12 as y1, 792.0::double page_height,
    concat(c_name, ' ', c_custkey % 1000, ' ', c_mktsegment,
      case c_custkey % 4 when 0 then ' xiv' when 1 then ' IX mm' else '' end) as text from customer)"""

PAGE_NUMBERS = """page_numbers as (
  with r as (select cast(c_nationkey as bigint) doc_id, c_custkey,
                    row_number() over (partition by c_nationkey order by c_custkey)-1 phys from customer),
       p as (select doc_id, phys, 0 as pos, c_custkey,
                    case when c_custkey%5=0 then c_custkey%50+1 else phys-(doc_id%7)+1 end printed from r)
  select doc_id, phys, pos, printed from p where c_custkey%11<>0 and printed>=1)"""

MESSAGES = """messages as (
  select cast(conv_id % 10 as varchar) user_id, concat('thread_', conv_id) thread_id,
         1000*conv_id + turn as seq, role, text as content,
         timestamp '2024-01-01 00:00:00' + to_hours(conv_id) + to_seconds(turn) as ts
  from conversations)"""

QUERY_ROWS = "query_rows as (select cast(item_id as varchar) query_id, text as query from benchmark)"
QUERY_VECTORS = "query_vectors as (select cast(vec_id as varchar) query_id, embedding from embeddings)"
CHUNK_VECTORS = """chunk_vectors as (
  select 'd' || label as doc_id, cast(vec_id as varchar) chunk_id, embedding, vec_id from embeddings)"""

NOISY = """noisy as (
  select doc_id, replace(replace(replace(replace(replace(text, ', ', ' ..... '), '. ', '- '),
    ' de ', ' —__ '), ' the ', ' “x” [12] '), ' und ', ' … ‡ é ?!! ') as text from documents)"""

REGISTRY = """registry as (
  select substr(sha256(text), 1, 16) doc_id, substr(text, 1, 40) title,
         concat('data/', source, '/', doc_id, '.pdf') source_path,
         cast(ceil(n_chars/3000.0) as bigint) total_pages, doc_id as seq from documents)"""


def with_(*parts: str) -> str:
    return "with " + ",\n".join(parts)
