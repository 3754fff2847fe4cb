"""Text scalars over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.catalog import inputs as I
from quire.catalog.base import query, table
from quire.functions import response as R
from quire.functions import text as T
from quire.sources import views as V

# White space in DuckDB: a class body for RE2 and a character list for trim().
SP = T.SPACE
SPC = T.SPACE_CHARS
STRIP = "trim({}, '" + SPC + "')"


def strip_sql(e: str) -> str:
    return STRIP.format(e)


NONPRINT = r"[\p{C}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def nonprint_sql(e):
    return f"regexp_replace({e}, '{NONPRINT}', '', 'g')"


def hyphen_sql(e):
    return f"regexp_replace({e}, '([{T.WORD}]+)-[{SP}]+([{T.WORD}]+)', '\\1\\2', 'g')"


def leaders_sql(e):
    return f"regexp_replace({e}, '\\.{{2,}}', ' ', 'g')"


def symbols_sql(e):
    return f"regexp_replace({e}, '[-_]{{2,}}', ' ', 'g')"


def space_sql(e):
    return strip_sql(f"regexp_replace({e}, '[{SP}]+', ' ', 'g')")


def clean_sql(e):
    return space_sql(symbols_sql(leaders_sql(hyphen_sql(nonprint_sql(e)))))


def unicode_sql(e):
    return strip_sql(f"translate({e}, '{T.UNICODE_FROM}', '--\"\"'''' ')")


def typographic_sql(e):
    return ("replace(replace(replace(translate(" + e + ", '" + R.TYPO_FROM + R.TYPO_DROP + "', '"
            + R.TYPO_TO.replace("'", "''") + "'), '…', '...'), '‡', '++'), '±', '+/-')")


def control_sql(e):
    return f"regexp_replace({e}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x9f]|\\p{{Cf}}|\\p{{Co}}', '', 'g')"


def spacing_sql(e):
    return strip_sql(f"regexp_replace(regexp_replace({e}, '\\n{{3,}}', e'\\n\\n', 'g'), '(?m)[ \\t]+$', '', 'g')")


def layout_sql(e):
    return strip_sql(f"""array_to_string(list_transform(
  regexp_split_to_array({e}, '{T.LINE_BREAK}'), lambda l: regexp_replace(regexp_replace(l,
   '^([{SP}]*)[*+\\x{{2022}}] [{SP}]*(.*?)[{SP}]*$', '\\1- \\2'),
   '^([{SP}]*)(\\p{{Nd}}+)[.)][{SP}]+(.*?)[{SP}]*$', '\\1\\2. \\3')), chr(10))""")


def nfkc_sql(e):
    """Composition alone plus the one compatibility character the texts contain; the whole mapping
    is compared with Python's in the tests."""
    return f"replace(nfc_normalize({e}), '…', '...')"


def marked(e: str) -> str:
    """Both ends of every run of letters, digits and underscores as an end mark and a start mark."""
    return f"regexp_replace({e}, '([\\p{{L}}\\p{{N}}_]+)', chr(1) || chr(2) || '\\1' || chr(1) || chr(2), 'g')"


def aggressive_sql(e: str) -> str:
    """Word edges made visible: a match begins at a start mark and ends at an end mark, so that neighbours share an edge."""
    def unmarked(x):
        return f"replace(replace({x}, chr(1), ''), chr(2), '')"
    other = f"[^a-zA-Z0-9{SP}\\x01\\x02]"
    few = unmarked(f"regexp_replace({marked(e)}, '\\x02{other}((\\x01\\x02)?{other})?\\x01', ' ', 'g')")
    stop = f"regexp_replace({few}, '[!?]{{2,}}', '.', 'g')"
    return unmarked(f"regexp_replace({marked(stop)}, '\\x02[a-zA-Z]\\x01', ' ', 'g')")


def _scalar(name, expr, sql, view=V.noisy, cte=I.NOISY, frm="noisy"):
    @query(name, f"with {cte} select doc_id, {sql} as result from {frm}" if sql else None)
    def run(spark, sf_dir):
        return view(spark, sf_dir).select("doc_id", expr(F.col("text")).alias("result"))
    return run


_scalar("clean_text", T.clean_text, clean_sql("text"))
_scalar("remove_non_printable", T.remove_non_printable, nonprint_sql("text"))
_scalar("fix_hyphenation", T.fix_hyphenation, hyphen_sql("text"))
_scalar("remove_dotted_leaders", T.remove_dotted_leaders, leaders_sql("text"))
_scalar("remove_repeated_symbols", T.remove_repeated_symbols, symbols_sql("text"))
_scalar("normalize_whitespace", T.normalize_whitespace, space_sql("text"))
_scalar("aggressive_cleanup", T.aggressive_cleanup, aggressive_sql("text"))
_scalar("clean_unicode", T.clean_unicode, unicode_sql("text"))
_scalar("text_preview", T.text_preview, unicode_sql("substr(text, 1, 500)"))
_scalar("strip_fake_citations", T.strip_fake_citations,
        r"regexp_replace(text, '\[\p{Nd}+\]', '', 'g')")
_scalar("typographic_map", R.typographic_map, typographic_sql("text"))
_scalar("nfkc", R.nfkc, nfkc_sql("text"))
_scalar("remove_control_chars", R.remove_control_chars, control_sql("text"))
_scalar("clean_spacing", R.clean_spacing, spacing_sql("text"))
_scalar("ocr_confidence", T.ocr_confidence,
        f"case when {strip_sql('text')} = '' then 0.0::double else round_even(least(1.0::double, "
        f"length(regexp_replace(text, '[^\\p{{L}}{SP}]', '', 'g')) / greatest(length(text), 1)::double), 2) end")


@query("clean_list", f"""with {I.NOISY} select doc_id,
  (select string_agg({clean_sql('l')}, '|' order by i) from
     (select unnest(string_split(text, chr(10))) l, generate_subscripts(string_split(text, chr(10)), 1) i)
   where l <> '') as result from noisy""")
def clean_list(spark, sf_dir):
    items = F.transform(F.split("text", "\n"), lambda x: F.when(x != "", x))
    return V.noisy(spark, sf_dir).select("doc_id", F.array_join(T.clean_list(items), "|").alias("result"))


@query("format_bullets", f"""select doc_id, (select string_agg('- ' || {unicode_sql('l')}, chr(10) order by i)
  from (select unnest(string_split(text, chr(10))) l, generate_subscripts(string_split(text, chr(10)), 1) i)) as result
  from documents""")
def format_bullets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", T.format_bullets(F.split("text", "\n")).alias("result"))


@query("is_hex_doc_id", """select doc_id, regexp_full_match(k, '[0-9a-fA-F]{16}') as full_id,
  regexp_full_match(k, '[0-9a-fA-F]+') as any_hex from (
  select doc_id, case doc_id % 3 when 0 then substr(sha256(text), 1, 16) when 1 then substr(sha256(text), 1, 9)
                 else source end k from documents)""")
def is_hex_doc_id(spark, sf_dir):
    h = F.sha2("text", 256)
    k = F.when(F.col("doc_id") % 3 == 0, F.substring(h, 1, 16)) \
        .when(F.col("doc_id") % 3 == 1, F.substring(h, 1, 9)).otherwise(F.col("source"))
    return table(spark, sf_dir, "documents").withColumn("k", k).select(
        "doc_id", T.is_hex_doc_id(F.col("k")).alias("full_id"), T.is_hex(F.col("k")).alias("any_hex"))


@query("drop_null_fields", """select doc_id, concat_ws(';', 'lang=' || case when lang <> 'en' then lang end,
  'n=' || case when n_chars > 1000 then n_chars end, 'source=' || source) as result from documents""")
def drop_null_fields(spark, sf_dir):
    m = F.create_map(F.lit("lang"), F.when(F.col("lang") != "en", F.col("lang")),
                     F.lit("n"), F.when(F.col("n_chars") > 1000, F.col("n_chars").cast("string")),
                     F.lit("source"), F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(
        F.array_sort(F.map_entries(T.drop_null_fields(m))),
        lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("result"))


CHAT = """chat as (select doc_id, case doc_id % 4 when 0 then 'Sure, here is the answer:' || chr(10) || text
  when 1 then 'Based on the provided context, ' || text when 2 then 'ACCORDING TO THE BOOK: ' || text
  else text end as text, case doc_id % 3 when 0 then 'medical' when 1 then 'book' else 'general' end intent
  from documents)"""


def chat(spark, sf_dir):
    m, t = F.col("doc_id") % 4, F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(m == 0, F.concat(F.lit("Sure, here is the answer:\n"), t))
        .when(m == 1, F.concat(F.lit("Based on the provided context, "), t))
        .when(m == 2, F.concat(F.lit("ACCORDING TO THE BOOK: "), t)).otherwise(t).alias("text"),
        F.when(F.col("doc_id") % 3 == 0, "medical").when(F.col("doc_id") % 3 == 1, "book")
        .otherwise("general").alias("intent"))


def chatter_sql(e):
    return strip_sql("regexp_replace(" + e + ", '(?i)" + R.CHATTER.replace("'", "''") + "', '')")


_scalar("strip_chatter", R.strip_chatter, chatter_sql("text"), view=chat, cte=CHAT, frm="chat")

LINKED = """linked as (select page_id as doc_id, concat('See [page ', page_id, '](', url, ') and ', url,
  '/more?p=1 twice, ', url, '/more?p=1', chr(10), html) as text from pages)"""


def linked(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.concat(
        F.lit("See [page "), "page_id", F.lit("]("), u, F.lit(") and "), u, F.lit("/more?p=1 twice, "),
        u, F.lit("/more?p=1\n"), "html").alias("text"))


MD, RAW = R.MD_LINK.replace("'", "''"), ("(https?://" + R.URL_CHARS + ")").replace("'", "''")


def links_sql(frm):
    return f"""select doc_id, case when len(urls) > 0 then {strip_sql('bare')} || e'\\n\\nREFERENCES:\\n' ||
      array_to_string(list_transform(urls, lambda u: '- ' || u), chr(10)) else bare end as text from (
      select doc_id, regexp_replace(body, '{RAW}', '', 'g') bare,
        list_filter(all_urls, lambda u, i: list_position(all_urls, u) = i) urls from (
        select doc_id, body, list_concat(regexp_extract_all(text, '{MD}', 2),
                                         regexp_extract_all(body, '{RAW}', 1)) all_urls from (
          select doc_id, text, regexp_replace(text, '{MD}', '\\1', 'g') body from {frm})))"""


@query("group_links", f"with {LINKED} select doc_id, text as result from ({links_sql('linked')})")
def group_links(spark, sf_dir):
    return linked(spark, sf_dir).select("doc_id", R.group_links(F.col("text")).alias("result"))


LISTED = r"""listed as (select doc_id, regexp_replace(replace(replace(text, '. ', e'.\n  * '), ', ', e'\n 12) '),
  ' la ', e'\n+ ', 'g') as text from documents)"""


def listed(spark, sf_dir):
    t = F.replace(F.replace(F.col("text"), F.lit(". "), F.lit(".\n  * ")), F.lit(", "), F.lit("\n 12) "))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.replace(t, F.lit(" la "), F.lit("\n+ ")).alias("text"))


_scalar("list_layout", R.list_layout, layout_sql("text"), view=listed, cte=LISTED, frm="listed")


def formatted_sql(src: str, dst: str) -> str:
    """``src(doc_id, intent, text)`` as ``dst(doc_id, intent, formatted)``."""
    laid = layout_sql(spacing_sql("l.text"))
    return f"""{dst}_a as (select doc_id, intent, {control_sql(typographic_sql(nfkc_sql(chatter_sql(strip_sql('text')))))} as text from {src}),
{dst}_b as ({links_sql(dst + '_a')}),
{dst}_c as (select a.doc_id, a.intent, {laid} as t from {dst}_a a join {dst}_b l using (doc_id)),
{dst} as (select doc_id, intent, case when contains(lower(t), '{R.NO_ANSWER}') then '{R.NO_ANSWER}'
   else {strip_sql("case when intent in ('medical', 'book') and not starts_with(t, '### ') then '### Direct Answer' || chr(10) || t else t end")}
   end as formatted from {dst}_c)"""


@query("format_response", f"with {CHAT}, {formatted_sql('chat', 'done')} select doc_id, intent, formatted as result from done")
def format_response(spark, sf_dir):
    return chat(spark, sf_dir).select("doc_id", "intent", R.format_response(
        F.col("text"), F.col("intent")).alias("result"))


@query("content_doc_id", "select doc_id, substr(sha256(text), 1, 16) as content_id from documents")
def content_doc_id(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.content_id(F.col("text")).alias("content_id"))


@query("short_text_near_image", f"""with {I.PAGE_TEXTS} select doc_id, page_index,
  case when length({strip_sql('text')}) < 300 then {strip_sql('text')} else '' end as near_text from page_texts""")
def short_text_near_image(spark, sf_dir):
    return V.page_texts(spark, sf_dir).select(
        "doc_id", "page_index", T.short_text(F.col("text")).alias("near_text"))


@query("page_scan", f"""with {I.PAGE_TEXTS} select doc_id, page_index, {strip_sql('text')} as text
  from page_texts where page_index < 5""")
def page_scan(spark, sf_dir):
    from quire.sources.files import page_scan as scan
    return scan(V.page_texts(spark, sf_dir), max_pages=5)
