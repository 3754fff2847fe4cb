"""Chat turns of whole conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.catalog import memory as MQ
from quire.catalog.base import query
from quire.catalog.text import strip_sql
from quire.operators import memory as M
from quire.plans.chat import chat_batch as chat
from quire.sources import views as V

KEEP = 6


def chat_requests(spark, sf_dir):
    """Every user message asks: in its own thread, a new one, or the active one; some are blank."""
    s = F.col("seq") % 5
    return V.messages(spark, sf_dir).where("role = 'user'").select(
        "user_id", "seq", F.when(s == 0, F.col("thread_id")).when(s == 3, " NEW ").when(s == 1, "").alias("thread_id"),
        F.when(F.col("seq") % 11 == 5, " ").otherwise(F.col("content")).alias("query"))


def echo(asked):
    """Stands in for a model: a reply that tells prompts apart; every sixteenth is empty."""
    digest = F.md5("prompt_query")
    return asked.select("user_id", "seq", F.when(digest.startswith("0"), "").otherwise(
        F.concat(F.lit("Reply "), digest)).alias("response"))


LAST = "(win[-8:])"
QA_TEXT = f"""array_to_string(list_transform(list_filter(list_transform({LAST}, lambda m, i: {{'role': m.role, 'q': m.content,
    'a': case when {LAST}[i + 1].role = 'assistant' then {LAST}[i + 1].content else '' end}}), lambda t: t.role = 'user'),
  lambda t, i: 'Q' || i || ': ' || t.q || chr(10) || 'A' || i || ': ' || t.a), chr(10) || chr(10))"""
MEMORY = f"""concat_ws(chr(10), '### User Long-Term Memory:' || chr(10) || notes,
    chr(10) || '### Recent Conversation:' || chr(10) || nullif({QA_TEXT}, ''))"""
SAID = "list_filter(win, lambda m: m.role = 'assistant')[-1].content"
TRANSFORMS = f"""regexp_matches(query, '(?i)(^|[^\\p{{L}}\\p{{N}}_])({"|".join(M.TRANSFORM_WORDS)})($|[^\\p{{L}}\\p{{N}}_])')"""


@query("chat_batch", f"""with recursive {MQ.ENTRIES},
requests as (select user_id, seq, case seq % 5 when 0 then thread_id when 3 then ' NEW ' when 1 then '' end as thread_id,
  case when seq % 11 = 5 then ' ' else content end as query from messages where role = 'user'),
named as (select *, case when lower({strip_sql('thread_id')}) = 'new' then {MQ.NEW_ID.format('seq')}
    when thread_id <> '' then thread_id end as set_to from requests where {strip_sql('query')} <> ''),
resolved as (select user_id, seq, query, coalesce(last_value(set_to ignore nulls) over w, {MQ.NEW_ID.format('min(seq) over w')}) as thread
  from named window w as (partition by user_id order by seq rows unbounded preceding)),
notes as (select user_id, string_agg('- ' || content, chr(10) order by seq) notes from (
    select *, row_number() over (partition by user_id order by seq desc) r from entries) where r <= 5 group by 1),
turns as (select r.*, n.notes, row_number() over (partition by user_id, thread order by seq) as turn, {TRANSFORMS} as recast
  from resolved r left join notes n using (user_id)),
held as (select user_id, thread_id, list({{'role': role, 'content': content}} order by seq) as win from messages where role = 'system' group by 1, 2),
waves as (
  select t.user_id, thread, 0::bigint as seq, 0::bigint as turn, null::boolean as recast, null::varchar as prompt, null::varchar as response,
    coalesce(win, []) as win
  from (select distinct user_id, thread from turns) t left join held h on h.user_id = t.user_id and h.thread_id = t.thread
  union all
  select user_id, thread, seq, turn, recast, prompt, response,
    case when prompt is null or response = '' then win else list_concat(win, [{{'role': 'user', 'content': query}},
      {{'role': 'assistant', 'content': response}}])[-{KEEP}:] end
  from (select *, case when prompt is null then '{M.NOTHING_TO_TRANSFORM}' when md5(prompt)[1] = '0' then '' else 'Reply ' || md5(prompt) end as response
    from (select *, case when recast then chr(10) || 'Previous Answer:' || chr(10) || nullif({SAID}, '') || chr(10) || chr(10) || 'Instruction:' || chr(10)
        || query || chr(10) when {MEMORY} = '' then query
        else {MEMORY} || chr(10) || chr(10) || '### Current User Query:' || chr(10) || query end as prompt
      from (select t.*, w.win from waves w join turns t on t.user_id = w.user_id and t.thread = w.thread and t.turn = w.turn + 1))))
select user_id, seq, thread as thread_id, turn::int as turn, case when recast then 'transformation' else 'knowledge' end as query_type,
  prompt as prompt_query, response from waves where turn > 0
union all select user_id, seq, null, null, null, null, '' from requests where {strip_sql('query')} = ''
""")
def chat_batch(spark, sf_dir):
    m = V.messages(spark, sf_dir)
    return chat(chat_requests(spark, sf_dir), echo, history=m.where("role = 'system'"), entries=MQ.entries(spark, sf_dir), keep=KEEP)
