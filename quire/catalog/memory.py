"""Conversation memory and usage."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.catalog import inputs as I
from quire.catalog.base import query, table
from quire.catalog.text import strip_sql
from quire.operators import memory as M
from quire.operators import stats as ST
from quire.sources import views as V

MSG = ["user_id", "thread_id", "seq", "role", "content", "ts"]


@query("stm_window", f"""with {I.MESSAGES} select {', '.join(MSG)} from (select *, row_number() over (
  partition by user_id, thread_id order by seq desc) r from messages) where r <= 4""")
def stm_window(spark, sf_dir):
    return M.stm_window(V.messages(spark, sf_dir), 4)


# Assistant turns double as long-term entries.
ENTRIES = I.MESSAGES + """,
entries as (select user_id, seq, content, case seq % 3 when 0 then 'fact' when 1 then '' end as category from messages where role = 'assistant'),
ltm as (select user_id, seq, content, coalesce(nullif(category, ''), 'general') as category from (select *, row_number() over (
  partition by user_id order by seq desc) r from entries) where r <= 20)"""


def entries(spark, sf_dir):
    return V.messages(spark, sf_dir).where("role = 'assistant'").select(
        "user_id", "seq", "content", F.when(F.col("seq") % 3 == 0, "fact").when(F.col("seq") % 3 == 1, "").alias("category"))


@query("ltm_window", f"with {ENTRIES} select * from ltm where category = 'general'")
def ltm_window(spark, sf_dir):
    return M.ltm_window(entries(spark, sf_dir), 20, "general")


QA = """qa as (select user_id, thread_id, string_agg('Q' || no || ': ' || content || chr(10) || 'A' || no || ': ' || answer,
    chr(10) || chr(10) order by no) as qa_text from (
  select *, row_number() over (partition by user_id, thread_id order by seq) no from (
    select *, case when lead(role) over w = 'assistant' then lead(content) over w else '' end answer from (
      select *, row_number() over (partition by user_id, thread_id order by seq desc) r from messages) where r <= 8
    window w as (partition by user_id, thread_id order by seq)) where role = 'user') group by 1, 2)"""


@query("qa_window", f"with {I.MESSAGES}, {QA} select * from qa")
def qa_window(spark, sf_dir):
    return M.qa_window(V.messages(spark, sf_dir))


LAST = """last_said as (select user_id, thread_id, coalesce(arg_max(content, seq) filter (role = 'assistant'), '') as last_answer
  from messages group by 1, 2)"""


@query("last_assistant", f"with {I.MESSAGES}, {LAST} select * from last_said")
def last_assistant(spark, sf_dir):
    return M.last_assistant(V.messages(spark, sf_dir))


@query("clear_memory", f"""with {I.MESSAGES}, clears as (select user_id, thread_id, seq from messages where seq % 1000 = 3 and seq % 7 < 4),
  last_clear as (select user_id, thread_id, max(seq) c from clears group by 1, 2)
  select {', '.join('m.' + c for c in MSG)} from messages m left join last_clear l using (user_id, thread_id) where c is null or seq > c""")
def clear_memory(spark, sf_dir):
    m = V.messages(spark, sf_dir)
    clears = m.where("seq % 1000 = 3 and seq % 7 < 4").select("user_id", "thread_id", "seq")
    return M.clear_memory(m, clears, M.THREAD).select(*MSG)


REQUESTS = I.MESSAGES + """,
requests as (select user_id, seq, case seq % 5 when 0 then thread_id when 3 then ' NEW ' when 1 then '' end as thread_id from messages)"""


def requests(spark, sf_dir):
    s = F.col("seq") % 5
    return V.messages(spark, sf_dir).select("user_id", "seq", F.when(s == 0, F.col("thread_id")).when(s == 3, " NEW ")
                                            .when(s == 1, "").alias("thread_id"))


NEW_ID = "'thread_' || substr(md5(user_id || ':' || {}), 1, 8)"


@query("resolve_thread", f"""with {REQUESTS}, s as (select *, case when lower({strip_sql('thread_id')}) = 'new' then {NEW_ID.format('seq')}
    when thread_id <> '' then thread_id end as set_to from requests)
  select user_id, seq, thread_id, coalesce(last_value(set_to ignore nulls) over w, {NEW_ID.format('min(seq) over w')}) as resolved
  from s window w as (partition by user_id order by seq rows unbounded preceding)""")
def resolve_thread(spark, sf_dir):
    return M.resolve_thread(requests(spark, sf_dir))


@query("memory_export", f"""with {ENTRIES}, stm as (select * from (select *, row_number() over (partition by user_id, thread_id order by seq desc) r
    from messages) where r <= 20)
  select user_id, 'stm' as part, thread_id, string_agg(role || ':' || content, '|' order by seq) as entries from stm group by 1, 3
  union all select user_id, 'ltm', null, string_agg(coalesce(nullif(category, ''), 'general') || ':' || content, '|' order by seq) from (
    select *, row_number() over (partition by user_id order by seq desc) r from entries) where r <= 500 group by 1""")
def memory_export(spark, sf_dir):
    out = M.memory_export(V.messages(spark, sf_dir), entries(spark, sf_dir))
    return out.withColumn("entries", F.array_join(F.transform("entries", lambda e: F.concat_ws(":", e["label"], e["content"])), "|"))


ASKS = """asks as (select user_id, thread_id, seq, content as query from messages where role = 'user'
  union all select 'x', 'thread_x' || p_partkey, p_partkey, p_name from part)"""


def asks(spark, sf_dir):
    m = V.messages(spark, sf_dir).where("role = 'user'").select(
        "user_id", "thread_id", "seq", F.col("content").alias("query"))
    p = table(spark, sf_dir, "part").select(F.lit("x").alias("user_id"), F.concat(F.lit("thread_x"), "p_partkey").alias("thread_id"),
                                            F.col("p_partkey").alias("seq"), F.col("p_name").alias("query"))
    return m.unionByName(p)


@query("memory_inject", f"""with {ENTRIES}, {QA}, {ASKS}, notes as (select user_id, string_agg('- ' || content, chr(10) order by seq) n from (
    select *, row_number() over (partition by user_id order by seq desc) r from entries) where r <= 5 group by 1),
  mem as (select asks.*, concat_ws(chr(10), '### User Long-Term Memory:' || chr(10) || n,
    chr(10) || '### Recent Conversation:' || chr(10) || nullif(qa_text, '')) m from asks left join notes using (user_id) left join qa using (user_id, thread_id))
  select user_id, thread_id, seq, query, case when m = '' then query else m || chr(10) || chr(10) || '### Current User Query:' || chr(10) || query end
  as enriched_query from mem""")
def memory_inject(spark, sf_dir):
    return M.memory_inject(asks(spark, sf_dir), entries(spark, sf_dir), V.messages(spark, sf_dir))


@query("transform_query_text", f"""with {I.MESSAGES}, {ASKS}, l as (select user_id, thread_id, arg_max(content, seq) last_answer
   from messages where role = 'assistant' group by 1, 2) select asks.*, case when coalesce(last_answer, '') = '' then '{M.NOTHING_TO_TRANSFORM}'
   else chr(10) || 'Previous Answer:' || chr(10) || last_answer || chr(10) || chr(10) || 'Instruction:' || chr(10) || query || chr(10) end
   as enriched_query from asks left join l using (user_id, thread_id)""")
def transform_query_text(spark, sf_dir):
    return M.transform_query_text(asks(spark, sf_dir), V.messages(spark, sf_dir))


@query("query_type", f"""with {I.MESSAGES} select seq, case when regexp_matches(content,
  '(?i)(^|[^\\p{{L}}\\p{{N}}_])({"|".join(M.TRANSFORM_WORDS)})($|[^\\p{{L}}\\p{{N}}_])') then 'transformation' else 'knowledge' end as query_type from messages""")
def query_type(spark, sf_dir):
    return V.messages(spark, sf_dir).select("seq", M.query_type(F.col("content")).alias("query_type"))


@query("thread_summary", f"with {I.MESSAGES} select user_id, thread_id, count(*) message_count, max(ts) last_ts from messages group by 1, 2")
def thread_summary(spark, sf_dir):
    return ST.thread_summary(V.messages(spark, sf_dir))


@query("thread_messages", f"""with {I.MESSAGES} select {', '.join(MSG)} from messages where thread_id in (
  select thread_id from messages group by 1 having count(*) >= 6)""")
def thread_messages(spark, sf_dir):
    m = V.messages(spark, sf_dir)
    busy = ST.thread_summary(m).where("message_count >= 6")
    return ST.thread_messages(m, busy).select(*MSG)


@query("thread_access", f"""with {I.MESSAGES}, threads as (select distinct user_id, thread_id from messages),
  visits as (select case when c_custkey % 17 = 0 then 'admin' when c_custkey % 5 = 1 then 'guest' when c_custkey % 5 = 2 then 'nobody' else 'user' end as role,
    cast(c_custkey % 10 as varchar) user_id, 'thread_' || (c_custkey * 7 % 200) as thread_id, c_custkey as visit from customer)
  select visit, v.user_id, v.thread_id, role from visits v join threads t using (thread_id) where role = 'admin' or t.user_id = v.user_id""")
def thread_access(spark, sf_dir):
    k = F.col("c_custkey")
    visits = table(spark, sf_dir, "customer").select(
        F.when(k % 17 == 0, "admin").when(k % 5 == 1, "guest").when(k % 5 == 2, "nobody").otherwise("user").alias("role"),
        (k % 10).cast("string").alias("user_id"), F.concat(F.lit("thread_"), k * 7 % 200).alias("thread_id"), k.alias("visit"))
    return ST.thread_access(visits, V.messages(spark, sf_dir)).select("visit", "user_id", "thread_id", "role")


@query("trailing_hour_limit", """select event_id, user_id, n as recent, n >= 3 as blocked from (select event_id, user_id,
  count(*) over (partition by user_id order by ts range between interval 1 hour preceding and current row) - 1 as n from events)""")
def trailing_hour_limit(spark, sf_dir):
    return M.trailing_hour_limit(table(spark, sf_dir, "events")).select("event_id", "user_id", "recent", "blocked")


@query("latest_active_event", """select user_id, event_id, event_type, value from (select *, row_number() over (
  partition by user_id order by ts desc, event_id desc) r from events where ts + interval 12 hours > (select max(ts) from events)) where r = 1""")
def latest_active_event(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    as_of = e.agg(F.max(M.epoch_us(F.col("ts")))).scalar()
    return M.latest_active_event(e, as_of, 12 * M.HOUR_US).select("user_id", "event_id", "event_type", "value")
