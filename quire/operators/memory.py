"""Conversation memory: windows per thread and user, question/answer pairs, thread resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.functions.text import strip
from quire.operators.ordered import block_of, first_rows, join_null_safe, running

THREAD = ["user_id", "thread_id"]
STM_MESSAGES = 20
LTM_ENTRIES = 500
QA_TURNS = 4
LTM_SHOWN = 5
HOUR_US = 3_600_000_000


def stm_window(messages: DataFrame, n: int = STM_MESSAGES) -> DataFrame:
    """The last ``n`` messages of every thread."""
    return first_rows(messages, THREAD, [F.col("seq").desc()], n)


def ltm_window(entries: DataFrame, n: int = LTM_ENTRIES, category: str | None = None) -> DataFrame:
    """The last ``n`` entries of every user; a category is picked from what was kept."""
    kept = first_rows(entries, ["user_id"], [F.col("seq").desc()], n).withColumn(
        "category", F.coalesce(F.nullif("category", F.lit("")), F.lit("general")))
    return kept if category is None else kept.where(F.col("category") == category)


def qa_window(messages: DataFrame, max_turns: int = QA_TURNS) -> DataFrame:
    """The last turns of a thread as numbered question/answer text. A user message is answered by
    the assistant message right behind it, or by nothing."""
    last = first_rows(messages, THREAD, [F.col("seq").desc()], 2 * max_turns)
    order = W.partitionBy(*THREAD).orderBy("seq")          # at most 2 * max_turns rows each
    paired = last.withColumn("answer", F.when(F.lead("role").over(order) == "assistant",
                                              F.lead("content").over(order)).otherwise(""))
    asked = paired.where("role = 'user'").withColumn("no", F.row_number().over(order))
    turn = F.concat(F.lit("Q"), "no", F.lit(": "), "content", F.lit("\nA"), "no", F.lit(": "), "answer")
    return asked.groupBy(*THREAD).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("no", turn.alias("turn")))), lambda x: x["turn"]), "\n\n").alias("qa_text"))


def last_assistant(messages: DataFrame) -> DataFrame:
    """Latest assistant message per thread, empty where there is none."""
    seq = F.when(F.col("role") == "assistant", F.col("seq"))
    return messages.groupBy(*THREAD).agg(F.coalesce(F.max_by("content", seq), F.lit("")).alias("last_answer"))


def clear_memory(rows: DataFrame, clears: DataFrame, keys: list[str]) -> DataFrame:
    """What came after the last clear of its thread (or user)."""
    last = clears.groupBy(*keys).agg(F.max("seq").alias("_cleared"))
    return rows.join(last, keys, "left").where(F.col("_cleared").isNull() | (F.col("seq") > F.col("_cleared"))).drop("_cleared")


def new_thread_id(user: Column, seq: Column) -> Column:
    return F.concat(F.lit("thread_"), F.substring(F.md5(F.concat_ws(":", user, seq.cast("string"))), 1, 8))


def resolve_thread(requests: DataFrame, block: int = 1 << 20) -> DataFrame:
    """The thread of each request (``user_id, seq, thread_id``): a named one becomes active, ``new``
    starts one, blank goes on in the active one, or starts one where the user has none. ``block``
    is a span of ``seq``; it may hold up to as many requests."""
    asked = F.coalesce("thread_id", F.lit(""))
    named = F.lower(strip(asked))
    set_to = F.when(named == "new", new_thread_id(F.col("user_id"), F.col("seq"))).when(asked != "", asked)
    out = running(requests, ["user_id"], "seq", lasts={"_active": set_to},
                  maxes={"_first": -F.col("seq")}, block=block_of("seq", block))
    return out.withColumn("resolved", F.coalesce("_active", new_thread_id(F.col("user_id"), -F.col("_first")))) \
        .drop("_active", "_first")


def memory_export(messages: DataFrame, entries: DataFrame) -> DataFrame:
    """Snapshot of every user: one row per thread with its window, one row with the long-term
    entries. Rows instead of one map per user keep every value bounded."""
    def pack(df, keys, part):
        return df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "label", "content"))),
                                                 lambda x: F.struct(x["label"].alias("label"), x["content"].alias("content")))
                                     .alias("entries")).withColumn("part", F.lit(part))
    stm = pack(stm_window(messages).withColumn("label", F.col("role")), THREAD, "stm")
    ltm = pack(ltm_window(entries).withColumn("label", F.col("category")), ["user_id"], "ltm")
    return stm.unionByName(ltm, allowMissingColumns=True).select("user_id", "part", "thread_id", "entries")


def long_term_notes(entries: DataFrame, shown: int = LTM_SHOWN) -> DataFrame:
    """``user_id, notes``: the user's last entries as a list, oldest first."""
    last = first_rows(ltm_window(entries), ["user_id"], [F.col("seq").desc()], shown)
    return last.groupBy("user_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("seq", "content"))), lambda x: F.concat(F.lit("- "), x["content"])), "\n").alias("notes"))


def memory_inject(requests: DataFrame, entries: DataFrame, messages: DataFrame, shown: int = LTM_SHOWN) -> DataFrame:
    """Query text with the user's last long-term entries and the thread's last turns in front."""
    notes = long_term_notes(entries, shown).withColumnRenamed("notes", "_notes")
    out = requests.join(notes, "user_id", "left").join(qa_window(messages), THREAD, "left")
    return out.select(*requests.columns, with_memory(F.col("_notes"), F.col("qa_text"), F.col("query")).alias("enriched_query"))


def with_memory(notes: Column, qa_text: Column, query: Column) -> Column:
    """The query with notes and turns in front; what is null or has no turns leaves no heading."""
    memory = F.concat_ws("\n", F.concat(F.lit("### User Long-Term Memory:\n"), notes),
                         F.concat(F.lit("\n### Recent Conversation:\n"), F.nullif(qa_text, F.lit(""))))
    return F.when(memory == "", query).otherwise(F.concat(memory, F.lit("\n\n### Current User Query:\n"), query))


NOTHING_TO_TRANSFORM = "No previous response available to transform."


def transform_query_text(requests: DataFrame, messages: DataFrame) -> DataFrame:
    """The previous answer with the instruction, or a message where there is none."""
    out = requests.join(last_assistant(messages), THREAD, "left")
    text = F.coalesce(with_last_answer(F.col("last_answer"), F.col("query")), F.lit(NOTHING_TO_TRANSFORM))
    return out.select(*requests.columns, text.alias("enriched_query"))


def with_last_answer(last_answer: Column, query: Column) -> Column:
    """The instruction behind the answer it is about; null where there is no answer."""
    return F.concat(F.lit("\nPrevious Answer:\n"), F.nullif(last_answer, F.lit("")), F.lit("\n\nInstruction:\n"), query, F.lit("\n"))


def window_qa(window: Column, max_turns: int = QA_TURNS) -> Column:
    """The turns of :func:`qa_window` from a thread's messages as an array of ``role, content``."""
    last = F.slice(window, F.greatest(F.size(window) - 2 * max_turns + 1, F.lit(1)), 2 * max_turns)

    def turn(m: Column, i: Column) -> Column:
        after = F.get(last, i + 1)
        return F.when(m["role"] == "user", F.struct(
            F.coalesce(m["content"], F.lit("")).alias("q"),
            F.when(after["role"] == "assistant", F.coalesce(after["content"], F.lit(""))).otherwise("").alias("a")))
    no = lambda i: (i + 1).cast("string")
    return F.array_join(F.transform(F.array_compact(F.transform(last, turn)), lambda t, i: F.concat(
        F.lit("Q"), no(i), F.lit(": "), t["q"], F.lit("\nA"), no(i), F.lit(": "), t["a"])), "\n\n")


def window_last_answer(window: Column) -> Column:
    """The latest assistant message of such an array, null if there is none."""
    said = F.filter(window, lambda m: m["role"] == "assistant")
    return F.get(said, F.size(said) - 1)["content"]


# Fixed values of this library: words that point back at an earlier answer or ask to recast it.
TRANSFORM_WORDS = ("above", "previous", "that", "it", "this answer", "summarize", "summarise", "summary", "rewrite",
                   "rephrase", "reformat", "format", "bullet", "bullets", "simplify", "shorten", "convert", "translate")


def query_type(query: Column, words=TRANSFORM_WORDS) -> Column:
    pattern = r"(?i)(?<![\p{L}\p{N}_])(" + "|".join(words) + r")(?![\p{L}\p{N}_])"
    return F.when(query.rlike(pattern), "transformation").otherwise("knowledge")


def epoch_us(ts: Column) -> Column:
    """Microseconds since 1970 for a timestamp with or without time zone."""
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60
    day = F.datediff(ts, F.lit("1970-01-01").cast("date")).cast("long")
    return (day * 86400 + seconds) * 1_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def trailing_hour_limit(events: DataFrame, limit: int = 3, window_us: int = HOUR_US, slots: int = 60) -> DataFrame:
    """For every event: how many of the user came in the hour before, and whether that is too many.

    The hour is cut into slots. Whole slots count through one row per user and slot; only the
    event's own slot and the one the hour starts in are looked at row by row. So no task sorts
    more than two slots of a user, however busy that user is.
    """
    slot_us = window_us // slots
    e = events.withColumn("_us", epoch_us(F.col("ts"))).withColumn("_slot", F.floor(F.col("_us") / F.lit(slot_us)).cast("long"))
    # Every event again one window later: there it is what drops out of the hour.
    spread = e.withColumn("_at", F.explode(F.array(
        F.struct(F.col("_slot").alias("slot"), F.col("_us").alias("us"), F.lit(1).alias("own")),
        F.struct((F.col("_slot") + slots).alias("slot"), (F.col("_us") + window_us).alias("us"), F.lit(0).alias("own")))))
    spread = spread.select(*e.columns, "_at.slot", "_at.us", "_at.own")
    order = W.partitionBy("user_id", "slot").orderBy("us")
    until = order.rangeBetween(W.unboundedPreceding, W.currentRow)
    since = order.rangeBetween(W.currentRow, W.unboundedFollowing)
    near = spread.withColumn("_near", F.sum("own").over(until) + F.sum(1 - F.col("own")).over(since)).where("own = 1")
    per_slot = e.groupBy("user_id", "_slot").agg(F.count(F.lit(1)).alias("_n"))
    whole = per_slot.select("user_id", "_slot", F.coalesce(F.sum("_n").over(
        W.partitionBy("user_id").orderBy("_slot").rangeBetween(-(slots - 1), -1)), F.lit(0)).alias("_whole"))
    out = join_null_safe(near, whole, ["user_id", "_slot"]).withColumn("recent", F.col("_near") + F.col("_whole") - 1)
    return out.withColumn("blocked", F.col("recent") >= limit).select(*events.columns, "recent", "blocked")


def latest_active_event(events: DataFrame, as_of: Column, ttl_us: int = 300_000_000) -> DataFrame:
    """Latest event per user that has not run out at ``as_of`` (microseconds); it runs out when its
    age reaches the time to live."""
    rows = events.withColumn("_us", epoch_us(F.col("ts"))).where(F.col("_us") + ttl_us > as_of)
    keep = [c for c in events.columns if c != "user_id"]
    return rows.groupBy("user_id").agg(F.max_by(F.struct(*keep), F.struct("_us", "event_id")).alias("_e")).select(
        "user_id", "_e.*")
