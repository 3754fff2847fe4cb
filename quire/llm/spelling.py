"""Spelling variants: words one edit apart, found as equal pairs of prefix and suffix nodes of two tries."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.tables import Scratch

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEAST_LENGTH, LEAST_COUNT = 5, 3
TIMES = 2            # a form is this many times as frequent
BLOCK_BITS = 14      # words of a block
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[a-zÀ-ÿ]+"
EVERY = 97


def one_letter_less(doc_id: Column, run: Column) -> Column:
    """The run, or the run without one letter where 97 divides the CRC-32 of ``<doc_id>:<run>``; the
    remainder by its length says which. A null id is written as nothing."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.length(run).cast("long")).cast("int")
    return F.when(F.pmod(h, F.lit(EVERY)) == 0,
                  F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def count_words(docs: DataFrame, altered: Callable[[Column, Column], Column] | None = None, id_col: str = "doc_id",
                text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n`` of the letter runs of all texts, A-Z in lower case, with at least ``least_length`` code
    points and ``least_count`` occurrences. ``altered`` makes the word of a row's id and run; it may shorten it.
    Occurrences are counted before they move, so a frequent word costs one row per task."""
    low = F.translate(docs[text_col], UPPER, LOWER)
    runs = docs.select(docs[id_col].alias("id"), F.explode(F.regexp_extract_all(low, F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= least_length)
    word = F.col("run") if altered is None else altered(F.col("id"), F.col("run"))
    words = runs.select(word.alias("word")).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _sorted(words: DataFrame, scratch: Scratch, *keep: str) -> DataFrame:
    """The words in code-point order with increasing numbers ``at``, in blocks of neighbours."""
    rows = words.repartitionByRange("word").sortWithinPartitions("word")
    rows = rows.select(*keep, "word", F.monotonically_increasing_id().alias("at"))
    return scratch.save(rows.withColumn("block", F.shiftright("at", BLOCK_BITS)))


def shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    for i in range(n):
        if a[i] != b[i]:
            return i
    return n


def block_nodes(words: list[str]) -> tuple[list[list[int]], int]:
    """For sorted words the nodes of their prefixes in a trie of their own, root (-1) first, numbered in
    the order in which the words reach them, and the number of nodes."""
    paths, path, before, new = [], [-1], "", 0
    for word in words:
        kept = shared(before, word)
        path = path[:kept + 1] + list(range(new, new + len(word) - kept))
        new += len(word) - kept
        before = word
        paths.append(path)
    return paths, new


def joined_blocks(blocks: Iterator[tuple]) -> Iterator[tuple[int, int, list[int]]]:
    """What turns the numbers of each block into those of one trie: ``(block, base, carry)``.

    ``blocks`` has, in order, ``(block, first word, last word, path of the last word, nodes)``. The prefixes that
    a block's first word shares with the last word before it have the numbers ``carry``; they were
    given the numbers from 0 in the block. All others have ``base`` added. The root is 0."""
    before, path, base = "", [], 1
    for block, first, last, own, nodes in blocks:
        carry = path[:shared(before, first)]
        yield block, base, carry
        path = [carry[x] if x < len(carry) else base + x for x in own[1:]]
        before, base = last, base + nodes


def trie_paths(words: DataFrame, scratch: Scratch) -> DataFrame:
    """``(w, path, again)`` of sorted words (see :func:`_sorted`, with ``w``): the numbers of the trie nodes of all
    their prefixes, the empty one first, and which letters equal the one before. Equal prefixes have
    equal numbers in all rows.

    Each block of neighbours builds its own trie; one row per block then tells how the tries fit
    together, as neighbouring blocks share only prefixes of the words at their border.
    """
    def build(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("at")
        paths, nodes = block_nodes(block["word"].tolist())
        again = [[i > 0 and x == word[i - 1] for i, x in enumerate(word)] for word in block["word"]]
        out = pd.DataFrame({"block": block["block"].to_numpy(), "w": block["w"].to_numpy(), "path": paths, "again": again})
        out["first"], out["last"], out["nodes"] = None, None, None
        end = out.index[-1]
        out.loc[end, ["first", "last", "nodes"]] = [block["word"].iloc[0], block["word"].iloc[-1], nodes]
        out["nodes"] = out["nodes"].astype("Int64")
        return out

    def join(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (tuple(r) for p in parts for r in p.itertuples(index=False))
        for block, base, carry in joined_blocks(rows):
            yield pd.DataFrame({"block": [block], "base": [base], "carry": [carry]})

    local = scratch.save(words.groupBy("block").applyInPandas(
        build, "block long, w long, path array<long>, again array<boolean>, first string, last string, nodes long"))
    # One row for each block of 16,384 words.
    ends = local.where("nodes is not null").select("block", "first", "last", "path", "nodes")
    fits = ends.repartition(1).sortWithinPartitions("block").mapInPandas(join, "block long, base long, carry array<long>")
    known = F.size("carry")
    path = F.transform("path", lambda x: F.when(x < 0, F.lit(0)).when(x < known, F.get("carry", x.cast("int"))).otherwise(
        F.col("base") + x))
    return local.join(scratch.save(fits), "block").select("w", path.alias("path"), "again")


def near_pairs(vocabulary: DataFrame, scratch: Scratch) -> DataFrame:
    """``(w, n, near, near_n)`` for all ordered pairs of words one edit apart, each once.

    ``vocabulary`` has ``word, n`` and the number ``w``. A word with its letter ``i`` skipped is the pair of its
    prefix node before and its suffix node behind that letter; a word with a letter inserted at ``i`` has the pair of
    the nodes before and behind that place. Equal skipped pairs are a replaced letter, a skipped
    pair equal to a whole one is a letter more. Of equal neighbouring letters only the first is skipped
    for the latter, so no pair is met twice. As a pair fixes all other letters, no pair of nodes has
    more words than there are letters.
    """
    forward = trie_paths(vocabulary.withColumn("at", F.col("w")).withColumn("block", F.shiftright("w", BLOCK_BITS)), scratch)
    turned = _sorted(vocabulary.select("w", F.reverse("word").alias("word")), scratch, "w")
    backward = trie_paths(turned, scratch).select("w", F.col("path").alias("back"))
    size = F.size("path") - 1
    both = forward.join(backward, "w").join(vocabulary.select("w", "n"), "w")
    whole = both.select("w", "n", F.lit(0).alias("kind"), F.inline(F.arrays_zip(F.col("path").alias("p"), F.reverse("back").alias("s"))))
    skipped = both.select("w", "n", F.inline(F.arrays_zip(
        F.slice("path", F.lit(1), size).alias("p"), F.reverse(F.slice("back", F.lit(1), size)).alias("s"),
        F.col("again"))))
    skipped = skipped.select("w", "n", F.when(F.col("again"), 2).otherwise(1).alias("kind"), "p", "s")
    pairs = scratch.save(whole.unionByName(skipped))
    other = pairs.select("p", "s", F.col("w").alias("near"), F.col("n").alias("near_n"), F.col("kind").alias("as"))
    kind, way = F.col("kind"), F.col("as")
    meets = ((kind > 0) & (way > 0)) | ((kind == 0) & (way == 1)) | ((kind == 1) & (way == 0))
    return pairs.join(other, ["p", "s"]).where(meets & (F.col("w") != F.col("near"))).select("w", "n", "near", "near_n")


def _roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """``(w, root)`` by doubling the steps along ``(w, form)``. Counts at least double with every step, so
    chains are short and never close."""
    steps = scratch.save(forms.select("w", F.col("form").alias("root")))
    while True:
        ahead = steps.select(F.col("w").alias("root"), F.col("root").alias("next"))
        now = scratch.save(steps.join(ahead, "root", "left").select(
            "w", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        scratch.drop(steps)
        steps = now
        if steps.where("moved").isEmpty():
            return steps.select("w", "root")


def spelling_variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for the words ``(word, n)``, each of which occurs once.

    Near words differ by exactly one inserted, deleted or replaced code point; ``n_near`` counts them. The
    ``form`` of a word is its near word of largest count (ties: the smallest in code-point order) if that count is at least
    ``times`` that of the word, which has to be 2 or more; else null. ``root`` follows the forms to the last one; it is the word
    itself if it has no form. Null words take no part. An empty table gives an empty result.
    """
    if times < 2:
        raise ValueError("times must be 2 or more")
    scratch = Scratch(words.sparkSession)
    vocabulary = _sorted(words.where("word is not null").select("word", "n"), scratch, "n").select(
        "word", "n", F.col("at").alias("w"))
    best = near_pairs(vocabulary, scratch).groupBy("w").agg(
        F.count(F.lit(1)).alias("n_near"), F.max(F.struct(F.col("near_n"), (-F.col("near")).alias("less"))).alias("best"))
    best = scratch.save(best.select("w", "n_near", F.col("best")["near_n"].alias("near_n"), (-F.col("best")["less"]).alias("near")))
    forms = scratch.save(vocabulary.join(best, "w").where(F.col("near_n") >= F.col("n") * times).select(
        "w", F.col("near").alias("form"), F.col("near_n").alias("form_n")))
    roots = _roots(forms, scratch)
    names = vocabulary.select("w", "word")
    named = forms.join(roots, "w").join(names.select(F.col("w").alias("form"), F.col("word").alias("form_word")), "form").join(
        names.select(F.col("w").alias("root"), F.col("word").alias("root_word")), "root").select("w", "form_word", "root_word", "form_n")
    out = vocabulary.join(best.select("w", "n_near"), "w", "left").join(named, "w", "left")
    return out.select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n",
                      F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


# The twin makes strings with one letter out instead of pairs of nodes. CRC-32 by its table, byte by byte.
VARIANTS_SQL = f"""
with recursive bits as (
  select i::bigint as i, i::bigint as c, 0 as k from range(0, 256) r(i)
  union all select i, case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end, k + 1 from bits where k < 8),
crc_table as (select list(c order by i) as t from bits where k = 8),
runs as (
  select doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-zÀ-ÿ]+')) as run from documents),
hashed as (
  select run, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(
      range(0, len(hex(encode(doc_id || ':' || run))) // 2),
      lambda i: ('0x' || substring(hex(encode(doc_id || ':' || run)), (2 * i + 1)::bigint, 2))::bigint)),
    lambda c, b: xor(c >> 8, t[(xor(c & 255, b) + 1)::bigint]))) as h
  from runs, crc_table where length(run) >= {LEAST_LENGTH}),
made as (
  select case when h % {EVERY} = 0 then substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) else run end as word
  from hashed),
words as (
  select word, count(*) as n from made where length(word) >= {LEAST_LENGTH} group by word having count(*) >= {LEAST_COUNT}),
less as (
  select word, n, i, substring(word, 1, i) || substring(word, i + 2) as rest
  from (select word, n, unnest(range(0, length(word))) as i from words)),
near as (
  select a.word, b.word as other, b.n as other_n from less a join less b on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union select l.word, w.word, w.n from less l join words w on l.rest = w.word
  union select w.word, l.word, l.n from less l join words w on l.rest = w.word),
best as (
  select word, count(*) as n_near, max(other_n) as other_n, arg_min(other, (-other_n, other)) as other from near group by word),
forms as (select w.word, other as form, other_n as form_n from words w join best b using (word) where other_n >= {TIMES} * n),
walk as (
  select word, form as reached, 1 as steps from forms
  union all select walk.word, forms.form, steps + 1 from walk join forms on forms.word = reached),
roots as (select word, arg_max(reached, steps) as root from walk group by word)
select w.word, f.form, coalesce(root, w.word) as root, w.n, coalesce(n_near, 0)::bigint as n_near, f.form_n
from words w left join best using (word) left join forms f using (word) left join roots using (word)
"""
