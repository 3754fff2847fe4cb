"""Removal of repeated passages: content-defined chunks of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.tables import Scratch, free_names

BASE, MODULUS = 1_000_003, 2_147_483_647
DIVISOR = 3
LONG_WORDS = 40
MIN_WORDS = 10
RUN_WORDS = 50


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for each row, however often the body uses it."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def words_in(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long")


def _chunk(lines: Column, first: Column, last: Column) -> Column:
    own = F.slice(lines, first, last - first + 1)
    n = F.aggregate(own, F.lit(0), lambda a, x: a + words_in(x))
    whole = ((last > first) & (n >= MIN_WORDS)) | (n >= LONG_WORDS)
    return F.struct(F.array_join(own, "\n").alias("chunk"), whole.alias("eligible"))


def chunks_of(text: Column, divisor: int = DIVISOR) -> Column:
    """The text's lines cut into chunks ``(chunk, eligible)``, in order.

    A hash rolled over two line hashes ends a chunk after about every ``divisor``-th line, so
    that an inserted line moves only the boundaries beside it. A line of ``LONG_WORDS`` words or
    more is a chunk of its own. Eligible for removal are those and chunks of several lines with
    ``MIN_WORDS`` words or more; a single short line never is.
    """
    def cut(per_line: Column, i: Column) -> Column:
        here, n = F.element_at(per_line, i), F.size(per_line)
        before = F.when(i > 1, F.element_at(per_line, F.greatest(i - 1, F.lit(1)))["h"]).otherwise(F.lit(0))
        rolled = F.pmod(F.pmod(before * BASE + here["h"], F.lit(MODULUS)), F.lit(divisor)) == 0
        after = F.element_at(per_line, F.least(i + 1, n))["w"]
        return (i == n) | rolled | (here["w"] >= LONG_WORDS) | (after >= LONG_WORDS)

    def cuts(lines: Column) -> Column:
        per_line = F.transform(lines, lambda x: F.struct(_line_hash(x).alias("h"), words_in(x).alias("w")))
        return bind(per_line, lambda p: F.filter(F.sequence(F.lit(1), F.size(p)), lambda i: cut(p, i)))

    def assemble(lines: Column) -> Column:
        return bind(cuts(lines), lambda ends: F.transform(ends, lambda e, k: _chunk(
            lines, F.when(k == 0, F.lit(1)).otherwise(F.element_at(ends, F.greatest(k, F.lit(1))) + 1), e)))

    return bind(F.split(text, "\n"), assemble)


def drop_repeated_chunks(docs: DataFrame, divisor: int = DIVISOR, id_col: str = "doc_id",
                         text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs``; the text without the chunks that stand elsewhere before.

    Of equal chunks the one of the smallest id stays (null first), in that text the first; every
    other is removed, within one text as well. Adds ``n_chunks`` and ``n_removed``. A text of
    which nothing is left is empty; a null text stays null with 0 chunks; rows equal in id and
    text are one document here and share its decision. Lines are split at line feeds only.

    Chunks meet by hash, pre-aggregated before the shuffle. The bytes are compared by keeping the
    smallest and the largest text of a hash: if they are equal, all are. The rare hashes with
    different texts are told apart by the texts themselves.
    """
    row, pos, one, gone, n_chunks, n_removed = free_names(docs, "_row", "_no", "_one", "_gone", "n_chunks", "n_removed")
    scratch = Scratch(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))
    rows = source.select("id", "row", F.posexplode(chunks_of(F.col("text"), divisor)).alias("no", "c")).where("c.eligible")
    rows = rows.select("id", "row", "no", F.xxhash64("c.chunk").alias("hash"), F.col("c.chunk").alias("chunk"))
    place = F.struct("id", "row", "no")
    met = rows.groupBy("hash").agg(
        F.count(F.lit(1)).alias("n"), F.min(place).alias("first"),
        F.min("chunk").alias("low"), F.max("chunk").alias("high")).where("n > 1")
    met = scratch.save(met.select("hash", "first", (F.col("low") == F.col("high")).alias("same")))

    again = rows.select("id", "row", "no", "hash").join(met.where("same").select("hash", "first"), "hash")
    removed = again.where(place > F.col("first")).select("id", "row", "no")
    clash = met.where("not same").select("hash")
    if not clash.isEmpty():
        apart = rows.join(clash, "hash")
        firsts = apart.groupBy("hash", "chunk").agg(F.min(place).alias("first"))
        removed = removed.union(apart.join(firsts, ["hash", "chunk"]).where(place > F.col("first")).select("id", "row", "no"))
    removed = removed.groupBy("id", "row").agg(F.collect_set("no").alias(gone)).select(
        F.col("id").alias(one), F.col("row").alias(row), gone)

    out = docs.join(removed, docs[id_col].eqNullSafe(removed[one]) & (F.xxhash64(docs[text_col]) == removed[row]), "left")
    gone_list = F.coalesce(F.col(gone), F.array().cast("array<int>"))
    cut = chunks_of(F.col(text_col), divisor)
    kept = bind(F.filter(cut, lambda c, i: ~F.array_contains(gone_list, i)),
                lambda left: F.array_join(F.transform(left, lambda c: c["chunk"]), "\n"))
    text = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(kept)
    return out.select(*[F.when(F.col(text_col).isNotNull(), text).alias(c) if c == text_col else docs[c] for c in docs.columns],
                      F.coalesce(F.size(cut), F.lit(0)).cast("long").alias(n_chunks),
                      F.size(gone_list).cast("long").alias(n_removed))


def _neighbours(text: Column) -> Column:
    """Every two neighbouring lines as one string, in order."""
    return bind(F.split(text, "\n"), lambda x: F.when(F.size(x) > 1, F.transform(
        F.slice(x, 1, F.size(x) - 1), lambda a, i: F.concat(a, F.lit("\n"), F.element_at(x, i + 2)))).otherwise(
            F.array().cast("array<string>")))


def _without_runs(text: Column, seen: Column, more_than: int) -> Column:
    """The text without its runs of lines of which every two neighbours are ``seen`` (ordered numbers, from 0,
    of the first of the two), where a run has more than ``more_than`` words."""
    def runs(at: Column) -> Column:  # first line and the line after the last, from 0
        begin = F.filter(at, lambda x: ~F.array_contains(at, x - 1))
        end = F.filter(at, lambda x: ~F.array_contains(at, x + 1))
        return F.zip_with(begin, end, lambda a, b: F.struct(a.alias("a"), (b + 2).alias("b")))

    def cut(lines: Column) -> Column:
        words = lambda r: F.aggregate(F.slice(lines, r["a"] + 1, r["b"] - r["a"]), F.lit(0), lambda n, x: n + words_in(x))
        return bind(F.filter(runs(seen), lambda r: words(r) > more_than), lambda out: F.filter(
            lines, lambda x, i: ~F.exists(out, lambda r: (r["a"] <= i) & (i < r["b"]))))

    return bind(F.split(text, "\n"), lambda lines: F.array_join(cut(lines), "\n"))


def drop_repeated_runs(docs: DataFrame, more_than: int = RUN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs``; the text without runs of repeated lines, whatever their lengths.

    Two neighbouring lines are repeated if the same two stand together in a smaller id (null first) or
    above. A run is a stretch of lines of which every two neighbours are repeated; one of more than
    ``more_than`` words goes whole. So every passage of several lines that stands before goes, wherever
    its host's lines are cut, and the first place of every line stays. Rows equal in id and text are
    one document. The lines meet by hash; those of a hash met twice are compared by their bytes.
    """
    row, one, seen = free_names(docs, "_row", "_one", "_seen")
    scratch = Scratch(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))
    pairs = source.select("id", "row", F.posexplode(_neighbours(F.col("text"))).alias("no", "both")).withColumn(
        "hash", F.xxhash64("both"))
    place = F.struct("id", "row", "no")
    met = scratch.save(pairs.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1"))
    again = pairs.join(met.select("hash", "first"), "hash")
    told = scratch.save(again.groupBy("hash").agg((F.min("both") == F.max("both")).alias("same")))
    clash = told.where("not same").select("hash")
    repeated = again.where(place > F.col("first"))
    if clash.isEmpty():
        repeated = repeated.select("id", "row", "no")
    else:
        apart = pairs.join(clash, "hash")
        firsts = apart.groupBy("hash", "both").agg(F.min(place).alias("first"))
        repeated = repeated.join(clash, "hash", "left_anti").select("id", "row", "no").union(
            apart.join(firsts, ["hash", "both"]).where(place > F.col("first")).select("id", "row", "no"))
    repeated = repeated.groupBy("id", "row").agg(F.sort_array(F.collect_set("no")).alias(seen)).select(
        F.col("id").alias(one), F.col("row").alias(row), seen)

    out = docs.join(repeated, docs[id_col].eqNullSafe(repeated[one]) & (F.xxhash64(docs[text_col]) == repeated[row]), "left")
    text = F.when(F.col(seen).isNull(), docs[text_col]).otherwise(_without_runs(docs[text_col], F.col(seen), more_than))
    return out.select(*[text.alias(c) if c == text_col else docs[c] for c in docs.columns])


CHUNKS_SQL = f"""
with lines as (
  select doc_id, n as no, line,
    length(line) - length(replace(line, ' ', '')) + 1 as w,
    ('0x' || substr(md5(line), 1, 8))::bigint as h
  from (select doc_id, unnest(string_split(text, chr(10))) as line,
               generate_subscripts(string_split(text, chr(10)), 1) as n from documents where text is not null)),
marked as (
  select *, (lead(no) over d is null or w >= {LONG_WORDS} or lead(w) over d >= {LONG_WORDS}
    or ((coalesce(lag(h) over d, 0) * {BASE} + h) % {MODULUS}) % {DIVISOR} = 0) as cut
  from lines window d as (partition by doc_id order by no)),
numbered as (
  select *, coalesce(sum(cut::int) over (partition by doc_id order by no rows between unbounded preceding and 1 preceding), 0) as k
  from marked),
chunks as (
  select doc_id, k, string_agg(line, chr(10) order by no) as chunk,
    (count(*) > 1 and sum(w) >= {MIN_WORDS}) or sum(w) >= {LONG_WORDS} as eligible
  from numbered group by doc_id, k),
decided as (
  select *, eligible and row_number() over (partition by eligible, chunk order by doc_id, k) > 1 as gone from chunks)
select d.doc_id,
  case when d.text is not null then coalesce(string_agg(chunk, chr(10) order by k) filter (where not gone), '') end as text,
  count(k) as n_chunks, count(*) filter (where gone) as n_removed
from documents d left join decided c on c.doc_id = d.doc_id
group by d.doc_id, d.text
"""
