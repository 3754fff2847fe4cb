"""File sources and sinks: corpus listing, TOC files, markup units, JSON and CSV output."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import content_id, normalize_whitespace, strip

TOC_SCHEMA = "title string, page_label string, level string"


def allowed_name(path, extensions: Sequence[str] = (".pdf",)):
    """Suffix test on the last path part, ignoring case."""
    suffix = F.lower(F.regexp_extract(path, r"[^/\\](\.[^./\\]+)$", 1))
    return suffix.isin(*[e.lower() for e in extensions])


def scan_corpus(spark: SparkSession, folder: str, extensions: Sequence[str] = (".pdf",),
                with_id: bool = True) -> DataFrame:
    """Files of a folder with an accepted extension, with their deterministic content id.

    Without the id only the listing is read, not the contents.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).where(
        allowed_name(F.col("path"), extensions))
    kept = found.select("path", "length", "modificationTime", *(["content"] if with_id else []))
    return kept.withColumn("doc_id", content_id(F.col("content"))).drop("content") if with_id else kept


def page_scan(pages: DataFrame, max_pages: int = 5) -> DataFrame:
    """The first pages of every document, trimmed."""
    return pages.where(F.col("page_index") < max_pages).withColumn("text", strip(F.col("text")))


def read_toc_json(spark: SparkSession, path: str) -> DataFrame:
    """TOC entry arrays, one file each; files that do not parse as UTF-8 are read as UTF-16."""
    def read(encoding: str) -> DataFrame:
        return (
            spark.read.option("multiLine", True).option("encoding", encoding)
            .schema(TOC_SCHEMA + ", _corrupt_record string").json(path)
            .withColumn("path", F.col("_metadata.file_path"))
            .where(F.col("_corrupt_record").isNull() & F.coalesce("title", "page_label", "level").isNotNull())
            .drop("_corrupt_record")
        )
    first = read("UTF-8")
    second = read("UTF-16").join(first.select("path").distinct(), "path", "left_anti")
    return first.unionByName(second)


TOC_LINE = f"doc_id string, part long, entries array<struct<{', '.join(f.replace(' ', ':', 1) for f in TOC_SCHEMA.split(', '))}>>"
TOC_PART = 4096          # entries of a line


def write_toc_lines(entries: DataFrame, path: str, position: str = "pos") -> None:
    """Contents entries as JSON lines, many documents to a file. A long list is several lines of one document.
    Spark's commit protocol makes the files visible when all tasks are done; a failed write leaves none."""
    part = F.floor(F.col(position) / TOC_PART).alias("part")
    entry = F.struct("title", "page_label", "level")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(position).alias("at"), entry.alias("entry")))), lambda x: x["entry"])
    write_json(entries.groupBy("doc_id", part).agg(ordered.alias("entries")), path, mode="errorifexists")


def read_toc_lines(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, pos, title, page_label, level`` of such files, which are split by bytes; lines that do not parse are left out."""
    lines = spark.read.schema(TOC_LINE).option("mode", "DROPMALFORMED").json(path)
    return lines.select("doc_id", "part", F.posexplode("entries").alias("at", "e")).select(
        "doc_id", (F.col("part") * TOC_PART + F.col("at")).alias("pos"), "e.*")


def html_units(pages: DataFrame) -> DataFrame:
    """Markup to typed units: ``h1`` is a heading, ``p`` is body; page furniture is dropped."""
    furniture = r"(?is)<(nav|footer|script|style|head)\b.*?</\1>|<!--.*?-->"
    pattern = r"(?is)<(?:h1|p)\b[^>]*>.*?(?=</?(?:h1|p|article|body|footer|nav|div|ul)\b|$)"
    body = F.regexp_replace("html", furniture, " ")
    units = pages.select("page_id", F.posexplode(F.regexp_extract_all(body, F.lit(pattern), 0))
                         .alias("unit_no", "raw"))
    plain = normalize_whitespace(F.regexp_replace("raw", r"(?s)<[^>]*>", " "))
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    return units.select(
        "page_id", "unit_no",
        F.when(F.lower(F.substring("raw", 1, 3)) == "<h1", "heading").otherwise("body").alias("type"),
        plain.alias("text"),
    ).where("text <> ''")


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines with null fields kept."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def json_rows(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Each row as one JSON text, null fields kept."""
    return df.select(*keys, F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def append_csv(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)
