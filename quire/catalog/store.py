"""Registry, uploads, deletes, listings, frequencies and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.catalog import inputs as I
from quire.catalog.base import query, table
from quire.operators import frequency as Q
from quire.operators import stats as ST
from quire.operators import store as S
from quire.sources import views as V

REG = ["doc_id", "title", "source_path", "total_pages", "seq"]
COLS = ", ".join(REG)

UPSERTED = I.REGISTRY + """,
versions as (select * from registry union all
  select doc_id, 'new ' || title, source_path, total_pages + 1, seq + 1000000 from registry where seq % 10 = 0),
current as (select * from (select *, row_number() over (partition by doc_id order by seq desc) r from versions) where r = 1)"""


def upserted(spark, sf_dir):
    r = V.registry(spark, sf_dir)
    updates = r.where(F.col("seq") % 10 == 0).select(
        "doc_id", F.concat(F.lit("new "), "title").alias("title"), "source_path",
        (F.col("total_pages") + 1).alias("total_pages"), (F.col("seq") + 1000000).alias("seq"))
    return S.upsert(r, updates, ["doc_id"], "seq")


def requested(spark, sf_dir):
    """Ids of the documents labelled toxic, next to as many unknown ones."""
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    ids = V.registry(spark, sf_dir).join(toxic.withColumnRenamed("doc_id", "seq"), "seq").select("doc_id")
    return ids.unionByName(toxic.select(F.concat(F.lit("x"), "doc_id").alias("doc_id")))


REQUESTED = """requested as (select substr(sha256(text), 1, 16) doc_id from documents join labels using (doc_id)
    where toxic = 1 union all select 'x' || doc_id from labels where toxic = 1)"""


@query("registry_upsert", f"with {UPSERTED} select {COLS} from current")
def registry_upsert(spark, sf_dir):
    return upserted(spark, sf_dir)


@query("registry_lookup", f"with {UPSERTED}, {REQUESTED} select {COLS} from current where doc_id in (select doc_id from requested)")
def registry_lookup(spark, sf_dir):
    return S.lookup(upserted(spark, sf_dir), requested(spark, sf_dir)).select(*REG)


@query("registry_delete", f"""with {UPSERTED}, {REQUESTED}
  select doc_id, 'kept' as state from current where doc_id not in (select doc_id from requested)
  union all select distinct doc_id, case when doc_id in (select doc_id from current) then 'deleted' else 'missing' end
  from requested""")
def registry_delete(spark, sf_dir):
    reg, ids = upserted(spark, sf_dir), requested(spark, sf_dir)
    report = S.delete_report(reg, ids).select(
        "doc_id", F.when(F.col("deleted"), "deleted").otherwise("missing").alias("state"))
    return S.delete(reg, ids).select("doc_id", F.lit("kept").alias("state")).unionByName(report)


@query("registry_export", f"""with {UPSERTED}, done as (select substr(sha256(text), 1, 16) doc_id from documents
  where doc_id in (select doc_id from labels)) select {COLS} from current where doc_id not in (select doc_id from done)""")
def registry_export(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("seq"))
    done = V.registry(spark, sf_dir).join(labels, "seq", "left_semi")
    return S.new_rows(upserted(spark, sf_dir), done).select(*REG)


@query("document_exists", f"""with {I.REGISTRY}, {REQUESTED} select distinct doc_id,
  doc_id in (select doc_id from registry) as found from requested""")
def document_exists(spark, sf_dir):
    return S.exists_flag(requested(spark, sf_dir).distinct(), V.registry(spark, sf_dir))


FILES = """files as (select source as batch, doc_id, case doc_id % 7 when 0 then '' when 1 then 'a' || doc_id || '.txt'
   else 'a' || doc_id || '.PDF' end as file_name, case when n_chars < 200 then 'no chunks' end as error from documents)"""


def files(spark, sf_dir):
    m = F.col("doc_id") % 7
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("batch"), "doc_id",
        F.when(m == 0, "").when(m == 1, F.concat(F.lit("a"), "doc_id", F.lit(".txt")))
        .otherwise(F.concat(F.lit("a"), "doc_id", F.lit(".PDF"))).alias("file_name"),
        F.when(F.col("n_chars") < 200, "no chunks").alias("error"))


@query("ingestion_report", f"""with {FILES} select file_name, case when error is null then 1 else 0 end as status from files""")
def ingestion_report(spark, sf_dir):
    return S.ingestion_report(files(spark, sf_dir))


@query("ingest_batch_summary", f"""with {FILES}, o as (select batch, file_name <> '' and lower(file_name) like '%.pdf'
  and error is null as ok from files) select *, case when ingested_count > 0 and failed_count = 0 then 'success'
  when ingested_count > 0 then 'partial' else 'failed' end as status from (select batch, count(*) uploaded_count,
  count(*) filter (ok) ingested_count, count(*) filter (not ok) failed_count from o group by 1)""")
def ingest_batch_summary(spark, sf_dir):
    return S.ingest_batch_summary(files(spark, sf_dir))


VEC_VERSIONS = I.CHUNK_VECTORS + """,
vectors as (select doc_id || '_' || chunk_id as id, doc_id, chunk_id, embedding, vec_id as version from chunk_vectors),
vec_versions as (select * from vectors union all
  select id, doc_id, chunk_id, list_transform(embedding, lambda x: -x), version + 1000000 from vectors where version % 7 = 0),
vec_current as (select * from (select *, row_number() over (partition by id order by version desc) r from vec_versions) where r = 1)"""


def vectors(spark, sf_dir):
    return V.chunk_vectors(spark, sf_dir).select(
        F.concat_ws("_", "doc_id", "chunk_id").alias("id"), "doc_id", "chunk_id",
        "embedding", F.col("vec_id").alias("version"))


VEC_VALUES = """select id, doc_id, chunk_id, version, pos - 1 as pos, embedding[pos]::double as value
  from (select *, unnest(generate_series(1, len(embedding))) as pos from {})"""


def vec_values(v):
    """One row per component of the stored vectors."""
    return v.select("id", "doc_id", "chunk_id", "version", F.posexplode("embedding").alias("pos", "value")).select(
        "id", "doc_id", "chunk_id", "version", F.col("pos").cast("long").alias("pos"), F.col("value").cast("double").alias("value"))


def vec_current(spark, sf_dir):
    v = vectors(spark, sf_dir)
    new = v.where(F.col("version") % 7 == 0).withColumns({"embedding": F.transform("embedding", lambda x: -x), "version": F.col("version") + 1000000})
    return S.upsert(v, new, ["id"], "version")


@query("vector_upsert", f"with {VEC_VERSIONS} {VEC_VALUES.format('vec_current')}")
def vector_upsert(spark, sf_dir):
    return vec_values(vec_current(spark, sf_dir))


@query("vector_delete", f"""with {VEC_VERSIONS} {VEC_VALUES.format('vec_current')}
  where doc_id not in (select 'd' || n_nationkey from nation where n_regionkey = 1)""")
def vector_delete(spark, sf_dir):
    ids = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(
        F.concat(F.lit("d"), "n_nationkey").alias("doc_id"))
    return vec_values(S.delete(vec_current(spark, sf_dir), ids))


RAW_IDS = """raw_ids as (select doc_id as pos, case doc_id % 5 when 0 then '  ' when 1 then '  ' || k || ' '
  when 2 then 'missing' || doc_id else k end as value from (select doc_id, substr(sha256(text), 1, 16) k from documents)),
outcome as (select v as doc_id, min(pos) pos, case when v in (select doc_id from current) then 'deleted'
   else 'document not found' end as outcome from (select trim(value) v, pos from raw_ids) where v <> '' group by 1)"""


def raw_ids(spark, sf_dir):
    m, k = F.col("seq") % 5, F.col("doc_id")
    return V.registry(spark, sf_dir).select(
        F.col("seq").alias("pos"),
        F.when(m == 0, "  ").when(m == 1, F.concat(F.lit("  "), k, F.lit(" ")))
        .when(m == 2, F.concat(F.lit("missing"), "seq")).otherwise(k).alias("value"))


@query("bulk_delete", f"with {UPSERTED}, {RAW_IDS} select doc_id, pos, outcome from outcome")
def bulk_delete(spark, sf_dir):
    return S.bulk_delete(raw_ids(spark, sf_dir), upserted(spark, sf_dir))


@query("bulk_delete_summary", f"""with {UPSERTED}, {RAW_IDS} select *, case when deleted_count > 0 and failed_count = 0
  then 'success' when deleted_count > 0 then 'partial' else 'failed' end as status from (
  select count(*) requested_count, count(*) filter (outcome = 'deleted') deleted_count,
         count(*) filter (outcome <> 'deleted') failed_count from outcome)""")
def bulk_delete_summary(spark, sf_dir):
    return S.bulk_delete_summary(S.bulk_delete(raw_ids(spark, sf_dir), upserted(spark, sf_dir)))


@query("document_search", f"""with {I.REGISTRY} select {COLS} from registry where contains(lower(title), 'rc1')
  or contains(lower(source_path), 'rc1') or contains(lower(doc_id), 'rc1')""")
def document_search(spark, sf_dir):
    return S.document_search(V.registry(spark, sf_dir), "  Rc1 ")


@query("paginate", f"""with {I.REGISTRY}, t as (select count(*) n from registry) select {COLS}, 3 as page,
  cast(greatest(1, ceil(n / 10.0)) as integer) as total_pages_all from registry, t order by title, seq limit 10 offset 20""")
def paginate(spark, sf_dir):
    out = S.paginate(V.registry(spark, sf_dir).withColumnRenamed("total_pages", "n_pages"),
                     [F.col("title"), F.col("seq")], 3)
    return out.withColumnsRenamed({"total_pages": "total_pages_all", "n_pages": "total_pages"})


VALUES = """vals as (select value, count(*) n, min(event_id * 10 + p) f from (
  select event_id, unnest([event_type, event_type, 'u' || (user_id % 5), json_extract_string(props, '$.k')]) as value,
         unnest([0, 1, 2, 3]) p from events) where value is not null group by 1)"""


def counts(spark, sf_dir):
    return Q.frequency_count(
        table(spark, sf_dir, "events"), "event_id", F.col("event_type"),
        F.array("event_type", F.concat(F.lit("u"), F.col("user_id") % 5)),
        F.from_json("props", "map<string,string>"))


@query("frequency_count", f"with {VALUES} select value, n from vals")
def frequency_count(spark, sf_dir):
    return counts(spark, sf_dir).select("value", "n")


@query("most_common", f"with {VALUES} select value, n from vals order by n desc, f limit 10")
def most_common(spark, sf_dir):
    return Q.most_common(counts(spark, sf_dir), 10)


@query("frequency_dominant", f"with {VALUES} select value from vals order by n desc, f limit 1")
def frequency_dominant(spark, sf_dir):
    return Q.dominant(counts(spark, sf_dir))


@query("frequency_min_count", f"with {VALUES} select value, n from vals where n >= 100")
def frequency_min_count(spark, sf_dir):
    return Q.min_frequency(counts(spark, sf_dir), 100)


@query("frequency_normalize", f"with {VALUES} select value, round_even(n / (select sum(n) from vals)::double, 4) as share from vals")
def frequency_normalize(spark, sf_dir):
    return Q.normalize(counts(spark, sf_dir))


@query("admin_statistics", f"""with {I.MESSAGES}, {I.REGISTRY}, {I.CHUNK_VECTORS} select
  (select count(distinct doc_id) from registry) as documents_count, (select count(*) from chunk_vectors) as vector_chunks_count,
  (select count(distinct user_id) from messages) as users_count, (select count(distinct user_id) from messages where user_id = '0') as admin_users_count,
  (select count(distinct thread_id) from messages) as threads_count, (select count(*) from messages) as messages_count""")
def admin_statistics(spark, sf_dir):
    return ST.admin_statistics(
        V.registry(spark, sf_dir), V.chunk_vectors(spark, sf_dir),
        V.messages(spark, sf_dir).withColumn("user_role", F.when(F.col("user_id") == "0", "admin").otherwise("user")))
