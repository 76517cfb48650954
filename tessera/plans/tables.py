"""The engine's tables derived from the driver's: tenants, files, chunks, registry and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import sha256, strip
from tessera.operators.chunk import chunk_simple


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    slugs = table(spark, sf_dir, "documents").select(F.col("source").alias("slug")).where("slug is not null").distinct()
    return slugs.withColumn("api_key", sha256(F.concat(F.lit("key-"), "slug")))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    status = F.when(F.length(strip(F.col("text"))) < 10, "failed").when(F.col("doc_id") % 10 == 0, "pending").when(F.col("doc_id") % 10 == 1, "processing").otherwise("synced")
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    return d.select(F.col("doc_id").alias("file_id"), F.col("source").alias("tenant_slug"), name.alias("filename"), F.concat("source", F.lit("/"), name).alias("file_path"), F.octet_length("text").cast("long").alias("file_size"), sha256(F.col("text")).alias("file_hash"), status.alias("sync_status"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.col("source").alias("tenant_slug"), "text")
    return chunk_simple(d)


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an earlier run knew: a tenth is missing, a tenth had other bytes, a tenth has since gone; those left are in every state."""
    f = files(spark, sf_dir)
    old = f.where("file_id % 10 <> 4").withColumn("file_hash", F.when(F.col("file_id") % 10 == 1, F.reverse("file_hash")).otherwise(F.col("file_hash")))
    gone = f.where("file_id % 10 = 2").withColumns({"file_id": F.col("file_id") + 10**9, "file_path": F.concat("file_path", F.lit(".old"))})
    return old.unionByName(gone)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("run_id"), F.col("user_id").cast("string").alias("tenant_slug"), F.col("ts").alias("started_at"), F.when(F.col("event_id") % 7 == 0, "failed").otherwise("completed").alias("status"), F.col("value").alias("duration"))


#: The same in SQL, as the start of a WITH list.
SQL = r"""
tenants AS (SELECT DISTINCT source AS slug, sha256('key-' || source) AS api_key FROM documents WHERE source IS NOT NULL),
files AS (SELECT doc_id AS file_id, source AS tenant_slug, doc_id || '.txt' AS filename, source || '/' || doc_id || '.txt' AS file_path,
  CAST(strlen(text) AS BIGINT) AS file_size, sha256(text) AS file_hash,
  CASE WHEN length(regexp_replace(text, '^\s+|\s+$', '', 'g')) < 10 THEN 'failed' WHEN doc_id % 10 = 0 THEN 'pending'
       WHEN doc_id % 10 = 1 THEN 'processing' ELSE 'synced' END AS sync_status FROM documents),
bare AS (SELECT doc_id, source, text, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents),
worded AS (SELECT *, CASE WHEN t = '' THEN CAST([] AS VARCHAR[]) ELSE regexp_split_to_array(t, '\s+') END AS w FROM bare),
cut AS (SELECT *, unnest(CASE WHEN len(w) > 512 THEN range(0, len(w) - 50, 462) ELSE [0] END) AS s FROM worded WHERE length(t) >= 10),
chunks AS (SELECT doc_id AS file_id, source AS tenant_slug, CAST(s // 462 AS INTEGER) AS chunk_index,
  CASE WHEN len(w) <= 512 THEN text ELSE array_to_string(w[s + 1:s + 512], ' ') END AS content, CAST(least(len(w) - s, 512) AS BIGINT) AS token_count FROM cut),
registry AS (SELECT file_id, tenant_slug, filename, file_path, file_size, CASE WHEN file_id % 10 = 1 THEN reverse(file_hash) ELSE file_hash END AS file_hash, sync_status
  FROM files WHERE file_id % 10 <> 4 UNION ALL SELECT file_id + 1000000000, tenant_slug, filename, file_path || '.old', file_size, file_hash, sync_status FROM files WHERE file_id % 10 = 2),
plan AS (SELECT coalesce(f.tenant_slug, r.tenant_slug) AS tenant_slug, coalesce(f.file_path, r.file_path) AS file_path, f.file_hash AS new_hash, f.file_size AS new_size,
  r.file_hash AS old_hash, r.sync_status AS old_status, CASE WHEN r.file_path IS NULL THEN 'new' WHEN f.file_path IS NULL THEN 'deleted'
  WHEN f.file_hash IS DISTINCT FROM r.file_hash THEN 'updated' ELSE 'unchanged' END AS change
  FROM files f FULL OUTER JOIN registry r ON f.tenant_slug = r.tenant_slug AND f.file_path = r.file_path),
runs AS (SELECT event_id AS run_id, CAST(user_id AS VARCHAR) AS tenant_slug, ts AS started_at, CASE WHEN event_id % 7 = 0 THEN 'failed' ELSE 'completed' END AS status, value AS duration FROM events)"""
