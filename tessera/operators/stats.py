"""Counts over tenants, files, chunks and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def system(tenants: DataFrame, files: DataFrame, chunks: DataFrame) -> DataFrame:
    parts = [df.select(F.lit(n).alias("entity")).groupBy("entity").count() for n, df in (("tenants", tenants), ("files", files), ("chunks", chunks))]
    return parts[0].union(parts[1]).union(parts[2]).withColumnRenamed("count", "n")


def by_status(files: DataFrame) -> DataFrame:
    """Files per tenant and status, one column a status."""
    wanted = ("pending", "processing", "synced", "failed")
    return files.groupBy("tenant_slug").agg(*(F.count_if(F.col("sync_status") == s).alias(s) for s in wanted), F.count("*").alias("total"))


def status_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("sync_status").agg(F.count("file_id").alias("n"))


def inventory(tenants: DataFrame, files: DataFrame) -> DataFrame:
    """Per tenant, those without files too: files, bytes, synced files. Files are counted before they meet the tenants."""
    per = files.groupBy("tenant_slug").agg(F.count("file_id").alias("n_files"), F.sum("file_size").alias("bytes"), F.count_if(F.col("sync_status") == "synced").alias("n_synced"))
    zero = F.lit(0).cast("long")
    return tenants.join(per, tenants["slug"] == per["tenant_slug"], "left").select("slug", *(F.coalesce(c, zero).alias(c) for c in ("n_files", "bytes", "n_synced")))


def chunks_per_file(files: DataFrame, chunks: DataFrame) -> DataFrame:
    per = chunks.groupBy("file_id").agg(F.count("*").alias("n_chunks"))
    return files.join(per, "file_id", "left").select("tenant_slug", "file_id", "filename", F.coalesce("n_chunks", F.lit(0).cast("long")).alias("n_chunks"))


def tokens_per_tenant(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("tenant_slug").agg(F.count("*").alias("n_chunks"), F.round(F.avg("token_count"), 6).alias("avg_tokens"), F.sum("token_count").alias("sum_tokens"))


def chunk_overall(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("n_chunks"), F.round(F.avg("token_count"), 6).alias("avg_tokens"), F.min("token_count").alias("min_tokens"), F.max("token_count").alias("max_tokens"), F.count_distinct("embedding_model").alias("n_models"))


def success_rate(files: DataFrame) -> DataFrame:
    ok = F.count_if(F.col("sync_status") == "synced")
    return files.groupBy("tenant_slug").agg(ok.alias("n_ok"), F.count("*").alias("n_all"), F.round(100 * ok / F.greatest(F.count("*"), F.lit(1)), 6).alias("success_rate"))


def sync_flags(files: DataFrame) -> DataFrame:
    busy = F.col("sync_status") == "processing"
    return files.groupBy("tenant_slug").agg(F.count_if(busy).alias("n_processing"), F.bool_or(busy).alias("is_syncing"))


def run_metrics(runs: DataFrame) -> DataFrame:
    """Per tenant: runs, their success rate and mean duration. runs: tenant_slug, started_at, status, duration."""
    ok = F.count_if(F.col("status") == "completed")
    return runs.groupBy("tenant_slug").agg(F.count("*").alias("n_runs"), F.round(100 * ok / F.count("*"), 6).alias("success_rate"), F.round(F.avg("duration"), 4).alias("avg_duration"), F.max("started_at").alias("last_started"))


def latest_run(runs: DataFrame, n: int = 1) -> DataFrame:
    w = Window.partitionBy("tenant_slug").orderBy(F.desc("started_at"), F.desc("run_id"))
    return runs.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n)


def status_lists(files: DataFrame) -> DataFrame:
    """Per tenant the sorted names of its files by status, empty lists where there are none."""
    wanted = ("pending", "processing", "synced", "failed")
    names = lambda s: F.sort_array(F.collect_list(F.when(F.col("sync_status") == s, F.col("filename")))).alias(s)
    return files.groupBy("tenant_slug").agg(*(names(s) for s in wanted))


def tenant_summary(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per tenant: files, chunks and a map of files by status. Chunks are counted before they meet the files."""
    per = files.groupBy("tenant_slug", "sync_status").count().groupBy("tenant_slug").agg(F.sum("count").alias("total_files"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("sync_status", "count")))).alias("status_breakdown"))
    held = chunks.groupBy("tenant_slug").agg(F.count("*").alias("total_chunks"))
    return per.join(held, "tenant_slug", "left").withColumn("total_chunks", F.coalesce("total_chunks", F.lit(0).cast("long")))


def holdings(tenants: DataFrame, files: DataFrame, chunks: DataFrame, runs: DataFrame) -> DataFrame:
    """Per tenant what hangs on it: files, chunks and runs, each counted before it meets the tenants."""
    out = tenants.select("slug")
    for name, rows in (("n_files", files), ("n_chunks", chunks), ("n_runs", runs)):
        per = rows.groupBy(F.col("tenant_slug").alias("slug")).agg(F.count("*").alias(name))
        out = out.join(per, "slug", "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    return out


def most_chunks(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Tenants with their chunks, most first; those without chunks too."""
    held = chunks.groupBy("tenant_slug").agg(F.count("*").alias("n_chunks"))
    slugs = files.select("tenant_slug").distinct()
    return slugs.join(held, "tenant_slug", "left").select("tenant_slug", F.coalesce("n_chunks", F.lit(0).cast("long")).alias("n_chunks")).orderBy(F.desc("n_chunks"), "tenant_slug")


def busy_files(files: DataFrame) -> DataFrame:
    """Per tenant the files that are being processed, and if there are any."""
    busy = F.col("sync_status") == "processing"
    return files.groupBy("tenant_slug").agg(F.sort_array(F.collect_list(F.when(busy, F.col("filename")))).alias("currently_processing"), F.bool_or(busy).alias("is_syncing"))


def recent_confidence(scores: DataFrame, by: str, at: str, score: str, n: int = 5) -> DataFrame:
    """Per group the mean of the last ``n`` scores, as a whole percentage."""
    w = Window.partitionBy(by).orderBy(F.desc(at), F.desc(score))
    last = scores.withColumn("__nth", F.row_number().over(w)).where(F.col("__nth") <= n)
    return last.groupBy(by).agg(F.round(100 * F.avg(score)).cast("long").alias("percent"))


def batch_size(texts: DataFrame, by: str, text_col: str = "text") -> DataFrame:
    """Per group the mean length of its texts and the batch size that suits an embedder: long texts in small batches."""
    mean = F.avg(F.length(text_col))
    return texts.groupBy(by).agg(F.round(mean, 4).alias("avg_chars"), F.when(mean > 1000, 8).when(mean > 500, 16).otherwise(32).alias("batch_size"))


def run_report(runs: DataFrame, by: str = "tenant_slug") -> DataFrame:
    """One row over all groups: runs, the share that completed, the mean duration, and the group with the longest run."""
    ok = F.count_if(F.col("status") == "completed")
    return runs.agg(F.count("*").alias("n_runs"), ok.alias("n_completed"), F.round(100 * ok / F.greatest(F.count("*"), F.lit(1)), 6).alias("success_rate"), F.round(F.avg("duration"), 4).alias("avg_duration"), F.max_by(by, F.struct("duration", by)).alias("slowest"))


def error_types(runs: DataFrame, error: str) -> DataFrame:
    """How often each error came up, per tenant, as a map."""
    counts = runs.where(F.col(error).isNotNull()).groupBy("tenant_slug", error).count()
    return counts.groupBy("tenant_slug").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(error, "count")))).alias("error_types"), F.sum("count").alias("n_errors"))
