"""Change detection and snapshot-to-snapshot updates of the file registry and its chunks."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import sha256, strip
from tessera.operators.chunk import ChunkConfig, chunk
from tessera.operators.embed import embed
from tessera.sources.shared import written

KEY = ["tenant_slug", "file_path"]
STATUSES = ("pending", "processing", "synced", "failed", "deleted")
RETRIED = ("pending", "processing", "failed")


def plan(snapshot: DataFrame, registry: DataFrame, force: bool = False, retry: bool = False) -> DataFrame:
    """One row per path of either side with its change: new, updated, deleted or unchanged. Hashes compare null-safe;
    ``retry`` also takes up files whose last run did not end well. What has no tenant or path is no file: such rows of the
    snapshot are left out (``quality.gate`` tells them apart) and those of the registry count as deleted."""
    fs = keyed(snapshot).select(*KEY, F.col("file_hash").alias("new_hash"), F.col("file_size").alias("new_size"), F.lit(True).alias("__fs"))
    db = registry.select(*KEY, F.col("file_hash").alias("old_hash"), F.col("sync_status").alias("old_status"), F.lit(True).alias("__db"))
    stale = ~F.col("new_hash").eqNullSafe(F.col("old_hash")) | F.lit(force)
    if retry:
        stale = stale | F.col("old_status").isin(*RETRIED)
    change = F.when(F.col("__db").isNull(), "new").when(F.col("__fs").isNull(), "deleted").when(stale, "updated").otherwise("unchanged")
    return fs.join(db, KEY, "full_outer").withColumn("change", change).drop("__fs", "__db")


def keyed(rows: DataFrame) -> DataFrame:
    return rows.where(F.col(KEY[0]).isNotNull() & F.col(KEY[1]).isNotNull())


def summary(planned: DataFrame) -> DataFrame:
    return planned.groupBy("change").agg(F.count("*").alias("n_files"), F.min("file_path").alias("first_path"), F.max("file_path").alias("last_path"))


def name_lists(planned: DataFrame) -> DataFrame:
    """Per kind of change the number of files and their sorted paths; the lists are as long as the plan."""
    return planned.groupBy("change").agg(F.count("*").alias("n_files"), F.sort_array(F.collect_list("file_path")).alias("paths"))


def preview(planned: DataFrame, most: int = 10) -> DataFrame:
    """Per kind of change its first paths and how many more there are, without listing the rest."""
    nth = F.row_number().over(Window.partitionBy("change").orderBy("file_path", "tenant_slug"))
    first = planned.select("change", "file_path", nth.alias("nth")).where(F.col("nth") <= most)
    shown = first.groupBy("change").agg(F.sort_array(F.collect_list("file_path")).alias("paths"))
    total = planned.groupBy("change").agg(F.count("*").alias("n_files"))
    return total.join(shown, "change").select("change", "n_files", "paths", (F.col("n_files") - F.size("paths")).alias("n_more"))


def apply(planned: DataFrame, registry: DataFrame) -> DataFrame:
    """The registry after the plan: deleted rows go, new and updated rows are processing with their new hash and size."""
    touched = planned.where(F.col("change").isin("new", "updated")).select(*KEY, F.col("new_hash").alias("file_hash"), F.col("new_size").alias("file_size"), F.lit("processing").alias("sync_status"))
    rest = keyed(registry).select(*KEY, "file_hash", "file_size", "sync_status").join(planned.where(F.col("change").isin("updated", "deleted")).select(*KEY), KEY, "left_anti")
    return rest.unionByName(touched)


def replace_chunks(chunks: DataFrame, fresh: DataFrame, changed: DataFrame, key: str = "file_id") -> DataFrame:
    """Replace-by-file: the changed files' chunks go and the fresh ones come, also where there are none."""
    return chunks.join(changed.select(key).distinct(), key, "left_anti").unionByName(fresh)


def delete_files(files: DataFrame, chunks: DataFrame, gone: DataFrame, key: str = "file_id") -> tuple[DataFrame, DataFrame]:
    keys = gone.select(key).distinct()
    return files.join(keys, key, "left_anti"), chunks.join(keys, key, "left_anti")


def orphans(chunks: DataFrame, files: DataFrame, key: str = "file_id") -> DataFrame:
    return chunks.join(files.select(key), key, "left_anti")


def without_orphans(chunks: DataFrame, files: DataFrame, key: str = "file_id", tenant: str | None = None) -> DataFrame:
    """Chunks that have a file. With ``tenant`` only that tenant's orphans go."""
    if tenant is None:
        return chunks.join(files.select(key).distinct(), key, "left_semi")
    gone = orphans(chunks.where(F.col("tenant_slug") == tenant), files, key).select(key).distinct()
    return chunks.join(gone.withColumn("tenant_slug", F.lit(tenant)), [key, "tenant_slug"], "left_anti").select(*chunks.columns)


class Synced(NamedTuple):
    """What a sync leaves: the registry, all chunks, and one row per changed file with its outcome."""

    registry: DataFrame
    chunks: DataFrame
    outcomes: DataFrame


def pieces_of(texts: DataFrame, config: ChunkConfig) -> DataFrame:
    """The chunks of texts (tenant_slug, file_path, text): chunk_index, content, chunk_hash, token_count. Blank texts and
    those under ten characters give none."""
    known = texts.select(*KEY, F.coalesce("text", F.lit("")).alias("text")).where(F.length(strip(F.col("text"))) >= 10)
    out = chunk(known, config.strategy, **({"size": config.size} if config.strategy == "semantic" else {"size": config.size, "overlap": config.overlap}))
    if config.max_chunks is not None:
        out = out.where(F.col("chunk_index") < config.max_chunks)
    return out.select(*KEY, "chunk_index", "content", sha256(F.col("content")).alias("chunk_hash"), "token_count")


def outcomes_of(changed: DataFrame, snapshot: DataFrame, pieces: DataFrame) -> DataFrame:
    """One row per changed file: its new hash and size, chunks made, and whether it ends as synced or failed, with the reason."""
    per = pieces.groupBy(*KEY).agg(F.count("*").alias("n_chunks"))
    done = changed.select(*KEY, "change").join(snapshot.select(*KEY, "file_hash", "file_size"), KEY).join(per, KEY, "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0).cast("long")))
    ok = F.col("n_chunks") > 0
    error = F.when(~ok, F.when(F.col("file_size") == 0, "empty").otherwise("no text"))
    return done.withColumns({"sync_status": F.when(ok, "synced").otherwise("failed"), "sync_error": error})


def sync(snapshot: DataFrame, registry: DataFrame, chunks: DataFrame, config: ChunkConfig | None = None, force: bool = False, retry: bool = True) -> Synced:
    """Carries a plan out: changed files are chunked and embedded, their chunks replace the old ones, deleted files and their
    chunks go.

    snapshot: tenant_slug, file_path, file_hash, file_size, text; chunks: tenant_slug, file_path, chunk_index, content,
    token_count, embedding, to which chunk_hash and embedding_model are added. A file without bytes or without text ends as failed with its reason, and its old chunks go
    too; a good one ends as synced without an error. The plan, the chunks and their vectors are worked out once and written to the shared folder, so that
    the three results agree; ``store.Store`` also keeps them."""
    config = config or ChunkConfig()
    planned = written(plan(snapshot, registry, force, retry).where("change <> 'unchanged'"), "plan")
    changed = planned.where(F.col("change").isin("new", "updated"))
    texts = snapshot.join(changed.select(*KEY), KEY, "left_semi").select(*KEY, "file_hash", "file_size", "text")
    fresh = written(embed(pieces_of(texts, config), config.model).withColumn("embedding_model", F.lit(config.model)), "fresh")
    done = outcomes_of(changed, snapshot, fresh)
    rest = keyed(registry).join(planned.select(*KEY), KEY, "left_anti")
    if "sync_error" not in rest.columns:
        rest = rest.withColumn("sync_error", F.lit(None).cast("string"))
    columns = [*KEY, "file_hash", "file_size", "sync_status", "sync_error"]
    kept = chunks.join(planned.select(*KEY), KEY, "left_anti")
    return Synced(rest.select(*columns).unionByName(done.select(*columns)), kept.unionByName(fresh, allowMissingColumns=True), done.select(*KEY, "change", "n_chunks", "sync_status", "sync_error"))


def outcome_summary(outcomes: DataFrame) -> DataFrame:
    """One row: files processed, synced and failed, chunks made, and how often each error came up."""
    errors = outcomes.where("sync_error is not null").groupBy("sync_error").count()
    histogram = errors.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("sync_error", "count")))).alias("errors"))
    counts = outcomes.agg(F.count("*").alias("n_files"), F.count_if(F.col("sync_status") == "synced").alias("n_synced"), F.count_if(F.col("sync_status") == "failed").alias("n_failed"), F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("n_chunks"))
    return counts.join(F.broadcast(histogram))  # one row each


def set_status(files: DataFrame, condition, status: str, error: str | None = None) -> DataFrame:
    """Rewrites the status where the condition holds; the error is cleared unless given."""
    if status not in STATUSES:
        raise ValueError(f"unknown status {status}")
    new = {"sync_status": F.when(condition, status).otherwise(F.col("sync_status"))}
    if "sync_error" in files.columns:  # in the same step, since the condition may look at the old status
        new["sync_error"] = F.when(condition, F.lit(error)).otherwise(F.col("sync_error"))
    return files.withColumns(new)


def reset_failed(files: DataFrame) -> DataFrame:
    return set_status(files, F.col("sync_status") == "failed", "pending")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keyed merge: a new row's values win where they are not null; a new row without a key is left out."""
    n = new.where(F.col(key).isNotNull()).select(*(F.col(c).alias(f"__{c}") for c in new.columns))
    merged = old.join(n, F.col(key) == F.col(f"__{key}"), "full_outer")
    return merged.select(*(F.coalesce(f"__{c}", c).alias(c) if c in new.columns else F.col(c) for c in old.columns))


def violations(files: DataFrame) -> DataFrame:
    """(rule, n) for the registry's checks that some rows break; zero rows are kept."""
    rules = {"file_size_positive": F.col("file_size") <= 0, "status_known": ~F.col("sync_status").isin(*STATUSES), "hash_present": F.col("file_hash").isNull() | (F.col("file_hash") == "")}
    counts = files.agg(*(F.count_if(c).alias(r) for r, c in rules.items()))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).alias("n")) for r in rules))).alias("x")).select("x.*")
