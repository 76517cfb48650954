"""The engine's tables on disk, and syncs that write them: one tenant at a time, under a lease, with a log.

A sync plans against the stored registry, cuts the changed files, embeds the texts that no run has embedded before, and
then rewrites only the buckets of the chunk and registry tables that hold a changed file; chunks first, so that a
sync that breaks off leaves the old registry and is simply run again. What it did is counted while it is written."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera.operators import sync as Y
from tessera.operators.chunk import ChunkConfig
from tessera.operators.lease import Conflict, Lease
from tessera.operators.runlog import RunLog
from tessera.operators.vectorstore import VectorStore
from tessera.sources.buckets import Buckets
from tessera.sources.shared import written

FILES = "tenant_slug string, file_path string, file_hash string, file_size bigint, sync_status string, sync_error string, updated_at timestamp"
CHUNKS = "tenant_slug string, file_path string, chunk_index int, content string, chunk_hash string, token_count bigint, embedding_model string, embedding array<float>, processed_at timestamp"
ERRORS = ("empty", "no text")


@dataclass(frozen=True)
class Ran:
    """How a sync ended: completed or conflict; its run, counts by name, texts embedded and buckets rewritten."""

    status: str
    run_id: str | None = None
    counts: dict[str, int] = field(default_factory=dict)
    embedded: int = 0
    rewritten: int = 0


def _now() -> datetime:
    return datetime.now(UTC)


class Store:
    """``clock`` and ``ids`` may be given, so that times and run ids are known beforehand."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, ttl: float = 300.0, clock: Callable[[], datetime] = _now, ids: Callable[[], str] = lambda: uuid.uuid4().hex):
        self.spark, self.root, self.ttl, self.clock, self.ids = spark, root.rstrip("/"), ttl, clock, ids
        self._files = Buckets(spark, f"{self.root}/files", FILES, "file_path", ["tenant_slug"], buckets)
        self._chunks = Buckets(spark, f"{self.root}/chunks", CHUNKS, "file_path", ["tenant_slug"], buckets)
        self.vectors = VectorStore(spark, f"{self.root}/vectors")
        self.log = RunLog(spark, f"{self.root}/runs")

    def lease(self, tenant: str) -> Lease:
        return Lease(self.spark, f"{self.root}/leases", tenant, self.ttl, lambda: self.clock().timestamp())

    def registry(self) -> DataFrame:
        return self._files.read()

    def files(self) -> DataFrame:
        """The registry as search wants it: file_id is the path."""
        return self.registry().withColumns({"file_id": F.col("file_path"), "filename": F.element_at(F.split("file_path", "/"), -1)})

    def chunks(self) -> DataFrame:
        return self._chunks.read().withColumn("file_id", F.col("file_path"))

    def sync(self, tenant: str, snapshot: DataFrame, config: ChunkConfig | None = None, force: bool = False, retry: bool = True) -> Ran:
        """snapshot: tenant_slug, file_path, file_hash, file_size, text, of which the tenant's rows count. While another sync
        of the tenant runs, the answer is conflict and nothing is done. An error is logged and raised."""
        lease = self.lease(tenant)
        try:
            with lease.held():
                return self._logged(lease, tenant, snapshot, config or ChunkConfig(), force, retry)
        except Conflict:
            return Ran("conflict")

    def _logged(self, lease: Lease, tenant: str, snapshot: DataFrame, config: ChunkConfig, force: bool, retry: bool) -> Ran:
        run_id, started, kind = self.ids(), self.clock(), "full_sync" if force else "delta_sync"
        self.log.start(run_id, tenant, kind, started)
        try:
            ran, errors = self._run(run_id, lease, tenant, snapshot, config, force, retry)
        except Exception as e:
            self.log.end(run_id, tenant, kind, "failed", started, self.clock(), error=str(e)[:2000])
            raise
        self.log.end(run_id, tenant, kind, "completed", started, self.clock(), ran.counts, details=errors)
        return ran

    def _run(self, run_id: str, lease: Lease, tenant: str, snapshot: DataFrame, config: ChunkConfig, force: bool, retry: bool) -> tuple[Ran, dict[str, str]]:
        own = self._own(snapshot, tenant)
        changes, outcome = Observation(), Observation()
        per = [F.count_if(F.col("change") == c).alias(c) for c in ("new", "updated", "deleted")]
        todo = Y.plan(own, self._own(self.registry(), tenant), force, retry).where("change <> 'unchanged'")
        planned = written(todo.select(*Y.KEY, "change").observe(changes, *per), "plan")
        changed = planned.where(F.col("change").isin("new", "updated"))
        pieces = written(Y.pieces_of(own.join(changed.select(*Y.KEY), Y.KEY, "left_semi"), config), "pieces")
        embedded = self.vectors.add(pieces, config.model)

        at = F.lit(self.clock()).cast("timestamp")
        fresh = self.vectors.joined(pieces, config.model).withColumn("processed_at", at)
        done = Y.outcomes_of(changed, own, pieces).withColumn("updated_at", at)
        ended = F.col("sync_status") == "synced"
        done = done.observe(outcome, F.count(F.lit(1)).alias("files"), F.count_if(~ended).alias("failed"), F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("chunks"), *(F.count_if(F.col("sync_error") == e).alias(e) for e in ERRORS))
        lease.check()
        rewritten = self._chunks.replace(fresh, planned, {"tenant_slug": tenant})
        lease.check()
        rewritten += self._files.replace(done, planned, {"tenant_slug": tenant})
        plan_counts, seen = changes.get, outcome.get if rewritten else {}
        counts = {"files_processed": seen.get("files", 0), "files_added": plan_counts["new"], "files_updated": plan_counts["updated"], "files_deleted": plan_counts["deleted"], "chunks_created": seen.get("chunks", 0)}
        return Ran("completed", run_id, counts, embedded, rewritten), {e: str(seen[e]) for e in ERRORS if seen.get(e)}

    def _own(self, rows: DataFrame, tenant: str) -> DataFrame:
        return rows.where(F.col("tenant_slug") == tenant)

    def delete(self, tenant: str, paths: DataFrame) -> int:
        """Takes the files of ``paths`` (file_path) and their chunks away; gives the number of buckets rewritten."""
        with self.lease(tenant).held() as lease:
            gone = written(self._own(self.registry(), tenant).join(paths.select("file_path"), "file_path", "left_semi").select("file_path"), "gone")
            lease.check()
            n = self._chunks.replace(self.spark.createDataFrame([], CHUNKS), gone, {"tenant_slug": tenant})
            return n + self._files.replace(self.spark.createDataFrame([], FILES), gone, {"tenant_slug": tenant})

    def clean(self, tenant: str) -> int:
        """Takes the tenant's chunks without a file away and gives their number."""
        with self.lease(tenant).held() as lease:
            lost = written(Y.orphans(self._own(self._chunks.read(), tenant), self._own(self.registry(), tenant), "file_path").select("file_path"), "orphans")
            n = lost.count()
            lease.check()
            self._chunks.replace(self.spark.createDataFrame([], CHUNKS), lost, {"tenant_slug": tenant})
            return n

    def reset_failed(self, tenant: str) -> int:
        """The tenant's failed files become pending, without their error; gives their number."""
        with self.lease(tenant).held() as lease:
            failed = written(self._own(self.registry(), tenant).where("sync_status = 'failed'"), "failed")
            n = failed.count()
            lease.check()
            self._files.replace(Y.reset_failed(failed), failed, {"tenant_slug": tenant})
            return n
