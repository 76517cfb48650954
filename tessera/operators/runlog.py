"""The log of sync runs: rows are only added, one when a run starts and one when it ends."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import stats
from tessera.sources.schema import TABLES

#: What a run may be and how it may stand.
OPERATIONS = ("full_sync", "delta_sync", "file_sync")
STATUSES = ("running", "completed", "failed", "cancelled")
SHAPE = TABLES["sync_operations"]


class RunLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _add(self, row: dict) -> None:
        if row["operation_type"] not in OPERATIONS or row["status"] not in STATUSES:
            raise ValueError(f"no such operation or status: {row['operation_type']}, {row['status']}")
        self.spark.createDataFrame([row], SHAPE).coalesce(1).write.mode("append").parquet(self.path)

    def start(self, run_id: str, tenant: str, operation: str, at: datetime) -> None:
        self._add({"run_id": run_id, "tenant_slug": tenant, "operation_type": operation, "status": "running", "started_at": at})

    def end(self, run_id: str, tenant: str, operation: str, status: str, started: datetime, at: datetime, counts: dict | None = None, error: str | None = None, details: dict | None = None) -> None:
        self._add({"run_id": run_id, "tenant_slug": tenant, "operation_type": operation, "status": status, "started_at": started, "completed_at": at, "error_message": error, "error_details": details} | (counts or {}))

    def runs(self) -> DataFrame:
        """One row a run, as it stands now: its end where there is one."""
        rows = self.spark.read.schema(SHAPE).parquet(self.path)
        names = rows.columns
        last = rows.groupBy("run_id").agg(F.max_by(F.struct(*names), F.struct(F.col("status") != "running", F.coalesce("completed_at", "started_at"))).alias("r"))
        return last.select("r.*").withColumn("duration", F.col("completed_at").cast("double") - F.col("started_at").cast("double"))

    def history(self, tenant: str, n: int = 10) -> DataFrame:
        """A tenant's last runs, newest first."""
        own = self.runs().where(F.col("tenant_slug") == tenant)
        return own.orderBy(F.desc("started_at"), F.desc("run_id")).limit(n)

    def metrics(self, since: datetime | None = None) -> DataFrame:
        """Per tenant: ended runs, their success rate, mean duration and last start; ``since`` bounds their starts."""
        ended = self.runs().where("status <> 'running'")
        return stats.run_metrics(ended if since is None else ended.where(F.col("started_at") >= F.lit(since)))
