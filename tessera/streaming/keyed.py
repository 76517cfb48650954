"""Ingestion with keyed state: what is known of each file is kept in the stream, and only changes come out.

The state of a (tenant, path) is its last version, hash and whether it is there. An observation whose version is not above
the last one is late and goes; one with the same hash changes nothing and gives nothing; a tombstone deletes. The state
lives in RocksDB beside the stream's checkpoint, so it may outgrow memory and survives executors."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tessera.operators.sync import KEY, keyed, plan

STATE = "file_hash string, version long, present boolean"
CHANGES = "tenant_slug string, file_path string, change string, file_hash string, version long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FileState(StatefulProcessor):
    """Observations (tenant_slug, file_path, file_hash, version, deleted) of one file -> its changes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.last.get() if self.last.exists() else None
        hash_, version, present = known if known is not None else (None, None, False)
        before = version
        # of rows of one version the deletion goes first and then the largest hash wins, whatever order they come in
        for r in sorted((r for r in rows if r.version is not None), key=lambda r: (r.version, not r.deleted, r.file_hash or "")):
            if before is not None and r.version <= before:
                continue
            version = r.version
            change = None
            if r.deleted:
                change = "deleted" if present else None
                hash_, present = None, False
            elif not present:
                change, hash_, present = "new", r.file_hash, True
            elif r.file_hash != hash_:
                change, hash_ = "updated", r.file_hash
            if change:
                yield Row(tenant_slug=key[0], file_path=key[1], change=change, file_hash=hash_, version=version)
        if version != before:
            self.last.update((hash_, version, present))

    def close(self) -> None:
        pass


def file_changes(observations: DataFrame) -> DataFrame:
    """The changes in a stream of observations; what has no tenant, path or version is left out. Set
    ``spark.sql.streaming.stateStore.providerClass`` to ``PROVIDER`` before the stream starts."""
    rows = keyed(observations).select(*KEY, "file_hash", F.col("version").cast("long").alias("version"), F.coalesce("deleted", F.lit(False)).alias("deleted"))
    return rows.groupBy(*KEY).transformWithState(statefulProcessor=FileState(), outputStructType=CHANGES, outputMode="Append", timeMode="None")


def observations(snapshot: DataFrame, before: DataFrame, version: int) -> DataFrame:
    """A snapshot as observations of one version, with tombstones for the files that the one before had and it has not."""
    planned = plan(snapshot, before)
    gone = F.col("change") == "deleted"
    return planned.select(*KEY, F.col("new_hash").alias("file_hash"), F.lit(version).cast("long").alias("version"), gone.alias("deleted"))


def change_stream(source: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Appends the changes to a Parquet folder, all that is there now, and ends."""
    source.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return file_changes(source).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def registry_of(spark: SparkSession, sink: str) -> DataFrame:
    """The registry that the changes lead to: of each file the last one, if it is no deletion."""
    rows = spark.read.schema(CHANGES).parquet(sink)
    order = F.struct("version", F.col("change") != "deleted", F.coalesce("file_hash", F.lit("")))
    last = rows.groupBy(*KEY).agg(F.max_by(F.struct("change", "file_hash", "version"), order).alias("x"))
    return last.select(*KEY, "x.*").where("change <> 'deleted'").drop("change")
