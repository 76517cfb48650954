"""The engine's tables: their columns, making them, checking them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Table names with their columns, and what they are stored by.
TABLES = {
    "tenants": "slug string, name string, api_key string, is_active boolean, created_at timestamp, updated_at timestamp",
    "files": "file_id string, tenant_slug string, filename string, file_path string, file_size bigint, file_hash string, sync_status string, sync_error string, word_count int, created_at timestamp, updated_at timestamp, deleted_at timestamp",
    "embedding_chunks": "file_id string, tenant_slug string, chunk_index int, content string, chunk_hash string, token_count bigint, embedding array<float>, embedding_model string, processed_at timestamp",
    "sync_operations": "run_id string, tenant_slug string, operation_type string, status string, started_at timestamp, completed_at timestamp, files_processed int, files_added int, files_updated int, files_deleted int, chunks_created int, error_message string, error_details map<string,string>",
}
PARTITIONED = {"files": "tenant_slug", "embedding_chunks": "tenant_slug", "sync_operations": "tenant_slug"}
KEYS = {"tenants": ["slug"], "files": ["tenant_slug", "file_path"], "embedding_chunks": ["file_id", "chunk_index"], "sync_operations": ["run_id"]}


def create(spark: SparkSession, database: str) -> None:
    """Makes the database and its missing tables; those that exist stay as they are."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, columns in TABLES.items():
        by = f" PARTITIONED BY ({PARTITIONED[name]})" if name in PARTITIONED else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet{by}")


def problems(spark: SparkSession, database: str) -> list[str]:
    """What is missing: the database, a table, a column, or a column's type."""
    if not spark.catalog.databaseExists(database):
        return [f"no database {database}"]
    out = []
    for name, columns in TABLES.items():
        if not spark.catalog.tableExists(f"{database}.{name}"):
            out.append(f"no table {name}")
            continue
        have = dict(spark.table(f"{database}.{name}").dtypes)
        for column, kind in (c.strip().split(" ", 1) for c in columns.replace("map<string,string>", "map<string;string>").split(",")):
            kind = kind.replace(";", ",")
            if have.get(column) != kind:
                out.append(f"{name}.{column} is {have.get(column, 'missing')}, not {kind}")
    return out


def repeated_keys(table: DataFrame, name: str) -> DataFrame:
    """Keys of a table that more than one row has."""
    return table.groupBy(*KEYS[name]).agg(F.count("*").alias("n")).where("n > 1")
