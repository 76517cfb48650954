"""The gate: every check, nulls, repeated keys, one writing pass."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import quality as Q
from tessera.operators import sync as Y

SHAPE = "tenant_slug string, file_path string, file_hash string, file_size long, sync_status string"
ROWS = [("a", "1", "h", 5, "synced"), ("a", "2", "h", 0, "synced"), ("a", "3", "h", None, None), ("a", "4", None, -1, "odd"), (None, "5", "h", 1, "failed"), ("a", "1", "g", 5, "synced"), (None, None, "h", 1, "failed"), (None, None, "h", 1, "failed")]


def test_files(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SHAPE)
    out = Q.gate(df, "files", ("tenant_slug", "file_path"), str(tmp_path / "g"))
    assert sorted(r.file_path for r in out.good.collect()) == ["1", "3"]
    broken = sorted((str(r.file_path), r.broken) for r in out.bad.collect())
    assert broken == sorted([("2", ["file_size_positive"]), ("4", ["file_size_positive", "sync_status_known", "file_hash_present"]), ("5", ["tenant_slug_present"]), ("1", ["key_repeated"])] + 2 * [("None", ["tenant_slug_present", "file_path_present"])])
    assert out.counts == {"file_size_positive": 2, "sync_status_known": 1, "tenant_slug_present": 3, "file_path_present": 2, "file_hash_present": 1, "key_repeated": 1, "__rows": 6}
    assert out.good.columns == df.columns
    empty = Q.gate(df.where("false"), "files")
    assert empty.good.count() == empty.bad.count() == 0 and empty.counts["__rows"] == 0


@pytest.mark.parametrize(("table", "row", "rule"), [
    ("chunks", {"chunk_index": -1}, "chunk_index_non_negative"), ("chunks", {"token_count": 0}, "token_count_positive"), ("runs", {"operation_type": "odd"}, "operation_type_known"),
    ("runs", {"status": "odd"}, "status_known"), ("runs", {"progress_percentage": 100.5}, "progress_in_range"), ("runs", {"progress_percentage": -0.1}, "progress_in_range"),
    ("runs", {"current_file_index": -1}, "current_file_index_non_negative"), ("runs", {"total_files_to_process": -1}, "total_files_non_negative"),
    ("chunks", {}, None), ("runs", {"progress_percentage": None, "status": None, "current_file_index": None}, None), ("runs", {"progress_percentage": 100.0, "current_file_index": 0}, None),
])
def test_each_rule(spark, table, row, rule):
    whole = {"chunks": {"tenant_slug": "a", "chunk_index": 0, "content": "x", "token_count": 1}, "runs": {"tenant_slug": "a", "operation_type": "full_sync", "status": "running", "progress_percentage": 5.0, "current_file_index": 1, "total_files_to_process": 0}}[table] | row
    kinds = {str: "string", int: "long", float: "double", type(None): "double"}
    df = spark.range(1).select(*(F.lit(v).cast("string" if k == "status" else kinds[type(v)]).alias(k) for k, v in whole.items()))
    assert Q.marked(df, table).first().broken == ([rule] if rule else [])


def test_rows_without_a_key_do_not_pile_up(spark):
    """What has no tenant or path is no file: it neither comes again with each run nor stays in the registry."""
    registry = spark.createDataFrame([(None, "p", "x", 1, "synced"), ("a", "q", "x", 1, "synced")], SHAPE)
    snapshot = spark.createDataFrame([(None, "p", "x", 1, "synced"), ("a", None, "x", 1, "synced"), ("a", "q", "x", 1, "synced")], SHAPE)
    for _ in range(2):
        planned = Y.plan(snapshot, registry)
        registry = Y.apply(planned, registry)
        assert [(r.tenant_slug, r.file_path) for r in registry.collect()] == [("a", "q")]
    assert {(r.file_path, r.change) for r in Y.plan(snapshot, spark.createDataFrame([(None, "p", "x", 1, "synced")], SHAPE)).collect()} == {("q", "new"), ("p", "deleted")}
