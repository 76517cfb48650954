"""One query per operator on the driver's tables, each with the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import ids as ID
from tessera.functions import text as X
from tessera.functions import vector as V
from tessera.operators import chunk as C
from tessera.operators import embed as E
from tessera.operators import ivf as IVF
from tessera.operators import paging as PG
from tessera.operators import quality as QG
from tessera.operators import retrieve as R
from tessera.operators import search as S
from tessera.operators import stats as A
from tessera.operators import sync as Y
from tessera.operators import tenants as N
from tessera.plans import tables as T
from tessera.sources.shared import shared_folder, written
from tessera.streaming.ingest import event_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SLUG = "src3"


def query(sql: str, derived: bool = True):
    """Registers a query under its function's name, with its SQL over the derived (or only the plain) tables."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = (f"WITH {T.SQL}\n{sql}" if derived else sql).replace("$SLUG", SLUG)
        return f

    return add


def _documents(s, d):
    return T.table(s, d, "documents")


# scans and lookups


@query("SELECT * FROM files WHERE tenant_slug = '$SLUG'")
def scan_files_by_tenant(s, d):
    return N.TenantView(SLUG).of(T.files(s, d))


@query("SELECT file_id, file_path, sync_status FROM files WHERE tenant_slug = '$SLUG' AND file_path = (SELECT min(file_path) FROM files WHERE tenant_slug = '$SLUG')")
def file_point_lookup(s, d):
    f = N.TenantView(SLUG).of(T.files(s, d))
    first = f.agg(F.min("file_path").alias("first"))
    return N.only(f.join(F.broadcast(first)), F.col("file_path") == F.col("first")).select("file_id", "file_path", "sync_status")  # first: one row


@query("SELECT file_id, chunk_index, token_count FROM chunks WHERE file_id = 7")
def chunks_for_file(s, d):
    return T.chunks(s, d).where("file_id = 7").select("file_id", "chunk_index", "token_count").orderBy("chunk_index")


@query("SELECT doc_id, sha256(text) AS file_hash FROM documents", False)
def file_hash(s, d):
    return _documents(s, d).select("doc_id", X.sha256(F.col("text")).alias("file_hash"))


@query("SELECT slug FROM tenants WHERE api_key = sha256('key-$SLUG')")
def auth_lookup(s, d):
    import hashlib

    return N.by_key(T.tenants(s, d), hashlib.sha256(f"key-{SLUG}".encode()).hexdigest()).select("slug")


@query("SELECT file_id, sync_status FROM files WHERE sync_status IN ('pending', 'failed')")
def files_by_status_set(s, d):
    return T.files(s, d).where(F.col("sync_status").isin("pending", "failed")).select("file_id", "sync_status")


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE lang = 'en' AND source IN ('src1', 'src2') AND n_chars BETWEEN 100 AND 2000", False)
def metadata_filter(s, d):
    return S.metadata_filter(_documents(s, d), {"lang": "en"}, {"source": ["src1", "src2"]}, {"n_chars": (100, 2000)}).select("doc_id", "lang", "source", "n_chars")


@query("SELECT file_id, file_path FROM files ORDER BY file_path, file_id LIMIT 20 OFFSET 20")
def page_files(s, d):
    return S.page(T.files(s, d).select("file_id", "file_path"), ["file_path", "file_id"], 2, 20)


@query("SELECT file_id, file_path FROM files ORDER BY file_path, file_id LIMIT 20 OFFSET 20")
def page_files_indexed(s, d):
    """The same page from a sorted table, of which only the ranges that hold it are read."""
    return PG.pages(T.files(s, d).select("file_id", "file_path"), ["file_path", "file_id"]).page(s, 2, 20)


@query("SELECT file_id, file_path FROM files WHERE (file_path, file_id) > ('src12/', 0) ORDER BY file_path, file_id LIMIT 20")
def page_after_key(s, d):
    return PG.pages(T.files(s, d).select("file_id", "file_path"), ["file_path", "file_id"]).after(s, ("src12/", 0), 20)


@query("SELECT file_id, sync_status, file_size FROM files ORDER BY file_id DESC LIMIT 10")
def recent_files(s, d):
    return T.files(s, d).select("file_id", "sync_status", "file_size").orderBy(F.desc("file_id")).limit(10)


@query("SELECT slug, created_at FROM (SELECT tenant_slug AS slug, min(started_at) AS created_at FROM runs GROUP BY tenant_slug) ORDER BY created_at, slug")
def tenants_by_creation(s, d):
    """A tenant came when its first run started."""
    return N.by_creation(T.runs(s, d).groupBy(F.col("tenant_slug").alias("slug")).agg(F.min("started_at").alias("created_at")))


@query("SELECT slug, (SELECT count(*) FROM tenants) AS total FROM tenants")
def tenant_list(s, d):
    return N.with_total(T.tenants(s, d).select("slug"))


@query("SELECT tenant_slug, filename, file_size FROM files ORDER BY tenant_slug, filename, file_id LIMIT 20")
def files_by_name(s, d):
    return T.files(s, d).orderBy("tenant_slug", "filename", "file_id").limit(20).select("tenant_slug", "filename", "file_size")


@query("SELECT slug, (SELECT count(*) FROM files f WHERE f.tenant_slug = slug) AS n_files, (SELECT count(*) FROM chunks c WHERE c.tenant_slug = slug) AS n_chunks, (SELECT count(*) FROM runs r WHERE 'src' || (CAST(r.tenant_slug AS BIGINT) % 25) = slug) AS n_runs FROM tenants")
def tenant_holdings(s, d):
    """Runs belong to users, whose numbers are dealt to the tenants."""
    runs = T.runs(s, d).withColumn("tenant_slug", F.concat(F.lit("src"), (F.col("tenant_slug").cast("long") % 25).cast("string")))
    return A.holdings(T.tenants(s, d), T.files(s, d), _chunk_rows(s, d, "tenant_slug"), runs)


_UUID = "md5('=' || file_id || chr(31) || '=' || file_path)"


@query(f"SELECT file_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-3' || substr(h, 14, 3) || '-' || substr('89ab', CAST(('0x' || substr(h, 17, 1)) AS INTEGER) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid FROM (SELECT file_id, {_UUID} AS h FROM files)")
def row_uuids(s, d):
    """Ids that a task which runs again makes again."""
    return T.files(s, d).select("file_id", ID.row_uuid(F.col("file_id"), F.col("file_path")).alias("uuid"))


@query("""SELECT file_id, '{"filename":"' || filename || '","retries":"0","status":"' || sync_status || '"}' AS merged FROM files""")
def merged_maps(s, d):
    """Settings with what is known of a file put over them."""
    base = F.create_map(F.lit("status"), F.lit("pending"), F.lit("retries"), F.lit("0"))
    own = F.create_map(F.lit("status"), F.col("sync_status"), F.lit("filename"), F.col("filename"))
    entries = F.sort_array(F.map_entries(X.merged(base, own)))
    return T.files(s, d).select("file_id", F.to_json(F.map_from_entries(entries)).alias("merged"))


@query("SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n, CAST(embedding[1] AS DOUBLE) AS first FROM embeddings", False)
def vector_floats(s, d):
    v = V.floats(F.col("embedding").cast("array<double>"))
    return T.table(s, d, "embeddings").select("vec_id", F.size(v).alias("n"), F.get(v, F.lit(0)).cast("double").alias("first"))


@query(r"SELECT doc_id, md5(regexp_replace(replace(text, chr(65533), ''), '\r\n?', chr(10), 'g')) AS digest FROM documents", False)
def extract_untrimmed(s, d):
    """Bytes as text, with the white space at both ends."""
    raw = F.encode("text", "UTF-8")
    return _documents(s, d).select("doc_id", F.md5(X.decode(raw, trim=False).cast("binary")).alias("digest"))


# chunkers


@query("SELECT file_id AS doc_id, chunk_index, token_count, sha256(content) AS chunk_hash FROM chunks")
def chunk_simple(s, d):
    return C.chunk_simple(_documents(s, d).select("doc_id", "text")).select("doc_id", "chunk_index", "token_count", "chunk_hash")


@query("SELECT file_id AS doc_id, chunk_index, token_count, sha256(content) AS chunk_hash FROM chunks WHERE chunk_index < 3")
def chunk_capped(s, d):
    """The cap of an embedding step as an explicit choice."""
    return C.chunk_simple(_documents(s, d).select("doc_id", "text"), max_chunks=3).select("doc_id", "chunk_index", "token_count", "chunk_hash")


_FIXED = """, fixed AS (SELECT doc_id, w, unnest(CASE WHEN len(w) > 512 THEN range(0, len(w) - {o}, {p}) ELSE [0] END) AS s FROM worded WHERE len(w) > 0),
f2 AS (SELECT doc_id, CAST(s // {p} AS INTEGER) AS chunk_index, array_to_string(w[s + 1:s + 512], ' ') AS content, CAST(length(array_to_string(w[1:s], ' ')) AS BIGINT) AS start_char,
CAST(least(len(w) - s, 512) AS BIGINT) AS token_count FROM fixed)
SELECT doc_id, chunk_index, start_char, start_char + length(content) AS end_char, token_count, sha256(content) AS chunk_hash FROM f2"""


def _fixed_columns(df):
    return df.select("doc_id", "chunk_index", "start_char", "end_char", "token_count", X.sha256(F.col("content")).alias("chunk_hash"))


@query(_FIXED.format(o=50, p=462))
def chunk_fixed_offsets(s, d):
    return _fixed_columns(C.chunk(_documents(s, d).select("doc_id", "text"), "fixed"))


@query(_FIXED.format(o=100, p=412))
def chunk_sliding(s, d):
    return _fixed_columns(C.chunk(_documents(s, d).select("doc_id", "text"), "sliding_window"))


@query(r""", parts AS (SELECT doc_id, string_split(text, '. ') AS p FROM bare WHERE t <> ''),
sized AS (SELECT doc_id, p, list_transform(p, lambda x: CASE WHEN regexp_replace(x, '^\s+|\s+$', '', 'g') = '' THEN 0 ELSE len(regexp_split_to_array(regexp_replace(x, '^\s+|\s+$', '', 'g'), '\s+')) END) AS n FROM parts),
walk AS (SELECT doc_id, p, n, 1 AS i, 0 AS chunk_index, n[1] AS total FROM sized
  UNION ALL SELECT doc_id, p, n, i + 1, CASE WHEN total + n[i + 1] > 512 THEN chunk_index + 1 ELSE chunk_index END,
  CASE WHEN total + n[i + 1] > 512 THEN n[i + 1] ELSE total + n[i + 1] END FROM walk WHERE i < len(p)),
packed AS (SELECT doc_id, chunk_index, string_agg(p[i], '. ' ORDER BY i) || '.' AS content FROM walk GROUP BY doc_id, chunk_index)
SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, sha256(content) AS chunk_hash FROM packed""")
def chunk_semantic(s, d):
    return C.chunk(_documents(s, d).select("doc_id", "text"), "semantic").select("doc_id", "chunk_index", X.sha256(F.col("content")).alias("chunk_hash"))


ORACLES["chunk_semantic"] = ORACLES["chunk_semantic"].replace("WITH ", "WITH RECURSIVE ", 1)


# change plans and updates


@query("SELECT * FROM plan")
def delta_plan(s, d):
    return Y.plan(T.files(s, d), T.registry(s, d))


@query("SELECT * REPLACE (CASE WHEN change = 'unchanged' THEN 'updated' ELSE change END AS change) FROM plan")
def delta_plan_force(s, d):
    return Y.plan(T.files(s, d), T.registry(s, d), force=True)


@query("SELECT * REPLACE (CASE WHEN change = 'unchanged' AND old_status IN ('pending', 'processing', 'failed') THEN 'updated' ELSE change END AS change) FROM plan")
def delta_plan_retry(s, d):
    return Y.plan(T.files(s, d), T.registry(s, d), retry=True)


@query("SELECT change, count(*) AS n_files, min(file_path) AS first_path, max(file_path) AS last_path FROM plan GROUP BY change")
def plan_summary(s, d):
    return Y.summary(delta_plan(s, d))


@query("""SELECT r.tenant_slug, r.file_path, r.file_hash, r.file_size, r.sync_status FROM registry r JOIN plan p USING (tenant_slug, file_path) WHERE p.change = 'unchanged'
UNION ALL SELECT tenant_slug, file_path, new_hash, new_size, 'processing' FROM plan WHERE change IN ('new', 'updated')""")
def plan_applied(s, d):
    return Y.apply(delta_plan(s, d), T.registry(s, d))


@query("SELECT file_path FROM files EXCEPT SELECT file_path FROM registry")
def set_new(s, d):
    return T.files(s, d).join(T.registry(s, d), "file_path", "left_anti").select("file_path").distinct()


@query("SELECT file_path FROM registry EXCEPT SELECT file_path FROM files")
def set_deleted(s, d):
    return T.registry(s, d).join(T.files(s, d), "file_path", "left_anti").select("file_path").distinct()


@query("SELECT file_path FROM files INTERSECT SELECT file_path FROM registry")
def set_common(s, d):
    return T.files(s, d).join(T.registry(s, d), "file_path", "left_semi").select("file_path").distinct()


def _chunk_rows(s, d, *more):
    return T.chunks(s, d).select("file_id", "chunk_index", "token_count", *more)


@query("SELECT c.file_id, c.chunk_index, c.token_count FROM chunks c LEFT JOIN files f ON c.file_id = f.file_id AND f.file_id % 4 <> 0 WHERE f.file_id IS NULL")
def orphan_chunks(s, d):
    return Y.orphans(_chunk_rows(s, d), T.files(s, d).where("file_id % 4 <> 0"))


@query("SELECT file_id, chunk_index, token_count FROM chunks WHERE file_id % 10 <> 1 UNION ALL SELECT file_id, chunk_index, token_count + 1 FROM chunks WHERE file_id % 10 = 1 AND file_id % 3 = 0")
def replace_chunks(s, d):
    c = _chunk_rows(s, d)
    fresh = c.where("file_id % 10 = 1 and file_id % 3 = 0").withColumn("token_count", F.col("token_count") + 1)
    return Y.replace_chunks(c, fresh, T.files(s, d).where("file_id % 10 = 1"))


@query("SELECT file_id, chunk_index, token_count FROM chunks WHERE file_id NOT IN (SELECT file_id FROM files WHERE file_id % 10 = 2)")
def cascade_delete(s, d):
    return Y.delete_files(T.files(s, d), _chunk_rows(s, d), T.files(s, d).where("file_id % 10 = 2"))[1]


@query("SELECT file_id, CASE WHEN sync_status = 'failed' THEN 'pending' ELSE sync_status END AS sync_status FROM files")
def reset_failed(s, d):
    return Y.reset_failed(T.files(s, d).select("file_id", "sync_status"))


@query("""SELECT slug, CASE WHEN slug IN ('src1', 'src2') THEN 'rotated' ELSE api_key END AS api_key FROM tenants
UNION ALL SELECT 'newcomer', 'fresh' UNION ALL SELECT v.slug, 'rotated' FROM (SELECT unnest(['src1', 'src2']) AS slug) v WHERE v.slug NOT IN (SELECT slug FROM tenants)""")
def tenant_upsert(s, d):
    return Y.upsert(T.tenants(s, d), s.createDataFrame([("src1", "rotated"), ("src2", "rotated"), ("newcomer", "fresh")], "slug string, api_key string"), "slug")


@query("""SELECT 'file_size_positive' AS rule, count(*) FILTER (WHERE file_size <= 0) AS n FROM files UNION ALL
SELECT 'status_known', count(*) FILTER (WHERE sync_status NOT IN ('pending', 'processing', 'synced', 'failed', 'deleted')) FROM files UNION ALL
SELECT 'hash_present', count(*) FILTER (WHERE file_hash IS NULL OR file_hash = '') FROM files""")
def quality_violations(s, d):
    return Y.violations(T.files(s, d))


def _rules_sql(entity: str, key: str, source: str, rules: list[tuple[str, str]], required: list[str]) -> str:
    cases = [f"CASE WHEN NOT ({test}) THEN '{name}' END" for name, test in rules] + [f"CASE WHEN {c} IS NULL THEN '{c}_present' END" for c in required]
    return f"SELECT '{entity}' AS entity, CAST({key} AS VARCHAR) AS id, array_to_string(list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL), ',') AS broken FROM {source}"


_QUARANTINE = " UNION ALL ".join((
    _rules_sql("files", "file_id", "files", [("file_size_positive", "file_size > 0"), ("sync_status_known", "sync_status IN ('pending', 'processing', 'synced', 'failed', 'deleted')")], ["tenant_slug", "file_path", "file_hash"]),
    _rules_sql("chunks", "file_id", "(SELECT file_id, tenant_slug, chunk_index - CASE WHEN file_id % 50 = 0 THEN 1 ELSE 0 END AS chunk_index, CASE WHEN file_id % 70 = 0 THEN 0 ELSE token_count END AS token_count, content FROM chunks)", [("chunk_index_non_negative", "chunk_index >= 0"), ("token_count_positive", "token_count > 0")], ["tenant_slug", "chunk_index", "content"]),
    _rules_sql("runs", "run_id", "(SELECT run_id, tenant_slug, CASE run_id % 40 WHEN 3 THEN 'odd_sync' WHEN 4 THEN NULL ELSE 'delta_sync' END AS operation_type, status, duration - 1 AS progress_percentage, run_id % 60 - 1 AS current_file_index, run_id % 80 - 1 AS total_files FROM runs)",
        [("operation_type_known", "operation_type IN ('full_sync', 'delta_sync', 'file_sync')"), ("status_known", "status IN ('running', 'completed', 'failed', 'cancelled')"), ("progress_in_range", "progress_percentage BETWEEN 0 AND 100"), ("current_file_index_non_negative", "current_file_index >= 0"), ("total_files_non_negative", "total_files >= 0")], ["tenant_slug", "operation_type"]),
))


@query(f"SELECT * FROM ({_QUARANTINE}) WHERE broken <> ''")
def quarantine(s, d):
    """Rows of files, chunks and runs with the checks they break. Chunks and runs get some values that do."""
    at = F.col("file_id")
    chunks = T.chunks(s, d).withColumns({"chunk_index": F.col("chunk_index") - F.when(at % 50 == 0, 1).otherwise(0), "token_count": F.when(at % 70 == 0, F.lit(0)).otherwise(F.col("token_count"))})
    run = F.col("run_id")
    runs = T.runs(s, d).withColumns({
        "operation_type": F.when(run % 40 == 3, "odd_sync").when(run % 40 != 4, "delta_sync"), "progress_percentage": F.col("duration") - 1,
        "current_file_index": run % 60 - 1, "total_files_to_process": run % 80 - 1,
    })
    bad = lambda rows, table, key: QG.marked(rows, table).where(F.size("broken") > 0).select(F.lit(table).alias("entity"), F.col(key).cast("string").alias("id"), F.array_join("broken", ",").alias("broken"))
    return bad(T.files(s, d), "files", "file_id").union(bad(chunks, "chunks", "file_id")).union(bad(runs, "runs", "run_id"))


# nearest neighbours

_DOT = "list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(q.e AS DOUBLE[]))"
_COS = f"round(1 - {_DOT} / nullif(sqrt(list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(q.e AS DOUBLE[]))), 0), 6) + 0.0"


def _knn_sql(distance: str, more: str = "") -> str:
    return f"SELECT vec_id, label, {distance} AS distance FROM embeddings v, (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) q {more} ORDER BY distance, vec_id LIMIT 10"


def _nearest(s, d, **options):
    v = T.table(s, d, "embeddings")
    q = v.where("vec_id = 0").select(F.col("embedding").alias("q"))
    return S.knn(v.join(F.broadcast(q)), F.col("q"), **options).select("vec_id", "label", (F.col("distance") + F.lit(0.0)).alias("distance"))  # one query row


@query(_knn_sql(_COS), False)
def knn_cosine(s, d):
    return _nearest(s, d)


@query(_knn_sql(f"round(-{_DOT}, 6) + 0.0"), False)
def knn_dot(s, d):
    return _nearest(s, d, metric="dot")


@query(_knn_sql("round(list_distance(CAST(v.embedding AS DOUBLE[]), CAST(q.e AS DOUBLE[])), 6) + 0.0"), False)
def knn_euclidean(s, d):
    return _nearest(s, d, metric="euclidean")


@query(_knn_sql(_COS, f"WHERE 1 - ({_COS}) >= 0.2"), False)
def knn_threshold(s, d):
    return _nearest(s, d, threshold=0.2)


@query(_knn_sql(f"round(-{_DOT}, 6) + 0.0", f"WHERE round({_DOT}, 6) >= 0.2"), False)
def knn_dot_threshold(s, d):
    """The threshold is the product's own, not one of the cosine."""
    return _nearest(s, d, metric="dot", threshold=0.2)


@query(_knn_sql(_COS, "WHERE v.label = 3"), False)
def knn_tenant(s, d):
    v = T.table(s, d, "embeddings")
    q = v.where("vec_id = 0").select(F.col("embedding").alias("q"))
    return S.knn(v.where("label = 3").join(F.broadcast(q)), F.col("q")).select("vec_id", "label", (F.col("distance") + F.lit(0.0)).alias("distance"))


_BATCH = f"""WITH r AS (SELECT q.vec_id AS query_id, v.vec_id, {_COS} AS distance FROM embeddings v JOIN (SELECT vec_id, embedding AS e, label FROM embeddings WHERE vec_id % 100 = 0) q ON {{on}}),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM r) SELECT query_id, vec_id, distance, rank FROM k WHERE rank <= 5"""


def _batch(s, d, by=(), metric="cosine"):
    v = T.table(s, d, "embeddings")
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"), *by)
    return S.knn_batch(v, q, 5, by, metric).withColumn("distance", F.col("distance") + F.lit(0.0))


@query(_BATCH.format(on="true"), False)
def knn_batch(s, d):
    """Every hundredth row as a query, so that the queries grow with the table."""
    return _batch(s, d)


@query(_BATCH.format(on="q.label = v.label"), False)
def knn_batch_tenant(s, d):
    return _batch(s, d, ("label",))


# the same under the names they had while the two above took fewer queries
knn_batch_hundredth = QUERIES["knn_batch_hundredth"] = knn_batch
knn_batch_tenant_hundredth = QUERIES["knn_batch_tenant_hundredth"] = knn_batch_tenant
ORACLES |= {"knn_batch_hundredth": ORACLES["knn_batch"], "knn_batch_tenant_hundredth": ORACLES["knn_batch_tenant"]}


@query(_BATCH.replace(_COS, "round(list_distance(CAST(v.embedding AS DOUBLE[]), CAST(q.e AS DOUBLE[])), 6) + 0.0").format(on="true"), False)
def knn_batch_euclidean(s, d):
    return _batch(s, d, metric="euclidean")


def knn_ivf(s, d):
    """Every hundredth row against all through an inverted file, with as many lists probed as a recall of 0.95 on a bounded set of queries needs; approximate, so
    without SQL: tests measure its recall against ``knn_batch_hundredth``."""
    v = T.table(s, d, "embeddings")
    index = IVF.build(v, shared_folder(s, "ivf"))
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    probes, _ = index.probes_for(q, 0.95)
    return index.search(q, 5, probes).withColumn("distance", F.col("distance") + F.lit(0.0))


QUERIES["knn_ivf"] = knn_ivf


@query("""SELECT doc_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS weight FROM
(SELECT doc_id, CAST(('0x' || substr(md5(lower(x)), 1, 8)) AS BIGINT) % 384 AS bucket, CAST(count(*) AS DOUBLE) AS n FROM (SELECT doc_id, unnest(w) AS x FROM worded) GROUP BY 1, 2)""")
def hash_embed(s, d):
    return E.hash_embed(_documents(s, d).select("doc_id", "text"), X.words(F.col("text")))


# answers


@query("""SELECT tenant_slug AS query_id, 'Based on the documents: ' || string_agg(substr(content, 1, 200) || '...', ' ' ORDER BY rank) AS answer, count(*) AS n_sources, CAST(0.8 AS DOUBLE) AS confidence
FROM (SELECT *, row_number() OVER (PARTITION BY tenant_slug ORDER BY token_count DESC, file_id, chunk_index) AS rank FROM chunks) WHERE rank <= 3 GROUP BY tenant_slug""")
def answer_extract(s, d):
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("tenant_slug").orderBy(F.desc("token_count"), "file_id", "chunk_index"))
    top = T.chunks(s, d).withColumn("rank", rank).where("rank <= 3").withColumnRenamed("tenant_slug", "query_id")
    top = written(top, "top")
    return R.answers(top, top).drop("method")


@query("""SELECT file_id, chunk_index, token_count, filename FROM (SELECT * FROM chunks ORDER BY token_count DESC, file_id, chunk_index LIMIT 10) JOIN files USING (file_id)""")
def citations(s, d):
    top = _chunk_rows(s, d).orderBy(F.desc("token_count"), "file_id", "chunk_index").limit(10)
    return S.citations(top, T.files(s, d))


@query("SELECT item_id, t <> '' AS is_valid, CAST(length(text) AS BIGINT) AS length, CAST(CASE WHEN t = '' THEN 0 ELSE len(regexp_split_to_array(t, '\\s+')) END AS BIGINT) AS word_count, CASE WHEN t <> '' THEN 'valid' ELSE 'empty' END AS status FROM (SELECT *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM benchmark)", False)
def query_validate(s, d):
    return S.validate_queries(T.table(s, d, "benchmark").withColumnRenamed("text", "query")).drop("query")


@query("SELECT event_id, CASE WHEN value / 100 >= 0.8 THEN 'high' WHEN value / 100 >= 0.6 THEN 'medium' ELSE 'low' END AS bucket FROM events", False)
def confidence_bucket(s, d):
    return T.table(s, d, "events").select("event_id", X.confidence_bucket(F.col("value") / 100).alias("bucket"))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'the')", False)
def keyword_containment(s, d):
    return _documents(s, d).where(X.contains_word(F.col("text"), "The")).select("doc_id")


# statistics


@query("SELECT 'tenants' AS entity, count(*) AS n FROM tenants UNION ALL SELECT 'files', count(*) FROM files UNION ALL SELECT 'chunks', count(*) FROM chunks")
def system_stats(s, d):
    return A.system(T.tenants(s, d), T.files(s, d), T.chunks(s, d))


@query("SELECT tenant_slug, count(*) FILTER (WHERE sync_status = 'pending') AS pending, count(*) FILTER (WHERE sync_status = 'processing') AS processing, count(*) FILTER (WHERE sync_status = 'synced') AS synced, count(*) FILTER (WHERE sync_status = 'failed') AS failed, count(*) AS total FROM files GROUP BY tenant_slug")
def tenant_status_breakdown(s, d):
    return A.by_status(T.files(s, d))


@query("SELECT sync_status, count(file_id) AS n FROM files GROUP BY sync_status")
def status_counts(s, d):
    return A.status_counts(T.files(s, d))


@query("SELECT slug, count(file_id) AS n_files, CAST(coalesce(sum(file_size), 0) AS BIGINT) AS bytes, count(DISTINCT file_id) FILTER (WHERE sync_status = 'synced') AS n_synced FROM tenants LEFT JOIN files ON slug = tenant_slug GROUP BY slug")
def tenant_inventory(s, d):
    return A.inventory(T.tenants(s, d), T.files(s, d))


tenant_inventory_all = QUERIES["tenant_inventory_all"] = tenant_inventory
ORACLES["tenant_inventory_all"] = ORACLES["tenant_inventory"]


@query("SELECT f.tenant_slug, f.file_id, filename, count(c.file_id) AS n_chunks FROM files f LEFT JOIN chunks c ON f.file_id = c.file_id GROUP BY ALL")
def file_chunk_counts(s, d):
    return A.chunks_per_file(T.files(s, d), _chunk_rows(s, d))


@query("SELECT tenant_slug, count(*) AS n_chunks, round(avg(token_count), 6) AS avg_tokens, CAST(sum(token_count) AS BIGINT) AS sum_tokens FROM chunks GROUP BY tenant_slug")
def tenant_token_stats(s, d):
    return A.tokens_per_tenant(T.chunks(s, d))


@query("SELECT count(*) AS n_chunks, round(avg(token_count), 6) AS avg_tokens, min(token_count) AS min_tokens, max(token_count) AS max_tokens, count(DISTINCT 'model-' || file_id % 3) AS n_models FROM chunks")
def chunk_overall_stats(s, d):
    return A.chunk_overall(T.chunks(s, d).withColumn("embedding_model", F.concat(F.lit("model-"), (F.col("file_id") % 3).cast("string"))))


@query("SELECT tenant_slug, count(*) FILTER (WHERE sync_status = 'synced') AS n_ok, count(*) AS n_all, round(100 * (count(*) FILTER (WHERE sync_status = 'synced')) / greatest(count(*), 1), 6) AS success_rate FROM files GROUP BY tenant_slug")
def success_rate(s, d):
    return A.success_rate(T.files(s, d))


@query("SELECT tenant_slug, count(*) FILTER (WHERE sync_status = 'processing') AS n_processing, bool_or(sync_status = 'processing') AS is_syncing FROM files GROUP BY tenant_slug")
def sync_flags(s, d):
    return A.sync_flags(T.files(s, d))


@query("SELECT tenant_slug, count(*) AS n_runs, round(100 * (count(*) FILTER (WHERE status = 'completed')) / count(*), 6) AS success_rate, round(avg(duration), 4) AS avg_duration, max(started_at) AS last_started FROM runs GROUP BY tenant_slug")
def run_metrics(s, d):
    return A.run_metrics(T.runs(s, d))


@query("SELECT run_id, tenant_slug, status, CAST(row_number() OVER (PARTITION BY tenant_slug ORDER BY started_at DESC, run_id DESC) AS INTEGER) AS nth FROM runs QUALIFY nth <= 5")
def run_history(s, d):
    return A.latest_run(T.runs(s, d), 5).select("run_id", "tenant_slug", "status", "nth")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL", False)
def event_windows(s, d):
    return event_counts(T.table(s, d, "events"))


@query("SELECT doc_id, round(CAST(strlen(text) AS DOUBLE) / 1048576, 1) AS mb, '[' || array_to_string([doc_id, n_chars], ',') || ']' AS pair FROM documents", False)
def size_and_literal(s, d):
    return _documents(s, d).select("doc_id", X.megabytes(F.octet_length("text")).alias("mb"), V.text_form(F.array("doc_id", "n_chars")).alias("pair"))


# from a question to an answer

#: Questions are the benchmark's items; each is asked of the tenant that its number names.
_ASKED = """, asked AS (SELECT item_id AS query_id, text AS query, 'src' || item_id % 20 AS tenant_slug FROM benchmark WHERE text IS NOT NULL),
cw AS (SELECT file_id || ':' || chunk_index AS chunk_id, tenant_slug, lower(x) AS x FROM (SELECT file_id, chunk_index, tenant_slug, unnest(string_split_regex(content, '\\s+')) AS x FROM chunks) WHERE x <> ''),
qw AS (SELECT query_id, tenant_slug, lower(x) AS x FROM (SELECT query_id, tenant_slug, unnest(string_split_regex(query, '\\s+')) AS x FROM asked) WHERE x <> ''),
cv AS (SELECT chunk_id, tenant_slug, CAST(('0x' || substr(md5(x), 1, 8)) AS BIGINT) % 384 AS b, CAST(count(*) AS DOUBLE) AS n FROM cw GROUP BY ALL),
qv AS (SELECT query_id, tenant_slug, CAST(('0x' || substr(md5(x), 1, 8)) AS BIGINT) % 384 AS b, CAST(count(*) AS DOUBLE) AS n FROM qw GROUP BY ALL),
cn AS (SELECT chunk_id, tenant_slug, sqrt(sum(n * n)) AS norm FROM cv GROUP BY ALL), qn AS (SELECT query_id, tenant_slug, sqrt(sum(n * n)) AS norm FROM qv GROUP BY ALL),
dots AS (SELECT query_id, chunk_id, sum(qv.n * cv.n) AS dot FROM qv JOIN cv ON qv.b = cv.b AND qv.tenant_slug = cv.tenant_slug GROUP BY ALL),
near AS (SELECT qn.query_id, cn.chunk_id, round(1 - coalesce(dot, 0) / (qn.norm * cn.norm), 6) + 0.0 AS distance FROM qn JOIN cn USING (tenant_slug) LEFT JOIN dots ON dots.query_id = qn.query_id AND dots.chunk_id = cn.chunk_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS INTEGER) AS rank FROM near QUALIFY rank <= {k}),
hits AS (SELECT query_id, rank, distance, chunk_id, c.file_id, c.chunk_index, content, token_count, filename FROM ranked JOIN chunks c ON chunk_id = c.file_id || ':' || c.chunk_index JOIN files f ON f.file_id = c.file_id)"""


def _asked(s, d):
    b = T.table(s, d, "benchmark").where("text is not null")
    q = b.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("tenant_slug"))
    return E.embed(q, text_col="query", vector_col="query_vector", double=True)


def _found(s, d, k=5, threshold=None):
    return _search(s, d, _vectors(s, d), k, threshold)


def _vectors(s, d):
    """The corpus is embedded once; whatever asks of it reads the written vectors."""
    return written(E.embed(T.chunks(s, d).drop("chunk_hash"), double=True), "vectors")


def _search(s, d, vectors, k=5, threshold=None):
    return R.search_batch(vectors, written(_asked(s, d).drop("query"), "asked"), T.files(s, d), R.SearchConfig(k=k, threshold=threshold))


@query(_ASKED.format(k=5) + """ SELECT query_id, rank, chunk_id, file_id, filename, chunk_index, sha256(content) AS content_hash, token_count, round(greatest(0.0, least(1.0, 1 - distance)), 6) AS score,
'{"filename":"' || filename || '","chunk_index":"' || chunk_index || '"}' AS metadata FROM hits""")
def semantic_search(s, d):
    """Every question against its tenant's chunks, with full citations."""
    return _found(s, d).withColumns({"content_hash": X.sha256(F.col("content")), "metadata": F.to_json("metadata")}).drop("content")


@query(_ASKED.format(k=5) + " SELECT query_id, rank, chunk_id, round(1 - distance, 6) AS score FROM hits WHERE 1 - distance >= 0.5")
def semantic_search_threshold(s, d):
    return _found(s, d, threshold=0.5).select("query_id", "rank", "chunk_id", "score")


@query(_ASKED.format(k=5) + """ SELECT a.query_id, CASE WHEN count(h.query_id) > 0 THEN 'Based on the documents: ' || string_agg(substr(content, 1, 200) || '...', ' ' ORDER BY rank) ELSE 'No relevant information found in the documents.' END AS answer,
count(h.query_id) AS n_sources, CASE WHEN count(h.query_id) > 0 THEN 0.8 ELSE CAST(0 AS DOUBLE) END AS confidence, 'extractive' AS method FROM asked a LEFT JOIN hits h ON h.query_id = a.query_id AND rank <= 3 AND 1 - distance >= 0.6 GROUP BY a.query_id""")
def rag_answer(s, d):
    """Questions without a source over the threshold get the fallback answer."""
    return R.answers(_asked(s, d), _found(s, d, threshold=0.6))


@query(_ASKED.format(k=5) + " SELECT query_id, to_json(list_sort(list(DISTINCT filename))) AS filenames, count(DISTINCT filename) AS n_files FROM hits GROUP BY query_id")
def source_names(s, d):
    return R.source_names(_found(s, d)).withColumn("filenames", F.to_json("filenames"))


@query(_ASKED.format(k=5) + """ SELECT query_id, count(*) AS n_first, count(*) FILTER (WHERE rank <= 3) AS n_second, count(*) FILTER (WHERE rank <= 3) AS n_both,
round(CAST(count(*) FILTER (WHERE rank <= 3) AS DOUBLE) / count(*), 6) AS overlap FROM hits GROUP BY query_id""")
def run_overlap(s, d):
    vectors = _vectors(s, d)
    return R.run_overlap(_search(s, d, vectors), _search(s, d, vectors, 3))


# lists, summaries and formats


@query("SELECT change, count(*) AS n_files, to_json(list(file_path ORDER BY file_path)) AS paths FROM plan GROUP BY change")
def plan_lists(s, d):
    return Y.name_lists(delta_plan(s, d)).withColumn("paths", F.to_json("paths"))


def _pages_sql(by: str, name: str, source: str) -> str:
    nth = f"(row_number() OVER (PARTITION BY {by} ORDER BY {name}) - 1) // 50 + 1"
    return f"SELECT {by}, page, to_json(list({name} ORDER BY {name})) AS names, any_value(n) AS total FROM (SELECT {by}, {name}, {nth} AS page, count(*) OVER (PARTITION BY {by}) AS n FROM {source} WHERE {name} IS NOT NULL) GROUP BY {by}, page"


@query(_pages_sql("change", "file_path", "plan"))
def plan_list_pages(s, d):
    """The plan's lists with at most fifty paths a row, so that no row grows with the plan."""
    return PG.list_pages(delta_plan(s, d), ["change"], "file_path", 50).withColumn("names", F.to_json("names"))


@query(_pages_sql("tenant_slug, sync_status", "filename", "files"))
def status_list_pages(s, d):
    return PG.list_pages(T.files(s, d), ["tenant_slug", "sync_status"], "filename", 50).withColumn("names", F.to_json("names"))


@query("""SELECT change, any_value(n) AS n_files, to_json(list(file_path ORDER BY file_path)) AS paths, any_value(n) - count(*) AS n_more
FROM (SELECT *, count(*) OVER (PARTITION BY change) AS n, row_number() OVER (PARTITION BY change ORDER BY file_path, tenant_slug) AS nth FROM plan) WHERE nth <= 10 GROUP BY change""")
def change_preview(s, d):
    return Y.preview(delta_plan(s, d)).withColumn("paths", F.to_json("paths"))


def _json_list(status: str) -> str:
    return f"coalesce(to_json(list(filename ORDER BY filename) FILTER (WHERE sync_status = '{status}')), '[]') AS {status}"


@query(f"SELECT tenant_slug, {', '.join(map(_json_list, ('pending', 'processing', 'synced', 'failed')))} FROM files GROUP BY tenant_slug")
def status_lists(s, d):
    out = A.status_lists(T.files(s, d))
    return out.select("tenant_slug", *(F.to_json(c).alias(c) for c in out.columns[1:]))


@query("""SELECT tenant_slug, total_files, total_chunks, '{' || string_agg('"' || sync_status || '":' || n, ',' ORDER BY sync_status) || '}' AS status_breakdown FROM
(SELECT tenant_slug, sync_status, count(*) AS n FROM files GROUP BY ALL) JOIN (SELECT tenant_slug, count(*) AS total_files FROM files GROUP BY ALL) USING (tenant_slug)
JOIN (SELECT f.tenant_slug, count(c.file_id) AS total_chunks FROM files f LEFT JOIN chunks c USING (file_id) GROUP BY ALL) USING (tenant_slug) GROUP BY ALL""")
def tenant_summary(s, d):
    return A.tenant_summary(T.files(s, d), T.chunks(s, d)).withColumn("status_breakdown", F.to_json("status_breakdown"))


@query("SELECT f.tenant_slug, count(c.file_id) AS n_chunks FROM files f LEFT JOIN chunks c USING (file_id) GROUP BY ALL")
def tenants_by_chunks(s, d):
    return A.most_chunks(T.chunks(s, d), T.files(s, d))


@query("SELECT tenant_slug, coalesce(to_json(list(filename ORDER BY filename) FILTER (WHERE sync_status = 'processing')), '[]') AS currently_processing, bool_or(sync_status = 'processing') AS is_syncing FROM files GROUP BY tenant_slug")
def sync_status(s, d):
    return A.busy_files(T.files(s, d)).withColumn("currently_processing", F.to_json("currently_processing"))


@query("""SELECT event_type AS tenant, CAST(round(100 * avg(value / 1000)) AS BIGINT) AS percent FROM
(SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, value / 1000 DESC) AS nth FROM events) WHERE nth <= 5 GROUP BY event_type""", False)
def recent_confidence(s, d):
    e = T.table(s, d, "events").select(F.col("event_type").alias("tenant"), "ts", (F.col("value") / 1000).alias("confidence"))
    return A.recent_confidence(e, "tenant", "ts", "confidence")


@query("SELECT source, round(avg(length(text)), 4) AS avg_chars, CASE WHEN avg(length(text)) > 1000 THEN 8 WHEN avg(length(text)) > 500 THEN 16 ELSE 32 END AS batch_size FROM documents GROUP BY source", False)
def batch_sizes(s, d):
    return A.batch_size(_documents(s, d), "source")


@query("SELECT count(*) AS n_runs, count(*) FILTER (WHERE status = 'completed') AS n_completed, round(100 * (count(*) FILTER (WHERE status = 'completed')) / greatest(count(*), 1), 6) AS success_rate, round(avg(duration), 4) AS avg_duration, arg_max(tenant_slug, struct_pack(d := duration, t := tenant_slug)) AS slowest FROM runs")
def run_report(s, d):
    return A.run_report(T.runs(s, d))


@query("""SELECT tenant_slug, '{' || string_agg('"' || error || '":' || n, ',' ORDER BY error) || '}' AS error_types, CAST(sum(n) AS BIGINT) AS n_errors FROM
(SELECT tenant_slug, CASE run_id % 3 WHEN 0 THEN 'timeout' WHEN 1 THEN 'no text' ELSE 'empty' END AS error, count(*) AS n FROM runs WHERE status = 'failed' GROUP BY ALL) GROUP BY tenant_slug""")
def error_types(s, d):
    error = F.when(F.col("run_id") % 3 == 0, "timeout").when(F.col("run_id") % 3 == 1, "no text").otherwise("empty")
    return A.error_types(T.runs(s, d).withColumn("error", F.when(F.col("status") == "failed", error)), "error").withColumn("error_types", F.to_json("error_types"))


@query("SELECT file_id, CASE sync_status WHEN 'synced' THEN '✅' WHEN 'pending' THEN '⏳' WHEN 'processing' THEN '🔄' WHEN 'failed' THEN '❌' ELSE '❓' END AS mark, replace(sync_status || '_files', '_', ' ') AS label FROM files")
def status_marks(s, d):
    return T.files(s, d).select("file_id", X.status_mark(F.col("sync_status")).alias("mark"), X.spaced(F.concat("sync_status", F.lit("_files"))).alias("label"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' AS at, printf('%.2f', round(value, 2)) AS shown FROM events", False)
def iso_times(s, d):
    return T.table(s, d, "events").select("event_id", X.iso(F.col("ts")).alias("at"), F.format_string("%.2f", F.round(F.col("value"), 2)).alias("shown"))


@query("SELECT file_id, tenant_slug FROM files WHERE sync_status <> 'failed'")
def not_deleted(s, d):
    """Failed files stand for those with a time of deletion."""
    marked = T.files(s, d).withColumn("deleted_at", F.when(F.col("sync_status") == "failed", F.lit("2024-01-01").cast("timestamp")))
    return N.present(marked).select("file_id", "tenant_slug")


@query("SELECT f.file_id, f.tenant_slug, substr(api_key, 1, 8) AS key_start, sync_status FROM files f JOIN tenants t ON slug = tenant_slug ORDER BY file_size DESC, file_id LIMIT 10")
def recent_files_tenants(s, d):
    """The first ten of an order, then their tenants: the join sees ten rows."""
    top = T.files(s, d).where("tenant_slug is not null").orderBy(F.desc("file_size"), "file_id").limit(10)
    return top.join(T.tenants(s, d), F.col("slug") == F.col("tenant_slug")).select("file_id", "tenant_slug", F.substring("api_key", 1, 8).alias("key_start"), "sync_status")


@query("""SELECT a.tenant_slug AS a, b.tenant_slug AS b, len(list_intersect(a.l, b.l)) AS n_both, len(list_filter(a.l, lambda x: NOT list_contains(b.l, x))) AS n_only_a, len(list_distinct(list_concat(a.l, b.l))) AS n_either FROM
(SELECT tenant_slug, list(DISTINCT lang) AS l FROM (SELECT source AS tenant_slug, lang FROM documents) GROUP BY 1) a JOIN (SELECT tenant_slug, list(DISTINCT lang) AS l FROM (SELECT source AS tenant_slug, lang FROM documents) GROUP BY 1) b ON a.tenant_slug = '$SLUG' AND b.tenant_slug <> a.tenant_slug""")
def tenant_sets(s, d):
    """One tenant's set of languages beside every other's."""
    sets = _documents(s, d).where("source is not null and lang is not null").groupBy(F.col("source").alias("tenant_slug")).agg(F.collect_set("lang").alias("langs"))
    own = sets.where(F.col("tenant_slug") == SLUG).select(F.col("tenant_slug").alias("a"), F.col("langs").alias("own"))
    others = sets.where(F.col("tenant_slug") != SLUG)
    return others.join(F.broadcast(own)).select("a", F.col("tenant_slug").alias("b"), F.size(F.array_intersect("own", "langs")).cast("long").alias("n_both"), F.size(F.array_except("own", "langs")).cast("long").alias("n_only_a"), F.size(F.array_union("own", "langs")).cast("long").alias("n_either"))  # own: one row
