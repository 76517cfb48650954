"""Files under <root>/<tenant>/ as rows: listing, hashes, decoded text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import decode
from tessera.sources import hadoop
from tessera.sources.folders import hashed, tree

LISTING = "file_path string, file_size long"


def listing(spark: SparkSession, root: str, by: str = "tasks") -> DataFrame:
    """tenant_slug, filename, file_path, file_size of all files, also of empty ones, which file scans skip.

    Tasks list the tree level by level. ``by="driver"`` walks it on the driver instead, for a file system that only
    Hadoop's classes reach; every path then passes the driver, so it is for small trees."""
    if by not in ("tasks", "driver"):
        raise ValueError(f"list by tasks or by driver, not by {by}")
    df = tree(spark, root).withColumnRenamed("path", "file_path") if by == "tasks" else _walked(spark, root)
    parts = F.split("file_path", "/")
    return df.select(F.element_at(parts, 1).alias("tenant_slug"), F.element_at(parts, -1).alias("filename"), "file_path", "file_size")


def _walked(spark: SparkSession, root: str) -> DataFrame:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(conf)
    if not fs.exists(path):
        return spark.createDataFrame([], LISTING)
    base, rows, it = fs.makeQualified(path).toString().rstrip("/") + "/", [], fs.listFiles(path, True)
    while it.hasNext():
        f = it.next()
        rows.append((f.getPath().toString().removeprefix(base), f.getLen()))
    return spark.createDataFrame(rows, LISTING)


def snapshot(spark: SparkSession, root: str, with_text: bool = False, by: str = "tasks") -> DataFrame:
    """The listing with each file's SHA-256 (and text): tenant_slug, filename, file_path, file_size, file_hash. Tasks list
    and read the files; ``by="driver"`` as in ``listing``."""
    files = listing(spark, root, by)
    if by == "tasks":
        out = hashed(files, root, with_text)
        names = ["tenant_slug", "filename", "file_path", "file_size", "file_hash"]
        return out.select(*names, *([F.coalesce(decode(F.col("content")), F.lit("")).alias("text")] if with_text else []))
    if not files.limit(1).count():
        return files.withColumn("file_hash", F.lit(None).cast("string"))
    content = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    prefix = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/") + "/"
    body = content.select(F.expr(f"substring(path, {len(prefix) + 1})").alias("file_path"), F.sha2("content", 256).alias("__hash"), *([decode(F.col("content")).alias("text")] if with_text else []))
    joined = files.join(body, "file_path", "left")
    empty = F.sha2(F.lit("").cast("binary"), 256)
    digest = F.coalesce("__hash", F.when(F.col("file_size") == 0, empty).otherwise(""))
    return joined.select(*files.columns, digest.alias("file_hash"), *([F.coalesce("text", F.lit("")).alias("text")] if with_text else []))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def keys_json(spark: SparkSession, path: str) -> DataFrame:
    """(slug, api_key, description) from a JSON object keyed by slug; no rows where the file is missing or no such object."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "slug string, api_key string, description string")
    shape = "map<string, struct<api_key: string, slug: string, description: string>>"
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", shape)).alias("slug", "v")).select("slug", "v.api_key", "v.description")


def write_keys_json(tenants: DataFrame, path: str) -> None:
    """(slug, api_key, description) as one JSON object keyed by slug, in one file of the folder ``path``: a table of keys is small."""
    entry = F.struct("slug", F.struct("api_key", "slug", "description"))
    one = tenants.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(entry)))).alias("value"))
    one.coalesce(1).write.mode("overwrite").text(path)


def env_file(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of KEY=VALUE lines; blank lines and comments go; no rows where the file is missing."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "key string, value string")
    # Spark's own sources pass over files whose names begin with a dot; settings are few lines, so they are read here
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).open(p)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    line = F.trim("value")
    rows = spark.createDataFrame([(x,) for x in text.splitlines()], "value string").where((line != "") & ~line.startswith("#") & line.contains("="))
    return rows.select(F.trim(F.regexp_extract("value", "^([^=]*)=", 1)).alias("key"), F.trim(F.regexp_extract("value", "^[^=]*=(.*)$", 1)).alias("value"))


def env_with(current: DataFrame, changes: DataFrame) -> DataFrame:
    """The settings after ``changes``: given values replace, new keys are added."""
    fresh = changes.select(F.col("key"), F.col("value").alias("__new"))
    return current.join(fresh, "key", "full_outer").select("key", F.coalesce("__new", "value").alias("value"))


def write_env_file(spark: SparkSession, path: str, changes: dict[str, str]) -> None:
    """Writes changed settings back: a key's line gets its new value, new keys are added at the end, and comments, blank lines
    and the order stay. The file is made where it is missing."""
    for k, v in changes.items():
        if not k.strip() or "=" in k or any(c in k + v for c in "\r\n") or k.strip().startswith("#"):
            raise ValueError(f"no setting: {k!r}")
    lines = hadoop.read_text(spark, path).splitlines() if hadoop.exists(spark, path) else []
    left, out = dict(changes), []
    for line in lines:
        key = line.split("=", 1)[0].strip()
        setting = "=" in line and not line.strip().startswith("#")
        if setting and key in changes:
            if key in left:
                out.append(f"{key}={left.pop(key)}")
            continue  # a key that stands twice is written once
        out.append(line)
    hadoop.write_text(spark, path, "".join(f"{x}\n" for x in [*out, *(f"{k}={v}" for k, v in left.items())]))
