"""Listing a folder tree in tasks, a level at a time, so that no path passes the driver.

Each level is a written table of folders. A task lists its folders one after the other and yields what is in them in
batches; folders found make the next level. The driver learns only how many there are. Local and object-store paths are
read through pyarrow's file systems; a scheme that it does not know has to be listed by the driver (``files.listing``
with ``by="driver"``)."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.sources.shared import remove, shared_folder

ENTRY = "path string, is_dir boolean, file_size long, modified timestamp"
ROWS = 10_000  # entries of a batch
BLOCK = 1 << 20  # bytes read at a time
HELD = 8 << 20  # bytes of files that a task passes on together
TASKS = 200  # tasks of a level, at most; fewer for few folders


def _local(root: str) -> str | None:
    parts = urlsplit(root)
    if not parts.scheme:
        return root
    return unquote(parts.path) if parts.scheme == "file" else None


def _entries(folder: str, base: str) -> Iterator[tuple[str, bool, int, float | None]]:
    """(path under the root, is it a folder, size, modified) of what lies in a folder; a folder that has gone is empty."""
    local = _local(base)
    if local is not None:
        try:
            found = os.scandir(os.path.join(local, folder) if folder else local)
        except (FileNotFoundError, NotADirectoryError):
            return
        with found:
            for x in found:
                try:
                    is_dir = x.is_dir()
                    stat = x.stat()
                except OSError:
                    continue  # it went meanwhile, or cannot be read
                yield f"{folder}/{x.name}" if folder else x.name, is_dir, 0 if is_dir else stat.st_size, stat.st_mtime
        return
    from pyarrow import fs

    system, top = fs.FileSystem.from_uri(base)
    top = top.rstrip("/")
    for x in system.get_file_info(fs.FileSelector(f"{top}/{folder}" if folder else top, allow_not_found=True)):
        if x.type in (fs.FileType.File, fs.FileType.Directory):
            is_dir = x.type == fs.FileType.Directory
            yield x.path[len(top) + 1 :], is_dir, 0 if is_dir else x.size, x.mtime.timestamp() if x.mtime else None


def _listed(base: str):
    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for folder in batch.column(0).to_pylist():
                for row in _entries(folder, base):
                    rows.append(row)
                    if len(rows) == ROWS:
                        yield _batch(rows)
                        rows = []
            if rows:
                yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    path, is_dir, size, at = zip(*rows, strict=True)
    when = pa.array([None if t is None else int(t * 1e6) for t in at], pa.int64()).cast(pa.timestamp("us", "UTC"))
    return pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(is_dir, pa.bool_()), pa.array(size, pa.int64()), when], ["path", "is_dir", "file_size", "modified"])


def tree(spark: SparkSession, root: str, deepest: int = 1000) -> DataFrame:
    """(path, file_size, modified) of every file under ``root``, empty ones too; no rows where the root is missing.
    A link is followed as what it points to; ``deepest`` levels end a circle of links with an error."""
    base = shared_folder(spark, "tree")
    folders, n = spark.createDataFrame([("",)], "path string"), 1
    for level in range(deepest):
        tasks = min(n, TASKS, max(1, 4 * spark.sparkContext.defaultParallelism))
        found = folders.repartition(tasks).mapInArrow(_listed(root), ENTRY)
        found.write.partitionBy("is_dir").parquet(f"{base}/level={level}")
        here = spark.read.schema(ENTRY).parquet(f"{base}/level={level}")
        folders = here.where("is_dir").select("path")
        n = folders.count()
        if not n:
            break
    else:
        remove(spark, base)
        raise ValueError(f"more than {deepest} levels of folders: do links run in a circle?")
    return spark.read.schema(ENTRY + ", level int").parquet(base).where("not is_dir").select("path", "file_size", "modified")


def _digest(open_file: Callable, with_bytes: bool) -> tuple[str, bytes]:
    """SHA-256 and, on request, the bytes; a file that cannot be read has neither."""
    digest, parts = hashlib.sha256(), []
    try:
        with open_file() as f:
            while block := f.read(BLOCK):
                digest.update(block)
                if with_bytes:
                    parts.append(block)
    except OSError:
        return "", b""
    return digest.hexdigest(), b"".join(parts)


def _read(base: str, with_bytes: bool):
    names = ["file_hash", *(["content"] if with_bytes else [])]

    def run(batches):
        local = _local(base)
        if local is None:
            from pyarrow import fs

            system, top = fs.FileSystem.from_uri(base)

        def opener(path):
            return (lambda: open(os.path.join(local, path), "rb")) if local is not None else lambda: system.open_input_stream(f"{top.rstrip('/')}/{path}")

        for batch in batches:
            start, held, found = 0, 0, []
            for i, path in enumerate(batch.column(0).to_pylist()):
                found.append(_digest(opener(path), with_bytes))
                held += len(found[-1][1])
                if held >= HELD or i == batch.num_rows - 1:
                    more = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.binary())][: len(names)]
                    yield pa.RecordBatch.from_arrays([*(c.slice(start, len(found)) for c in batch.columns), *more], [*batch.schema.names, *names])
                    start, held, found = i + 1, 0, []

    return run


def hashed(files: DataFrame, root: str, with_bytes: bool = False) -> DataFrame:
    """``files`` (file_path first) with each file's SHA-256 and, on request, its bytes, read in tasks a file at a time.
    A file that cannot be read has the hash ''."""
    names = ["file_path", *(c for c in files.columns if c != "file_path")]
    spread = files.select(*names).repartition(max(1, 4 * files.sparkSession.sparkContext.defaultParallelism))
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spread.schema) + ", file_hash string" + (", content binary" if with_bytes else "")
    return spread.mapInArrow(_read(root, with_bytes), shape)
