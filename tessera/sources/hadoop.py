"""Small files through Hadoop's file system: settings, leases and marks that the driver alone reads and writes."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _at(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files in a folder; none where it is missing."""
    p, fs = _at(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(p) if s.isFile()] if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    p, fs = _at(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Puts a whole new file in the old one's place."""
    p, fs = _at(spark, path)
    stream = fs.create(p, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def create_new(spark: SparkSession, path: str, text: str) -> bool:
    """Makes the file unless it is there; of callers at the same time one gets True.

    HDFS creates exclusively; Hadoop's class for local folders looks first and creates then, so that those, network mounts
    among them, are opened by the operating system's exclusive creation instead."""
    from py4j.protocol import Py4JJavaError

    p, fs = _at(spark, path)
    if fs.getScheme() == "file":
        local = fs.makeQualified(p).toUri().getPath()
        os.makedirs(os.path.dirname(local), exist_ok=True)
        try:
            at = os.open(local, os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o644)
        except FileExistsError:
            return False
        with os.fdopen(at, "w") as f:
            f.write(text)
        return True
    try:
        stream = fs.create(p, False)
    except Py4JJavaError as e:
        if "already exists" in str(e.java_exception) or "FileAlreadyExists" in str(e.java_exception):
            return False
        raise
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    return True
