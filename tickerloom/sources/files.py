"""Small-file helpers on the session's Hadoop file system (any cluster storage)."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    hadoop, fs = _path(spark, path)
    return fs.exists(hadoop)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names directly below a folder; empty when the folder is absent."""
    hadoop, fs = _path(spark, path)
    if not fs.exists(hadoop):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(hadoop))


def rename(spark: SparkSession, source: str, target: str) -> None:
    """Rename to a path that must not exist yet."""
    a, fs = _path(spark, source)
    b, _ = _path(spark, target)
    if fs.exists(b) or not fs.rename(a, b):
        raise FileExistsError(f"cannot move {source} to {target}")


def remove(spark: SparkSession, path: str) -> None:
    hadoop, fs = _path(spark, path)
    fs.delete(hadoop, True)


def read_json(spark: SparkSession, path: str) -> dict:
    hadoop, fs = _path(spark, path)
    stream = fs.open(hadoop)
    try:
        size = fs.getFileStatus(hadoop).getLen()
        raw = spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, size)
        return json.loads(bytes(raw).decode())
    finally:
        stream.close()


def write_json(spark: SparkSession, path: str, content: dict) -> None:
    """Create a file that must not exist; readers see it whole or not at all."""
    staging = f"{path}.{uuid.uuid4().hex}.tmp"
    hadoop, fs = _path(spark, staging)
    stream = fs.create(hadoop, False)
    try:
        stream.write(bytearray(json.dumps(content, indent=1, sort_keys=True).encode()))
    finally:
        stream.close()
    rename(spark, staging, path)
