"""Small files in the stores that Spark reaches: listing, texts that appear whole or not at all, deletion."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (a temporary one where none is set, as in tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or "file://" + tempfile.mkdtemp(prefix="quire-")
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _store(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if there's no folder."""
    fs, at = _store(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _store(spark, path)
    return fs.exists(at)


def read_text(spark: SparkSession, path: str) -> str:
    fs, at = _store(spark, path)
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, text: str) -> None:
    """Write a text that others see whole or not at all; FileExistsError if it is there already."""
    fs, at = _store(spark, path)
    if fs.exists(at):
        raise FileExistsError(path)
    made = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.new")
    stream = fs.create(made, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    if not fs.rename(made, at):
        fs.delete(made, False)
        raise FileExistsError(path)


def deleted(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        fs, at = _store(spark, path)
        fs.delete(at, True)
