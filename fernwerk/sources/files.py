"""Single files on any file system that Spark reads: exports of bounded size."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str) -> tuple:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.setWriteChecksum(False)
    return fs, at


def save(spark: SparkSession, path: str, chunks: Iterable[bytes | str] | str) -> None:
    """Writes the chunks one after another; a file of that name is replaced."""
    fs, at = _at(spark, path)
    out = fs.create(at, True)
    try:
        for c in [chunks] if isinstance(chunks, str) else chunks:
            out.write(bytearray(c.encode("utf-8") if isinstance(c, str) else c))
    finally:
        out.close()


def load(spark: SparkSession, path: str) -> bytes:
    fs, at = _at(spark, path)
    stream = fs.open(at)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match, by name."""
    fs, at = _at(spark, pattern)
    return sorted(s.getPath().toString() for s in fs.globStatus(at) or [])
