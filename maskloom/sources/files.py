"""File system calls; the one place that needs a classic session's JVM gateway."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _opened(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, system = _opened(spark, path)
    return system.exists(target)


def matching(spark: SparkSession, pattern: str) -> list[str]:
    target, system = _opened(spark, pattern)
    return [str(s.getPath()) for s in system.globStatus(target) or []]


def listing(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Path, length and modification time of every file below a path; empty if there is none."""
    target, system = _opened(spark, path)
    if not system.exists(target):
        return []
    found, out = system.listFiles(target, True), []
    while found.hasNext():
        status = found.next()
        out.append((str(status.getPath()), status.getLen(), status.getModificationTime()))
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder that this library wrote, for example superseded state."""
    target, system = _opened(spark, path)
    system.delete(target, True)
