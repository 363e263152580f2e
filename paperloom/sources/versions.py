"""Tables that are replaced as a whole: each version lies in a folder of its own, and a numbered manifest names it.

A writer stores its rows first and then publishes the next manifest, which only one writer can.  Readers take the
newest manifest, so they see the old version or the new one and never a part.  Folders of older versions stay, for
readers that still use them, until `drop_versions`.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paperloom.sources.files import hadoop, publish

MANIFEST = re.compile(r"v(\d{12})\.txt")


class Conflict(RuntimeError):
    """Another writer published the version first."""


def _numbers(spark: SparkSession, root: str) -> list[int]:
    fs, folder = hadoop(spark, f"{root}/manifests")
    if not fs.exists(folder):
        return []
    found = (MANIFEST.fullmatch(status.getPath().getName()) for status in fs.listStatus(folder))
    return sorted(int(m[1]) for m in found if m)


def _manifest(root: str, number: int) -> str:
    return f"{root}/manifests/v{number:012d}.txt"


def newest(spark: SparkSession, root: str) -> int:
    """Number of the newest version; 0 where none was published."""
    return max(_numbers(spark, root), default=0)


def read_version(spark: SparkSession, root: str, number: int | None = None) -> DataFrame | None:
    """The rows of a version, the newest unless one is named; None for a table without versions."""
    number = newest(spark, root) if number is None else number
    if not number:
        return None
    return spark.read.parquet(f"{root}/{spark.read.text(_manifest(root, number)).first()[0]}")


def commit(df: DataFrame, root: str, after: int) -> int:
    """Store ``df`` as the version that follows ``after``; `Conflict` where another writer was first.

    The rows of a writer that comes too late are removed again; they were never visible.
    """
    spark, name = df.sparkSession, f"data-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{name}")
    if not publish(spark, _manifest(root, after + 1), name):
        fs, folder = hadoop(spark, f"{root}/{name}")
        fs.delete(folder, True)
        raise Conflict(f"version {after + 1} of {root} was published by another writer")
    return after + 1


def update(spark: SparkSession, root: str, change: Callable[[DataFrame | None], DataFrame], tries: int = 5) -> int:
    """Replace the table by ``change(current rows)``; begins again from the new rows where another writer was first.

    So no writer's rows are lost.  `Conflict` after ``tries`` attempts.
    """
    for attempt in range(1, tries + 1):
        number = newest(spark, root)
        try:
            return commit(change(read_version(spark, root, number)), root, number)
        except Conflict:
            if attempt == tries:
                raise
    raise ValueError("tries must be at least 1")


def drop_versions(spark: SparkSession, root: str, before: int) -> None:
    """Remove versions below ``before``, but never the newest; the manifest goes first, so none names a missing folder."""
    numbers = _numbers(spark, root)
    for number in numbers[:-1]:
        if number < before:
            fs, manifest = hadoop(spark, _manifest(root, number))
            name = spark.read.text(_manifest(root, number)).first()[0]
            fs.delete(manifest, False)
            fs.delete(hadoop(spark, f"{root}/{name}")[1], True)
