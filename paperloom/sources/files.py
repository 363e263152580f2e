"""Single files inside tasks and on the driver: the file system behind an address, and publishing a file only once."""

from __future__ import annotations

import os
import uuid

import pyarrow.fs as pafs
from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def located(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of an address as Spark shows it (``file:/…``, ``hdfs://…``) or of a plain path."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def hadoop(spark: SparkSession, uri: str):
    """Hadoop's file system and path object of an address, on the driver."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def publish(spark: SparkSession, uri: str, content: str) -> bool:
    """Create the file ``uri`` with its whole content, or return False where it already exists.

    The content is written under another name first and then linked (local) or renamed without overwriting (other
    file systems), so that of several writers one wins and no reader sees half a file.
    """
    fs, path = hadoop(spark, uri)
    folder, draft = path.getParent(), f".draft-{uuid.uuid4().hex}"
    fs.mkdirs(folder)
    if fs.getScheme() == "file":
        target = located(uri)[1]
        source = os.path.join(os.path.dirname(target), draft)
        with open(source, "w", encoding="utf-8") as out:
            out.write(content)
        try:
            os.link(source, target)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(source)
    hfs = spark._jvm.org.apache.hadoop.fs
    source = hfs.Path(folder, draft)
    out = fs.create(source, True)
    out.write(content.encode())
    out.close()
    context = hfs.FileContext.getFileContext(path.toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(hfs.Options.Rename, 0)
    try:
        context.rename(source, path, options)
        return True
    except Py4JJavaError as error:
        fs.delete(source, False)
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
