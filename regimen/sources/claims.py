"""Small files that exactly one writer can publish, on the file system of a shared folder.

``publish`` writes the whole content under a name of its own first and then gives it the wanted name in one step that fails
if the name is taken: a hard link on local disks, a rename without overwrite elsewhere (atomic on HDFS and the file systems
that follow it; an object store needs a committer with conditional writes). So a reader sees either no file or all of it, a
writer that dies leaves nothing behind under the wanted name, and of several writers one succeeds.
"""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession


def local_path(path: str) -> str | None:
    """The path on the local disk, or None on another file system."""
    url = urlparse(path)
    return unquote(url.path) if url.scheme in ("", "file") else None


def _is_local(spark: SparkSession, path: str) -> bool:
    return local_path(path) is not None and (urlparse(path).scheme == "file" or _system(spark, path)[0].getScheme() == "file")


def _system(spark: SparkSession, path: str):
    """(Hadoop file system, Hadoop path) of ``path``."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """Create ``path`` with ``text``, unless it exists; whether this call created it."""
    folder, name = path.rsplit("/", 1)
    draft = f"{folder}/.{name}.{uuid.uuid4().hex}"              # hidden names are no part of any listing
    if _is_local(spark, path):
        os.makedirs(local_path(folder), exist_ok=True)
        with open(local_path(draft), "x", encoding="utf-8") as file:
            file.write(text)
            file.flush()
            os.fsync(file.fileno())
        try:
            os.link(local_path(draft), local_path(path))
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(local_path(draft))
    files, at = _system(spark, path)
    files.mkdirs(at.getParent())
    jvm = spark.sparkContext._jvm
    draft_at = jvm.org.apache.hadoop.fs.Path(draft)
    out = files.create(draft_at, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    none = spark.sparkContext._gateway.new_array(rename, 0)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(draft_at, at, none)
        return True
    except Exception:
        if not files.exists(at):
            raise
        files.delete(draft_at, False)
        return False


def listed(spark: SparkSession, folder: str) -> list[str]:
    """Names in ``folder``, sorted; none if there is no such folder. Any other failure is an error."""
    files, at = _system(spark, folder)
    if not files.exists(at):
        return []
    return sorted(n for n in (s.getPath().getName() for s in files.listStatus(at)) if not n.startswith("."))


def content(spark: SparkSession, path: str) -> str:
    files, at = _system(spark, path)
    size = files.getFileStatus(at).getLen()
    stream = files.open(at)
    try:
        return bytes(stream.readNBytes(int(size))).decode()
    finally:
        stream.close()


def removed(spark: SparkSession, folder: str) -> None:
    """Delete ``folder`` with all below it, if it is there."""
    files, at = _system(spark, folder)
    files.delete(at, True)
