"""Where tables that queries share are kept: under the session's checkpoint folder, which all executors see."""

from __future__ import annotations

import functools
import hashlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own(application: str) -> str:
    return tempfile.mkdtemp(prefix="lexweave-")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of this machine only where that is unset and the session runs on this machine alone."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is not set: on a cluster it must name a folder that all executors share")
    return _own(spark.sparkContext.applicationId)


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of df from a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def path_of(spark: SparkSession, name: str):
    """The Hadoop file system and path of a name."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.sc().hadoopConfiguration()), path


def exists(spark: SparkSession, name: str) -> bool:
    files, path = path_of(spark, name)
    return files.exists(path)


def listed(spark: SparkSession, name: str) -> list[str]:
    """The names in a folder; none where there is no such folder."""
    files, path = path_of(spark, name)
    return [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []


def delete(spark: SparkSession, name: str) -> None:
    files, path = path_of(spark, name)
    files.delete(path, True)


def read_text(spark: SparkSession, name: str) -> str:
    files, path = path_of(spark, name)
    stream = files.open(path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create(spark: SparkSession, name: str, text: str) -> bool:
    """A small file that is whole or not there: written under another name and renamed. False where the name is taken."""
    files, path = path_of(spark, name)
    _, draft = path_of(spark, f"{name.rpartition('/')[0]}/.{uuid.uuid4().hex}")
    stream = files.create(draft)
    stream.write(bytearray(text.encode("utf-8")))
    stream.close()
    if files.exists(path) or not files.rename(draft, path):
        files.delete(draft, False)
        return False
    return True


def fingerprint(df: DataFrame) -> str:
    """A hash of the names, sizes and times of the files that df reads."""
    told = []
    for name in sorted(df.inputFiles()):
        files, path = path_of(df.sparkSession, name)
        status = files.getFileStatus(path)
        told.append(f"{name}:{status.getLen()}:{status.getModificationTime()}")
    return hashlib.sha256("\n".join(told).encode()).hexdigest()[:24]
