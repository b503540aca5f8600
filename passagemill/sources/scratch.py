"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []
_notes: list[list[DataFrame]] = []
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset: one of this machine in local mode, else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="passagemill-"))
    return _local[0]


def materialize(df: DataFrame) -> DataFrame:
    """Written as Parquet into the shared folder and read again: cuts the lineage, survives a lost executor.

    The folder goes by ``discard``, or when the driver ends.
    """
    spark = df.sparkSession
    path = folder(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    for made in _notes:
        made.append(out)
    return out


def folder(spark: SparkSession) -> str:
    """A new path in the shared folder for files; what is written there goes when the driver ends."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    fs, at = _place(spark, path)
    fs.deleteOnExit(at)
    return path


def stored(spark: SparkSession, name: str, make: Callable[[str], None]) -> str:
    """The path of a table, or folder of tables, that this application has written once under ``name``: ``make(path)``.

    It stays for the queries that follow and goes when the driver ends. A folder without its mark, left by a run that
    failed, is written anew.
    """
    app = hashlib.sha256(f"{spark.sparkContext.applicationId} {name}".encode()).hexdigest()[:32]
    path = f"{shared_dir(spark)}/stored-{app}"
    fs, at = _place(spark, path)
    _, done = _place(spark, f"{path}/_DONE")
    if not fs.exists(done):
        fs.delete(at, True)
        fs.deleteOnExit(at)
        make(path)
        fs.create(done).close()
    return path


def input_state(df: DataFrame) -> str:
    """Names, lengths and times of the files that df reads: what tells whether something stored is still of this input."""
    out = []
    for name in sorted(df.inputFiles()):
        fs, at = _place(df.sparkSession, name)
        status = fs.getFileStatus(at)
        out.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join(out).encode()).hexdigest()


def discard(*tables: DataFrame) -> None:
    """Deletes materialized tables that nothing reads any more; other frames are passed over."""
    for df in tables:
        path = _paths.pop(df, None)
        if path is not None:
            fs, at = _place(df.sparkSession, path)
            fs.delete(at, True)


@contextmanager
def noted() -> Iterator[list[DataFrame]]:
    """Lists the tables that are materialized within."""
    made: list[DataFrame] = []
    _notes.append(made)
    try:
        yield made
    finally:
        _notes[:] = [n for n in _notes if n is not made]  # by identity: a list around it may hold the same tables


def _place(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as its object."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at
