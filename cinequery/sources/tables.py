"""Parquet tables of a data folder, and the folder that all executors share."""

from __future__ import annotations

import atexit
import hashlib
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder``: one Parquet file or a folder of parts."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def hadoop(spark: SparkSession, path: str):
    """The file system that holds ``path``, and the path for it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session. Only where the master is local, one is made if none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="cinequery-"))
    return context.getCheckpointDir().rstrip("/")


#: Paths of intermediate results, for each open scope; the first is the session's.
_SCOPES: list[list[tuple[SparkSession, str]]] = [[]]


def _remove(held: list[tuple[SparkSession, str]]) -> None:
    while held:
        spark, path = held.pop()
        try:
            system, target = hadoop(spark, path)
            system.delete(target, True)
        except Exception:  # the session may be gone already
            pass


atexit.register(_remove, _SCOPES[0])


@contextmanager
def scratch() -> Iterator[None]:
    """Intermediate results that are written inside are removed at the end: queries must have run by then.

    Outside of any scope they are removed when the driver ends, as a result may be read at any time until then.
    """
    _SCOPES.append([])
    try:
        yield
    finally:
        _remove(_SCOPES.pop())


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, which cuts its lineage.

    Files in the shared folder outlive any executor, so a lost one costs a re-read and no
    recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _SCOPES[-1].append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keep_until_exit(spark: SparkSession, path: str) -> None:
    """Remove ``path`` when the driver ends."""
    _SCOPES[0].append((spark, path))


def fingerprint(spark: SparkSession, folder: str, *names: str) -> str:
    """Changes when one of the tables does: names, lengths and times of the files."""
    said = []
    for name in names:
        system, target = hadoop(spark, f"{folder}/{name}.parquet")
        for status in sorted(system.listStatus(target), key=lambda s: s.getPath().toString()):
            said.append(f"{status.getPath()} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join(said).encode()).hexdigest()[:24]
