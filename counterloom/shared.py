"""Intermediate tables in the folder that the driver and all executors share."""

import uuid
import warnings
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Folders of the innermost open scope. Every thread has its own: a stream's
# micro-batch runs beside the caller's thread and must not take its folders along.
_scope: ContextVar[list[str] | None] = ContextVar("scope", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, else one in the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/settled"
        if not spark.sparkContext.master.startswith("local"):
            warnings.warn(f"spark.checkpoint.dir is unset; executors must share {folder}")
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    paths = _scope.get()
    if paths is not None:
        paths.append(path)
    return path


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The table is computed once however often it is used, it outlives lost
    executors, and Catalyst knows its true size when it picks a join.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def settled_scope(spark: SparkSession) -> Iterator[None]:
    """Delete at the end every folder that this thread made inside.

    Frames that read them must have been used or written elsewhere by then.
    """
    paths: list[str] = []
    token = _scope.set(paths)
    try:
        yield
    finally:
        _scope.reset(token)
        for path in paths:
            delete_folder(spark, path)


def discard(df: DataFrame) -> None:
    """Delete the files of a settled table that nothing will read any more."""
    for path in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        delete_folder(df.sparkSession, path)


def delete_folder(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
