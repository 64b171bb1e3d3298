"""Intermediate tables in the session's shared folder, and how long they live.

A table staged inside a ``scope`` goes when the scope ends: operators that
return figures, not lazy tables, open one around their work.  All other staged
tables may still be read by a result, so they live as long as the session's
Python process; its end deletes the process's folder.
"""

from __future__ import annotations

import atexit
import contextlib
import functools
import uuid
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from tablewright.session import checkpoint_dir

_paths: ContextVar[list | None] = ContextVar("staged_paths", default=None)
_folders: set[str] = set()
_OWN = uuid.uuid4().hex


def _delete(spark: SparkSession, path: str) -> None:
    jvm = getattr(spark, "_jvm", None)
    if jvm is not None:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _folder(spark: SparkSession) -> str:
    """This process's folder below the shared one; deleted with the process."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/staged-{_OWN}"
    if path not in _folders:
        _folders.add(path)

        def at_end():
            with contextlib.suppress(Exception):  # the session may have ended before
                _delete(spark, path)
        atexit.register(at_end)
    return path


@contextlib.contextmanager
def scope(spark: SparkSession):
    """Tables staged inside, by this thread, are deleted at the end."""
    token = _paths.set([])
    try:
        yield
    finally:
        for path in _paths.get():
            _delete(spark, path)
        _paths.reset(token)


def scoped(fn):
    """A function of a DataFrame whose result reads no staged table."""
    @functools.wraps(fn)
    def run(df, *args, **kw):
        with scope(df.sparkSession):
            return fn(df, *args, **kw)
    return run


def staging_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared checkpoint folder, deleted with the scope."""
    path = f"{_folder(spark)}/{label}-{uuid.uuid4().hex}"
    if _paths.get() is not None:
        _paths.get().append(path)
    return path


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet below the shared checkpoint folder and read
    back: later jobs prune columns, and a lost executor costs running tasks
    only."""
    path = staging_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
