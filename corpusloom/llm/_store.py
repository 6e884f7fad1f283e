"""Where intermediate tables and shard files go: the shared folder of the cluster, never a machine's own disk."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession

_ours: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """This application's folder under spark.checkpoint.dir.

    Where that setting is unset, a temporary folder is set, but only for a local master: on a cluster it raises ValueError,
    because executors would not see each other's files. The folder is deleted when the driver's Python ends.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _ours:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
            sc.setCheckpointDir(base)
        elif sc.getCheckpointDir() is None:
            sc.setCheckpointDir(base)
        path = sc._jvm.org.apache.hadoop.fs.Path(base)  # with the scheme that the cluster's settings give it, if it has none
        base = path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString()
        _ours[sc.applicationId] = f"{base.rstrip('/')}/corpusloom-{sc.applicationId}"
        atexit.register(_forget, sc, _ours[sc.applicationId])
    return _ours[sc.applicationId]


def _forget(sc, folder: str) -> None:
    if sc._jsc is not None:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


#: Of each open scope of this thread or task, the folders that end with it.
_scopes: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("scopes", default=())


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """A scope at whose end the tables that :func:`kept` wrote in it are deleted, but for those it gave to the scope around it."""
    mine: list[str] = []
    before = _scopes.set((*_scopes.get(), mine))
    try:
        yield
    finally:
        _scopes.reset(before)
        for path in mine:
            _forget(spark.sparkContext, path)


def kept(df: DataFrame, name: str, outlives: bool = False) -> DataFrame:
    """Writes a table once and reads it back: its lineage is cut, and a lost executor loses none of it.

    The table stays until the innermost :func:`scratch` scope ends (``outlives``: the one around that), or the driver's Python.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    around = _scopes.get()[:-1] if outlives else _scopes.get()
    if around:
        around[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def discard(table: DataFrame) -> None:
    """Deletes a table of :func:`kept` before its scope ends; other tables stay as they are."""
    if path := table.__dict__.get("kept_at"):
        _forget(table.sparkSession.sparkContext, path)


def give_back() -> None:
    """Gives a worker's free memory back to the system: workers stay when their tasks end, beside the next stage's JVM memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def modest_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lowers the session's Arrow batch size to ``rows``, so that batches of long texts stay small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(rows))
