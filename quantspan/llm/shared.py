"""Tables written to the cluster's shared folder, so that lineage is cut durably.

The folder is the one named by ``spark.checkpoint.dir``. Only where that is unset (tests, a laptop)
is a temporary folder of this process used, once per session.
"""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows that a Python worker is sent at once, Spark's 10,000 being tens of MB of whole texts: the JVM holds them
#: outside its heap, the worker twice.
ROWS_AT_ONCE = 2000
_AT_ONCE = "spark.sql.execution.arrow.maxRecordsPerBatch"

_fallback: dict[str, str] = {}
_open: list[Workspace] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _fallback:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        _fallback[app] = "file://" + tempfile.mkdtemp(prefix="quantspan-")
    return _fallback[app]


def bound_batches(spark: SparkSession) -> None:
    """From now on the session sends Python at most ``ROWS_AT_ONCE`` rows at once; a lower setting stays."""
    if not 0 < int(spark.conf.get(_AT_ONCE)) <= ROWS_AT_ONCE:
        spark.conf.set(_AT_ONCE, ROWS_AT_ONCE)


def give_back() -> None:
    """Memory that this process has freed but keeps goes to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:  # glibc only
        trim(0)


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for ``mapInArrow``. Spark keeps its Python workers, so at the end of a task each gives back what
    the task held; else those that wait add up to more than those that run."""

    @functools.wraps(run)
    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


class Workspace:
    """Intermediate tables of one operator call, as Parquet in the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        bound_batches(spark)
        self.spark = spark
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        _open.append(self)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return the written rows; its shuffles may then be freed."""
        path = f"{self.root}/{name}"
        df.write.parquet(path, compression="zstd")
        schema = df.schema
        del df
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more, and let Spark free unused shuffles."""
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        self.release()

    def close(self) -> None:
        """Delete all tables; what was made of them must be written or collected."""
        self.drop("")

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *failure) -> None:
        self.close()

    def release(self) -> None:
        gc.collect()
        self.spark._jvm.System.gc()


class Collected:
    """Closes, when asked, the workspaces that operators have opened since the last time."""

    def __enter__(self) -> Collected:
        self.before = len(_open)
        return self

    def close(self) -> None:
        for work in _open[self.before :]:
            work.close()

    def __exit__(self, *failure) -> None:
        del _open[self.before :]


def columns_as(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names: extra columns cannot clash."""
    return df.select(*[df[source].alias(own) for own, source in columns.items()])
