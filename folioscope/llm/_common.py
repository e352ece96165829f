"""Helpers shared by the operators: table access, shared storage, binning."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters [\x20\x09-\x0D] (fixed values).
WHITESPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Temporary folders of local sessions without a shared one, by application, and the tables written by each application.
_LOCAL: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session may lack it: a temporary folder serves there, as driver and
    executors are one process.  On a cluster that would lose tables, so it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="folioscope-")
        root = _LOCAL[app]
    return root.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that nothing reads any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all intermediate tables that this session has written: once the results are stored elsewhere."""
    for path in _WRITTEN.pop(spark.sparkContext.applicationId, []):
        discard(spark, path)


def materialize(df: DataFrame, label: str, into: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back; the path is added to ``into``.

    This cuts the lineage in a way that survives lost executors, and gives the
    planner the true size, so that it broadcasts the table only where it is small.
    """
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    if into is not None:
        into.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")).cast("string")


def crc_bucket(id_col: str, modulus: int) -> Column:
    """crc32 of the identifier's decimal text modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release() -> None:
    """Give memory that a worker no longer uses back to the system: it outlives the task, and what it keeps the next ones lack."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: Rows that pass between a task and its Python worker at a time.
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Keep the batches that Python workers get small: rows hold whole texts, some of them very long.

    Both the worker and the task hold a batch in memory.  A smaller setting of the session stays.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
