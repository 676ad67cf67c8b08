"""Tables in the folder that driver and executors share, which cut lineage and go when the session ends."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

_run_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, as in tests, a temporary folder is set; only a local master may do that.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir() or found
    return found.rstrip("/")


def hadoop_fs(spark: SparkSession, path: str):
    """The file system of a path, and the path as that system's object."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def run_dir(spark: SparkSession) -> str:
    """A folder of this application in the shared one, with its file system named in full. It is deleted when the driver ends."""
    key = f"{spark.sparkContext.applicationId} {shared_dir(spark)}"
    if key not in _run_dirs:
        fs, at = hadoop_fs(spark, f"{shared_dir(spark)}/marginalia-{uuid.uuid4().hex}")
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        _run_dirs[key] = fs.makeQualified(at).toString()
    return _run_dirs[key]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df as Parquet into the shared folder and reads it back."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path, for tasks, of a URI as Spark names it; new_path() always gives its scheme."""
    scheme, _, rest = uri.partition(":")
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    if scheme == "dbfs":  # mounted there on every machine
        return pafs.LocalFileSystem(), "/dbfs/" + rest.lstrip("/")
    if not rest:
        raise ValueError(f"a path without a scheme: {uri}")
    return pafs.FileSystem.from_uri(f"{ {'s3a': 's3', 's3n': 's3'}.get(scheme, scheme)}:{rest}")


def discard(table: DataFrame) -> None:
    """Deletes the files of a table that written() gave and that nothing reads any more."""
    spark = table.sparkSession
    for path in {f.rpartition("/")[0] for f in table.inputFiles()}:
        if run_dir(spark).rpartition("/")[2] in path:
            fs, at = hadoop_fs(spark, path)
            fs.delete(at, True)


def lean() -> None:
    """Gives the memory that earlier tasks of this worker process freed back to the system. Workers outlive stages, and allocators keep what their largest task took."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):  # glibc
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD: larger blocks go back when they are freed; unset, it grows to 32 MB with the blocks
        libc.malloc_trim(0)


def lean_driver(spark: SparkSession) -> None:
    """The same for the driver, between the steps of a long job: its Python, and the heap that its JVM took for plans of earlier steps."""
    lean()
    spark._jvm.System.gc()
