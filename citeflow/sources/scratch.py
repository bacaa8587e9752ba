"""Tables and files of this driver in the shared folder."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_RUN = f"citeflow-{uuid.uuid4().hex}"
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def new_path(spark: SparkSession) -> str:
    """A new path under spark.checkpoint.dir (a temporary folder where it is
    unset and the master local), deleted when the driver ends."""
    have = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not have:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        have = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", have)
    path, fs = _file_system(spark, f"{have}/{_RUN}")
    if not fs.exists(path):
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return f"{have}/{_RUN}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table, read back."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for df in tables:
        path, fs = _file_system(df.sparkSession, _paths.pop(df))
        fs.delete(path, True)


def put(spark: SparkSession, content: bytes, name: str, folder: str | None = None) -> str:
    """The path of a new file with these bytes: in ``folder``, or one whose
    own name ends in ``name``."""
    whole = f"{folder}/{name}" if folder else new_path(spark) + name
    path, fs = _file_system(spark, whole)
    out = fs.create(path)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    return whole


@contextlib.contextmanager
def fetched(spark: SparkSession, path: str):
    """The path of a copy of a file on the driver's own disk, for a while."""
    at, fs = _file_system(spark, path)
    with tempfile.TemporaryDirectory(prefix="citeflow-") as own:
        fs.copyToLocalFile(False, at, spark._jvm.org.apache.hadoop.fs.Path(f"file://{own}/file"), True)
        yield f"{own}/file"


def send(spark: SparkSession, local: str, path: str) -> None:
    """Copies a file or folder of the driver's own disk to a path."""
    at, fs = _file_system(spark, path)
    fs.copyFromLocalFile(False, True, spark._jvm.org.apache.hadoop.fs.Path(f"file://{local}"), at)
