"""Tables and files that cut lineage, kept in the folder all executors share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only for local masters without it."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named if "://" in named else f"file://{os.path.abspath(named)}"
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _OWN:
        _OWN[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="sediment-")
    return _OWN[sc.applicationId]


_ROOTS: list[str] = []


@atexit.register
def _delete_all() -> None:
    """When the driver's process ends, nothing reads its scratch folders any more."""
    for root in _ROOTS:
        try:
            fs, path = pafs.FileSystem.from_uri(root)
            fs.delete_dir(path)
        except (OSError, ValueError):  # gone, or in a store that pyarrow doesn't reach
            pass


class Scratch:
    """Named tables and file folders under one fresh folder of shared_dir(), deleted when the driver's process ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        _ROOTS.append(self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write df as Parquet and return the written table."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that no later plan reads."""
        for name in names:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, uri: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def put_file(uri: str, parts) -> int:
    """Write an iterable of bytes to uri in one step: a retried task replaces its own file."""
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    tmp, n = f"{path}.{uuid.uuid4().hex}.tmp", 0
    with fs.open_output_stream(tmp) as out:
        for part in parts:
            out.write(part)
            n += len(part)
    fs.move(tmp, path)
    return n


def open_file(uri: str):
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs.open_input_file(path)


def local_path(uri: str) -> str:
    """The path under which workers can memory-map a shared file."""
    if not uri.startswith("file:"):
        raise ValueError(f"memory mapping needs a mounted shared folder, not {uri}")
    return "/" + uri[len("file:"):].lstrip("/")
