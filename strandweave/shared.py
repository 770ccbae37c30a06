"""The folder that driver and executors share, and tables and files in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's URI under `spark.checkpoint.dir`; only a local session that lacks it gets a temporary one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="strandweave-"))
        base = f"file://{_LOCAL[0]}"
    return f"{base.rstrip('/')}/strandweave/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` to the shared folder and reads it back, so that several uses compute it once and no lineage is left."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_folder(uri: str):
    """(pyarrow file system, path) of a URI; works on executors, for any store that pyarrow knows."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def free_name(taken: list[str], name: str) -> str:
    """`name`, with underscores before it until no column has it, in any case."""
    known = {c.lower() for c in taken}
    while name.lower() in known:
        name = f"_{name}"
    return name
