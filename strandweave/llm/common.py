"""What the operators of this subpackage share: tables, the shared folder, file access."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LOCAL_SHARED: list[str] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's URI under `spark.checkpoint.dir`, which driver and executors share.

    Only a local session that doesn't set it (tests, a laptop) gets a temporary folder.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _LOCAL_SHARED:
            _LOCAL_SHARED.append(tempfile.mkdtemp(prefix="strandweave-"))
        base = f"file://{_LOCAL_SHARED[0]}"
    return f"{base.rstrip('/')}/strandweave/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def drop_stored(spark: SparkSession) -> None:
    """Deletes all that this application has stored; call it once the results are written elsewhere."""
    folder = shared_folder(spark, "").rpartition("/")[0]
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` to the shared folder and reads it back: lineage ends at files that outlive executors."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def open_folder(uri: str):
    """(pyarrow file system, path) of a URI; works on executors, for any store that pyarrow knows."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def column(part: pa.RecordBatch, name: str) -> pa.Array:
    """A batch's column by a name that may differ in case, as Spark takes names."""
    return part.column(next(i for i, c in enumerate(part.schema.names) if c.lower() == name.lower()))


def within_bytes(rows: DataFrame, order: list, size, most: int) -> DataFrame:
    """The first of a bounded number of `rows`, in `order`, that together hold at most `most` bytes; one at least."""
    before = F.sum(size).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    after = F.sum(size).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumns({"__before": before, "__after": after}).where((F.col("__after") <= most) | F.col("__before").isNull()).drop("__before", "__after")


def trained(rows: DataFrame, train: Callable[[pa.Table], object]) -> object:
    """`train` of a bounded number of rows, run by one task, so that only the model comes to the driver."""

    def fit(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := [p for p in parts if p.num_rows]:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(pa.Table.from_batches(held)))], pa.binary())], names=["model"])

    got = rows.coalesce(1).mapInArrow(fit, "model binary").collect()
    return pickle.loads(got[0]["model"]) if got else train(rows.limit(0).toArrow())


def batches(columns: dict[str, tuple[list, pa.DataType]], rows: int = 8192) -> Iterator[pa.RecordBatch]:
    """Record batches of at most `rows` rows from whole columns."""
    arrays = [pa.array(v, type=t) for v, t in columns.values()]
    n = len(arrays[0]) if arrays else 0
    for at in range(0, n, rows):
        yield pa.RecordBatch.from_arrays([a.slice(at, rows) for a in arrays], names=list(columns))
