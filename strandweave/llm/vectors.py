"""Vectors in tables: which take part, and files of blocks of them, which tasks read by place."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm.common import open_folder

SAMPLE_ROWS, SAMPLE_BYTES = 20_000, 64 << 20
BLOCK_BYTES = 16 << 20


def usable(vectors: DataFrame) -> tuple[DataFrame, list[int]]:
    """(vec_id, embedding as array<double>) of the rows that take part, and the dimensions they have.

    Out are null ids and vectors, null or non-finite components and zero vectors.  A table without
    usable vectors has no dimensions.  There is a row for each dimension on the driver.
    """
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = v.where(
        F.col("vec_id").isNotNull() & F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0)
    )
    return good, sorted(r["d"] for r in good.select(F.size("embedding").alias("d")).distinct().collect())


def of_dimension(good: DataFrame, dim: int) -> DataFrame:
    return good.where(F.size("embedding") == dim)


def rows_of(most: int, dim: int, size: int = BLOCK_BYTES) -> int:
    """`most` rows, or as many vectors as `size` bytes hold."""
    return max(16, min(most, size // (8 * dim)))


def sample_matrix(good: DataFrame, dim: int, rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Unit vectors of at most `rows` rows, and SAMPLE_BYTES, chosen by the hash of their ids: for fitting an index only."""
    chosen = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(rows_of(rows, dim, SAMPLE_BYTES)).select("embedding").toArrow()
    return unit(matrix(chosen.column("embedding").combine_chunks(), dim))


class BlockWriter:
    """Appends arrays to one file of a task attempt, under a name of its own: other attempts' files are listed by no table."""

    def __init__(self, folder: str):
        self.uri, self.out, self.at = f"{folder}/{uuid.uuid4().hex}.blocks", None, 0

    def add(self, *arrays: np.ndarray) -> tuple[str, int]:
        """Where the arrays' bytes stand: (file, place)."""
        if self.out is None:
            fs, path = open_folder(self.uri)
            fs.create_dir(path.rpartition("/")[0], recursive=True)
            self.out = fs.open_output_stream(path)
        place = self.at
        for array in arrays:
            raw = np.ascontiguousarray(array).tobytes()
            self.out.write(raw)
            self.at += len(raw)
        return self.uri, place

    def close(self) -> None:
        if self.out is not None:
            self.out.close()


def read_block(uri: str, at: int, *shapes: tuple[str, tuple[int, ...]]) -> list[np.ndarray]:
    """Arrays of the given (type, shape) that follow each other from place `at`."""
    kinds = [(np.dtype(t), shape, int(np.prod(shape))) for t, shape in shapes]
    fs, path = open_folder(uri)
    with fs.open_input_file(path) as file:
        file.seek(at)
        raw = file.read(sum(t.itemsize * n for t, _, n in kinds))
    out, pos = [], 0
    for t, shape, n in kinds:
        out.append(np.frombuffer(raw, t, n, pos).reshape(shape))
        pos += t.itemsize * n
    return out


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def unit(m: np.ndarray) -> np.ndarray:
    scaled = m / np.abs(m).max(axis=1, keepdims=True) if len(m) else m  # no square overflows
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision, the same whatever rows stand beside: products are summed along each row."""
    a, b = (m / np.abs(m).max(axis=1, keepdims=True) for m in (a, b))
    lengths = np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1))
    return np.clip((a * b).sum(axis=1) / lengths, -1.0, 1.0)
