"""Embedding near-duplicates by an epsilon grid order join.

Cosine at least `least` is a distance of at most epsilon between unit vectors.  Vectors are
sorted by the grid cells, of side epsilon, of their leading principal components (fitted on a
bounded sample; the order needs no more), and cut into intervals and blocks, which are written to
files.  Tables hold only the blocks' places and boxes.  The join goes down
pairs of intervals, of blocks, and of parts of blocks, and skips pairs whose boxes are over
epsilon apart in those components, which no distance undercuts.  What is left is multiplied out,
and pairs near the limit are decided in double precision.

Equal vectors are joined once, with their number; a task gives link counts and a spanning forest
of its links, never the pairs.  Vectors out of `usable` link with nothing; vectors of different
dimensions are joined apart and never link.  Rows that repeat a
vec_id are one node, with the links of all its vectors; a repeated row links with its repeats.  An
empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm.common import batches, read_table, shared_folder, stored
from strandweave.llm.components import connected, unite
from strandweave.llm.vectors import BlockWriter, cosines, matrix, of_dimension, read_block, rows_of, sample_matrix, unit, usable

LEAST, DIMS = 0.95, 6
BLOCK_ROWS, PART_ROWS, MAX_INTERVALS = 4096, 256, 512
#: Blocks on a side of a tile, whose pairs one task joins, and the most tasks.
TILE, MAX_TASKS = 4, 32_768


def principal_axes(sample: np.ndarray, dims: int) -> np.ndarray:
    """Leading eigenvectors of the covariance, as columns."""
    centred = sample - sample.mean(axis=0)
    _, axes = np.linalg.eigh(centred.T @ centred)
    return axes[:, ::-1][:, :dims]


def interval_pairs(low: np.ndarray, high: np.ndarray, epsilon: float) -> list[tuple[int, int]]:
    """Pairs (i <= j) of intervals not provably distant, by recursion over halves of the sequence."""
    out: list[tuple[int, int]] = []

    def apart(a: tuple[int, int], b: tuple[int, int]) -> bool:
        gap = np.maximum(low[b[0] : b[1]].min(0) - high[a[0] : a[1]].max(0), low[a[0] : a[1]].min(0) - high[b[0] : b[1]].max(0))
        return float((np.maximum(gap, 0) ** 2).sum()) > epsilon * epsilon

    todo = [((0, len(low)), (0, len(low)))] if len(low) else []
    while todo:
        a, b = todo.pop()
        if apart(a, b):
            continue
        if a[1] - a[0] == 1 and b[1] - b[0] == 1:
            out.append((a[0], b[0]))
            continue
        halves = lambda x: [x] if x[1] - x[0] == 1 else [(x[0], (x[0] + x[1]) // 2), ((x[0] + x[1]) // 2, x[1])]
        todo += [(x, y) for x in halves(a) for y in halves(b) if x[0] <= y[0]]
    return sorted(out)


def join_blocks(a, b, same: bool, axes: np.ndarray, least: float):
    """(links of each row of a, of b, forest u, forest v) of two blocks (ids, vectors, copies)."""
    epsilon = math.sqrt(max(0.0, 2 - 2 * least)) + 1e-6
    (ids_a, vec_a, many_a), (ids_b, vec_b, many_b) = a, b
    unit_a, unit_b = unit(vec_a), unit(vec_b)
    at_a, at_b = unit_a @ axes, unit_b @ axes
    unit_a, unit_b = unit_a.astype(np.float32), unit_b.astype(np.float32)
    n_a, n_b = len(ids_a), len(ids_b)
    # What a product in single precision may be off by: a rounding for each term, and those of the vectors themselves.
    doubt = (vec_a.shape[1] + 8) * 2.0**-23
    links_a, links_b = np.zeros(n_a, np.int64), np.zeros(n_b, np.int64)
    parent = np.arange(n_a + n_b)
    if same:
        unite(parent, np.arange(n_a), n_a + np.arange(n_b))
    cuts = np.arange(0, n_b, PART_ROWS)
    low_b, high_b = np.minimum.reduceat(at_b, cuts), np.maximum.reduceat(at_b, cuts)
    for first in range(0, n_a, PART_ROWS):
        rows = slice(first, min(n_a, first + PART_ROWS))
        gap = np.maximum(np.maximum(low_b - at_a[rows].max(0), at_a[rows].min(0) - high_b), 0)
        near = (gap * gap).sum(axis=1) <= epsilon * epsilon
        if same:
            near &= cuts + PART_ROWS > first  # each pair of rows once
        parts = [np.arange(c, min(n_b, c + PART_ROWS)) for c in cuts[near]]
        if not parts:
            continue
        columns = np.concatenate(parts)
        products = unit_a[rows] @ unit_b[columns].T
        i, j = np.nonzero(products >= least - doubt)
        doubtful = products[i, j] < least + doubt
        i, j = i + first, columns[j]
        if same:
            later = j > i
            i, j, doubtful = i[later], j[later], doubtful[later]
        if doubtful.any():
            sure = ~doubtful
            sure[doubtful] = cosines(vec_a[i[doubtful]], vec_b[j[doubtful]]) >= least
            i, j = i[sure], j[sure]
        links_a += np.bincount(i, many_b[j], n_a).astype(np.int64)
        links_b += np.bincount(j, many_a[i], n_b).astype(np.int64)
        unite(parent, i, n_a + j)
    ids = np.concatenate([ids_a, ids_b])
    rows = np.flatnonzero(parent != np.arange(n_a + n_b))
    rows = rows[ids[rows] != ids[parent[rows]]]
    return links_a, links_b, ids[parent[rows]], ids[rows]


BLOCKS = "interval long, block long, path string, at long, rows long, low array<double>, high array<double>"


def _blocks(dim: int, axes: np.ndarray, folder: str):
    """Sorted rows to blocks, written to files; a row tells where a block stands, and its box."""
    most = rows_of(BLOCK_ROWS, dim)

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        made: list[tuple] = []
        writer = BlockWriter(folder)

        def out() -> None:
            table = pa.Table.from_batches(held)
            vectors = matrix(table.column("embedding").combine_chunks(), dim)
            at = unit(vectors) @ axes
            ids, copies = (table.column(c).to_numpy().astype("<i8") for c in ("vec_id", "copies"))
            place = writer.add(ids, vectors.astype("<f8"), copies)
            made.append((TaskContext.get().partitionId(), len(made), *place, len(ids), at.min(0).tolist(), at.max(0).tolist()))

        for part in parts:
            at = 0
            while at < part.num_rows:
                take = min(part.num_rows - at, most - n)
                held.append(part.slice(at, take))
                at, n = at + take, n + take
                if n == most:
                    out()
                    held, n = [], 0
        if held:
            out()
        writer.close()
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()))
        names = ("interval", "block", "path", "at", "rows", "low", "high")
        yield from batches({k: ([m[i] for m in made], t) for i, (k, t) in enumerate(zip(names, kinds))})

    return cut


def _joined(dim: int, axes: np.ndarray, least: float):
    """Rows that name two blocks to link counts (u = v, n) and forests (u, v) of the blocks' links."""

    def join(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read: OrderedDict[tuple[str, int], list[np.ndarray]] = OrderedDict()

        def block(path: str, at: int, n: int) -> list[np.ndarray]:
            if (path, at) in read:
                read.move_to_end((path, at))
            else:
                while len(read) >= 2 * TILE:
                    read.popitem(last=False)
                read[path, at] = read_block(path, at, ("<i8", (n,)), ("<f8", (n, dim)), ("<i8", (n,)))
            return read[path, at]

        for part in parts:
            for row in part.to_pylist():
                a, b = (block(row[f"path_{s}"], row[f"at_{s}"], row[f"rows_{s}"]) for s in "ab")
                n_a, n_b, u, v = join_blocks(a, b, row["same"], axes, least)
                for ids, n in ((a[0], n_a), (b[0], n_b)):
                    some = np.flatnonzero(n)
                    yield from batches({"u": (ids[some], pa.int64()), "v": (ids[some], pa.int64()), "n": (n[some], pa.int64())})
                yield from batches({"u": (u, pa.int64()), "v": (v, pa.int64()), "n": (np.zeros(len(u), np.int64), pa.int64())})

    return join


def _links(good: DataFrame, dim: int, least: float, dims: int) -> tuple[DataFrame, DataFrame]:
    """(u, v, n: links found among distinct vectors; embedding, node, copies of repeated ones), all of one dimension."""
    spark = good.sparkSession
    axes = principal_axes(sample_matrix(good, dim), min(dims, dim))
    width = axes.shape[1]
    epsilon = math.sqrt(max(0.0, 2 - 2 * least)) + 1e-6
    distinct = good.groupBy("embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))

    def gridded(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            cells = np.floor(unit(matrix(part.column("embedding"), dim)) @ axes / epsilon).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column("node"), part.column("embedding"), part.column("copies"), *(pa.array(cells[:, i]) for i in range(width))],
                names=["vec_id", "embedding", "copies", *(f"g{i}" for i in range(width))],
            )

    grid = [f"g{i}" for i in range(width)]
    cells = stored(
        distinct.mapInArrow(gridded, "vec_id long, embedding array<double>, copies long, " + ", ".join(f"{g} long" for g in grid)), "ego-grid"
    )
    intervals = max(1, min(MAX_INTERVALS, -(-cells.count() // rows_of(BLOCK_ROWS, dim))))
    blocks = stored(
        cells.repartitionByRange(intervals, *grid, "vec_id").sortWithinPartitions(*grid, "vec_id")
        .select("vec_id", "embedding", "copies").mapInArrow(_blocks(dim, axes, shared_folder(spark, "ego-vectors")), BLOCKS),
        "ego-blocks",
    )
    # One row an interval, and at most about MAX_INTERVALS of them.
    boxes = blocks.groupBy("interval").agg(
        *(F.min(F.col("low")[i]).alias(f"low{i}") for i in range(width)), *(F.max(F.col("high")[i]).alias(f"high{i}") for i in range(width))
    ).orderBy("interval").collect()
    low = np.array([[b[f"low{i}"] for i in range(width)] for b in boxes])
    high = np.array([[b[f"high{i}"] for i in range(width)] for b in boxes])
    pairs = [(boxes[i]["interval"], boxes[j]["interval"]) for i, j in interval_pairs(low, high, epsilon)]
    plan = spark.createDataFrame(pairs or [(0, 0)], "a long, b long")
    side = lambda s: blocks.select(*(F.col(c).alias(f"{c}_{s}") for c in blocks.columns))
    gap = F.zip_with(
        F.zip_with("low_b", "high_a", lambda x, y: x - y), F.zip_with("low_a", "high_b", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0))
    )
    apart = F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x)
    # Only places and boxes of blocks are joined and dealt; tasks read the blocks' files.
    work = stored(
        plan.join(side("a").withColumnRenamed("interval_a", "a"), "a")
        .join(side("b").withColumnRenamed("interval_b", "b"), "b")
        .where((F.col("a") < F.col("b")) | (F.col("block_a") <= F.col("block_b")))
        .where(apart <= epsilon * epsilon)
        .select(
            "a", "b", "block_a", "block_b", "path_a", "at_a", "rows_a", "path_b", "at_b", "rows_b",
            ((F.col("a") == F.col("b")) & (F.col("block_a") == F.col("block_b"))).alias("same"),
        ),
        "ego-pairs",
    )
    # Pairs of a tile of blocks go to one task, which reads each of them once.
    tile = ["a", "b", F.floor(F.col("block_a") / TILE), F.floor(F.col("block_b") / TILE)]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MAX_TASKS, work.count() // TILE))
    dealt = work.repartition(tasks, *tile).sortWithinPartitions(*tile, "block_a", "block_b").drop("a", "b", "block_a", "block_b")
    found = stored(dealt.mapInArrow(_joined(dim, axes, least), "u long, v long, n long"), "ego-links")
    return found, cells.where("copies > 1").select("embedding", F.col("vec_id").alias("node"), "copies")


def near_duplicates(vectors: DataFrame, least: float = LEAST, dims: int = DIMS) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of `vectors` (columns vec_id, embedding)."""
    good, sizes = usable(vectors)
    everyone = vectors.select("vec_id")
    if not sizes:
        return everyone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    each = [_links(of_dimension(good, dim), dim, least, dims) for dim in sizes]
    found, repeated = (reduce(DataFrame.unionByName, part) for part in zip(*each))
    # Only vectors with copies need their node looked up; any other is its own.
    members = stored(good.join(repeated, "embedding").select("vec_id", "node", "copies"), "ego-copies")
    ties = members.where("vec_id != node").select(F.col("vec_id").alias("u"), F.col("node").alias("v")).distinct()
    labels = connected(found.where("u != v").select("u", "v").unionByName(ties), "ego-links")
    counts = found.groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n"))
    nodes = members.select("vec_id", "node", "copies").distinct()
    of_copies = nodes.join(counts, "node", "left").select("vec_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"))
    of_others = counts.join(nodes, counts["node"] == nodes["vec_id"], "left_anti").select(F.col("node").alias("vec_id"), "n")
    direct = of_copies.unionByName(of_others).groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    return (
        everyone.join(direct, "vec_id", "left")
        .join(labels.withColumnRenamed("node", "vec_id"), "vec_id", "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component", "vec_id").alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op9: links and components of all `embeddings`."""
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0
), l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), r AS (
  SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x
), c AS (SELECT x AS vec_id, min(y) AS component_id FROM r GROUP BY x),
n AS (SELECT x AS vec_id, count(*) AS n_links FROM l GROUP BY x)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(component_id, vec_id) AS component_id,
  coalesce(vec_id = component_id, vec_id IS NOT NULL) AS kept
FROM (SELECT vec_id FROM embeddings) LEFT JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""
