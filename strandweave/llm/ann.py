"""Approximate nearest neighbours by cosine, through low-dimensional stable projections.

Unit vectors are projected with a Gaussian (2-stable) matrix: a squared projected distance over
the squared true one is chi-square with `dims` degrees of freedom.  The projections are indexed
by a kd-tree: its top, fitted on a bounded sample, deals all rows to cells; each shard of a cell
has a tree of its own, written once to a file that searches read.  A search takes leaves by growing projected distance and verifies their vectors
until the chi-square test says that a nearer one than the k-th found would, with probability
`confidence`, have been met.

A first round searches each query's own cell.  Its k-th distance bounds which other cells the
second round visits, and stops searches in them early.  Only queries travel, with the places of the
trees they search; a shard holds at most about SHARD_ROWS vectors, however many fall in one cell.

Rows out of `usable` take no part; vectors are compared with those of their own dimension.  A query's own row is any with its vec_id; a repeated query id
counts once, by its least vector; every other repeated row is a candidate as often as it comes.
An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandweave.llm.common import batches, read_table, shared_folder, stored
from strandweave.llm.vectors import BlockWriter, cosines, matrix, of_dimension, read_block, rows_of, unit, usable

DIMS, CONFIDENCE, SEED = 8, 0.98, 7
CELL_ROWS, SHARD_ROWS, LEAF_ROWS, QUERY_ROWS = 16_384, 16_384, 64, 512
#: Cells grow with the rows up to this many; each gets so many rows of the sample (projections of `dims` doubles).
MAX_CELLS, SAMPLE_CELL, MAX_TASKS = 16_384, 32, 32_768
SLACK = 1e-9


def chi_square_tail(x: float, dims: int) -> float:
    """P(chi-square with `dims` degrees > x)."""
    half = x / 2
    if dims % 2:
        total, term, i = math.erfc(math.sqrt(half)), math.exp(-half) * math.sqrt(half) / math.gamma(1.5), 1.5
    else:
        total, term, i = math.exp(-half), math.exp(-half) * half, 1.0
    while i < dims / 2:
        total += term
        i += 1
        term *= half / i
    return total


def chi_square_quantile(p: float, dims: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_tail(mid, dims) > 1 - p else (low, mid)
    return high


def kd_split(points: np.ndarray, leaves: int) -> list[tuple[int, float]]:
    """Splits (axis, value) of a complete kd-tree in heap order; `leaves` is a power of two."""
    splits: list[tuple[int, float]] = []
    level = [np.arange(len(points))]
    while len(level) < leaves:
        below = []
        for rows in level:
            at = points[rows]
            axis = int(np.argmax(np.ptp(at, axis=0))) if len(rows) else 0
            value = float(np.median(at[:, axis])) if len(rows) else 0.0
            splits.append((axis, value))
            low = at[:, axis] < value
            below += [rows[low], rows[~low]]
        level = below
    return splits


def kd_cell(points: np.ndarray, splits: list[tuple[int, float]]) -> np.ndarray:
    """The leaf of each point."""
    node = np.zeros(len(points), np.int64)
    if splits:
        axes, values = np.array([s[0] for s in splits]), np.array([s[1] for s in splits])
        for _ in range((len(splits) + 1).bit_length() - 1):
            right = points[np.arange(len(points)), axes[node]] >= values[node]
            node = 2 * node + 1 + right
    return node - len(splits)


def kd_leaves(points: np.ndarray, leaf_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(row order, leaf starts with the end) of a kd-tree cut at medians."""
    order, starts = [], [0]
    todo = [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        if len(rows) <= leaf_rows:
            order.append(rows)
            starts.append(starts[-1] + len(rows))
            continue
        at = points[rows]
        axis = int(np.argmax(np.ptp(at, axis=0)))
        half = len(rows) // 2
        cut = np.argpartition(at[:, axis], half)
        todo += [rows[cut[half:]], rows[cut[:half]]]
    return np.concatenate(order), np.array(starts)


class Shard:
    """Vectors in the order of the kd-tree of their projections, with its leaves' starts and boxes."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, starts: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.ids, self.vectors, self.starts, self.low, self.high = ids, vectors, starts, low, high
        self.units = unit(vectors).astype(np.float32)

    def search(self, query_id: int, vector: np.ndarray, point: np.ndarray, k: int, quantile: float, bound: float):
        """(ids, scores) of the k nearest verified, with all ties of the last."""
        near = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        far = (near * near).sum(axis=1)
        leaves = np.argsort(far, kind="stable")
        far = far[leaves]
        direction = unit(vector[None])[0].astype(np.float32)
        doubt = (len(vector) + 8) * 2.0**-23  # of single precision; scores are exact below
        rows, found = np.zeros(0, np.int64), np.zeros(0, np.float32)
        at, step, worst = 0, 4, bound
        # Not at equality: at distance zero, equal vectors are ties to be seen.
        while at < len(leaves) and not far[at] > quantile * worst + SLACK:
            take = leaves[at : at + step]
            more = np.concatenate([np.arange(self.starts[x], self.starts[x + 1]) for x in take])
            more = more[self.ids[more] != query_id]
            rows, found = np.append(rows, more), np.append(found, self.units[more] @ direction)
            if len(found) > k:
                last = np.partition(found, len(found) - k)[len(found) - k]
                kept = found >= last - 2 * doubt
                rows, found = rows[kept], found[kept]
                worst = min(bound, max(0.0, 2 - 2 * float(last)))
            at += step
            step = min(2 * step, 64)
        scores = cosines(self.vectors[rows], np.broadcast_to(vector, (len(rows), len(vector))))
        best = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows][best], scores[best]


INDEX = "shard long, path string, at long, rows long, leaves long"


def _indexer(dim: int, projection: np.ndarray, most: int, folder: str):
    """Rows sorted by shard to its tree, written to a file; of over `most` rows several trees.  A row tells where each stands."""

    def index(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, made = BlockWriter(folder), []
        held: list[tuple[np.ndarray, np.ndarray]] = []
        held_shard, n = None, 0

        def out() -> None:
            ids, vectors = (np.concatenate(c) for c in zip(*held))
            points = unit(vectors) @ projection
            order, starts = kd_leaves(points, LEAF_ROWS)
            points = points[order]
            low, high = np.minimum.reduceat(points, starts[:-1]), np.maximum.reduceat(points, starts[:-1])
            place = writer.add(ids[order].astype("<i8"), vectors[order].astype("<f8"), starts.astype("<i8"), low.astype("<f8"), high.astype("<f8"))
            made.append((held_shard, *place, len(ids), len(low)))

        for part in parts:
            shards, ids, vectors = part.column("shard").to_numpy(), part.column("vec_id").to_numpy(), matrix(part.column("embedding"), dim)
            cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
            for a, b in zip(cuts, cuts[1:]):
                while a < b:
                    if held and (held_shard != shards[a] or n >= most):
                        out()
                        held, n = [], 0
                    upto = min(b, a + most - n)
                    held.append((ids[a:upto], vectors[a:upto]))
                    held_shard, n, a = int(shards[a]), n + upto - a, upto
        if held:
            out()
        writer.close()
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        names = ("shard", "path", "at", "rows", "leaves")
        yield from batches({k: ([m[i] for m in made], t) for i, (k, t) in enumerate(zip(names, kinds))})

    return index


FOUND = "query_id long, vec_id long, score double"


def _searcher(dim: int, projection: np.ndarray, k: int, quantile: float):
    """Queries with the places of the trees to search, sorted by place, to FOUND; each tree is read once a run."""

    def search(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_hand, shard = None, None
        for part in parts:
            q_ids, bounds, vectors = part.column("vec_id").to_numpy(), part.column("bound").to_numpy(), matrix(part.column("embedding"), dim)
            points = unit(vectors) @ projection
            places = list(zip(*(part.column(c).to_pylist() for c in ("path", "at", "rows", "leaves"))))
            got = []
            for place, q, v, p, bound in zip(places, q_ids.tolist(), vectors, points, bounds.tolist()):
                if place != at_hand:
                    path, at, n, leaves = at_hand = place
                    boxes = ("<f8", (leaves, projection.shape[1]))
                    shard = Shard(*read_block(path, at, ("<i8", (n,)), ("<f8", (n, dim)), ("<i8", (leaves + 1,)), boxes, boxes))
                got.append(shard.search(q, v, p, k, quantile, bound))
            if got:
                yield from batches(
                    {
                        "query_id": (np.repeat(q_ids, [len(g[0]) for g in got]), pa.int64()),
                        "vec_id": (np.concatenate([g[0] for g in got]), pa.int64()),
                        "score": (np.concatenate([g[1] for g in got]), pa.float64()),
                    }
                )

    return search


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 5, dims: int = DIMS, confidence: float = CONFIDENCE, seed: int = SEED
) -> DataFrame:
    """query_id, rank, vec_id, score for each of `queries` among `vectors` (columns vec_id, embedding)."""
    good, sizes = usable(vectors)
    asked = queries.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    asked = asked.join(good.select("vec_id").distinct(), "vec_id", "left_semi")
    if not sizes:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = reduce(DataFrame.unionByName, (_nearest(of_dimension(good, d), of_dimension(asked, d), d, k, dims, confidence, seed) for d in sizes))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _nearest(good: DataFrame, asked: DataFrame, dim: int, k: int, dims: int, confidence: float, seed: int) -> DataFrame:
    """FOUND, with more than the nearest, of vectors and queries of one dimension."""
    spark = good.sparkSession
    asked = asked.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    quantile = chi_square_quantile(confidence, dims)
    projection = np.random.default_rng(seed).standard_normal((dim, dims))
    shard_rows = rows_of(SHARD_ROWS, dim)

    def projected(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            points = unit(matrix(part.column("embedding"), dim)) @ projection
            yield pa.RecordBatch.from_arrays([pa.array(list(points), pa.list_(pa.float64()))], names=["point"])

    # The sample grows with the cells up to a fixed bound, and holds projections only.
    total = good.count()
    cells = min(MAX_CELLS, 1 << max(0, math.ceil(math.log2(max(1, total / rows_of(CELL_ROWS, dim))))))
    wanted = SAMPLE_CELL * cells
    share = F.lit(1 << 30) if total <= wanted else F.lit(math.ceil((1 << 30) * wanted / total))
    drawn = good.where(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(1 << 30)) < share).limit(2 * wanted)
    sample = drawn.select("embedding").mapInArrow(projected, "point array<double>").toArrow()
    splits = kd_split(matrix(sample.column("point").combine_chunks(), dims), cells)

    def place(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            points = unit(matrix(part.column("embedding"), dim)) @ projection
            cell = kd_cell(points, splits)
            yield pa.RecordBatch.from_arrays(
                [part.column("vec_id"), part.column("embedding"), pa.array(cell), pa.array(list(points), pa.list_(pa.float64()))],
                names=["vec_id", "embedding", "cell", "point"],
            )

    placed = stored(good.mapInArrow(place, "vec_id long, embedding array<double>, cell long, point array<double>"), "ann-cells")
    # One row a cell, and at most MAX_CELLS cells.
    boxes = placed.groupBy("cell").agg(
        F.count("*").alias("n"),
        *(F.min(F.col("point")[i]).alias(f"low{i}") for i in range(dims)),
        *(F.max(F.col("point")[i]).alias(f"high{i}") for i in range(dims)),
    ).orderBy("cell").collect()
    counts = np.array([-(-b["n"] // shard_rows) for b in boxes])
    starts = np.cumsum(counts) - counts
    shards = int(counts.sum())
    first_shard, n_shards = np.full(cells, -1), np.zeros(cells, np.int64)
    known = np.array([b["cell"] for b in boxes])
    first_shard[known], n_shards[known] = starts, counts
    low = np.array([[b[f"low{i}"] for i in range(dims)] for b in boxes])
    high = np.array([[b[f"high{i}"] for i in range(dims)] for b in boxes])

    def dealt(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            cell, mixed = part.column("cell").to_numpy(), part.column("mixed").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(first_shard[cell] + mixed % n_shards[cell]), part.column("vec_id"), part.column("embedding")], names=["shard", "vec_id", "embedding"]
            )

    mixed = F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(1 << 40)).alias("mixed")
    index = stored(
        placed.select("cell", mixed, "vec_id", "embedding").mapInArrow(dealt, "shard long, vec_id long, embedding array<double>")
        .repartition(max(1, shards), "shard").sortWithinPartitions("shard", "vec_id")
        .mapInArrow(_indexer(dim, projection, 2 * shard_rows, shared_folder(spark, "ann-trees")), INDEX),
        "ann-index",
    )
    salts = 1 + asked.count() // QUERY_ROWS
    # A fixed count: queries are too few bytes for AQE to see the work behind them.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MAX_TASKS, shards * salts))

    def rounds(rows: DataFrame) -> DataFrame:
        """Searches shard, vec_id, embedding, bound rows: only queries and places travel, and a tree's many queries go to several tasks."""
        salt = F.pmod(F.xxhash64("vec_id"), F.lit(salts))
        return (
            rows.join(index, "shard")
            .repartition(tasks, "path", "at", salt)
            .sortWithinPartitions("path", "at", "vec_id")
            .select("vec_id", "embedding", "bound", "path", "at", "rows", "leaves")
            .mapInArrow(_searcher(dim, projection, k, quantile), FOUND)
        )

    def homes(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            cell = kd_cell(unit(matrix(part.column("embedding"), dim)) @ projection, splits)
            # A query may fall in a cell that holds no row only if it is no row itself.
            home = pa.array(first_shard[cell], mask=first_shard[cell] < 0)
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("embedding"), home], names=["vec_id", "embedding", "home"])

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    own = asked.mapInArrow(homes, "vec_id long, embedding array<double>, home long")
    far = F.lit(4.0)  # the squared distance of opposite unit vectors
    one = rounds(own.where("home is not null").select(F.col("home").alias("shard"), "vec_id", "embedding", far.alias("bound")))
    one = one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    one = stored(one.select("query_id", "vec_id", "score", "rank"), "ann-first")
    bounds = one.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), (2 - 2 * F.col("score")).alias("bound"))
    asked_again = own.join(bounds, "vec_id", "left").withColumn("bound", F.coalesce("bound", far))

    def spread(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            points = unit(matrix(part.column("embedding"), dim)) @ projection
            bound, home = part.column("bound").to_numpy(), part.column("home").to_pylist()
            rows, to = [], []
            for i, p in enumerate(points):
                near = np.maximum(np.maximum(low - p, p - high), 0)
                for c in np.flatnonzero((near * near).sum(axis=1) <= quantile * bound[i] + SLACK).tolist():
                    more = [s for s in range(starts[c], starts[c] + counts[c]) if s != home[i]]
                    rows += [i] * len(more)
                    to += more
            taken = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(to, pa.int64()), *(part.column(c).take(taken) for c in ("vec_id", "embedding", "bound"))],
                names=["shard", "vec_id", "embedding", "bound"],
            )

    two = rounds(asked_again.select("vec_id", "embedding", "home", "bound").mapInArrow(spread, "shard long, vec_id long, embedding array<double>, bound double"))
    return one.select("query_id", "vec_id", "score").unionByName(two)


def query(spark, sf_dir: str) -> DataFrame:
    """op4: the 5 nearest of every vector whose id is divisible by 50."""
    vectors = read_table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0))
