"""Nearest passages by blocks of like vectors, in order of the most they can reach.

Vectors are dealt to the nearest of some centres, which a bounded sample gives, and a centre's vectors are cut
into blocks, which are written to files.  A block's ball, its mean and the largest distance to it, bounds its
product with a seed s: s·x <= s·mean + |s| radius.  A block of seeds takes the blocks in the order of their bounds and stops at
the first whose bound no seed's k-th best falls short of; within a block only the seeds that it can serve are multiplied.  The
bound holds for any vectors, so the picks are those of all pairs.  How much it leaves out depends on the vectors: little
where they have no clusters.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.operators.blocked import in_files, read_block, whole
from strandweave.shared import stored

BLOCK_ROWS, SEED_ROWS, HELD_BLOCKS = 1024, 256, 8
#: Centres, the sample they come from, and what all centres or all balls may hold in bytes, on the driver and in each task.
CENTRES, SAMPLE_ROWS, STEPS, BALL_BYTES = 4096, 20_000, 6, 32 << 20
SLACK = 1e-9


def _centres(vectors: DataFrame, n: int) -> np.ndarray:
    """Centres of at most SAMPLE_ROWS vectors, chosen by the hash of their ids, by a few rounds of k-means in one task."""

    def fit(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.stack(p.column("vec").to_numpy(zero_copy_only=False)) for p in parts if p.num_rows]
        if not held:
            return
        m = np.concatenate(held)
        count = max(1, min(n, len(m) // 4, BALL_BYTES // (8 * m.shape[1])))
        c = m[np.random.default_rng(1).choice(len(m), count, replace=False)]
        for _ in range(STEPS):
            near = np.argmax(m @ c.T - (c * c).sum(axis=1) / 2, axis=1)
            sums, size = np.zeros_like(c), np.bincount(near, minlength=count)
            np.add.at(sums, near, m)
            c = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], c)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.list_(pa.float64()))], names=["vec"])

    sample = vectors.select("id", "vec").orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).select("vec")
    rows = sample.coalesce(1).mapInArrow(fit, "vec array<double>").collect()
    return np.array([r["vec"] for r in rows])


def _dealt(vectors: DataFrame, centres: np.ndarray, rows_each: int, side: str) -> tuple[DataFrame, int]:
    """Places of blocks of at most about `rows_each` vectors of one centre, and the number of vectors."""
    half = (centres * centres).sum(axis=1) / 2

    def near(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if part.num_rows:
                m = np.stack(part.column("vec").to_numpy(zero_copy_only=False))
                at = np.argmax(m @ centres.T - half, axis=1)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("vec"), pa.array(at, pa.int64())], names=["id", "vec", "centre"])

    placed = stored(vectors.select("id", "vec").mapInArrow(near, "id long, vec array<double>, centre long"), "centred")
    size = {r["centre"]: r["count"] for r in placed.groupBy("centre").count().collect()}
    cuts = np.array([-(-size.get(c, 0) // rows_each) for c in range(len(centres))], np.int64)
    firsts = np.concatenate([[0], np.cumsum(cuts)[:-1]])
    of = lambda values: F.element_at(F.lit(values.tolist()), (F.col("centre") + 1).cast("int"))
    block = of(firsts) + F.pmod(F.xxhash64("id"), F.greatest(of(cuts), F.lit(1)))
    return in_files(placed.withColumn("block", block).select("id", "vec", "block"), side, max(1, int(cuts.sum())), F.col("block")), sum(size.values())


def nearest(seeds: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """seed_id, id, similarity, pos, multiplied: each seed's `k` nearest passages (ties to the smaller id), itself left out.

    `multiplied` is the number of passages that the seed was multiplied with.  Rows without a whole vector take no part.
    """
    spark = seeds.sparkSession
    seeds, chunks = whole(seeds.select("id", "vec")), whole(chunks.select("id", "vec"))
    schema = "seed_id long, id long, similarity double, pos int, multiplied long"
    n = chunks.count()
    centres = _centres(chunks, max(1, min(CENTRES, n // BLOCK_ROWS)))
    if not len(centres):
        return spark.createDataFrame([], schema)
    # Blocks grow with the passages beyond what all balls may hold.
    rows_each = max(BLOCK_ROWS, -(-n * 8 * (centres.shape[1] + 2) // BALL_BYTES))
    places, _ = _dealt(chunks, centres, rows_each, "c")

    def ball(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for r in part.to_pylist():
                m = read_block(r["c_path"], r["c_at"], r["c_size"])["vec"]
                mean = m.mean(axis=0)
                radius = float(np.sqrt(((m - mean) ** 2).sum(axis=1).max()))
                yield pa.RecordBatch.from_pylist([r | {"mean": mean.tolist(), "radius": radius}], schema=pa.schema([("c_path", pa.string()), ("c_at", pa.int64()), ("c_size", pa.int64()), ("mean", pa.list_(pa.float64())), ("radius", pa.float64())]))

    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    balls = places.select("c_path", "c_at", "c_size").repartition(tasks).mapInArrow(ball, "c_path string, c_at long, c_size long, mean array<double>, radius double").collect()
    if not balls:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(([(b["c_path"], b["c_at"], b["c_size"]) for b in balls], np.array([b["mean"] for b in balls]), np.array([b["radius"] for b in balls])))

    def search(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, means, radii = shared.value
        read: OrderedDict[int, dict] = OrderedDict()

        def block(j: int) -> dict:
            if j not in read:
                while len(read) >= HELD_BLOCKS:
                    read.popitem(last=False)
                read[j] = read_block(*where[j])
            read.move_to_end(j)
            return read[j]

        for part in parts:
            for r in part.to_pylist():
                s = read_block(r["s_path"], r["s_at"], r["s_size"])
                ids, vec = s["id"], s["vec"]
                length = np.sqrt((vec * vec).sum(axis=1))
                bound = vec @ means.T + length[:, None] * radii + SLACK * (1 + length[:, None])
                best = np.full((len(ids), k), -np.inf)
                found = np.full((len(ids), k), np.iinfo(np.int64).max)
                tried = np.zeros(len(ids), np.int64)
                for j in np.argsort(-bound.max(axis=0), kind="stable"):
                    open_ = np.flatnonzero(bound[:, j] >= best[:, -1])
                    if not len(open_):
                        # Later blocks reach less at most, but perhaps more for a seed whose own bound is lower here.
                        if bound[:, j].max() < best[:, -1].min():
                            break
                        continue
                    c = block(int(j))
                    sims = vec[open_] @ c["vec"].T
                    tried[open_] += len(c["id"])
                    sims[ids[open_][:, None] == c["id"][None, :]] = -np.inf
                    every = np.concatenate([best[open_], sims], axis=1)
                    names = np.concatenate([found[open_], np.broadcast_to(c["id"], sims.shape)], axis=1)
                    order = np.lexsort((names, -every), axis=1)[:, :k]
                    best[open_], found[open_] = np.take_along_axis(every, order, 1), np.take_along_axis(names, order, 1)
                row, place = np.nonzero(np.isfinite(best))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[row]), pa.array(found[row, place]), pa.array(best[row, place]), pa.array(place.astype(np.int32) + 1), pa.array(tried[row])],
                    names=["seed_id", "id", "similarity", "pos", "multiplied"],
                )

    asked, _ = _dealt(seeds, centres, SEED_ROWS, "s")
    # One block of seeds is one piece of work: they are dealt out one by one, whatever their bytes.
    return asked.select("s_path", "s_at", "s_size").repartition(max(tasks, 1)).mapInArrow(search, schema)
