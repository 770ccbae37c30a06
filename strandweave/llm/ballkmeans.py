"""Centroid clustering of whole-number vectors by ball k-means.

A cluster is a ball: its centroid and the largest distance of a member to it.  Another centroid is
a neighbour of the ball if half its distance from the ball's own centroid is within that radius;
no member of the ball can be nearer to any other.  Members nearer to their centroid than half
the way to the nearest neighbour are the stable core and stay.  The rest lie in annuli between the
half distances to the neighbours, nearest first; those of an annulus are compared, exactly, only with
the neighbours whose half distance they have passed.  The balls are those of a block's members,
which are smaller than those of the whole table, so that they have fewer neighbours.

Vectors are written to files once, in blocks; a round's table holds a block's place, its clusters and
the sums of its members, and is written, so that a lost executor loses none.  Only the centroids come
to the driver.  Components are floor(`scale` * x), whole numbers; distances and means are exact,
whatever the components' size.

Out are null ids and vectors, vectors of another dimension and those with null or non-finite
components.  Repeated rows take part as often as they stand there.  Ties in distance go to the
smaller cluster number, equal starting places to the smaller vector.  With fewer vectors than
clusters each starts one.  An empty table gives no rows.  A sum or distance over the largest long is given as that.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm.common import batches, read_table, shared_folder, stored
from strandweave.llm.vectors import BlockWriter, matrix, read_block, rows_of

DIM, SCALE, CLUSTERS, ROUNDS = 64, 64, 16, 3
BLOCK_ROWS = 4096
#: Sums of squares of differences of smaller numbers are exact in double precision, in any order.
SMALL = 1 << 21
LONGEST = (1 << 63) - 1


def kept(vectors: DataFrame, dim: int = DIM) -> DataFrame:
    """(vec_id, embedding as array<double>) of the rows that take part."""
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return v.where(F.col("vec_id").isNotNull() & (F.size("embedding") == dim) & F.forall("embedding", finite))


def cells(m: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x): doubles that are whole numbers while they are SMALL, else Python's integers."""
    if not m.size or np.abs(m).max() < SMALL // scale:
        return np.floor(m * scale)
    whole = [[scale * int(x) if math.isinf(scale * x) else math.floor(scale * x) for x in row] for row in m.tolist()]
    return np.array(whole, object).reshape(m.shape)


def squared(members: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Exact squared distances of the members to one centroid."""
    if members.dtype == object or np.abs(centroid).max() >= SMALL:
        gap = members.astype(object) - centroid.astype(object)
        return np.array([int(x) for x in (gap * gap).sum(axis=1)], object)
    gap = members - centroid
    return np.einsum("ij,ij->i", gap, gap)


def nearest(members: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each member's cluster and squared distance by comparing it with every centroid."""
    best = squared(members, centroids[0])
    at = np.zeros(len(members), np.int32)
    for j in range(1, len(centroids)):
        found = squared(members, centroids[j])
        nearer = (found < best).astype(bool)
        best[nearer], at[nearer] = found[nearer], j
    return at, best


def reassigned(members: np.ndarray, centroids: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """As `nearest`, from the members' former clusters, by balls; and the number of distances taken."""
    at, best = before.copy(), np.zeros(len(members), squared(members[:1], centroids[0]).dtype)
    between = np.array([squared(centroids, c) for c in centroids])
    taken = 0
    for own in np.unique(before).tolist():
        rows = np.flatnonzero(before == own)
        ball = members[rows]
        inner = squared(ball, centroids[own])
        taken += len(rows)
        radius = inner.max()
        # In squares: half the distance of the centroids is within the radius.
        neighbours = [j for j in range(len(centroids)) if j != own and between[own][j] <= 4 * radius]
        neighbours.sort(key=lambda j: (between[own][j], j))
        cluster, least = np.full(len(rows), own, np.int32), inner.copy()
        out = np.arange(len(rows))
        for j in neighbours:
            # What isn't past this half distance isn't past the later ones: it leaves with its annulus.
            out = out[(4 * inner[out] >= between[own][j]).astype(bool)]
            found = squared(ball[out], centroids[j])
            taken += len(out)
            nearer = ((found < least[out]) | ((found == least[out]) & (j < cluster[out]))).astype(bool)
            cluster[out[nearer]], least[out[nearer]] = j, found[nearer]
        at[rows], best[rows] = cluster, least
    return at, best, taken


def _blocks(kept_rows: DataFrame, dim: int, folder: str) -> DataFrame:
    most = rows_of(BLOCK_ROWS, dim)

    def written(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, ids, held, places = BlockWriter(folder), [], [], []

        def close() -> None:
            if held:
                path, at = writer.add(np.concatenate(ids).astype("<i8"), np.concatenate(held).astype("<f8"))
                places.append((path, at, sum(map(len, held))))
                ids.clear()
                held.clear()

        for part in parts:
            m, v = matrix(part.column("embedding"), dim), part.column("vec_id").to_numpy()
            while len(m):
                room = most - sum(map(len, held))
                ids.append(v[:room])
                held.append(m[:room])
                m, v = m[room:], v[room:]
                if sum(map(len, held)) == most:
                    close()
        close()
        writer.close()
        yield from batches({"path": ([p[0] for p in places], pa.string()), "at": ([p[1] for p in places], pa.int64()), "rows": ([p[2] for p in places], pa.int64())})

    return kept_rows.mapInArrow(written, "path string, at long, rows long")


def _read(part: pa.RecordBatch, dim: int, scale: int) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
    for place in zip(*(part.column(c).to_pylist() for c in ("path", "at", "rows"))):
        path, at, n = place
        ids, m = read_block(path, at, ("<i8", (n,)), ("<f8", (n, dim)))
        yield place, ids, cells(m, scale)


_ROUND = "path string, at long, rows long, clusters binary, taken long, sums array<struct<cluster:int,n:long,inertia:string,total:string>>"


def _assign(blocks: DataFrame, centroids: np.ndarray, dim: int, scale: int) -> DataFrame:
    """A round's table: each block's clusters, and for each of them its number, summed distances and components."""

    def assign(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            former = part.column("clusters").to_pylist() if "clusters" in part.schema.names else [None] * part.num_rows
            for (place, _, members), before in zip(_read(part, dim, scale), former):
                if before is None:
                    at, best = nearest(members, centroids)
                    taken = len(members) * len(centroids)
                else:
                    at, best, taken = reassigned(members, centroids, np.frombuffer(before, "<i4"))
                sums = []
                for k in np.unique(at).tolist():
                    own = at == k
                    # In Python's integers: sums of many blocks may pass what doubles hold.
                    sums.append({"cluster": k, "n": int(own.sum()), "inertia": str(sum(map(int, best[own]))), "total": ",".join(str(int(x)) for x in members[own].sum(axis=0))})
                yield pa.RecordBatch.from_pylist(
                    [{"path": place[0], "at": place[1], "rows": place[2], "clusters": at.astype("<i4").tobytes(), "taken": taken, "sums": sums}],
                    schema=pa.schema([("path", pa.string()), ("at", pa.int64()), ("rows", pa.int64()), ("clusters", pa.binary()), ("taken", pa.int64()),
                                      ("sums", pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("inertia", pa.string()), ("total", pa.string())])))]),
                )

    return blocks.mapInArrow(assign, _ROUND)


_SUMS = "cluster int, n long, inertia string, total string"


def _added(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of a cluster's rows in these batches: one row a cluster."""
    held: dict[int, list] = {}
    for part in parts:
        for k, n, inertia, total in zip(*(part.column(c).to_pylist() for c in ("cluster", "n", "inertia", "total"))):
            own = held.setdefault(k, [0, 0, None])
            numbers = [int(x) for x in total.split(",")]
            held[k] = [own[0] + n, own[1] + int(inertia), numbers if own[2] is None else [a + b for a, b in zip(own[2], numbers)]]
    if held:
        ks = list(held)
        yield from batches(
            {
                "cluster": (ks, pa.int32()), "n": ([held[k][0] for k in ks], pa.int64()),
                "inertia": ([str(held[k][1]) for k in ks], pa.string()), "total": ([",".join(map(str, held[k][2])) for k in ks], pa.string()),
            }
        )


def _summed(table: DataFrame) -> dict[int, tuple[int, int, list[int]]]:
    """Cluster to (members, summed distances, summed components).

    A task adds up its blocks' sums before they meet by cluster: a row a task and cluster is shuffled, a row a cluster comes to the driver.
    """
    own = table.select(F.inline("sums")).mapInArrow(_added, _SUMS)
    met = own.repartition(F.col("cluster")).mapInArrow(_added, _SUMS)
    return {r["cluster"]: (r["n"], int(r["inertia"]), [int(x) for x in r["total"].split(",")]) for r in met.collect()}


def _as_cells(rows: list[list[int]]) -> np.ndarray:
    small = all(abs(x) < SMALL for row in rows for x in row)
    return np.array(rows, np.float64 if small else object).reshape(len(rows), -1)


def starting(kept_rows: DataFrame, clusters: int, scale: int, seed: str = "1") -> np.ndarray:
    """The `clusters` vectors of smallest sha256 of `seed:vec_id`: a bounded number, found by a top-k."""
    chosen = kept_rows.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256), "embedding").limit(clusters).collect()
    return _as_cells([[int(x) for x in row] for row in cells(np.array([r["embedding"] for r in chosen]), scale)]) if chosen else np.zeros((0, 0))


def clustered(vectors: DataFrame, dim: int = DIM, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, cluster_size, n_compared for columns vec_id, embedding.

    n_compared is the number of distances that the member's block took in the last assignment, a measure of what the balls saved.
    """
    spark = vectors.sparkSession
    rows = kept(vectors, dim)
    centroids = starting(rows, clusters, scale)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, cluster_size long, n_compared long"
    if not len(centroids):
        return spark.createDataFrame([], schema)
    table = stored(_blocks(rows, dim, shared_folder(spark, "ball-blocks")), "ball-places")
    for turn in range(rounds + 1):
        table = stored(_assign(table, centroids, dim, scale), f"ball-round-{turn}")
        sums = _summed(table)
        if turn < rounds:
            now = [[int(x) for x in c] for c in centroids]
            for k, (n, _, total) in sums.items():
                now[k] = [x // n for x in total]
            centroids = _as_cells(now)
    digests = [hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest() for c in centroids]
    inertia = {k: min(LONGEST, s[1]) for k, s in sums.items()}
    whole = min(LONGEST, sum(s[1] for s in sums.values()))
    size = {k: s[0] for k, s in sums.items()}

    def rows_out(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for (_, ids, members), at, taken in zip(_read(part, dim, scale), part.column("clusters").to_pylist(), part.column("taken").to_pylist()):
                own = np.frombuffer(at, "<i4")
                distance = np.zeros(len(own), np.int64)
                for k in np.unique(own).tolist():
                    distance[own == k] = [min(LONGEST, int(x)) for x in squared(members[own == k], centroids[k])]
                yield from batches(
                    {
                        "vec_id": (ids, pa.int64()), "cluster": (own, pa.int32()), "distance": (distance, pa.int64()),
                        "cluster_inertia": ([inertia[k] for k in own.tolist()], pa.int64()), "inertia": ([whole] * len(own), pa.int64()),
                        "centroid_sha256": ([digests[k] for k in own.tolist()], pa.string()), "cluster_size": ([size[k] for k in own.tolist()], pa.int64()),
                        "n_compared": ([taken] * len(own), pa.int64()),
                    }
                )

    return table.select("path", "at", "rows", "clusters", "taken").mapInArrow(rows_out, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op13: the clusters of all `embeddings`."""
    return clustered(read_table(spark, sf_dir, "embeddings")).drop("cluster_size", "n_compared")


def _oracle() -> str:
    near = "SELECT vec_id, k AS cluster, d AS distance, x FROM (SELECT v.vec_id, v.x, c.k, list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))::BIGINT AS d, row_number() OVER (PARTITION BY v.row ORDER BY d, c.k) AS place FROM v CROSS JOIN {c} c) WHERE place = 1"
    parts = [
        """v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda y: floor(64 * y::DOUBLE)::BIGINT) AS x FROM embeddings
 WHERE vec_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda y: y IS NOT NULL AND isfinite(y))) = 64)""",
        "c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR), x) - 1 AS k, x FROM v QUALIFY k < 16)",
    ]
    for t in range(ROUNDS):
        parts += [
            f"a{t} AS ({near.format(c=f'c{t}')})",
            f"m{t} AS (SELECT cluster, i, sum(x[i])::HUGEINT AS s, count(*) AS n FROM a{t} CROSS JOIN range(1, 65) r(i) GROUP BY cluster, i)",
            f"""n{t} AS (SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS x FROM m{t} GROUP BY cluster)""",
            f"c{t + 1} AS (SELECT c{t}.k, coalesce(n{t}.x, c{t}.x) AS x FROM c{t} LEFT JOIN n{t} ON n{t}.cluster = c{t}.k)",
        ]
    return f"""WITH {", ".join(parts)}, last AS ({near.format(c=f'c{ROUNDS}')})
SELECT vec_id, cluster::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
 (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c{ROUNDS}.x, ',')) AS centroid_sha256
FROM last JOIN c{ROUNDS} ON c{ROUNDS}.k = last.cluster"""


#: Cross joins here are DuckDB's way to compare a few hundred vectors with 16 centroids.
ORACLE_SQL = _oracle()
