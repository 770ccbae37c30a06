"""Near-duplicates by word shingles: two texts link if the Jaccard similarity of their sets of
five-word shingles is at least 0.8.

Candidates come from two sources, and whole sets of shingles (as 64-bit hashes) decide: SimHash
fingerprints of the sets, linked by pigeonring as in `simhash`, and MinHash bands, as 64 bits are too
few for this similarity (texts at 0.8 differ in about 10 of them).  A pair at exactly 0.8 shares none
of the 40 bands of 5 values with a chance of 1.3e-7, and a nearer pair with less.

Texts of equal sets are one node.  In each bucket every node is first compared with the bucket's
hub, the node that shares most buckets with others, so that a large group of near copies costs a link
each.  Then the nodes of a hub are compared with each other, but for those that are both linked to it: they are
sorted by their distance to the hub and written to files in blocks; tasks join pairs of blocks, but
for blocks over 0.2 apart in that distance (Jaccard distance is a metric), and give links, never pairs
that aren't.  A hub with very many nodes is many blocks, and no single task.

Words are white space parts, lower-cased; a text of fewer than five words is one shingle.  Texts
without words, null ones among them, are copies of each other.  Null and repeated doc_ids are taken
as in `simhash`.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm import simhash
from strandweave.llm.common import batches, shared_folder, stored
from strandweave.llm.components import connected, unite
from strandweave.llm.vectors import BlockWriter, read_block

SHINGLE_WORDS, SEED = 5, 42
#: Similarity 0.8 as a fraction, so that the comparison is in whole numbers.
PART, WHOLE = 4, 5
BANDS, BAND_VALUES = 40, 5
AT_ONCE = 512
#: A block of nodes ends at so many, or at so many shingles; products take so many shingles at once.
BLOCK_NODES, BLOCK_SHINGLES, COLUMNS = 512, 1 << 20, 4096
_RNG = np.random.default_rng(SEED)
_TURNS = _RNG.integers(0, 1 << 32, BANDS * BAND_VALUES, np.uint32) | np.uint32(1)
_STARTS = _RNG.integers(0, 1 << 63, BANDS, np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the whole text's shingles."""
    import xxhash

    words = (text or "").lower().split()
    n = min(len(words), SHINGLE_WORDS)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(" ".join(words[i : i + n]), SEED) for i in range(len(words) - n + 1 if n else 0)], np.uint64))


def bands(hashes: np.ndarray) -> np.ndarray:
    """One bucket for each band of MinHash values; none for an empty set."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    low = np.full(len(_TURNS), np.iinfo(np.uint32).max, np.uint32)
    high = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(high), AT_ONCE):
        np.minimum(low, np.multiply.outer(_TURNS, high[at : at + AT_ONCE]).min(axis=1), out=low)
    keys = _STARTS.copy()
    for column in low.reshape(BANDS, BAND_VALUES).T:
        keys = (keys ^ column) * _MIX
        keys ^= keys >> np.uint64(29)
    return keys


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, digest and n (which name the set of shingles), its fingerprint fp, and its bands, of columns doc_id, text."""

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for part in parts:
            sets = [shingles(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"), pa.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], pa.uint64()).view(pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()), pa.array(np.array([simhash.majority([s], len(s)) for s in sets], np.uint64).view(np.int64)),
                    pa.array([bands(s).view(np.int64) for s in sets], pa.list_(pa.int64())),
                ],
                names=["doc_id", "digest", "n", "fp", "bands"],
            )

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, digest long, n long, fp long, bands array<long>")


def _sets(docs: DataFrame) -> DataFrame:
    """doc_id, shingles."""

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sets = pa.array([shingles(t).view(np.int64) for t in part.column("text").to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), sets], names=["doc_id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, shingles array<long>")


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs u, v, spoke with linked and away (their Jaccard distance), by their whole sets."""
    side = lambda c: sets.select(F.col("doc_id").alias(c), F.col("shingles").alias(f"{c}_set"))
    both, total = F.size(F.array_intersect("u_set", "v_set")).alias("both"), (F.size("u_set") + F.size("v_set")).alias("total")
    return (
        pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "spoke", both, total)
        .select("u", "v", "spoke", (F.col("both") * (PART + WHOLE) >= F.col("total") * PART).alias("linked"), (1 - F.col("both") / (F.col("total") - F.col("both"))).alias("away"))
    )


class Nodes(NamedTuple):
    """A block: nodes of some hubs, sorted by hub; the shingles of node i are shingles[starts[i] : starts[i + 1]]."""

    hub: np.ndarray
    node: np.ndarray
    component: np.ndarray
    starts: np.ndarray
    shingles: np.ndarray

    def run(self, hub: int) -> "Nodes":
        low, high = np.searchsorted(self.hub, hub, "left"), np.searchsorted(self.hub, hub, "right")
        starts = self.starts[low : high + 1]
        return Nodes(*(c[low:high] for c in self[:3]), starts - starts[0], self.shingles[starts[0] : starts[-1]])


def overlaps(a: Nodes, b: Nodes) -> np.ndarray:
    """Numbers of common shingles of each node of `a` with each other one of `b`, which may be `a`."""
    out = np.zeros((len(a.node), len(b.node)), np.int64)
    if a is b:
        values, counts = np.unique(a.shingles, return_counts=True)
        common = values[counts > 1]
    else:
        common = np.intersect1d(a.shingles, b.shingles)
    if not len(common):
        return out

    def placed(side: Nodes) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(common, side.shingles), len(common) - 1)
        held = np.flatnonzero(common[at] == side.shingles)
        held = held[np.argsort(at[held], kind="stable")]
        return at[held], (np.searchsorted(side.starts, held, "right") - 1)

    sides = [(placed(side), len(side.node)) for side in ((a,) if a is b else (a, b))]
    for first in range(0, len(common), COLUMNS):
        ones = []
        for (at, owner), n in sides:
            some = slice(*np.searchsorted(at, (first, first + COLUMNS)))
            matrix = np.zeros((n, min(COLUMNS, len(common) - first)), np.float32)
            matrix[owner[some], at[some] - first] = 1
            ones.append(matrix)
        out += (ones[0] @ ones[-1].T).astype(np.int64)
    return out


def links_between(a: Nodes, b: Nodes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(u, v): a spanning forest, for each hub, of the links between nodes of different components; `b` may be `a`.

    Nodes linked to the hub have it as component, any other itself.
    """
    for hub in np.intersect1d(a.hub, b.hub).tolist():
        one = a.run(hub)
        two = one if b is a else b.run(hub)
        if two is one and (one.component == one.component[0]).all():
            continue
        total = np.diff(one.starts)[:, None] + np.diff(two.starts)
        near = overlaps(one, two) * (PART + WHOLE) >= total * PART
        i, j = np.nonzero(near & (one.component[:, None] != two.component))
        node = one.node if two is one else np.concatenate([one.node, two.node])
        parent = np.arange(len(node))
        unite(parent, i, j if two is one else len(one.node) + j)
        linked = np.flatnonzero(parent != np.arange(len(node)))
        if len(linked):
            yield node[parent[linked]], node[linked]


BLOCKS = "path string, at long, rows long, total long"
EDGES = "edges array<struct<hub:long,low:double,high:double,least:long,most:long>>"


def _blocks(folder: str):
    """Rows (hub, node, component, away, shingles), sorted by hub and away, to blocks in files.

    A block's row tells where it stands and, of its first and last hub, the nodes' range of distances and components.
    """

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, made = BlockWriter(folder), []
        held: list[tuple] = []
        size = 0

        def out() -> None:
            hub, node, component = (np.array([h[i] for h in held], "<i8") for i in range(3))
            away = np.array([h[3] for h in held])
            starts = np.cumsum([0, *(len(h[4]) for h in held)]).astype("<i8")
            place = writer.add(hub, node, component, starts, np.concatenate([h[4] for h in held]).astype("<u8"))
            edges = []
            for h in dict.fromkeys((int(hub[0]), int(hub[-1]))):
                of = hub == h
                edges.append({"hub": h, "low": away[of].min(), "high": away[of].max(), "least": component[of].min(), "most": component[of].max()})
            made.append((*place, len(held), int(starts[-1]), edges))

        for part in parts:
            columns = [part.column(c).to_numpy(zero_copy_only=False) for c in ("hub", "node", "component", "away")]
            lists = part.column("shingles")
            values, offsets = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
            for i, row in enumerate(zip(*columns)):
                held.append((*row, values[offsets[i] : offsets[i + 1]].copy()))
                size += len(held[-1][4])
                if len(held) == BLOCK_NODES or size >= BLOCK_SHINGLES:
                    out()
                    held, size = [], 0
        if held:
            out()
        writer.close()
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct({"hub": pa.int64(), "low": pa.float64(), "high": pa.float64(), "least": pa.int64(), "most": pa.int64()})))
        names = ("path", "at", "rows", "total", "edges")
        yield from batches({k: ([m[i] for m in made], t) for i, (k, t) in enumerate(zip(names, kinds))})

    return cut


def _joined(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that name two blocks to the links u, v between their nodes."""

    def block(path: str, at: int, n: int, total: int) -> Nodes:
        return Nodes(*read_block(path, at, ("<i8", (n,)), ("<i8", (n,)), ("<i8", (n,)), ("<i8", (n + 1,)), ("<u8", (total,))))

    for part in parts:
        for row in part.to_pylist():
            a, b = ([row[f"{c}_{s}"] for c in ("path", "at", "rows", "total")] for s in "ab")
            one = block(*a)
            for u, v in links_between(one, one if a == b else block(*b)):
                yield from batches({"u": (u, pa.int64()), "v": (v, pa.int64())})


def _within_hubs(members: DataFrame) -> DataFrame:
    """u, v: links between nodes of a hub and different components (columns hub, node, component, away, shingles)."""
    spark = members.sparkSession
    ordered = members.repartitionByRange("hub", "away", "node").sortWithinPartitions("hub", "away", "node")
    blocks = stored(ordered.mapInArrow(_blocks(shared_folder(spark, "shingle-nodes")), f"{BLOCKS}, {EDGES}"), "shingle-blocks")
    place = ("path", "at", "rows", "total")
    side = lambda s, df: df.select(*(F.col(c).alias(f"{c}_{s}") for c in df.columns))
    edges = blocks.select(*place, F.explode("edges").alias("e")).select(*place, "e.*")
    both = side("a", edges).join(side("b", edges), F.col("hub_a") == F.col("hub_b"))
    later = (F.col("path_a") < F.col("path_b")) | ((F.col("path_a") == F.col("path_b")) & (F.col("at_a") < F.col("at_b")))
    reach = F.greatest(F.col("low_b") - F.col("high_a"), F.col("low_a") - F.col("high_b")) <= 1 - PART / WHOLE + 1e-9
    differ = F.least("least_a", "least_b") < F.greatest("most_a", "most_b")
    names = [f"{c}_{s}" for s in "ab" for c in place]
    across = both.where(later & reach & differ).select(*names).distinct()
    alone = blocks.select(*(F.col(c).alias(f"{c}_{s}") for s in "ab" for c in place))
    work = stored(alone.unionByName(across), "shingle-work")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(32_768, work.count() // 4))
    return work.repartition(tasks, "path_a", "at_a", "path_b", "at_b").mapInArrow(_joined, "u long, v long")


def links(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """u, v of nodes (columns node, n, fp, bands), whose texts are in `docs`: enough links to connect all that are linked."""
    rows = nodes.select("node", F.explode("bands").alias("bucket"))
    held = rows.groupBy("bucket").count().where("count > 1")
    shared = stored(rows.join(held, "bucket"), "shingle-buckets")
    popular = shared.groupBy("node").agg(F.sum("count").alias("weight"))
    hubs = shared.join(popular, "node").groupBy("bucket").agg(F.max(F.struct(F.col("weight"), (-F.col("node")).alias("minus"))).alias("h"))
    spokes = shared.select("bucket", "node").join(hubs.select("bucket", (-F.col("h.minus")).alias("hub")), "bucket").where("hub != node").select("hub", "node").distinct()
    prints = nodes.groupBy("fp").agg(F.min("node").alias("node"))
    alike = prints.withColumnRenamed("node", "u").join(nodes.select("fp", F.col("node").alias("v")), "fp").where("u != v").select("u", "v")
    printed = simhash.links(prints).unionByName(alike)
    pairs = stored(
        spokes.select(F.col("hub").alias("u"), F.col("node").alias("v"), F.lit(True).alias("spoke"))
        .unionByName(printed.select("u", "v", F.lit(False).alias("spoke"))),
        "shingle-spokes",
    )
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct()
    sets = stored(_sets(docs.join(wanted, "doc_id", "left_semi")), "shingle-sets")
    compared = stored(_compared(pairs, sets), "shingle-stars")
    first = compared.where("linked").select("u", "v")
    # Nodes linked to their hub are connected: only the others are left to compare, with each other and with those.
    star = compared.where("spoke").select(F.col("u").alias("hub"), F.col("v").alias("node"), F.when(F.col("linked"), F.col("u")).otherwise(F.col("v")).alias("component"), "away")
    left = star.where("component != hub").groupBy("hub").agg(F.count("*").alias("open"))
    star = star.join(left.select("hub"), "hub", "left_semi")
    members = star.unionByName(left.select("hub", F.col("hub").alias("node"), F.col("hub").alias("component"), F.lit(0.0).alias("away")))
    members = members.join(sets.withColumnRenamed("doc_id", "node"), "node")
    return first.unionByName(_within_hubs(members.select("hub", "node", "component", "away", "shingles")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, component_id (the smallest doc_id reachable through links, its own included)."""
    found = stored(sketches(docs), "sketches")
    named = found.where(F.col("doc_id").isNotNull())
    # One node for each set: the smallest doc_id that has it.
    distinct = named.groupBy("digest", "n").agg(F.min("doc_id").alias("node"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    # A doc_id with several texts ties its sets together.
    owners = distinct.select("digest", "n", "node")
    ties = named.select("doc_id", "digest", "n").join(owners, ["digest", "n"]).where("doc_id != node")
    several = named.select("doc_id", "digest", "n").distinct().groupBy("doc_id").count().where("count > 1").select("doc_id")
    ties = ties.join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
    labels = connected(links(distinct, docs).unionByName(ties), "shingle-links")
    classes = owners.join(labels, "node", "left").select("digest", "n", F.coalesce("component", "node").alias("component_id"))
    return found.join(classes, ["digest", "n"], "left").select(
        "doc_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    )
