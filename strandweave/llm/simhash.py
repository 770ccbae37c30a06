"""SimHash near-duplicates, linked through pigeonring candidates.

A fingerprint has bit b if more than half of its document's shingle hashes have it.  Two
fingerprints within `distance` bits, cut into `distance + 1` segments on a ring, have a segment
from which every chain of consecutive segments stays within its proportional budget: the first
l segments differ in at most l * distance / (distance + 1) bits.  So the first agree exactly,
which gives the bucket, and the longer chains prune before the full check.

Buckets hold distinct fingerprints, so copies cost nothing.  A bucket beyond `bucket_rows` is
dealt again by the chain of two segments (exact, then within one bit), which every link of it
still meets, and what is still beyond it by the chain of three (then within two bits), after which
only one segment is open and a bucket has a fixed bound.  A task gives a spanning forest of its
links, never all pairs.

A text without words has fingerprint zero and links like any other; a null text is an empty one.
A null doc_id links with nothing and has a null component.  Rows that repeat a doc_id are one
document: they get the same component.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandweave.llm.common import batches, read_table, stored
from strandweave.llm.components import connected, unite

SHINGLE_WORDS, DISTANCE, SEED = 3, 3, 42
BITS, SEGMENT = 64, 16
BUCKET_ROWS = 4096
SHINGLES_AT_ONCE = 200_000


def majority(parts: Iterable[np.ndarray], n: int) -> int:
    """The bits that over half of `n` unsigned 64-bit hashes, given in parts, have."""
    ones = np.zeros(BITS, np.int64)
    for hashes in parts:
        ones += np.unpackbits(hashes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words_each: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit fingerprint of the whole text."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    # For bytes, lower() and split() know ASCII only: A-Z, and space with \x09-\x0D.
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate([len(w) + 1 for w in words]))
    starts = [0, *ends[:-1]]
    lasts = ends[words_each - 1 :] or ends[-1:]
    n = len(lasts)
    cuts = range(0, n, SHINGLES_AT_ONCE)
    return majority(
        (np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts[at : at + SHINGLES_AT_ONCE], lasts[at : at + SHINGLES_AT_ONCE])], "<u8") for at in cuts), n
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a long) of columns doc_id, text."""

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            got = np.array([fingerprint(t) for t in part.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(got)], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, fp long")


def _turned(fps: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Fingerprints turned so that segment `first` is the lowest."""
    shift = (first * SEGMENT).astype(np.uint64)
    back = (np.uint64(BITS) - shift) % np.uint64(BITS)
    return np.where(shift == 0, fps, (fps >> shift) | (fps << back))


def within_chain(a: np.ndarray, b: np.ndarray, first: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """True where the chains from segment `first` keep their budgets, whose last is the Hamming check."""
    diff = _turned(a ^ b, first)
    good = np.ones(len(diff), bool)
    for length in range(1, BITS // SEGMENT + 1):
        part = diff[good] & np.uint64((1 << (SEGMENT * length)) - 1)
        # length * distance / (distance + 1), whole bits only
        good[good] = np.bitwise_count(part) <= length * distance // (distance + 1)
    return good


def _forest(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, first, own, fp, node), sorted by bucket, to a spanning forest (u, v) of its links."""

    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        bucket, first, own, node = (table.column(c).to_numpy() for c in ("bucket", "first", "own", "node"))
        fps = table.column("fp").to_numpy().view(np.uint64)
        parent = np.arange(len(fps))
        rows = np.arange(len(fps))
        gap = 1
        while len(rows := rows[rows + gap < len(fps)]):
            rows = rows[bucket[rows] == bucket[rows + gap]]
            tried = rows[own[rows] | own[rows + gap]]
            tried = tried[within_chain(fps[tried], fps[tried + gap], first[tried])]
            unite(parent, tried, tried + gap)
            gap += 1
        linked = np.flatnonzero(parent != np.arange(len(fps)))
        yield from batches({"u": (node[parent[linked]], pa.int64()), "v": (node[linked], pa.int64())})

    held: list[pa.RecordBatch] = []
    for part in parts:
        keys = part.column("bucket").to_numpy()
        if not len(keys):
            continue
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut or (held and held[-1].column("bucket")[-1].as_py() != keys[0]):
            whole = [*held, part.slice(0, cut)]
            # With nothing cut off, only what was held is whole.
            yield from solve(pa.Table.from_batches(whole))
            held = []
        held.append(part.slice(cut))
    if held:
        yield from solve(pa.Table.from_batches(held))


def _bits(value):
    """The numbers of a segment's set bits."""
    one = lambda b: F.lit(1).cast("long").bitwiseAND(F.call_function("shiftrightunsigned", value, b)) == 1
    return F.filter(F.sequence(F.lit(0), F.lit(SEGMENT - 1)), one)


def _without(value, bit):
    return value - F.call_function("shiftleft", F.lit(1).cast("long"), bit)


def _cleared(name: str, own: bool):
    """Structs (`name`, own) of the segment with one set bit cleared, for each."""
    return F.transform(_bits(F.col(name)), lambda b: F.struct(_without(F.col(name), b).alias(name), F.lit(own).alias("own")))


def links(fps: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """u, v of distinct fingerprints (columns fp, node): enough links to connect all that are linked."""
    n = BITS // SEGMENT
    segment = lambda k: F.shiftrightunsigned("fp", SEGMENT * k).bitwiseAND(F.lit((1 << SEGMENT) - 1))
    chains = F.array(
        *(F.struct(F.lit(k).alias("first"), segment(k).alias("key"), segment((k + 1) % n).alias("second")) for k in range(n))
    )
    rows = fps.select("fp", "node", F.explode(chains).alias("c")).select("fp", "node", "c.*")
    # At most 4 * 65,536 buckets, whatever the input: the list of the large ones has a fixed bound.
    large = rows.groupBy("first", "key").count().where(F.col("count") > bucket_rows).select("first", "key", F.lit(True).alias("large"))
    dealt = rows.join(F.broadcast(large), ["first", "key"], "left")
    two = F.col("first").cast("long") * (1 << SEGMENT) + F.col("key")
    small = dealt.where("large is null").select("first", "fp", "node", F.lit(True).alias("own"), (two * (1 << (SEGMENT + 1))).alias("bucket"))
    if large.isEmpty():
        return small.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_forest, "u long, v long")
    # Of two second segments one bit apart, one has that bit and the other is the first's with it cleared.
    exact = lambda c: F.array(F.struct(F.col(c).alias(c), F.lit(True).alias("own")))
    again = dealt.where("large").select("first", "key", "fp", "node", F.explode(F.concat(exact("second"), _cleared("second", False))).alias("s"))
    again = stored(again.select("first", "fp", "node", "s.own", (two * (1 << (SEGMENT + 1)) + F.col("s.second") + 1).alias("bucket")), "simhash-buckets")
    crowded = again.groupBy("bucket").count().where(F.col("count") > bucket_rows).select("bucket")
    calm = again.join(crowded, "bucket", "left_anti").select("first", "fp", "node", "own", "bucket")
    # Three segments: of values within two bits, both have a common one, each with at most two bits cleared.
    third = F.element_at(F.array(*(segment((k + 2) % n) for k in range(n))), F.col("first") + 1)
    held = again.join(crowded, "bucket", "left_semi").withColumn("third", third)
    one = _cleared("third", False)
    both = F.flatten(F.transform(one, lambda x: F.transform(_bits(x["third"]), lambda b: F.struct(_without(x["third"], b).alias("third"), F.lit(False).alias("own")))))
    last = held.select("first", "fp", "node", "own", "bucket", F.explode(F.array_distinct(F.concat(exact("third"), one, both))).alias("t"))
    # Places of second and third, 50 bits in all, and the ring's start stay apart from the shorter keys by sign.
    last = last.select("first", "fp", "node", "own", (-1 - (F.col("bucket") * (1 << SEGMENT) + F.col("t.third"))).alias("bucket"))
    # Rows of one bucket that stand for the same fingerprint: one is enough, its own if there is one.
    last = last.groupBy("bucket", "first", "fp", "node").agg(F.max("own").alias("own")).select("first", "fp", "node", F.lit(True).alias("own"), "bucket")
    keyed = small.unionByName(calm).unionByName(last)
    return keyed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_forest, "u long, v long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable through links, its own included)."""
    found = stored(fingerprints(docs), "fingerprints")
    named = found.where(F.col("doc_id").isNotNull())
    # One node for each fingerprint: the smallest doc_id that has it.
    distinct = named.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"))
    # A doc_id with several texts ties its fingerprints together.
    several = named.groupBy("doc_id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low < high")
    ties = several.join(named.distinct(), "doc_id").join(distinct.select("fp", "node"), "fp").select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
    labels = connected(links(distinct.select("fp", "node")).unionByName(ties), "simhash-links")
    classes = distinct.join(labels, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return found.join(classes, "fp", "left").select(
        "doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    )


def keep_one(docs: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """`docs` with one row of each group of near-duplicates: the smallest doc_id's; all columns stay.

    The groups are this module's or the given ones (columns doc_id, component_id).

    Of rows that repeat the kept doc_id the one with the least text stays; rows with a null doc_id
    stay, as nothing names them.  Columns of any names pass through.
    """
    columns = docs.columns
    taken = {c.lower() for c in columns}
    row = next(name for name in map("__row{}".format, range(len(columns) + 1)) if name not in taken)
    kept = (near_duplicates(docs) if groups is None else groups).where("doc_id = component_id").select("doc_id").distinct()
    one = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_first())
    named = docs.join(kept, "doc_id", "left_semi")
    chosen = named.withColumn(row, F.row_number().over(one)).where(F.col(row) == 1).select(*columns)
    return chosen.unionByName(docs.where(F.col("doc_id").isNull()))


def query(spark, sf_dir: str) -> DataFrame:
    """op5: fingerprint and component of all `documents`."""
    return near_duplicates(read_table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
