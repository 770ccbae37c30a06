"""All seeds against all passages, block by block: matrix products without a cross join of rows.

Both sides are cut into blocks of about `BLOCK_ROWS` rows by the hash of their ids.  Each pair of
blocks is multiplied in numpy; a task keeps, over all blocks it meets, the best few of each seed, or
counts, so no pair of rows is ever a row of a DataFrame.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from copy import copy

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from strandweave.shared import free_name, open_folder, shared_folder, stored

BLOCK_ROWS = 2048
#: Pairs of blocks that may travel with their rows; entries of a matrix whose places are looked at together, which stay in a core's cache.
FEW_PAIRS, MOST_PLACES = 16, 1 << 19
#: Passages and seeds that are multiplied together, whose products stay in a core's cache; blocks of rows that a block of seeds holds at most.
TILE, WIDEST = (512, 512), 4
#: Pairs of rows that are multiplied in double precision together; the longest vectors that single precision is asked of.
PRECISE, LONGEST = 1 << 14, 1e15
#: What a row of each seed must reach, among a seed block's columns.
LEAST = "\0least"
Block = dict[str, np.ndarray]
Work = Callable[[Block, Block], dict[str, np.ndarray]]
Allowed = Callable[[np.ndarray, np.ndarray], np.ndarray]
Gather = Callable[[Block], "Best | Sums"]
Shape = Callable[[pa.Table], pa.Table]


def whole(df: DataFrame) -> DataFrame:
    """`df` without rows that lack a vector: they take no part."""
    for field in df.schema.fields:
        if isinstance(field.dataType, ArrayType):
            df = df.where(F.col(field.name).isNotNull() & ~F.exists(field.name, lambda x: x.isNull()))
    return df


def blocks_of(df: DataFrame) -> int:
    """The number of blocks that `df` makes: it is counted once."""
    return max(1, -(-df.count() // BLOCK_ROWS))


def in_blocks(df: DataFrame, block: str, rows: str, n: int, key: Column | None = None) -> DataFrame:
    """A row for each of `n` blocks, with its rows."""
    return df.groupBy(F.pmod(F.xxhash64("id") if key is None else key, F.lit(n)).alias(block)).agg(F.collect_list(F.struct(*df.columns)).alias(rows))


def unpack(rows: pa.StructArray) -> Block:
    """A block's columns as arrays, vectors as matrices; vectors of several lengths are refused."""
    out: Block = {}
    for i, field in enumerate(rows.type):
        column = rows.field(i)
        if pa.types.is_list(field.type):
            flat = column.flatten().to_numpy(zero_copy_only=False)
            if len(rows) and len(flat) % len(rows) or len(pc.unique(column.value_lengths())) > 1:
                raise ValueError(f"{field.name}: vectors differ in length")
            out[field.name] = flat.reshape(len(rows), -1)
        else:
            out[field.name] = column.to_numpy(zero_copy_only=False)
    return out


def in_files(df: DataFrame, side: str, n: int, block: Column | None = None, shape: Shape | None = None) -> DataFrame:
    """block, path, at, size: where the rows of each block, a hash of the id if none is told, stand as Arrow data, in the order of ids or as `shape` makes them."""
    spark = df.sparkSession
    folder, names = shared_folder(spark, "blocks"), df.columns
    block = F.pmod(F.xxhash64("id"), F.lit(n)) if block is None else block

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, made, at = f"{folder}/{uuid.uuid4().hex}.blocks", [], 0
        fs, path = open_folder(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(path) as out:
            held, block = [], None

            def put() -> None:
                nonlocal at
                sink = pa.BufferOutputStream()
                table = pa.Table.from_batches(held).combine_chunks()
                table = shape(table) if shape else table
                with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as stream:
                    stream.write_table(table)
                raw = sink.getvalue()
                out.write(raw)
                made.append((block, uri, at, len(raw)))
                at += len(raw)

            for part in parts:
                keys = part.column(0).to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
                for low, high in zip(cuts, cuts[1:]):
                    if low < high:
                        if held and keys[low] != block:
                            put()
                            held = []
                        block = int(keys[low])
                        held.append(part.slice(low, high - low).select(names))
            if held:
                put()
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=[f"{side}b", f"{side}_path", f"{side}_at", f"{side}_size"])

    key = free_name(names, "block")
    dealt = df.select(block.cast("long").alias(key), *names)
    # A block whose order `shape` makes is a partition and needs no sort.
    dealt = dealt.repartitionById(n, F.col(key).cast("int")) if shape else dealt.repartition(n, key).sortWithinPartitions(key, "id")
    return stored(dealt.mapInArrow(write, f"{side}b long, {side}_path string, {side}_at long, {side}_size long"), "block-places")


def read_block(path: str, at: int, size: int) -> Block:
    fs, name = open_folder(path)
    with fs.open_input_file(name) as file:
        file.seek(at)
        table = pa.ipc.open_stream(file.read_buffer(size)).read_all().combine_chunks()
    return unpack(pa.StructArray.from_arrays([c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in table.columns], names=table.schema.names))


def block_pairs(
    seeds: DataFrame, chunks: DataFrame, work: Work, schema: str, gather: Gather | None = None, block: Column | None = None, blocks: tuple[int, int] | None = None, shape: Shape | None = None
) -> DataFrame:
    """`work(seed block, chunk block)` of every pair of blocks; both sides have a column id.

    A few blocks travel to their pairs; more are written to files once, and only their places travel: a task takes a
    block of seeds with all blocks of passages or, where seeds have few blocks, with an equal share of them.  What the pairs
    of a block of seeds give is then put together by `gather` within the task, so that what leaves it does not grow with
    the blocks of passages.  `block` deals passages to blocks by another key than their id; `blocks` tells the numbers
    of blocks, where a passage is not a row, and blocks are then always files; `shape` makes what is written of a block of passages.
    """
    one = seeds is chunks and block is None
    seeds, chunks = whole(seeds), whole(chunks)
    m = blocks[0] if blocks else blocks_of(seeds)
    n = blocks[1] if blocks else m if one else blocks_of(chunks)
    if blocks is None and m * n > FEW_PAIRS:
        # A block of passages that is read serves more seeds, where blocks of seeds are many for the tasks.
        wide = max(1, min(WIDEST, m // (4 * seeds.sparkSession.sparkContext.defaultParallelism)))
        one, m = one and wide == 1, -(-m // wide)
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    if m * n <= FEW_PAIRS and blocks is None:
        left, right = in_blocks(seeds, "sb", "seeds", m), in_blocks(chunks, "cb", "chunks", n, block)
        pairs = left.withColumn("cb", every).join(right, "cb")

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                for s, c in zip(part.column("seeds"), part.column("chunks")):
                    yield pa.RecordBatch.from_pydict(work(unpack(s.values), unpack(c.values)))

        return pairs.select("seeds", "chunks").mapInArrow(run, schema)
    left = in_files(seeds, "s", m)
    right = left.toDF("cb", "c_path", "c_at", "c_size") if one else in_files(chunks, "c", n, block if block is None else F.pmod(block, F.lit(n)), shape)
    shares = min(n, -(-2 * seeds.sparkSession.sparkContext.defaultParallelism // m))
    task = (F.col("sb") * shares + F.col("cb") % shares).cast("int")

    def batch(rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        if rows and len(next(iter(rows.values()))):
            yield pa.RecordBatch.from_pydict(rows)

    def run_files(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = seed = got = None
        for part in parts:
            for r in part.to_pylist():
                if r["sb"] != at:
                    yield from batch(got.rows() if got else {})
                    at, seed = r["sb"], read_block(r["s_path"], r["s_at"], r["s_size"])
                    got = gather(seed) if gather else None
                made = work(seed, read_block(r["c_path"], r["c_at"], r["c_size"]))
                if got is None:
                    yield from batch(made)
                else:
                    got.add(made)
        yield from batch(got.rows() if got else {})

    pairs = left.withColumn("cb", every).join(right, "cb")
    dealt = pairs.repartitionById(m * shares, task).sortWithinPartitions("sb", "cb")
    return dealt.select("sb", "s_path", "s_at", "s_size", "c_path", "c_at", "c_size").mapInArrow(run_files, schema)


class Best:
    """Gathers the `limit` best rows of each seed by a column, ties to the smaller id, and tells the seeds' block what a row must reach."""

    def __init__(self, seed: Block, limit: int, order: str):
        self.seed, self.limit, self.order, self.held = seed, limit, order, []
        self.ids, self.place = np.unique(seed["id"], return_inverse=True)
        self.cut_at = 0

    def add(self, rows: dict[str, np.ndarray]) -> None:
        self.held.append(rows)
        # The first rows give a bound at once; later ones, which reach it, are few.
        if sum(len(r["id"]) for r in self.held) > self.cut_at:
            self.rows()

    def rows(self) -> dict[str, np.ndarray]:
        rows = {n: np.concatenate([r[n] for r in self.held]) for n in self.held[0]}
        at, place = best_places(rows["seed_id"], rows[self.order], rows["id"], self.limit)
        rows = {n: v[at] for n, v in rows.items()}
        least = np.full(len(self.ids), -np.inf)
        last = place == self.limit - 1
        least[np.searchsorted(self.ids, rows["seed_id"][last])] = rows[self.order][last]
        self.seed[LEAST], self.held = least[self.place], [rows]
        self.cut_at = len(rows["id"]) + max(1 << 14, len(rows["id"]) // 2)
        return rows


class Sums:
    """Gathers rows that come alike from each pair, with a column summed."""

    def __init__(self, seed: Block, column: str):
        self.column, self.held = column, None

    def add(self, rows: dict[str, np.ndarray]) -> None:
        self.held = rows if self.held is None else rows | {self.column: self.held[self.column] + rows[self.column]}

    def rows(self) -> dict[str, np.ndarray]:
        return self.held


def best(limit: int, order: str = "similarity") -> Gather:
    return lambda seed: Best(seed, limit, order)


def sums(column: str) -> Gather:
    return lambda seed: Sums(seed, column)


def best_places(rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(index, 0-based place) of each row's `limit` best entries, rows together, ties to the smaller id."""
    order = np.lexsort((ids, -scores, rows))
    sorted_ = rows[order]
    starts = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]]) if len(order) else np.zeros(0, int)
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return order[place < limit], place[place < limit]


def _single(block: Block, column: str) -> tuple[np.ndarray, float]:
    """A matrix of a block in single precision, and its longest row; made once for a block."""
    name = f"\0{column}"
    if name not in block:
        with np.errstate(over="ignore", invalid="ignore"):
            block[name] = block[column].astype(np.float32), float(np.sqrt(np.max(np.einsum("nd,nd->n", block[column], block[column]), initial=0.0)))
    return block[name]


class Products:
    """Products of a block's vectors with another's: all in single precision, some rows at a time, and those asked for in double.

    `slack` is the most by which single precision is wrong: that of a sum of as many products of rounded numbers.  Vectors too long for
    it, or not finite, are multiplied in double precision, with no slack.  `starts` of groups of passages, which stand together, make a
    group's greatest product one column.
    """

    def __init__(self, seed: Block, chunk: Block, column: str = "vec", starts: np.ndarray | None = None):
        self.a, self.b = seed[column], chunk[column]
        (self.rough_a, most_a), (self.rough_b, most_b) = _single(seed, column), _single(chunk, column)
        self.slack = (self.a.shape[1] + 5) * 2.0**-24 * most_a * most_b + 1e-30
        if not (most_a < LONGEST and most_b < LONGEST):
            self.rough_a, self.rough_b, self.slack = self.a, self.b, 0.0
        #: What makes products whole numbers of two bytes; nought for those in double precision.
        self.scale = 32_000 / (most_a * most_b) if self.slack and most_a * most_b > 1e-30 else 0.0
        self.starts = starts
        self.shape = (len(self.a), len(self.b) if starts is None else len(starts))

    def rows(self, low: int, high: int) -> np.ndarray:
        with np.errstate(invalid="ignore", over="ignore"):
            made = self.rough_a[low:high] @ self.rough_b.T
        return made if self.starts is None else np.maximum.reduceat(made, self.starts, axis=1)

    def scaled(self) -> "Products":
        """The same whose pieces are products times `scale`, wrong by no more than the slack times it."""
        made = copy(self)
        made.scale = float(np.float32(self.scale))
        made.rough_a = self.rough_a * np.float32(made.scale)
        return made

    def tile(self, low: int, high: int, left: int, right: int, room: np.ndarray | None = None) -> np.ndarray:
        """Columns low to high of rows left to right, a column of theirs a row; in `room`, if it is told."""
        if self.starts is None:
            b, a = self.rough_b[low:high], self.rough_a[left:right].T
            return np.matmul(b, a, out=None if room is None or room.dtype != b.dtype else room[: len(b) * a.shape[1]].reshape(len(b), -1))
        ends = np.append(self.starts, len(self.b))
        first = ends[low]
        return np.maximum.reduceat(self.rough_b[first : ends[min(high, self.shape[1])]] @ self.rough_a[left:right].T, self.starts[low:high] - first, axis=0)

    def exact(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        if self.starts is not None:
            sizes = np.diff(np.append(self.starts, len(self.b)))[j]
            first = np.cumsum(sizes) - sizes
            at = np.repeat(self.starts[j] - first, sizes) + np.arange(sizes.sum())
            return np.maximum.reduceat(self._each(np.repeat(i, sizes), at), first) if len(j) else np.zeros(0)
        return self._each(i, j)

    def _each(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0), *(np.einsum("nd,nd->n", self.a[i[x : x + PRECISE]], self.b[j[x : x + PRECISE]]) for x in range(0, len(i), PRECISE))])


class Known:
    """A matrix of scores that are all there, as `Products` gives them."""

    slack = scale = 0.0

    def __init__(self, scores: np.ndarray):
        self.scores, self.shape = scores, scores.shape

    def rows(self, low: int, high: int) -> np.ndarray:
        return self.scores[low:high]

    def tile(self, low: int, high: int, left: int, right: int, room: np.ndarray | None = None) -> np.ndarray:
        return np.ascontiguousarray(self.scores[left:right, low:high].T)

    def exact(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return self.scores[i, j].astype(float)


def products(scores: np.ndarray | Products) -> Products | Known:
    return Known(scores) if isinstance(scores, np.ndarray) else scores


def _down(floor: np.ndarray, kind: np.dtype) -> np.ndarray:
    """Floors in the precision `kind`, not higher than they are."""
    if floor.dtype == kind:
        return floor
    with np.errstate(over="ignore"):
        return np.nextafter(floor.astype(kind), kind.type(-np.inf))


def places(flags: np.ndarray) -> np.ndarray:
    """The flat places of true entries; where they are few, by eights."""
    flat = flags.reshape(-1)
    end = len(flat) // 8 * 8
    eights = np.flatnonzero(flat[:end].view(np.uint64) != 0)
    if len(eights) * 32 > len(flat):
        return np.flatnonzero(flat)
    at = (eights[:, None] * 8 + np.arange(8)).reshape(-1)
    return np.concatenate([at[flat[at]], np.flatnonzero(flat[end:]) + end])


def over(part: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """Which entries are not under their row's floor."""
    return part >= _down(floor, part.dtype)[:, None]


def tiles(scores: Products | Known, tile: tuple[int, int]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, first column, products) of the matrix, a column a row, by pieces that stay in a core's cache; all of some rows together.

    A piece is written over the one before.
    """
    n, width = scores.shape
    room = np.empty(min(tile[0], width) * min(tile[1], n), np.float32)
    for left in range(0, n, tile[1]):
        for low in range(0, width, tile[0]):
            with np.errstate(invalid="ignore", over="ignore"):
                part = scores.tile(low, low + tile[0], left, left + tile[1], room)
            yield left, low, part


def reaching(scores: Products, floor: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray] | None:
    """(row, column) of the entries that are not under their row's floor; none, if there are more than `most`."""
    rows, columns, total, own = [], [], 0, None
    for left, low, part in tiles(scores, TILE):
        own = _down(floor, part.dtype) if own is None else own
        at = places(part >= own[left : left + part.shape[1]])
        if len(at):
            j, i = np.divmod(at, part.shape[1])
            rows.append(i + left)
            columns.append(j + low)
            total += len(at)
            if total > most:
                return None
    return tuple(np.concatenate(x or [np.zeros(0, int)]) for x in (rows, columns))


def best_of(
    scores: np.ndarray | Products, ids: np.ndarray, limit: int, seed: Block | None = None, ok: Allowed | None = None, least: float = -np.inf, most: float = np.inf
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of each row's `limit` best finite scores, ties to the smaller id; with `seed` those that may be among the best of all blocks.

    Scores under `least`, of `most` or more, and entries that `ok(rows, columns)` refuses don't count.  It is asked only
    for scores that reach what the seed has got, which after a first block are few.
    """
    scores = products(scores)
    n, width = scores.shape
    floor = np.maximum(np.broadcast_to((seed or {}).get(LEAST, -np.inf), n), max(least, np.finfo(float).min))
    found = []

    def chosen(i: np.ndarray, j: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, column, score, place) of the best of the entries told."""
        if ok is not None and len(i):
            good = ok(i + low, j)
            i, j = i[good], j[good]
        value = scores.exact(i + low, j)
        good = np.isfinite(value) & (value >= floor[i + low]) & (value < most)
        i, j, value = i[good], j[good], value[good]
        at, place = best_places(i, value, ids[j], limit)
        return i[at], j[at], value[at], place

    if LEAST in (seed or {}) and isinstance(scores, Products):
        # After a first block few reach what the seeds have.
        got = reaching(scores, floor - scores.slack, (2 * limit + 64) * n)
        if got is not None:
            return chosen(*got, 0)[:3]
    # Some rows at a time, so that they stay in a core's cache.
    step = max(1, MOST_PLACES // max(1, width))
    for low in range(0, n, step):
        part = scores.rows(low, min(n, low + step))
        i, j = np.divmod(places(over(part, floor[low : low + step] - scores.slack)), width)
        take = 2 * limit + 64
        if take < width and len(i) > take * len(part):
            # Rows whose best are surely among a few of their greatest entries need no others.
            flat = np.nan_to_num(part, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
            reach = np.partition(flat, width - take, axis=1)[:, width - take].astype(float)
            a, b, value, place = chosen(*np.divmod(places(over(flat, np.maximum(reach, floor[low : low + step] - scores.slack))), width), low)
            sure = np.zeros(len(part), bool)
            last = place == limit - 1
            sure[a[last]] = value[last] > reach[a[last]] + scores.slack
            mine = sure[a]
            found.append((a[mine] + low, b[mine], value[mine]))
            rest = ~sure[i]
            i, j = i[rest], j[rest]
        if len(i):
            a, b, value, _ = chosen(i, j, low)
            found.append((a + low, b, value))
    return tuple(np.concatenate([f[x] for f in found] or [np.zeros(0, kind)]) for x, kind in enumerate((int, int, float)))


def kept(seed: Block, chunk: Block, scores: np.ndarray | Products, limit: int, ok: Allowed | None = None, least: float = -np.inf, most: float = np.inf) -> dict[str, np.ndarray]:
    i, j, value = best_of(scores, chunk["id"], limit, seed, ok, least, most)
    return {"seed_id": seed["id"][i], "id": chunk["id"][j], "similarity": value}
