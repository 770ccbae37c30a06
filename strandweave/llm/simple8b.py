"""Token ids in files, Simple-8b coded: varying counts of ids in 64-bit words.

A word's top four bits select how many ids of how many bits its other 60 hold; the writer takes
the selector that packs most of what comes next.  An id that needs over 60 bits is escaped: its
word holds the place of the raw value in a list behind the words.  Ids are cut into blocks that
start on a new word, and the offsets of the blocks' words let a reader decode many at once.

A shard file is: the words; the escapes; where each block's words start; each document's id, null
mark and id count; then a footer with the counts and a mark.  Shards in their order, and documents
in a shard, ascend by doc_id (null first; repeated ids by their texts' hash, then by text), so that
the rows of one much repeated id, or of null ids, are cut over shards too.  A null text is an empty one.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandweave.llm.common import batches, open_folder, read_table, shared_folder
from strandweave.llm.segment_encoder import encoder

END_ID = 0
BLOCK = 4096
#: (ids, bits each) by selector, 0 to 13; selector 15 is an escape.
LAYOUTS = (
    (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60),
)
COUNTS = np.array([n for n, _ in LAYOUTS] + [0, 1], np.int64)
ESCAPE = 15
MOST = 60
MARK = b"SWS8B\x00\x00\x01"
FOOTER = struct.Struct("<QQQQQ8s")


def _width(values: np.ndarray) -> np.ndarray:
    """Bits of the narrowest field that holds each value; 64 if only an escape does."""
    limits = np.array([1 << b for _, b in LAYOUTS], np.uint64)
    return np.array([*(b for _, b in LAYOUTS), 64], np.uint8)[np.searchsorted(limits, values, side="right")]


#: Of the values of up to 16 bits, which nearly all ids have.
WIDTHS = _width(np.arange(1 << 16, dtype=np.uint64))


def encode_blocks(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, escapes, words in each block) of unsigned 64-bit values; blocks hold BLOCK values, the last fewer."""
    n = len(values)
    blocks = -(-n // BLOCK)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    stride = BLOCK + MOST
    body = np.zeros(blocks * BLOCK, np.uint64)
    body[:n] = values
    padded = np.zeros((blocks, stride), np.uint64)
    padded[:, :BLOCK] = body.reshape(blocks, BLOCK)
    if padded.max() < len(WIDTHS):
        widths = WIDTHS[padded.astype(np.uint16)]
    else:
        widths = _width(padded)
    selectors = np.full((blocks, stride), ESCAPE, np.uint8)
    reach, widest = 1, widths
    for selector in range(len(LAYOUTS) - 1, -1, -1):
        count, bits = LAYOUTS[selector]
        while reach < count:  # `widest` is of the next `reach` values
            step = min(reach, count - reach)
            widest = np.maximum(widest[:, :-step], widest[:, step:])
            reach += step
        np.putmask(selectors[:, :BLOCK], widest[:, :BLOCK] <= bits, selector)
    # All blocks step from word to word side by side.
    steps = COUNTS.astype(np.uint8)[selectors].ravel()
    at = np.arange(blocks) * stride
    stop = at + BLOCK
    stop[-1] = at[-1] + n - (blocks - 1) * BLOCK
    starts = []
    while len(at):
        starts.append(at)
        at = at + steps[at]
        live = at < stop
        if not live.all():
            at, stop = at[live], stop[live]
    start = np.sort(np.concatenate(starts))
    flat = padded.ravel()
    chosen = selectors.ravel()[start]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for selector, (count, bits) in enumerate(LAYOUTS):
        rows = np.flatnonzero(chosen == selector)
        if len(rows):
            first = start[rows]
            word = words[rows]
            for k in range(count):
                word |= flat[first + k] << np.uint64(k * bits)
            words[rows] = word
    raw = np.flatnonzero(chosen == ESCAPE)
    words[raw] |= np.arange(len(raw), dtype=np.uint64)
    return words, flat[start[raw]], np.bincount(start // stride, minlength=blocks)


def decode_blocks(words: np.ndarray, escapes: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
    """The `n` values of consecutive blocks; `sizes` are the blocks' words."""
    blocks = len(sizes)
    chosen = (words >> np.uint64(60)).astype(np.intp)
    taken = COUNTS[chosen]
    ends = np.cumsum(taken)
    first = np.cumsum(sizes) - sizes
    base = np.repeat(ends[first] - taken[first] if blocks else ends[:0], sizes)
    place = ends - taken - base + np.repeat(np.arange(blocks), sizes) * (BLOCK + MOST)
    out = np.zeros(blocks * (BLOCK + MOST), np.uint64)
    for selector, (count, bits) in enumerate(LAYOUTS):
        rows = np.flatnonzero(chosen == selector)
        mask = np.uint64((1 << bits) - 1)
        for k in range(count) if len(rows) else ():
            out[place[rows] + k] = (words[rows] >> np.uint64(k * bits)) & mask
    raw = np.flatnonzero(chosen == ESCAPE)
    out[place[raw]] = escapes[(words[raw] & np.uint64((1 << 60) - 1)).astype(np.intp)]
    return out.reshape(blocks, BLOCK + MOST)[:, :BLOCK].ravel()[:n]


class ShardWriter:
    """Streams ids to a shard file; holds one run of blocks and the documents' counts."""

    RUN = 256 * BLOCK

    def __init__(self, uri: str):
        fs, path = open_folder(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = fs.open_output_stream(path)
        self.pending: list[np.ndarray] = []
        self.held = self.ids = self.words = 0
        self.escapes: list[np.ndarray] = []
        self.n_escapes = 0
        self.sizes: list[np.ndarray] = []
        self.docs: list[int | None] = []
        self.counts: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.counts.append(len(ids))
        self.pending.append(ids)
        self.held += len(ids)
        if self.held >= self.RUN:
            self._flush(self.held // BLOCK * BLOCK)

    def _flush(self, n: int) -> None:
        values = np.concatenate(self.pending) if self.pending else np.zeros(0, np.uint64)
        words, escapes, sizes = encode_blocks(values[:n].astype(np.uint64))
        if len(escapes):
            raw = np.flatnonzero(words >> np.uint64(60) == ESCAPE)
            words[raw] += np.uint64(self.n_escapes)
            self.escapes.append(escapes)
            self.n_escapes += len(escapes)
        self.out.write(words.astype("<u8").tobytes())
        self.words += len(words)
        self.sizes.append(sizes)
        self.ids += n
        self.pending, self.held = [values[n:]], len(values) - n

    def close(self) -> None:
        self._flush(self.held)
        sizes = np.concatenate(self.sizes)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        nulls = np.array([d is None for d in self.docs], np.uint8)
        self.out.write(b"".join(e.astype("<u8").tobytes() for e in self.escapes))
        self.out.write(offsets.astype("<u8").tobytes())
        self.out.write(np.array([d or 0 for d in self.docs], "<i8").tobytes() + nulls.tobytes())
        self.out.write(np.array(self.counts, "<u8").tobytes())
        self.out.write(FOOTER.pack(self.words, self.n_escapes, len(sizes), self.ids, len(self.docs), MARK))
        self.out.close()


class ShardReader:
    """Reads a shard file's tables, then runs of its blocks."""

    def __init__(self, file, size: int):
        self.file = file
        file.seek(size - FOOTER.size)
        self.words, escapes, self.blocks, self.ids, docs, mark = FOOTER.unpack(file.read(FOOTER.size))
        if mark != MARK:
            raise ValueError("not a shard of coded ids")
        file.seek(8 * self.words)
        self.escapes = np.frombuffer(file.read(8 * escapes), "<u8")
        self.offsets = np.frombuffer(file.read(8 * (self.blocks + 1)), "<u8").astype(np.int64)
        doc_ids = np.frombuffer(file.read(8 * docs), "<i8").tolist()
        nulls = file.read(docs)
        self.docs = [None if z else d for d, z in zip(doc_ids, nulls)]
        self.counts = np.frombuffer(file.read(8 * docs), "<u8").astype(np.int64)

    def run(self, first: int, last: int) -> np.ndarray:
        """The values of blocks `first` to before `last`, from their range of the file alone."""
        self.file.seek(8 * int(self.offsets[first]))
        n_words = int(self.offsets[last] - self.offsets[first])
        words = np.frombuffer(self.file.read(8 * n_words), "<u8")
        n = min(self.ids, last * BLOCK) - first * BLOCK
        return decode_blocks(words, self.escapes, np.diff(self.offsets[first : last + 1]), n)

    def documents(self, blocks_each: int = 256) -> Iterator[tuple[int | None, int, int]]:
        """(doc_id, ids, crc32 of the ids as unsigned 32-bit) in the file's order."""
        starts = np.cumsum(self.counts) - self.counts
        sums = [0] * len(self.docs)
        doc = 0
        for block in range(0, self.blocks, blocks_each):
            last = min(self.blocks, block + blocks_each)
            ids = self.run(block, last).astype("<u4").tobytes()
            low, high = block * BLOCK, min(self.ids, last * BLOCK)
            while doc < len(self.docs) and starts[doc] < high:
                begin, end = int(starts[doc]), int(starts[doc] + self.counts[doc])
                sums[doc] = zlib.crc32(ids[4 * (max(begin, low) - low) : 4 * (min(end, high) - low)], sums[doc])
                if end > high:
                    break
                doc += 1
        yield from zip(self.docs, self.counts.tolist(), sums)


MANIFEST = "path string, part long, ids long, documents long"


def write_shards(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = END_ID) -> DataFrame:
    """Encodes columns doc_id, text, and writes shards in ascending doc_id; returns MANIFEST.

    Each task attempt writes a file of its own, and the manifest lists those of ended attempts.
    """
    end = end_id.to_bytes(4, "little")

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, writer = encoder(tokenizer_path).encode, None
        uri = f"{folder}/{uuid.uuid4().hex}.s8b"
        for part in parts:
            writer = writer or ShardWriter(uri)
            for doc_id, ids in zip(part.column("doc_id").to_pylist(), encode(part.column("text").to_pylist())):
                writer.add(doc_id, np.frombuffer(ids + end, "<u4"))
        if writer is not None and writer.docs:
            writer.close()
            row = (uri, TaskContext.get().partitionId(), writer.ids, len(writer.docs))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
            names = ("path", "part", "ids", "documents")
            yield from batches({k: ([v], t) for k, v, t in zip(names, row, kinds)})

    by_text = F.xxhash64("text")
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id", by_text).sortWithinPartitions("doc_id", by_text, "text")
    made = ordered.mapInArrow(write, MANIFEST)
    made.write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(made.schema).parquet(f"{folder}/manifest")


READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_shards(manifest: DataFrame) -> DataFrame:
    """READ of every document in the shards, from the files."""

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for uri, base in zip(part.column("path").to_pylist(), part.column("base").to_pylist()):
                fs, path = open_folder(uri)
                out: list[list] = [[], [], [], []]
                with fs.open_input_file(path) as file:
                    for doc_id, n, crc in ShardReader(file, file.size()).documents():
                        for column, value in zip(out, (doc_id, base, n, crc)):
                            column.append(value)
                        base += n
                names = ("doc_id", "start", "n_tokens", "ids_crc32")
                yield from batches({k: (v, pa.int64()) for k, v in zip(names, out)})

    # One row a shard: the window's single task sees file names and counts only.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.select("path", "part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    # A fixed count, dealt by number, one file a task: file names are too few bytes for AQE to see the work behind them.
    return based.repartitionByRange(max(1, manifest.count()), "part").mapInArrow(read, READ)


def query(spark, sf_dir: str) -> DataFrame:
    """op10: writes the ids of all `documents` to shards and reads them back."""
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents")
    manifest = write_shards(docs, public_tokenizers.path("byte_bpe_50k.json"), shared_folder(spark, "ids"))
    return read_shards(manifest)
