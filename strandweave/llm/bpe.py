"""Byte-level BPE: scans find the pre-tokens, cached pair merging codes them.

Pre-tokenisation has no regex.  Every code point gets a class; a class with its next neighbour
gives one of ten symbols; each symbol is a function on the states of an eight-state automaton.
Composing functions is associative, so blocks of symbols are composed side by side, a scan over
the blocks gives each one's first state, and a second sweep marks where pre-tokens begin.  The
slices between marks are merged by rank, each distinct one once.

Nulls and empty texts have no ids and decode to no bytes; repeated rows give repeated rows; an
empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandweave.llm.common import read_table

CACHE_ENTRIES = 700_000
#: Longer pieces are merged each time and never kept, so that the cache is bounded in bytes.
KEPT_CHARACTERS = 256

#: Code point classes, then symbols: a white space is "last" if a non-space follows it.
LETTER, NUMBER, OTHER, SPACE, WHITE, STOP = range(6)
L, N, O, SPACE_LAST, WHITE_LAST, MID, SHORT, LONG, END = range(9)  # noqa: E741
#: States: nothing open; a run of letters, numbers, others; a space to attach; inner white space;
#: one or two letters of a contraction to come.
FRESH, IN_L, IN_N, IN_O, ATTACH, IN_WHITE, ONE, TWO = range(8)
STATES, SYMBOLS = 8, 9
BLOCK = 128

#: Code points with Unicode's White_Space property.  Fixed values.
WHITE_SPACE = (
    0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0x85, 0xA0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005,
    0x2006, 0x2007, 0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, begins a pre-token) by symbol and state."""
    to = np.zeros((SYMBOLS, STATES), np.uint8)
    mark = np.ones((SYMBOLS, STATES), bool)
    for symbol, run in ((L, IN_L), (N, IN_N), (O, IN_O)):
        to[symbol] = run
        mark[symbol, [run, ATTACH]] = False
    to[L, TWO], to[L, ONE] = ONE, FRESH
    mark[L, [ONE, TWO]] = False
    to[SPACE_LAST], to[WHITE_LAST], to[MID], to[END] = ATTACH, FRESH, IN_WHITE, FRESH
    mark[MID, IN_WHITE] = False
    for symbol, letters in ((SHORT, ONE), (LONG, TWO)):
        to[symbol] = letters
        # Behind a space or another mark, an apostrophe opens no contraction.
        to[symbol, [IN_O, ATTACH]] = IN_O
        mark[symbol, [IN_O, ATTACH]] = False
    return to, mark


NEXT, MARK = _automaton()
_CLASSES: list[np.ndarray] = []


def code_point_classes() -> np.ndarray:
    """Class of every code point, from the Unicode data of this Python."""
    if not _CLASSES:
        first = {"L": LETTER, "N": NUMBER}
        table = np.array([first.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)], np.uint8)
        table[list(WHITE_SPACE)] = WHITE
        table[0x20] = SPACE
        _CLASSES.append(table)
    return _CLASSES[0]


def _symbols(points: np.ndarray, stops: np.ndarray) -> np.ndarray:
    cls = code_point_classes()[points]
    cls[stops] = STOP
    out = np.array([L, N, O, MID, MID, END], np.uint8)[cls]
    after = np.append(cls[1:], STOP)
    followed = after < SPACE
    out[(cls == SPACE) & followed] = SPACE_LAST
    out[(cls == WHITE) & followed] = WHITE_LAST
    quote = np.flatnonzero((points == ord("'")) & (after == LETTER))
    if len(quote):
        padded = np.append(points, [0, 0])
        one, two = padded[quote + 1], padded[quote + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = np.zeros(len(quote), bool)
        for a, b in ("re", "ve", "ll"):
            long |= (one == ord(a)) & (two == ord(b))
        out[quote[short]] = SHORT
        out[quote[long]] = LONG
    return out


def pre_token_marks(points: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """True where a pre-token begins; `stops` are the places of text ends, which are marked too."""
    n = len(points)
    rows = max(1, -(-n // BLOCK))
    symbols = np.full(rows * BLOCK, END, np.uint8)
    symbols[:n] = _symbols(points, stops)
    by_step = np.ascontiguousarray(symbols.reshape(rows, BLOCK).T).astype(np.intp) * STATES
    to, mark = NEXT.ravel(), MARK.ravel()
    # Each block's function: where every state leads.
    functions = np.repeat(np.arange(STATES, dtype=np.uint8)[:, None], rows, axis=1)
    for step in by_step:
        functions = to[step + functions]
    # Prefix compositions, doubling the reach; then each block's first state.
    reach = 1
    while reach < rows:
        functions[:, reach:] = np.take_along_axis(functions[:, reach:], functions[:, :-reach].astype(np.intp), axis=0)
        reach *= 2
    state = np.empty(rows, np.uint8)
    state[0], state[1:] = FRESH, functions[FRESH, :-1]
    marks = np.empty((BLOCK, rows), bool)
    for k, step in enumerate(by_step):
        at = step + state
        marks[k] = mark[at]
        state = to[at]
    return marks.T.ravel()[:n]


def pre_tokens(texts: list[str]) -> list[list[str]]:
    """The pre-tokens of each text; joined they are the text."""
    joined = "\0".join(texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
    stops = np.cumsum([len(t) + 1 for t in texts]) - 1
    begins = np.flatnonzero(pre_token_marks(points, stops))
    ends = np.searchsorted(begins, stops)
    places = begins.tolist()
    slices = [joined[a:b] for a, b in zip(places, places[1:])]
    out, first = [], 0
    for end in ends.tolist():
        out.append(slices[first:end])
        first = end + 1
    return out


class _Cached(dict):
    __slots__ = ("code",)

    def __missing__(self, piece: str) -> bytes:
        found = self.code(piece)
        if len(piece) <= KEPT_CHARACTERS:
            self[piece] = found
        return found


class BytePairCodec:
    """Ids of a rank file (`base64 rank` lines): encodes pre-tokens by lowest-rank merges, and decodes."""

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, file)))}
        self.tokens: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.sizes = np.array([len(t) for t in self.tokens], np.int64)
        self.cache = _Cached()
        self.cache.code = lambda piece: np.array(self.merge(piece.encode()), "<u4").tobytes()
        self.cache_entries = cache_entries

    def merge(self, piece: bytes) -> list[int]:
        """Joins neighbours, lowest rank first and leftmost among equals, until no pair has a rank."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        if len(piece) > 64:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        scores = [ranks.get(a + b, -1) for a, b in zip(parts, parts[1:])]
        while True:
            best, at = None, -1
            for i, s in enumerate(scores):
                if s >= 0 and (best is None or s < best):
                    best, at = s, i
            if best is None:
                return [ranks[p] for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            if at:
                scores[at - 1] = ranks.get(parts[at - 1] + parts[at], -1)
            if at < len(scores):
                scores[at] = ranks.get(parts[at] + parts[at + 1], -1)

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same merges with a heap and linked parts: near-linear in a very long piece."""
        ranks, n = self.ranks, len(piece)
        end, left = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and end[i] < n and (s := ranks.get(piece[i : end[end[i]]])) is not None:
                heapq.heappush(heap, (s, i, end[end[i]]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if end[i] == 0 or end[i] >= n or end[end[i]] != stop:
                continue  # one of its parts has been merged since
            gone = end[i]
            end[i], end[gone] = stop, 0
            if stop < n:
                left[stop] = i
            offer(i)
            offer(left[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed little-endian ids of each text."""
        get = self.cache.__getitem__
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            if len(self.cache) > self.cache_entries:
                self.cache.clear()
            group, size = [], 0
            while at < len(texts) and size < 2_000_000:  # a scan takes some MB of text, or one longer text
                group.append(texts[at] or "")
                size += len(group[-1])
                at += 1
            out += [b"".join(map(get, pieces)) for pieces in pre_tokens(group)]
        return out

    def ends(self, ids: bytes) -> np.ndarray:
        """Where each id's bytes end in the text's UTF-8."""
        return np.cumsum(self.sizes[np.frombuffer(ids, "<u4")])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODECS: dict[str, BytePairCodec] = {}


def codec(path: str) -> BytePairCodec:
    if path not in _CODECS:
        _CODECS[path] = BytePairCodec(path)
    return _CODECS[path]


ENCODED = "doc_id long, ids binary, ends binary"
DECODED = "doc_id long, ids binary, text binary"


#: Rows in one record batch: ids and offsets take many times a text's bytes.
ROWS_AT_ONCE = 512


def encode_batches(path: str, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bpe = codec(path)
    for part in parts:
        for at in range(0, part.num_rows, ROWS_AT_ONCE):
            some = part.slice(at, ROWS_AT_ONCE)
            ids = bpe.encode(some.column("text").to_pylist())
            ends = [bpe.ends(x).astype("<i8").tobytes() for x in ids]
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(ids, pa.binary()), pa.array(ends, pa.binary())], names=["doc_id", "ids", "ends"])


def decode_batches(path: str, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bpe = codec(path)
    for part in parts:
        ids = part.column("ids").to_pylist()
        texts = [bpe.decode(x) for x in ids]
        for text, places in zip(texts, part.column("ends")):
            last = places.as_buffer()[-8:] if len(places.as_buffer()) else b""
            if len(text) != int.from_bytes(bytes(last), "little"):
                raise ValueError("ids and offsets disagree")
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), pa.array(texts, pa.binary())], names=["doc_id", "ids", "text"])


def encode(docs: DataFrame, path: str) -> DataFrame:
    """ENCODED for columns doc_id, text: ids as packed unsigned 32-bit, ends as 64-bit byte offsets."""
    return docs.select("doc_id", "text").mapInArrow(lambda parts: encode_batches(path, parts), ENCODED)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """DECODED for columns doc_id, ids, ends; the retained offsets must agree with the bytes."""
    return encoded.select("doc_id", "ids", "ends").mapInArrow(lambda parts: decode_batches(path, parts), DECODED)


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digests(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shown: list[str] = []
    for part in parts:
        counts, sums = [], []
        for packed in part.column("ids").to_pylist():
            ids = np.frombuffer(packed, "<u4")
            top = int(ids.max(initial=0))
            if top >= len(shown):
                shown = [str(i) for i in range(top + 1)]
            counts.append(len(ids))
            sums.append(hashlib.sha256(",".join(map(shown.__getitem__, ids.tolist())).encode()).hexdigest())
        texts = [hashlib.sha256(x).hexdigest() for x in part.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(sums), pa.array(texts)],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def query(spark, sf_dir: str) -> DataFrame:
    """op3: encodes all `documents`, decodes the ids, and digests both, as one pass of one worker a task."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.mapInArrow(lambda parts: _digests(decode_batches(path, encode_batches(path, parts))), DIGESTS)
