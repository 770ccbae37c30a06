"""Durable quote anchors: exact, normalised and fuzzy resolution, spans to passages, orphans, notes."""

from __future__ import annotations

import difflib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandweave.operators.blocked import Best, blocks_of, in_files, kept, read_block
from strandweave.operators.intervals import touching
from strandweave.shared import stored

LEAST_RATIO, RUNNER_UP_GAP, SLACK_WORDS, CONTEXT = 0.86, 0.02, 2, 40


_BREAK = re.compile(r"-[ \t]*\n\s*")


@lru_cache(maxsize=1 << 16)
def _shown(code: int) -> tuple[bool, tuple[int, ...]]:
    """(white space, what stands for a character)."""
    c = chr(code)
    if c == "\u00ad":
        return False, ()
    if c.isspace():
        return True, (32,)
    return False, tuple(ord(d) for d in unicodedata.normalize("NFKD", c) if not unicodedata.combining(d))


def normalised(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(code points of the text without accents, soft hyphens and line-end hyphens, white space as one space; source offset of each)."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    kinds, which = np.unique(codes, return_inverse=True)
    shown = [_shown(int(c)) for c in kinds]
    sizes = np.array([len(s[1]) for s in shown], np.int64)
    many = sizes[which]
    if "-" in text:
        for m in _BREAK.finditer(text):
            many[m.start() : m.end()] = 0
    at = np.repeat(np.arange(len(codes)), many)
    if (sizes > 1).any():
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        flat = np.array([d for s in shown for d in s[1]], np.uint32)
        inner = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
        out = flat[starts[which[at]] + inner]
    else:
        out = np.array([s[1][0] if s[1] else 0 for s in shown], np.uint32)[which[at]]
    white = np.array([s[0] for s in shown], bool)[which[at]]
    # White space goes where a space, or nothing, stands before it.
    again = white & np.concatenate([[True], out[:-1] == 32]) if len(out) else white
    return out[~again], at[~again]


def normalise(text: str) -> tuple[str, list[int]]:
    out, at = normalised(text)
    return out.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass"), at.tolist()


def _context(text: str, start: int, end: int, prefix: str | None, suffix: str | None) -> float:
    scores = []
    if prefix:
        scores.append(difflib.SequenceMatcher(None, text[max(0, start - CONTEXT) : start][-len(prefix) :], prefix).ratio())
    if suffix:
        scores.append(difflib.SequenceMatcher(None, text[end : end + CONTEXT][: len(suffix)], suffix).ratio())
    return sum(scores) / len(scores) if scores else 0.0


def _choose(text: str, spans: list[tuple[int, int]], prefix, suffix) -> tuple[int, int] | None:
    """The span whose surroundings fit best; none if several fit alike."""
    if len(spans) == 1:
        return spans[0]
    ranked = sorted(((_context(text, a, b, prefix, suffix), -a, (a, b)) for a, b in spans), reverse=True)
    if not (prefix or suffix) or ranked[0][0] == ranked[1][0]:
        return None
    return ranked[0][2]


def _occurrences(text: str, quote: str) -> list[tuple[int, int]]:
    out, at = [], text.find(quote)
    while at >= 0:
        out.append((at, at + len(quote)))
        at = text.find(quote, at + 1)
    return out


def resolve(text: str, quote: str, prefix: str | None = None, suffix: str | None = None) -> tuple[int, int, float, str] | None:
    """(start, end, confidence, tier), or none for an orphan."""
    if not text or not quote:
        return None
    if spans := _occurrences(text, quote):
        got = _choose(text, spans, prefix, suffix)
        return (*got, 1.0, "exact") if got else None
    flat, at = normalise(text)
    wanted = normalise(quote)[0].strip()
    source = lambda a, b: (at[a], at[b - 1] + 1)
    if wanted and (spans := _occurrences(flat, wanted)):
        got = _choose(text, [source(a, b) for a, b in spans], prefix, suffix)
        return (*got, 0.99, "normalised") if got else None
    words = [(m.start(), m.end()) for m in re.finditer(r"\S+", flat)]
    n = len(wanted.split())
    best: list[tuple[float, int, int]] = []
    m = difflib.SequenceMatcher(None, "", wanted, autojunk=False)  # what it knows of the quote serves all windows
    for first in range(len(words)):
        top = (0.0, 0, 0)
        for size in range(max(1, n - SLACK_WORDS), n + SLACK_WORDS + 1):
            if first + size > len(words):
                break
            a, b = words[first][0], words[first + size - 1][1]
            m.set_seq1(flat[a:b])
            if m.real_quick_ratio() >= LEAST_RATIO and m.quick_ratio() >= LEAST_RATIO:
                top = max(top, (m.ratio(), a, b))
        if top[0] >= LEAST_RATIO:
            best.append(top)
    best.sort(reverse=True)
    if not best:
        return None
    rival = next((x for x in best[1:] if x[1] >= best[0][2] or x[2] <= best[0][1]), None)
    if rival and best[0][0] - rival[0] < RUNNER_UP_GAP:
        return None
    return (*source(best[0][1], best[0][2]), best[0][0], "fuzzy")


#: Characters that a segment of a book owns at least; quotes that travel together; characters of a gram.
SEGMENT, PACK, GRAM = 16_384, 256, 3
_ASKED = "quote_id long, book_id long, quote string, prefix string, suffix string, wanted string"


def _grams(flat: np.ndarray) -> np.ndarray:
    """A 16-bit code for each run of GRAM characters: equal runs have equal codes."""
    c = flat.astype(np.uint64)
    if len(c) < GRAM:
        return np.zeros(0, np.int64)
    mixed = (c[:-2] * np.uint64(1_000_003) + c[1:-1]) * np.uint64(1_000_003) + c[2:]
    return ((mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)


def _segments(spines: DataFrame, margin: int, whole: int) -> DataFrame:
    """A book's normalised text in segments that begin at words, each with what may follow a start in it, and its place in the book.

    A segment owns its first `owned` characters, and the book's characters from `own` to `own_end`; `margin` normalised and
    `whole` book characters follow.  A book's text is normalised once, in the task that reads it.
    """
    schema = "book_id long, flat binary, at binary, owned int, raw string, raw_from long, own long, own_end long"

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for book, text in zip(part.column("book_id"), part.column("text")):
                text = text.as_py()
                if not text:
                    continue
                flat, at = normalised(text)
                size = max(SEGMENT, 2 * margin)
                heads = np.flatnonzero(flat[:-1] == 32) + 1 if len(flat) else np.zeros(0, np.int64)
                firsts = [0]
                while (k := np.searchsorted(heads, firsts[-1] + size)) < len(heads):
                    firsts.append(int(heads[k]))
                ends = [*firsts[1:], len(flat)]
                for first, end in zip(firsts, ends):
                    own = int(at[first]) if first else 0
                    own_end = int(at[end]) if end < len(flat) else len(text)
                    low, high = max(0, own - CONTEXT), own_end + whole + CONTEXT
                    row = [
                        [book.as_py()], [flat[first : end + margin].astype("<u4").tobytes()], [at[first : end + margin].astype("<i8").tobytes()],
                        [end - first], [text[low:high]], [low], [own], [own_end],
                    ]
                    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names=[c.split()[0] for c in schema.split(", ")])

    return spines.select("book_id", "text").mapInArrow(cut, schema)


def _verbatim(segment: dict, asked: list[dict]) -> Iterator[tuple]:
    """(quote_id, tier, score, start, end) of each quote's exact and normalised places that begin in the segment."""
    raw, shift = segment["raw"], segment["raw_from"]
    flat = segment["flat"].decode("utf-32-le", "surrogatepass")
    at = np.frombuffer(segment["at"], "<i8")
    for q in asked:
        exact = [(a, b) for a, b in _occurrences(raw, q["quote"]) if segment["own"] <= a + shift < segment["own_end"]]
        for a, b in exact:
            yield q["quote_id"], "exact", _context(raw, a, b, q["prefix"], q["suffix"]), a + shift, b + shift
        if q["wanted"] and not exact:
            for a, b in _occurrences(flat, q["wanted"]):
                if a < segment["owned"]:
                    start, end = int(at[a]), int(at[b - 1]) + 1
                    yield q["quote_id"], "normalised", _context(raw, start - shift, end - shift, q["prefix"], q["suffix"]), start, end


def _subsequences(wanted: str, at_bits: dict[str, int], text: str, ends: list[int]) -> list[int]:
    """Length of the longest common subsequence of `wanted` and the text up to each of `ends`, which rise: one bit for a character of `wanted`."""
    whole = (1 << len(wanted)) - 1
    bits, out, done = whole, [], 0
    for end in ends:
        for c in text[done:end]:
            if hit := bits & at_bits.get(c, 0):
                bits = ((bits + hit) | (bits - hit)) & whole
        done = end
        out.append(len(wanted) - bits.bit_count())
    return out


def _alike(segment: dict, asked: list[dict]) -> Iterator[tuple]:
    """(quote_id, "fuzzy", ratio, start, end) of the best window at each word that begins in the segment, where one is alike enough.

    A ratio r of two texts of together n characters means matching blocks of r n / 2 characters, and at most (1 - r) n + 1
    blocks, as a character that matches nothing stands between two.  So at least r n / 2 - (GRAM - 1) ((1 - r) n + 1) of a
    window's grams are grams of the quote.  A running count of those, one for a quote, names the windows that are looked at.
    Blocks are a common subsequence, whose length is counted for all windows of a word in one pass; the ratio is taken
    where that is long enough.
    """
    flat = np.frombuffer(segment["flat"], "<u4")
    text = segment["flat"].decode("utf-32-le", "surrogatepass")
    at, codes = np.frombuffer(segment["at"], "<i8"), _grams(flat)
    space = flat == 32
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    ends = np.flatnonzero(~space & np.concatenate([space[1:], [True]])) + 1
    firsts = np.flatnonzero(starts < segment["owned"])
    known = np.zeros(1 << 16, bool)
    for q in asked:
        wanted = q["wanted"]
        if not wanted:
            continue
        own = _grams(np.frombuffer(wanted.encode("utf-32-le", "surrogatepass"), "<u4"))
        known[own] = True
        held = np.concatenate([[0], np.cumsum(known[codes])]) if len(codes) else np.zeros(1, np.int64)
        known[own] = False
        n, compared = len(wanted.split()), []
        for size in range(max(1, n - SLACK_WORDS), n + SLACK_WORDS + 1):
            last = firsts + size - 1
            first = firsts[last < len(ends)]
            a, b = starts[first], ends[first + size - 1]
            both = len(wanted) + b - a
            least = LEAST_RATIO * both / 2 - (GRAM - 1) * ((1 - LEAST_RATIO) * both + 1)
            shared = held[np.maximum(a, np.minimum(b - GRAM + 1, len(held) - 1))] - held[np.minimum(a, len(held) - 1)]
            near = (shared >= least - 1e-6) & (2 * np.minimum(b - a, len(wanted)) >= LEAST_RATIO * both - 1e-6)
            compared += zip(a[near].tolist(), b[near].tolist())
        if not compared:
            continue
        at_bits: dict[str, int] = {}
        for k, c in enumerate(wanted):
            at_bits[c] = at_bits.get(c, 0) | 1 << k
        windows: dict[int, list[int]] = {}
        for a, b in compared:
            windows.setdefault(a, []).append(b)
        m = difflib.SequenceMatcher(None, "", wanted, autojunk=False)  # what it knows of the quote serves all windows
        best: dict[int, tuple[float, int]] = {}
        for a, stops in windows.items():
            for b, common in zip(stops, _subsequences(wanted, at_bits, text[a : stops[-1]], [b - a for b in stops])):
                if 2 * common >= LEAST_RATIO * (len(wanted) + b - a) - 1e-6:
                    m.set_seq1(text[a:b])
                    if (ratio := m.ratio()) >= LEAST_RATIO:
                        best[a] = max(best.get(a, (0.0, 0)), (ratio, b))
        for a, (ratio, b) in best.items():
            yield q["quote_id"], "fuzzy", ratio, int(at[a]), int(at[b - 1]) + 1


_PLACES = "quote_id long, tier string, score double, start long, end long"


def _places(segments: DataFrame, asked: DataFrame, find) -> DataFrame:
    """What `find` gives of each segment and the quotes of its book.

    A book's quotes go together in packs, so that its text travels once for a pack and not for each quote.
    """
    sizes = asked.groupBy("book_id").agg(F.ceil(F.count("*") / PACK).alias("packs"))
    packed = asked.join(sizes, "book_id").withColumn("pack", F.pmod(F.xxhash64("quote_id"), F.col("packs")))
    packs = packed.groupBy("book_id", "pack").agg(F.collect_list(F.struct("quote_id", "quote", "prefix", "suffix", "wanted")).alias("asked"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row in range(part.num_rows):
                segment = {c: part.column(c)[row].as_py() for c in part.schema.names}
                found = list(zip(*find(segment, segment["asked"]))) or [()] * 5
                kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(found, kinds)], names=["quote_id", "tier", "score", "start", "end"])

    rows = segments.join(packs, "book_id").drop("book_id", "pack")
    # A fixed count: quotes are too few bytes for AQE to see the work behind them.
    return rows.repartition(max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))).mapInArrow(run, _PLACES)


def resolve_all(quotes: DataFrame, spines: DataFrame) -> DataFrame:
    """quote_id, start, end, confidence, tier for quotes (quote_id, book_id, quote, prefix, suffix) in spines (book_id, text).

    What `resolve` gives of each quote in its book's text, from segments of the books that all quotes share: first the
    exact and normalised places, then, for quotes without one, the windows that a count of shared grams names.
    Quotes without a place, or with several that fit alike, are orphans.
    """

    def wanted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            flat = [normalise(q)[0].strip() if q else "" for q in part.column("quote").to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(flat, pa.string())], names=[*part.schema.names, "wanted"])

    named = quotes.select(F.col("quote_id").cast("long"), F.col("book_id").cast("long"), "quote", "prefix", "suffix")
    asked = stored(named.where(F.length("quote") > 0).mapInArrow(wanted, _ASKED), "quotes")
    longest = asked.agg(F.max(F.length("wanted")).alias("flat"), F.max(F.length("quote")).alias("whole")).first()
    # A window alike enough is at most 57 / 43 as long as its quote.
    margin, whole = int(1.4 * (longest["flat"] or 0)) + 8, 2 * (longest["whole"] or 0)
    books = spines.select(F.col("book_id").cast("long"), "text").join(asked.select("book_id").distinct(), "book_id", "left_semi")
    segments = stored(_segments(books, margin, whole), "segments")
    verbatim = stored(_places(segments, asked, _verbatim), "verbatim")
    context = asked.select("quote_id", (F.length(F.coalesce("prefix", F.lit(""))) + F.length(F.coalesce("suffix", F.lit(""))) > 0).alias("context"))
    # The exact places of a quote count before its normalised ones; of several the one whose surroundings fit best, if it is the only one.
    exact = verbatim.groupBy("quote_id").agg(F.max(F.col("tier") == "exact").alias("exact"))
    chosen = verbatim.join(exact, "quote_id").where((F.col("tier") == "exact") == F.col("exact"))
    best = chosen.groupBy("quote_id", "tier").agg(F.max(F.struct("score", (-F.col("start")).alias("before"), "start", "end")).alias("best"), F.count("*").alias("n"))
    rivals = chosen.join(best.select("quote_id", F.col("best.score").alias("top")), "quote_id").where("score = top").groupBy("quote_id").agg(F.count("*").alias("rivals"))
    sure = (F.col("n") == 1) | (F.col("context") & (F.col("rivals") == 1))
    placed = best.join(rivals, "quote_id").join(context, "quote_id").where(sure).select(
        "quote_id", "best.start", "best.end", F.when(F.col("tier") == "exact", 1.0).otherwise(0.99).alias("confidence"), "tier"
    )
    left = asked.join(exact, "quote_id", "left_anti")
    fuzzy = stored(_places(segments, left, _alike), "alike")
    top = fuzzy.groupBy("quote_id").agg(F.max(F.struct("score", "start", "end")).alias("best"))
    apart = fuzzy.join(top, "quote_id").where((F.col("start") >= F.col("best.end")) | (F.col("end") <= F.col("best.start")))
    rival = apart.groupBy("quote_id").agg(F.max("score").alias("rival"))
    clear = top.join(rival, "quote_id", "left").where(F.col("rival").isNull() | (F.col("best.score") - F.col("rival") >= RUNNER_UP_GAP))
    found = placed.unionByName(clear.select("quote_id", "best.start", "best.end", F.col("best.score").alias("confidence"), F.lit("fuzzy").alias("tier")))
    rows = quotes.select(F.col("quote_id").cast("long")).join(found.distinct(), "quote_id", "left")
    return rows.select("quote_id", "start", "end", "confidence", F.coalesce("tier", F.lit("orphan")).alias("tier"))


def chunks_for(spans: DataFrame, chunks: DataFrame) -> DataFrame:
    """span_id, id, overlap, pos: passages of the book that a span (book_id, start, end) touches, most overlap first."""
    pairs = touching(spans.select("book_id", "span_id", "start", "end"), chunks.select("book_id", "id", "start", "end"), "book_id")
    overlap = F.least("l.end", "r.end") - F.greatest("l.start", "r.start")
    w = Window.partitionBy("span_id").orderBy(F.desc("overlap"), "id")
    return pairs.select(F.col("l.span_id").alias("span_id"), F.col("r.id").alias("id"), overlap.alias("overlap")).withColumn("pos", F.row_number().over(w))


def quote_words(text):
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]{3,})"), F.lit(1)))


#: Passages whose words are counted together.
TOGETHER = 512


def orphan_candidates(quotes: DataFrame, chunks: DataFrame, k: int = 5) -> DataFrame:
    """quote_id, id, overlap: passages that share most of a quote's words.

    A task counts what its passages share with each block of quotes as a product of noughts and ones, and keeps a quote's best as it
    goes, so that what leaves it doesn't grow with the passages.  Blocks of quotes are files; a task reads them once and holds `k` rows a quote.
    """
    asked = quotes.select(F.col("quote_id").cast("long").alias("id"), quote_words(F.col("quote")).alias("w")).where(F.size("w") > 0)
    asked = asked.select("id", F.size("w").alias("n"), F.array_join("w", " ").alias("w"))
    # A row a block.
    blocks = [tuple(r)[1:] for r in in_files(asked, "q", blocks_of(asked)).orderBy("qb").collect()]

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for place in blocks:
            block = read_block(*place)
            words = [w.split(" ") for w in block["w"]]
            known = sorted({x for w in words for x in w})
            at = {x: i for i, x in enumerate(known)}
            has = np.zeros((len(known), len(words)), np.float32)
            for q, w in enumerate(words):
                has[[at[x] for x in w], q] = 1
            held.append((block, pa.array(known, pa.string()), has, Best(block, k, "hits")))
        for part in parts:
            for low in range(0, part.num_rows, TOGETHER):
                some = part.slice(low, TOGETHER)
                ids, lists = some.column("id").to_numpy(), some.column("w")
                row = np.repeat(np.arange(len(ids)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                flat = lists.flatten()
                for block, known, has, got in held:
                    word = pc.index_in(flat, known).fill_null(-1).to_numpy(zero_copy_only=False)
                    mine = np.zeros((len(ids), len(known)), np.float32)
                    mine[row[word >= 0], word[word >= 0]] = 1
                    # Small whole numbers are exact in single precision.
                    made = kept(block, {"id": ids}, (mine @ has).T.copy(), k, least=1.0)
                    if len(made["id"]):
                        hits = made.pop("similarity")
                        n = block["n"][np.searchsorted(block["id"], made["seed_id"])]
                        got.add(made | {"hits": hits, "n": n.astype(np.int64)})
        for *_, got in held:
            if got.held:
                yield pa.RecordBatch.from_pydict(got.rows())

    rows = chunks.select(F.col("id").cast("long"), quote_words(F.col("text")).alias("w")).where("id is not null")
    found = rows.mapInArrow(count, "seed_id long, id long, hits double, n long")
    w = Window.partitionBy("seed_id").orderBy(F.desc("hits"), "id")
    best = found.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k)
    return best.select(F.col("seed_id").alias("quote_id"), "id", (F.col("hits") / F.col("n")).alias("overlap"), "pos")


#: Note tags with their other names, and the role each has in a search.
TAGS = {
    "anchor": (("anch",), "seed"), "sutra": (("sutrra",), "seed"), "reveal": (("rev",), "pattern"), "assert": ((), "claim"),
    "correlate": (("corr",), "edge"), "chamatkara": (("chamat",), "intensity"), "mythought": (("mythoughts",), "voice"),
    "suggest": ((), "direction"), "action": ((), "task"), "describe": (("des",), "context"),
}
_TYPES = {name: tag for tag, (others, _) in TAGS.items() for name in (tag, *others)}
_MARKER = re.compile(rf"[<(]\s*(/?)\s*({'|'.join(sorted(_TYPES, key=len, reverse=True))})\s*[>)]", re.I)


def parse_note(text: str) -> Iterator[tuple[int, str, str, str, bool, int | None]]:
    """(n, type, role, text, inline, parent) of a note's tagged spans, numbered as they open.

    `<tag>` or `(tag)` opens a span that its closing marker ends, or the note's end; spans inside that
    are still open then are dropped.  An opening marker right after a character other than white space
    is inline and tags its line up to there.  Markers inside a span's text are left out.
    """
    spans: list[dict] = []
    open_: list[int] = []
    for m in _MARKER.finditer(text):
        tag = _TYPES[m[2].lower()]
        if m[1]:
            at = next((k for k in range(len(open_) - 1, -1, -1) if spans[open_[k]]["tag"] == tag), None)
            if at is not None:
                spans[open_[at]]["end"] = m.start()
                del open_[at:]
            continue
        inline = m.start() > 0 and text[m.start() - 1] not in " \t\r\n"
        start, end = (text.rfind("\n", 0, m.start()) + 1, m.start()) if inline else (m.end(), None)
        spans.append({"tag": tag, "start": start, "end": end, "inline": inline, "parent": open_[-1] if open_ else None})
        if not inline:
            open_.append(len(spans) - 1)
    for k in open_:
        spans[k]["end"] = len(text)
    for n, s in enumerate(spans):
        if s["end"] is not None:
            yield n, s["tag"], TAGS[s["tag"]][1], _MARKER.sub("", text[s["start"] : s["end"]]).strip(), s["inline"], s["parent"]


def _holding(short: DataFrame, spines: DataFrame, parts) -> DataFrame:
    """quote_id, quote, book_id of books with a word (or white space) that holds the longest word of a quote.

    Words are looked up in the books' vocabulary, which grows slower than the books, by a part's first three characters.
    """
    longest = F.array_sort(F.transform("w", lambda x: F.struct((-F.length(x)).alias("less"), x.alias("word"))))
    part = F.when(F.size("w") > 0, F.try_element_at(longest, F.lit(1))["word"]).otherwise(F.col("quote"))
    asked = short.select("quote_id", "quote", part.alias("part")).withColumn("gram", F.substring("part", 1, 3))
    gaps = F.regexp_extract_all("text", F.lit(r"(\s+)"), F.lit(1))
    held = spines.select("book_id", F.explode(F.array_distinct(F.concat(parts("text"), gaps))).alias("word")).distinct()

    def grams(n: int):
        # `substr` past the end gives fewer characters, which the filter takes out.
        cut = F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.substr(F.col("word"), i, F.lit(n)))
        return F.filter(cut, lambda g: F.length(g) == n)

    vocabulary = held.where("word <> ''").select("word").distinct()
    vocabulary = vocabulary.select("word", F.explode(F.array_distinct(F.concat(grams(1), grams(2), grams(3)))).alias("gram"))
    words = asked.join(vocabulary, "gram").where(F.contains("word", "part")).select("quote_id", "quote", "word")
    return words.join(held, "word").select("quote_id", "quote", "book_id")


#: What `\\s` is; bytes of text whose words are hashed together; odd multipliers of bytes, of words and of keys.
_SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\x0b\f\r", np.uint8))
HASHED, _BYTE, _WORD, _MIX = 1 << 20, 0x100000001B3, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Bits of the table of keys that are asked for, and of a row of it.
KEY_BITS, ROW_BITS = 24, 15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _run_keys(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of each run of `words` words of the texts; equal runs have equal keys.

    A word's hash is a polynomial in its bytes modulo 2^64: the difference of two running sums, brought to the word's start by
    the inverse of an odd power.
    """
    if not len(texts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    inner, edge = ~_SPACE[data], np.zeros(len(data) + 1, bool)
    edge[at] = True
    starts = np.flatnonzero(inner & (edge[:-1] | ~np.concatenate([[False], inner[:-1]])))
    ends = np.flatnonzero(inner & (edge[1:] | ~np.concatenate([inner[1:], [False]]))) + 1
    if len(starts) < words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes, first = np.zeros(len(starts), np.uint64), 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + HASHED, "right")))
        low, high = starts[first], ends[last - 1]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data[low:high] + np.uint64(1)) * _powers(_BYTE, high - low), dtype=np.uint64)])
        back = _powers(pow(_BYTE, -1, 1 << 64), high - low)
        hashes[first:last] = (sums[ends[first:last] - low] - sums[starts[first:last] - low]) * back[starts[first:last] - low]
        first = last
    # Words of few letters are few numbers: mixed before they are added up.
    hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(_MIX)
    row = np.searchsorted(at, starts, "right") - 1
    n = len(starts) - words + 1
    key = np.zeros(n, np.uint64)
    for k in range(words):
        key = (key + hashes[k : k + n]) * np.uint64(_WORD)
    key = (key ^ (key >> np.uint64(32))) * np.uint64(_MIX)
    mine = row[:n] == row[words - 1 :]
    return row[:n][mine], key[mine].view(np.int64)


def _keyed(df: DataFrame, keep: str, text: str, words: int, wanted: np.ndarray | None = None) -> DataFrame:
    """`keep` and key of the distinct runs of words in `text`; with `wanted`, a table of bits, only those that may be asked for."""

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            row, key = _run_keys(part.column(1), words)
            if wanted is not None:
                bit = (key.view(np.uint64) >> np.uint64(64 - KEY_BITS)).astype(np.int64)
                asked = (wanted[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
                row, key = row[asked], key[asked]
            order = np.lexsort((key, row))
            row, key = row[order], key[order]
            new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (key[1:] != key[:-1])])[: len(row)])
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row[new])), pa.array(key[new])], names=[keep, "key"])

    kind = df.schema[keep].dataType.simpleString()
    return df.select(keep, text).mapInArrow(cut, f"`{keep}` {kind}, key long")


def _bits(keyed: DataFrame) -> np.ndarray:
    """A table of 2^KEY_BITS bits of the keys there are; the driver sees at most as many rows of it as there are, of 4 KB."""
    bit = F.shiftrightunsigned("key", 64 - KEY_BITS)
    rows = keyed.groupBy(F.shiftright(bit, ROW_BITS).alias("r")).agg(F.bitmap_construct_agg(F.pmod(bit, F.lit(1 << ROW_BITS))).alias("bits")).collect()
    out = np.zeros((1 << KEY_BITS - ROW_BITS, 1 << ROW_BITS - 3), np.uint8)
    for r in rows:
        out[r["r"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def contained(quotes: DataFrame, spines: DataFrame, words: int = 6) -> DataFrame:
    """quote_id, book_id, hits of every spine that holds a quote verbatim.

    All but a quote's outer words are whole words of the spine, so runs of `words` of them are an
    equi-join key; shorter quotes are looked up by the words that hold their longest one.  Runs whose key no quote has are
    left out where texts are read, by a table of bits of fixed size.  The text is compared only where a key agrees.
    Repeated rows of a quote count once; null and empty quotes or texts give none.
    """
    parts = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    q = quotes.where(F.length("quote") > 0).withColumn("w", parts("quote"))
    long = q.where(F.size("w") >= words + 2).select("quote", F.array_join(F.slice("w", 2, words), " ").alias("inner")).distinct()
    long = stored(_keyed(long, "quote", "inner", words), "quote-keys")
    keyed = _keyed(spines.select("book_id", "text"), "book_id", "text", words, _bits(long))
    pairs = keyed.join(long, "key").join(quotes.select("quote_id", "quote"), "quote").select("quote_id", "quote", "book_id")
    short = q.where(F.size("w") < words + 2).select("quote_id", "quote", "w")
    # The vocabulary is only built for quotes that need it.
    if not short.isEmpty():
        pairs = pairs.unionByName(_holding(short, spines.select("book_id", "text"), parts))
    found = pairs.distinct().join(spines.select("book_id", "text"), "book_id").where(F.contains("text", "quote"))
    hits = (F.length("text") - F.length(F.replace("text", F.col("quote"), F.lit("")))) / F.length("quote")
    return found.select("quote_id", "book_id", hits.cast("long").alias("hits"))


def detected_books(quotes: DataFrame, spines: DataFrame) -> DataFrame:
    """import_id, book_id, hits, weight: the book that holds most of an import's quotes (import_id, quote_id, quote).

    Quotes and books are compared in small letters, white space as one space.  Ties go to the most characters found, then to the
    smallest book.  An import none of whose quotes is found has no row.
    """
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    asked = quotes.select("import_id", plain("quote").alias("quote")).where("quote <> ''")
    each = stored(asked.select("quote").distinct().withColumn("quote_id", F.xxhash64("quote")), "distinct-quotes")
    held = contained(each, spines.select("book_id", plain("text").alias("text"))).join(each, "quote_id").select("quote", "book_id")
    scored = asked.join(held, "quote").groupBy("import_id", "book_id").agg(F.count("*").alias("hits"), F.sum(F.length("quote")).alias("weight"))
    best = F.max(F.struct("hits", "weight", (-F.col("book_id")).alias("before"))).alias("b")
    return scored.groupBy("import_id").agg(best).select("import_id", (-F.col("b.before")).alias("book_id"), "b.hits", "b.weight")
