"""Text to units: blocks, greedy passages, offsets, parents, sentences, sections, contents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandweave.functions.text import bag, boilerplate, word_count
from strandweave.shared import stored

TARGET, OVERLAP, LEAST = 240, 40, 60
PARENT_TARGET, PARENT_OVERLAP, SECTION_WORDS = 500, 60, 1000


def blocks(books: DataFrame, separator: str = r"\n\s*\n") -> DataFrame:
    """book_id, pos, kind (para, heading or page), text, words of columns book_id, text."""
    parts = books.select("book_id", F.posexplode(F.split("text", separator)).alias("pos", "raw"))
    text = F.trim(F.regexp_replace("raw", r"^\s+|\s+$", ""))
    kind = (
        F.when(text.rlike(r"^<!--\s*page\s+\d+\s*-->$") & (F.length(text) < 40), "page")
        .when(text.rlike(r"^#{1,6} [^\n]*$"), "heading")
        .otherwise("para")
    )
    return parts.select("book_id", "pos", kind.alias("kind"), text.alias("text")).where("text != ''").withColumn("words", word_count(F.col("text")))


def accumulate(paras: list[tuple[str, int, str]], target: int, overlap: int, least: int) -> Iterator[tuple[list[str], str | None, int | None]]:
    """(paragraphs, heading, page) of greedy passages over (kind, words, text); every cut carries a tail of `overlap` words over.

    The page is the one that holds the buffer's start, or the first one marked after it.
    """
    held: list[tuple[int, str]] = []
    heading = page = first_page = None

    def size() -> int:
        return sum(w for w, _ in held)

    def made() -> list[tuple[list[str], str | None, int | None]]:
        return [([t for _, t in held], heading, first_page)] if size() >= least else []

    def carry() -> None:
        nonlocal held, first_page
        keep, words = len(held), 0
        while keep and overlap and words < overlap:
            keep -= 1
            words += held[keep][0]
        held, first_page = held[keep:], page

    for kind, words, text in paras:
        if kind == "page":
            page = int("".join(c for c in text if c.isdigit()))
        first_page = page if first_page is None else first_page
        if kind == "para":
            held.append((words, text))
        if kind != "page" and size() >= (target if kind == "para" else target // 2):
            yield from made()
            carry()
        if kind == "heading":
            heading = text.lstrip("#").strip()
    yield from made()


def passages(books: DataFrame, separator: str = r"\n\s*\n", target: int = TARGET, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """book_id, n, heading, page, words, start, end, text: greedy passages that aren't boilerplate, with offsets in the book.

    A book is one group: the state is sequential, and a book is the bound of its memory.
    """
    schema = "book_id long, n int, heading string, page int, words int, start long, end long, text string"

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        split = re.compile(separator)
        for pdf in parts:
            rows = []
            for book, text in zip(pdf["book_id"], pdf["text"]):
                if not text:
                    continue
                paras = []
                for raw in split.split(text):
                    t = raw.strip()
                    if t:
                        page, head = re.fullmatch(r"<!--\s*page\s+\d+\s*-->", t), re.fullmatch(r"#{1,6} [^\n]*", t)
                        paras.append(("page" if page else "heading" if head else "para", len(t.split()), t))
                cursor = 0
                made = accumulate(paras, target, overlap, least)
                for n, (texts, heading, page) in enumerate(m for m in made if not boilerplate("\n\n".join(m[0]))):
                    start = text.find(texts[0], cursor)
                    start = text.find(texts[0]) if start < 0 else start
                    last = text.find(texts[-1], start)
                    end = last + len(texts[-1]) if last >= 0 else None
                    cursor = start + 1
                    rows.append((book, n, heading, page, sum(len(t.split()) for t in texts), start, end, "\n\n".join(texts)))
            made = pd.DataFrame(rows, columns=["book_id", "n", "heading", "page", "words", "start", "end", "text"])
            yield made.astype({"page": "Int32"})

    return books.select("book_id", "text").mapInPandas(cut, schema)


def sentences(units: DataFrame, least_words: int = 5) -> DataFrame:
    """book_id, id, n, text: sentences of at least `least_words` words, numbered in each book, in the order of the units' `n` if they have one."""
    number = [F.col("n").alias("unit_n")] if "n" in units.columns else []
    parts = units.select("book_id", "id", *number, F.posexplode(F.split("text", r"(?<=[.!?])\s+(?=[A-Z\"'(])")).alias("pos", "text"))
    good = parts.where(word_count(F.col("text")) >= least_words)
    order = [c for c in ("unit_n", "id", "pos") if c in good.columns]
    w = Window.partitionBy("book_id").orderBy(*order)
    return good.select("book_id", "id", (F.row_number().over(w) - 1).alias("n"), "text")


def link_parents(children: DataFrame, parents: DataFrame) -> DataFrame:
    """id, parent_id, overlap: the parent of the same book that holds most of the child's words (ties to the first, by `n` if it has one)."""
    c = children.select("book_id", "id", bag(F.col("text")).alias("words")).where(F.size("words") > 0)
    p = parents.select("book_id", F.col("id").alias("parent_id"), bag(F.col("text")).alias("parent_words"), (F.col("n") if "n" in parents.columns else F.lit(0)).alias("parent_n"))
    share = F.size(F.array_intersect("words", "parent_words")) / F.size("words")
    w = Window.partitionBy("id").orderBy(F.desc("overlap"), "parent_n", "parent_id")
    pairs = c.join(p, "book_id").withColumn("overlap", share).where("overlap > 0")
    return pairs.withColumn("r", F.row_number().over(w)).where("r = 1").select("id", "parent_id", "overlap")


def parents_of(units: DataFrame, children: DataFrame, parents: DataFrame) -> DataFrame:
    """seed_id, pos, id, level: for each seed's units (seed_id, pos, id), the parents they belong to, each once, in order.

    `children` has id, parent_id of propositions and passages; `parents` has the parents' ids.  A proposition
    leads to its passage and that to its parent; a unit without one stands for itself.
    """
    up = lambda key, to: children.select(F.col("id").alias(key), F.col("parent_id").alias(to))
    one = units.select("seed_id", "pos", "id").join(up("id", "first"), "id", "left")
    two = one.join(up("first", "second"), "first", "left")
    top = F.coalesce("second", "first", "id")
    found = two.groupBy("seed_id", top.alias("id")).agg(F.min("pos").alias("first_pos"))
    known = parents.select("id", F.lit("parent").alias("level"))
    w = Window.partitionBy("seed_id").orderBy("first_pos", "id")
    return found.join(known, "id", "left").select("seed_id", F.row_number().over(w).alias("pos"), "id", F.coalesce("level", F.lit("unit")).alias("level"))


#: Units of a book that are folded together.
CHUNK_UNITS = 4096
#: (words, cosines) to the least number of words held that ends a run before each unit; it doesn't fall as more are held.
Need = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _folded(words: np.ndarray, need: np.ndarray) -> tuple[list[float], list[int], list[int]]:
    """What a chunk of units does to the words held before it: (least held, cuts, words held after) for each way it can go.

    The words held decide only where the first cut falls: at the first unit that needs no more.  Further on all that
    counts is where that cut was, and such paths soon meet.
    """
    upto = np.concatenate([[0], np.cumsum(words)])
    size, known = len(words), {}

    def follow(at: int) -> tuple[int, int]:
        path = []
        while at not in known:
            path.append(at)
            k = at + 1
            while k < size and upto[k] - upto[at] < need[k]:
                k += 1
            if k == size:
                known[at] = (1, int(upto[size] - upto[at]))
                path.pop()
                break
            at = k
        cuts, held = known[at]
        for own in reversed(path):
            cuts += 1
            known[own] = (cuts, held)
        return cuts, held

    least, steps = np.inf, []
    for at, wanted in enumerate((need - upto[:-1]).tolist()):
        if wanted < least:
            least = wanted
            steps.append((least, *follow(at)))
            if least <= 0:
                break
    return [s[0] for s in steps], [s[1] for s in steps], [s[2] for s in steps]


def _chunked(need: Need):
    """Sorted units to chunks of one book: their ids and words, and what they do to the words held."""

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        held: list[tuple] = []
        book, made, task = None, 0, TaskContext.get().partitionId()

        def close() -> None:
            nonlocal made
            if held:
                words, cosines = np.array([h[1] or 0 for h in held], np.int64), np.array([np.nan if h[2] is None else h[2] for h in held], np.float64)
                wanted = np.asarray(need(words, cosines), np.float64)
                least, cuts, after = _folded(words, wanted)
                rows.append({"chunk": (task << 33) + made, "ids": [h[0] for h in held], "words": words.tolist(), "need": wanted.tolist(), "least": least, "cuts": cuts, "after": after, "book_id": book})
                made += 1
                held.clear()

        for part in parts:
            for b, *row in zip(*(part.column(c).to_pylist() for c in ("book_id", "id", "words", "cosine"))):
                if b != book or len(held) >= CHUNK_UNITS:
                    close()
                    book = b
                held.append(tuple(row))
            if len(rows) >= 64:
                yield from _chunk_rows(rows, part.schema)
        close()
        if rows:
            yield from _chunk_rows(rows, part.schema)

    return cut


def _chunk_rows(rows: list[dict], shape: pa.Schema) -> Iterator[pa.RecordBatch]:
    ids, book = shape.field("id").type, shape.field("book_id").type
    kinds = [("chunk", pa.int64()), ("ids", pa.list_(ids)), ("words", pa.list_(pa.int64())), ("need", pa.list_(pa.float64())), ("least", pa.list_(pa.float64())), ("cuts", pa.list_(pa.int64())), ("after", pa.list_(pa.int64())), ("book_id", book)]
    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds))
    rows.clear()


def _chained(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted chunks to the words held, and the number of runs closed, before each."""
    book, held, section, fresh = None, 0, 0, True
    for part in parts:
        out = []
        for b, least, cuts, after, total in zip(*(part.column(c).to_pylist() for c in ("book_id", "least", "cuts", "after", "total"))):
            if fresh or b != book:
                book, held, section, fresh = b, 0, 0, False
            out.append((held, section))
            way = next((k for k, x in enumerate(least) if x <= held), None)
            held, section = (held + total, section) if way is None else (after[way], section + cuts[way])
        yield pa.RecordBatch.from_arrays([part.column("chunk"), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64())], names=["chunk", "held", "section"])


def numbered_runs(units: DataFrame, need: Need) -> DataFrame:
    """book_id, id, words, section: the number in its book of the run that each unit (book_id, id, words, cosine) falls in.

    A run ends before the unit at which it holds `need` words, which is over nought.  Units are dealt by ranges of (book, id), so that a book is as many
    chunks as its size asks for; a pass over chunks, a few numbers each, tells what each begins with.
    """
    rows = units.select("book_id", "id", "words", "cosine")
    book, key = (rows.schema[c].dataType.simpleString() for c in ("book_id", "id"))
    shape = f"chunk long, ids array<{key}>, words array<long>, need array<double>, least array<double>, cuts array<long>, after array<long>, book_id {book}"
    chunks = stored(rows.repartitionByRange("book_id", "id").sortWithinPartitions("book_id", "id").mapInArrow(_chunked(need), shape), "unit-chunks")
    first = F.get("ids", F.lit(0)).alias("first")
    small = chunks.select("chunk", "book_id", first, "least", "cuts", "after", F.aggregate("words", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))
    before = small.repartition("book_id").sortWithinPartitions("book_id", "first", "chunk").mapInArrow(_chained, "chunk long, held long, section long")

    def number(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for b, ids, words, wanted, held, section in zip(part.column("book_id"), *(part.column(c).to_pylist() for c in ("ids", "words", "need", "held", "section"))):
                numbers = []
                for w, n in zip(words, wanted):
                    if held >= n:
                        held, section = 0, section + 1
                    held += w
                    numbers.append(section)
                shape_ = part.schema.field("ids").type.value_type
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b.as_py()] * len(ids), b.type), pa.array(ids, shape_), pa.array(words, pa.int32()), pa.array(numbers, pa.int32())], names=["book_id", "id", "words", "section"]
                )

    return chunks.join(before, "chunk").mapInArrow(number, f"book_id {book}, id {key}, words int, section int")


def _runs(numbered: DataFrame) -> DataFrame:
    return numbered.groupBy("book_id", "section").agg(
        F.count("*").alias("n_units"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.sum("words").alias("words")
    )


def section_numbers(units: DataFrame, words_each: int = SECTION_WORDS) -> DataFrame:
    """book_id, id, words, section: the section, of at least `words_each` words, that each passage falls in."""
    counted = units.select("book_id", "id", word_count(F.col("text")).alias("words"), F.lit(None).cast("double").alias("cosine"))
    return numbered_runs(counted, lambda words, cosine: np.full(len(words), float(words_each)))


def sections(units: DataFrame, words_each: int = SECTION_WORDS) -> DataFrame:
    """book_id, section, n_units, first_id, last_id, words: runs of passages of at least `words_each` words."""
    return _runs(section_numbers(units, words_each))


def section_heads(units: DataFrame, words_each: int = SECTION_WORDS) -> DataFrame:
    """book_id, section, heading (the first that isn't empty), page_start, page_end of units (book_id, id, text, heading, page)."""
    placed = section_numbers(units, words_each).select("book_id", "id", "section").join(units.select("book_id", "id", "heading", "page"), ["book_id", "id"])
    first = F.min(F.when(F.trim("heading") != "", F.struct("id", "heading")))["heading"]
    return placed.groupBy("book_id", "section").agg(F.coalesce(first, F.lit("")).alias("heading"), F.min("page").alias("page_start"), F.max("page").alias("page_end"))


def section_texts(units: DataFrame, words_each: int = SECTION_WORDS) -> DataFrame:
    """book_id, section, text: a section's passages joined by blank lines.  A section ends with the unit that fills it."""
    placed = section_numbers(units, words_each).select("book_id", "id", "section").join(units.select("book_id", "id", "text"), ["book_id", "id"])
    parts = placed.groupBy("book_id", "section").agg(F.array_sort(F.collect_list(F.struct("id", "text"))).alias("parts"))
    return parts.select("book_id", "section", F.concat_ws("\n\n", F.col("parts.text")).alias("text"))


def semantic_passages(units: DataFrame, threshold: float = 0.55, target: int = TARGET, least: int = LEAST) -> DataFrame:
    """Runs of units (book_id, id, vec, words) cut where neighbours are unlike and enough words are held, or where a run is full."""
    near = semantic_cuts(units, threshold).select("id", "cosine")
    rows = units.select("book_id", "id", "words").join(near, "id", "left")
    return _runs(numbered_runs(rows, lambda words, cosine: np.where(cosine < threshold, min(least, target), target)))


def neighbours(units: DataFrame, clip: int = 240) -> DataFrame:
    """id, prev_id, next_id and the neighbours' first `clip` characters, within the book."""
    w = Window.partitionBy("book_id").orderBy("id")
    part = lambda c: F.substring(c, 1, clip)
    return units.select(
        "id", F.lag("id").over(w).alias("prev_id"), F.lead("id").over(w).alias("next_id"),
        part(F.lag("text").over(w)).alias("prev_text"), part(F.lead("text").over(w)).alias("next_text"),
    )


def contents(units: DataFrame, heading: str = "heading", page: str | None = None, stride: int = 25) -> DataFrame:
    """book_id, id, title: a book's table of contents.

    Where three passages or more have a heading, those whose heading is another than the last one's, every
    n-th of them if they are over 300; else, where three have a page, those at least five pages on; else
    every `stride`-th passage.  Empty headings count as none.
    """
    w, whole = Window.partitionBy("book_id").orderBy("id"), Window.partitionBy("book_id")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    title = F.when(F.trim(heading) != "", F.trim(heading))
    number = F.col(page).cast("int") if page else F.lit(None).cast("int")
    marked = units.select("book_id", "id", title.alias("title"), number.alias("page"), (F.row_number().over(w) - 1).alias("place"))
    turned = marked.select(
        "*", F.coalesce(F.col("title") != F.last("title", True).over(before), F.col("title").isNotNull()).alias("turn"),
        F.count("title").over(whole).alias("titled"), F.count("page").over(whole).alias("paged"),
    )
    turned = turned.select("*", F.sum(F.col("turn").cast("int")).over(whole).alias("turns"), F.sum(F.col("turn").cast("int")).over(w).alias("turn_no"))
    step = F.when(F.col("turns") > 300, F.greatest(F.lit(1), F.floor(F.col("turns") / 120))).otherwise(F.lit(1))
    by_title = turned.where("titled >= 3").where(F.col("turn") & ((F.col("turn_no") - 1) % step == 0)).select("book_id", "id", "title")
    by_place = turned.where((F.col("titled") < 3) & (F.col("paged") < 3) & (F.col("place") % stride == 0))
    by_place = by_place.select("book_id", "id", F.concat(F.lit("Passage "), (F.col("place") + 1).cast("string")).alias("title"))
    every = by_title.unionByName(by_place)
    if page is None:
        return every

    def strides(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, last = None, None
        for part in parts:
            keep = []
            for b, p in zip(part.column("book_id").to_pylist(), part.column("page").to_pylist()):
                if b != book:
                    book, last = b, None
                keep.append(last is None or p - last >= 5)
                last = p if keep[-1] else last
            yield part.filter(pa.array(keep, pa.bool_()))

    paged = turned.where((F.col("titled") < 3) & (F.col("paged") >= 3) & F.col("page").isNotNull()).select("book_id", "id", "page")
    by_page = paged.repartition("book_id").sortWithinPartitions("book_id", "id").mapInArrow(strides, paged.schema)
    return every.unionByName(by_page.select("book_id", "id", F.concat(F.lit("Page "), F.col("page").cast("string")).alias("title")))


def semantic_cuts(vectors: DataFrame, threshold: float = 0.55) -> DataFrame:
    """id, cosine to the unit before it in its book, and whether a passage is cut there."""
    w = Window.partitionBy("book_id").orderBy("id")
    dot = F.aggregate(F.zip_with("vec", "before", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    rows = vectors.withColumn("before", F.lag("vec").over(w)).where("before is not null")
    return rows.select("id", F.round(dot, 6).alias("cosine"), (dot < threshold).alias("cut"))
