"""Annotations: anchored creation, imports, lists, sparks kept or dismissed, and where marks lie.

An annotation has annotation_id, book_id, target, source, origin, quote, note, chunk_ids, start, end,
confidence, approximate and orphaned.  Nulls: a null source is the reader's, a null quote is an orphan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandweave.functions.text import fingerprint
from strandweave.operators import anchors
from strandweave.shared import stored

CONTEXT = 32
PAGE_OF_MARKDOWN, PAGE_OF_SIDECAR = -1, -2


def anchored(quotes: DataFrame, spines: DataFrame, chunks: DataFrame) -> DataFrame:
    """The quotes' rows with target, chunk_ids, start, end, confidence, approximate, orphaned.

    `quotes` has quote_id, book_id, quote, prefix, suffix; `chunks` has book_id, id, start, end.  A quote
    that isn't found is an orphan, whose target is its book; it is never dropped.
    """
    found = anchors.resolve_all(quotes.select("quote_id", "book_id", "quote", "prefix", "suffix"), spines)
    spans = found.where("start is not null").join(quotes.select("quote_id", "book_id"), "quote_id").withColumnRenamed("quote_id", "span_id")
    touched = anchors.chunks_for(spans.select("span_id", "book_id", "start", "end"), chunks)
    # A span touches the few passages it lies in.
    lists = touched.groupBy("span_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("chunk_ids"))
    rows = quotes.join(found, "quote_id").join(lists.withColumnRenamed("span_id", "quote_id"), "quote_id", "left")
    home = F.concat(F.lit("book:"), F.col("book_id").cast("string"))
    return rows.withColumns(
        {
            "orphaned": F.col("start").isNull(), "approximate": F.coalesce(F.col("confidence") < 1, F.lit(False)), "confidence": F.round("confidence", 4),
            "target": F.coalesce(F.get("chunk_ids", F.lit(0)).cast("string"), home),
        }
    ).drop("tier")


def with_hash(pairs: DataFrame, page: int) -> DataFrame:
    """Imported pairs (book_id, quote, note) with the content_hash that tells a second import from a new quote."""
    return pairs.withColumn("content_hash", fingerprint(F.col("book_id"), F.lit(page), F.col("quote"), F.col("note")))


def import_report(pairs: DataFrame, known: DataFrame, spines: DataFrame, chunks: DataFrame, page: int = PAGE_OF_MARKDOWN) -> DataFrame:
    """book_id, imported, orphaned, duplicate, total of pairs (quote_id, book_id, quote, note).

    A pair whose hash `known` (content_hash) has, or an earlier pair of the import, is a duplicate.
    """
    hashed = with_hash(pairs, page)
    first = Window.partitionBy("content_hash").orderBy("quote_id")
    marked = hashed.withColumn("again", F.row_number().over(first) > 1).join(known.select("content_hash", F.lit(True).alias("held")).distinct(), "content_hash", "left")
    # Written, as it is what is resolved and what is counted.
    marked = stored(marked, "import-marked")
    fresh = marked.where(~F.col("again") & F.col("held").isNull()).select("quote_id", "book_id", "quote", F.lit(None).cast("string").alias("prefix"), F.lit(None).cast("string").alias("suffix"))
    made = anchored(fresh, spines, chunks).select("quote_id", "orphaned")
    both = marked.select("quote_id", "book_id").join(made, "quote_id", "left")
    n = lambda c: F.sum(c.cast("int")).cast("long")
    return both.groupBy("book_id").agg(
        n(F.coalesce(~F.col("orphaned"), F.lit(False))).alias("imported"), n(F.coalesce("orphaned", F.lit(False))).alias("orphaned"),
        n(F.col("orphaned").isNull()).alias("duplicate"), F.count("*").alias("total"),
    )


def migrated(annotations: DataFrame, spines: DataFrame, chunks: DataFrame) -> DataFrame:
    """Annotations without a selector (null start), but with a quote, anchored: quote_id and `anchored`'s columns.  The book is the target's, if none is told."""
    book = F.coalesce("book_id", F.regexp_extract("target", "^([^#]*)#", 1).cast(spines.schema["book_id"].dataType))
    asked = annotations.where(F.col("start").isNull() & (F.col("quote") != "")).select(F.col("annotation_id").alias("quote_id"), book.alias("book_id"), "quote", "prefix", "suffix")
    return anchored(asked, spines, chunks)


def listed(annotations: DataFrame, **wanted) -> DataFrame:
    """Annotations by any of target, source, passage_id, book_id, origin, orphaned; without a source they are the reader's."""
    for name, value in wanted.items():
        own: Column = F.coalesce("source", F.lit("reader")) if name == "source" else F.coalesce("orphaned", F.lit(False)) if name == "orphaned" else F.col(name)
        annotations = annotations.where(own.eqNullSafe(F.lit(value)))
    return annotations


def of_books(annotations: DataFrame) -> DataFrame:
    """annotation_id, book_id, pos: each book's annotations, its own or those on its passages, by target and time of creation."""
    book = F.coalesce(F.col("book_id"), F.regexp_extract("target", "^([^#]*)#", 1))
    w = Window.partitionBy("book").orderBy("target", "created", "annotation_id")
    return annotations.withColumn("book", book).select("annotation_id", F.col("book").alias("book_id"), F.row_number().over(w).alias("pos"))


def mark_targets(marks: DataFrame, chunks: DataFrame) -> DataFrame:
    """mark_id, id: the passage a mark lies on: the first of its chunk_ids there is, else its target, else its passage_id."""
    known = chunks.select("id").distinct()
    ids = marks.select("mark_id", F.posexplode("chunk_ids").alias("k", "id")).join(known, "id", "left_semi")
    first = ids.groupBy("mark_id").agg(F.min(F.struct("k", "id"))["id"].alias("first"))
    there = lambda c: known.select(F.col("id").alias(c), F.col("id").alias(f"{c}_id"))
    rows = marks.select("mark_id", "target", "passage_id").join(first, "mark_id", "left").join(there("target"), "target", "left").join(there("passage_id"), "passage_id", "left")
    return rows.select("mark_id", F.coalesce("first", "target_id", "passage_id_id").alias("id")).where("id is not null")


def sparks(actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(annotations, labels) of a reader's keep or dismiss of candidate passages (book_id, passage_id, action, evidence).

    A kept one becomes a note and a positive label, a dismissed one a negative label; other actions and rows without a passage are left out.
    """
    good = actions.where(F.col("action").isin("keep", "dismiss") & F.col("passage_id").isNotNull())
    note = F.concat(F.lit("Reading rhythm drew you here — "), F.coalesce("evidence", F.lit("")))
    kept = good.where("action = 'keep'").select("book_id", F.col("passage_id").alias("target"), "passage_id", F.lit("note").alias("kind"), note.alias("note"), F.lit("spark").alias("source"))
    return kept, good.select("book_id", "passage_id", (F.col("action") == "keep").cast("int").alias("label"), "evidence")


def selection_anchor(spans: DataFrame, spines: DataFrame, context: int = CONTEXT) -> DataFrame:
    """span_id, quote, prefix, suffix of selected spans (span_id, book_id, start, end), with `context` characters on each side."""
    rows = spans.join(spines.select("book_id", "text"), "book_id")
    before = F.greatest(F.lit(0), F.col("start") - context)
    cut = lambda a, b: F.col("text").substr((a + 1).cast("int"), (b - a).cast("int"))
    return rows.select("span_id", cut(F.col("start"), F.col("end")).alias("quote"), cut(before, F.col("start")).alias("prefix"), cut(F.col("end"), F.col("end") + context).alias("suffix"))


def book_rows(units: DataFrame) -> DataFrame:
    """book_id, pos, id, n_chunks: a book's passages in order, each with their number in the book."""
    w = Window.partitionBy("book_id")
    return units.select("book_id", F.row_number().over(w.orderBy("id")).alias("pos"), "id", F.count("*").over(w).alias("n_chunks"))
