"""What surrounds the engines: injected model callables with a cache, contexts, notes, reader views, a flat map.

Callables take and give lists of one batch; they run on executors, so they must be picklable.  Null
texts are left out of what a model sees and get a null value; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandweave import shared
from strandweave.operators.anchors import parse_note

#: The highlight colours and their red, green and blue shares.
PALETTE = {
    "amber": (0.957, 0.851, 0.545),
    "rose": (0.949, 0.722, 0.690),
    "sage": (0.737, 0.839, 0.675),
    "sky": (0.663, 0.796, 0.878),
    "violet": (0.792, 0.737, 0.878),
}
NO_COLOUR = "amber"


def free_name(df: DataFrame, name: str) -> str:
    """A name like `name` that no column of `df` has."""
    return shared.free_name(df.columns, name)


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def pending(units: DataFrame, cache: DataFrame) -> DataFrame:
    """hash, text: each different text of `units` that `cache` (hash, value) lacks."""
    asked = units.where(F.col("text").isNotNull()).select(content_hash(F.col("text")).alias("hash"), "text").dropDuplicates(["hash"])
    return asked.join(cache.select("hash"), "hash", "left_anti")


def answered(rows: DataFrame, call: Callable[[list[str]], list[str]]) -> DataFrame:
    """hash, value: what the model says of each text."""

    def ask(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if part.num_rows:
                value = pa.array(call(part.column("text").to_pylist()), pa.string())
                yield pa.RecordBatch.from_arrays([part.column("hash"), value], names=["hash", "value"])

    return rows.select("hash", "text").mapInArrow(ask, "hash string, value string")


def enrich(units: DataFrame, cache: DataFrame, call: Callable[[list[str]], list[str]]) -> DataFrame:
    """`units` with the model's value of their text: one call for each different text that isn't cached.

    A column `value` of the caller's gives way; any other name passes through.
    """
    units = units.drop("value")
    known = cache.select("hash", "value").unionByName(answered(pending(units, cache), call))
    key = free_name(units, "hash")
    keyed = units.withColumn(key, content_hash(F.col("text")))
    return keyed.join(known.withColumnRenamed("hash", key), key, "left").drop(key)


def contextual(blurb: Column, text: Column) -> Column:
    """The blurb above the text, or the text alone."""
    return F.when(F.coalesce(blurb, F.lit("")) != "", F.concat_ws("\n", blurb, text)).otherwise(text)


def confirmed(picks: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Picks that the verdicts (seed_id, id, connected, forced_risk, confidence) hold genuine, surest first."""
    good = verdicts.where(F.col("connected") & (F.col("forced_risk") != "high")).select("seed_id", "id", "forced_risk", "confidence")
    order = Window.partitionBy("seed_id").orderBy(F.desc("confidence"), "before")
    both = picks.withColumnRenamed("pos", "before").join(good, ["seed_id", "id"])
    return both.withColumn("pos", F.row_number().over(order)).drop("before")


def judge(pairs: DataFrame, call: Callable[[list[str], list[str]], list[tuple[bool, str, float]]]) -> DataFrame:
    """seed_id, id, connected, forced_risk, confidence of pairs (seed_id, id, seed_text, text)."""

    def ask(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            said = call(part["seed_text"].tolist(), part["text"].tolist())
            yield part[["seed_id", "id"]].assign(connected=[s[0] for s in said], forced_risk=[s[1] for s in said], confidence=[s[2] for s in said])

    schema = "seed_id long, id long, connected boolean, forced_risk string, confidence double"
    return pairs.select("seed_id", "id", "seed_text", "text").mapInPandas(ask, schema)


def contexts(picks: DataFrame, chunks: DataFrame, chars: int = 800) -> DataFrame:
    """seed_id, context: a seed's picks as numbered, cited and clipped passages.  A seed has k picks at most."""
    named = picks.select("seed_id", "id", "pos").join(chunks.select("id", "book_id", "text"), "id")
    cited = F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("] "), F.coalesce("book_id", F.lit("?")), F.lit("\n"), F.substring(F.coalesce("text", F.lit("")), 1, chars))
    each = named.groupBy("seed_id").agg(F.array_sort(F.collect_list(F.struct("pos", cited.alias("part")))).alias("parts"))
    return each.select("seed_id", F.concat_ws("\n\n", F.col("parts.part")).alias("context"))


NOTE = "note_id long, n int, type string, role string, text string, inline boolean, parent int"


def note_records(notes: DataFrame) -> DataFrame:
    """NOTE rows of the tagged spans in notes (note_id, text)."""

    def parse(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = [
                (note, *span)
                for note, text in zip(part.column("note_id").to_pylist(), part.column("text").to_pylist())
                for span in parse_note(text or "")
            ]
            kinds = {"note_id": pa.int64(), "n": pa.int32(), "type": pa.string(), "role": pa.string(), "text": pa.string(), "inline": pa.bool_(), "parent": pa.int32()}
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values())], names=list(kinds))

    return notes.select("note_id", "text").mapInArrow(parse, NOTE)


def note_seed(records: DataFrame) -> DataFrame:
    """note_id, role, text: what a note starts a search with: its longest seed, else first edge, else first span."""
    kind = F.when(F.col("role") == "seed", 0).when(F.col("role") == "edge", 1).otherwise(2)
    order = Window.partitionBy("note_id").orderBy(kind, F.when(F.col("role") == "seed", -F.length("text")), "n")
    place = free_name(records, "place")
    return records.withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).select("note_id", "role", "text")


def nearest_colour(red: Column, green: Column, blue: Column, palette: dict[str, tuple[float, float, float]] = PALETTE) -> Column:
    """The palette's colour of least squared distance, the earlier of equals; no colour gives NO_COLOUR."""
    far = lambda c: sum(((x - F.lit(v)) * (x - F.lit(v)) for x, v in zip((red, green, blue), c)), F.lit(0.0))
    each = [F.struct(far(c).alias("d"), F.lit(i).alias("i"), F.lit(n).alias("name")) for i, (n, c) in enumerate(palette.items())]
    known = red.isNotNull() & green.isNotNull() & blue.isNotNull()
    return F.when(known, F.array_min(F.array(*each))["name"]).otherwise(F.lit(NO_COLOUR))


def pinned(orphans: DataFrame, chunks: DataFrame, spines: DataFrame) -> DataFrame:
    """mark_id, id, start, end, approximate: orphans (mark_id, id, quote) put into their chosen passage.

    The quote's place within the passage (book_id, id, start, end) where it lies there whole, else the passage's own.
    """
    rows = orphans.join(chunks.select("id", "book_id", "start", "end"), "id").join(spines.select("book_id", F.col("text").alias("spine")), "book_id")
    at = F.call_function("locate", F.col("quote"), F.substring(F.col("spine"), F.col("start") + 1, F.col("end") - F.col("start")))
    rows = rows.withColumn("at", at.cast("long"))
    exact = F.coalesce((F.col("at") > 0) & (F.col("quote") != ""), F.lit(False))
    return rows.select(
        "mark_id", "id",
        F.when(exact, F.col("start") + F.col("at") - 1).otherwise(F.col("start")).cast("long").alias("start"),
        F.when(exact, F.col("start") + F.col("at") - 1 + F.length("quote")).otherwise(F.col("end")).cast("long").alias("end"),
        (~exact).alias("approximate"),
    )


def title_of(slug: Column) -> Column:
    """A title guessed from a file's name."""
    return F.initcap(F.trim(F.regexp_replace(slug, r"[-_\s]+", " ")))


def book_formats(extension: Column) -> Column:
    """Formats a book can be read in: its own where a reader shows it, then Markdown."""
    low = F.lower(F.coalesce(extension, F.lit("")))
    own = F.when(low == "mobi", "epub").when(low.isin("pdf", "epub"), low)
    return F.filter(F.array(own, F.lit("md")), lambda f: f.isNotNull())


def digest(edges: DataFrame) -> DataFrame:
    """origin, n, n_sources, n_targets."""
    return edges.groupBy("origin").agg(F.count("*").alias("n"), F.countDistinct("source").alias("n_sources"), F.countDistinct("target").alias("n_targets"))


def flat_map(chunks: DataFrame) -> DataFrame:
    """id, x, y: passages (id, vec) on the two main axes of their vectors.

    Only sums of products reach the driver, d * (d + 1) numbers for d components.  An axis points to
    the side of its largest component.  Rows without a vector are left out.
    """
    rows = chunks.where(F.col("vec").isNotNull()).select("id", F.col("vec").cast("array<double>").alias("vec"))

    def sums(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for part in parts:
            if part.num_rows:
                m = part.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                m = np.column_stack([np.ones(len(m)), m])
                total = m.T @ m if total is None else total + m.T @ m
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["cell", "value"])

    cells = rows.select("vec").mapInArrow(sums, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    got = cells.toArrow().sort_by("cell").column("value").to_numpy()
    if not len(got):
        return rows.select("id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    size = round(len(got) ** 0.5)
    total = got.reshape(size, size)
    mean = total[0, 1:] / total[0, 0]
    axes = np.linalg.eigh(total[1:, 1:] / total[0, 0] - np.outer(mean, mean))[1][:, ::-1][:, :2]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    if axes.shape[1] < 2:
        axes = np.column_stack([axes, np.zeros(len(axes))])

    def place(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            m = part.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1) if part.num_rows else np.zeros((0, size - 1))
            at = (m - mean) @ axes
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(at[:, 0]), pa.array(at[:, 1])], names=["id", "x", "y"])

    return rows.mapInArrow(place, "id long, x double, y double")
