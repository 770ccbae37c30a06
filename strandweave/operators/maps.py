"""Maps of a corpus: passages of all levels, and concepts, as points on their main axes with the edges between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.operators import concepts, engines, library
from strandweave.shared import stored

SIDE = 1000.0
#: The layout's sums of products are this number squared at most.
MOST_CONCEPTS = 1024


def on_a_square(points: DataFrame) -> DataFrame:
    """`points` with x and y scaled to 0 to SIDE, to one place; an axis on which all are alike is nought."""
    ends = points.agg(*(f(c).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("low", F.min), ("high", F.max)))).first()

    def scaled(c: str) -> Column:
        low, high = ends[f"low_{c}"] or 0.0, ends[f"high_{c}"] or 0.0
        return F.round((F.col(c) - low) / (high - low) * SIDE, 1) if high > low else F.lit(0.0)

    return points.withColumns({"x": scaled("x"), "y": scaled("y")})


def chunk_map(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of units (level, id, parent_id, book_id, vec) whose ids differ over all levels.

    nodes: level, id, book_id, x, y, all levels on one pair of axes.  edges: source, target, kind; `parent` where the
    parent is a unit, `near` to the nearest other unit of the level.  Levels are few.  Units without a vector are left out.
    """
    units = units.where(F.col("vec").isNotNull())
    placed = stored(library.flat_map(units.select("id", "vec")), "map-places")
    nodes = units.select("level", "id", "book_id").join(on_a_square(placed), "id").select("level", "id", "book_id", "x", "y")
    known = units.select(F.col("id").alias("target"))
    edges = units.select(F.col("id").alias("source"), F.col("parent_id").alias("target")).join(known, "target", "left_semi").select("source", "target", F.lit("parent").alias("kind"))
    for (level,) in units.select("level").distinct().orderBy("level").collect():
        own = units.where(F.col("level") == level).select("id", "vec")
        near = engines.plain(own, own, 1)
        edges = edges.unionByName(near.select(F.col("seed_id").alias("source"), F.col("id").alias("target"), F.lit("near").alias("kind")))
    return nodes, edges


def concept_map(links: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the concepts of passages (id, label): label, n, book (that has most of them; ties to the first), x, y; a, b, n.

    A concept's place is its row of co-occurrence counts on the main axes of all rows.  Over MOST_CONCEPTS concepts are refused.
    """
    counted = links.select("id", "label").distinct()
    labels = [r["label"] for r in counted.select("label").distinct().orderBy("label").limit(MOST_CONCEPTS + 1).collect()]
    if len(labels) > MOST_CONCEPTS:
        raise ValueError(f"over {MOST_CONCEPTS} concepts: pass a smaller vocabulary")
    per_book = counted.join(chunks.select("id", "book_id"), "id").groupBy("label", "book_id").agg(F.count("*").alias("own"))
    dominant = per_book.groupBy("label").agg(F.sum("own").alias("n"), F.min(F.struct((-F.col("own")).alias("less"), "book_id"))["book_id"].alias("book"))
    edges = concepts.co_occurrence(counted)
    if not labels:
        return dominant.select("label", "n", "book", F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), edges
    place = counted.sparkSession.createDataFrame([(i, label) for i, label in enumerate(labels)], "j long, label string")
    # At most MOST_CONCEPTS rows.
    numbered = counted.join(F.broadcast(place), "label").select("id", "j")
    pairs = numbered.join(numbered.withColumnRenamed("j", "i"), "id").where("i != j").groupBy("i", "j").agg(F.count("*").cast("double").alias("n"))
    rows = pairs.groupBy(F.col("i").alias("id")).agg(concepts.dense(F.collect_list(F.struct(F.col("j").cast("int"), "n")), len(labels)).alias("vec"))
    alone = place.select(F.col("j").alias("id")).join(rows.select("id"), "id", "left_anti").withColumn("vec", F.array_repeat(F.lit(0.0), len(labels)))
    placed = stored(library.flat_map(rows.unionByName(alone)), "concept-places")
    at = on_a_square(placed).join(F.broadcast(place), F.col("id") == F.col("j")).select("label", "x", "y")
    return dominant.join(at, "label").select("label", "n", "book", "x", "y"), edges
