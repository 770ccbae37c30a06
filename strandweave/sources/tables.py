"""Model tables over a data folder: passages with vectors or text, marks, edges, events, chats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Tables between these sizes are dealt to all cores after the scan, as a file of few row groups is read by as few tasks.
SPREAD_BYTES = (1 << 20, 256 << 20)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) / float(spark.conf.get("spark.sql.sources.fileCompressionFactor"))
    # Larger tables have row groups enough, and would pay for a shuffle.
    return df.repartition(spark.sparkContext.defaultParallelism) if SPREAD_BYTES[0] <= size < SPREAD_BYTES[1] else df


def vec_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, book_id, author, vec: the passages that vector engines search; rows without a whole vector take no part."""
    e = table(spark, sf_dir, "embeddings")
    e = e.where(F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)))
    return e.select(
        F.col("vec_id").alias("id"),
        F.concat(F.lit("b"), "label").alias("book_id"),
        F.concat(F.lit("a"), F.col("label") % 5).alias("author"),
        F.col("embedding").cast("array<double>").alias("vec"),
    )


def structural_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages in the second vector space; as a stand-in for it, the reversed vector."""
    return vec_chunks(spark, sf_dir).withColumn("vec", F.reverse("vec"))


def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, book_id, text: the passages that text engines search."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("book_id"), "text")


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mark_id, target, book_id, quote, note, orphaned, vec: marks of whole passages that have a vector.

    Stand-ins: a mark's vector is its passage's, its components moved on by one.
    """
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    v = vec_chunks(spark, sf_dir)
    turned = F.concat(F.slice("vec", 2, 1 << 20), F.slice("vec", 1, 1))
    return (
        labels.join(docs, "doc_id")
        .join(v, F.col("id") == F.col("doc_id"))
        .select(
            F.col("doc_id").alias("mark_id"), F.col("doc_id").alias("target"), "book_id", F.col("text").alias("quote"),
            F.lit("").alias("note"), (F.col("toxic") == 1).alias("orphaned"), turned.alias("vec"),
        )
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, target, provenance, origin: attributed bridges."""
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    return labels.where("quality = 1").join(docs, "doc_id").select(
        F.col("lang").alias("source"), F.col("source").alias("target"), F.col("doc_id").alias("provenance"), F.lit("authored").alias("origin")
    )


#: How the event log's types stand for reading events.
EVENT_TYPES = {"view": "enter", "purchase": "exit", "click": "select", "error": "idle", "signup": "active"}


def reading_events(events: DataFrame, days: int = 1) -> DataFrame:
    """book, session, t (microseconds), type, passage, event_id, highlighted of an event log; batch or stream.

    A session, in this stand-in for a reader's log, is a period of `days` days, named by its first; a selection of value
    100 or more became a highlight.
    """
    kind = F.create_map(*(F.lit(x) for pair in EVENT_TYPES.items() for x in pair))
    day = F.to_date("ts")
    return events.select(
        F.col("user_id").alias("book"),
        (day if days == 1 else F.date_sub(day, F.pmod(F.unix_date(day), F.lit(days)).cast("int"))).alias("session"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("t"),
        kind[F.col("event_type")].alias("type"),
        F.get_json_object("props", "$.k").cast("long").alias("passage"),
        "event_id",
        (F.col("value") >= 100).alias("highlighted"),
    )
