"""What a reader sees: concept sites, highlighted runs, sessions, summaries, merged rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandweave.operators.intervals import touching
from strandweave.shared import free_name

SITES, PREVIEW, LABEL, SUMMARY, SUMMARY_LEAST = 40, 240, 80, 280, 30


def stripped(text: Column, pattern: str = r"\A\p{Zs}+|(?<!\p{Zs})\p{Zs}+\z") -> Column:
    """The text without space characters of any kind (no-break ones too) at its ends; tabs and line ends stay, as with SQL's trim."""
    return F.regexp_replace(text, pattern, "")


def clip(text: Column, n: int) -> Column:
    """The text, or its first n - 1 characters and an ellipsis."""
    return F.when(F.length(text) > n, F.concat(stripped(F.substring(text, 1, n - 1), r"(?<!\p{Zs})\p{Zs}+\z"), F.lit("…"))).otherwise(text)


def concept_counts(links: DataFrame, chunks: DataFrame) -> DataFrame:
    """label, n, n_books of chunk concepts (id, label)."""
    return links.join(chunks.select("id", "book_id"), "id").groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("book_id").alias("n_books"))


def concept_sites(links: DataFrame, chunks: DataFrame, most: int = SITES) -> DataFrame:
    """label, pos, id, preview: the first `most` passages of each concept; the limit is the feature."""
    first = Window.partitionBy("label").orderBy("id")
    sites = links.select("label", "id").withColumn("pos", F.row_number().over(first)).where(F.col("pos") <= most)
    return sites.join(chunks.select("id", "text"), "id").select("label", "pos", "id", F.substring("text", 1, PREVIEW).alias("preview"))


def highlighted_runs(runs: DataFrame, spans: DataFrame) -> DataFrame:
    """book_id, start, end, span_id: runs (book_id, start, end) cut where spans (book_id, span_id, start, end) begin or end.

    span_id is the least of the spans that cover a piece, null if none does.  Empty runs and spans give nothing.
    """
    r = runs.where(F.col("start") < F.col("end")).select("book_id", "start", "end").distinct()
    s = spans.select("book_id", "span_id", "start", "end")
    own = lambda x: (F.col(f"{x}.start").alias("r_start"), F.col(f"{x}.end").alias("r_end"))
    inner = touching(r, s, "book_id").select("book_id", *own("l"), F.explode(F.array(F.greatest("l.start", "r.start"), F.least("l.end", "r.end"))).alias("at"))
    ends = r.select("book_id", F.col("start").alias("r_start"), F.col("end").alias("r_end"), F.explode(F.array("start", "end")).alias("at"))
    cuts = inner.unionByName(ends).distinct()
    after = F.lead("at").over(Window.partitionBy("book_id", "r_start", "r_end").orderBy("at"))
    pieces = cuts.withColumn("end", after).where("end is not null").select("book_id", F.col("at").alias("start"), "end").distinct()
    # A span that touches a piece covers it: pieces end where spans do.
    covered = touching(pieces, s, "book_id").groupBy("book_id", F.col("l.start").alias("start"), F.col("l.end").alias("end")).agg(F.min("r.span_id").alias("span_id"))
    return pieces.join(covered, ["book_id", "start", "end"], "left")


def sessions(chats: DataFrame) -> DataFrame:
    """target, title (the first user message, clipped), n, last_role of messages (target, n, role, content)."""
    asked = F.min(F.when(F.col("role") == "user", F.struct("n", "content")))["content"]
    return chats.groupBy("target").agg(clip(asked, LABEL).alias("title"), F.count("*").alias("n"), F.max(F.struct("n", "role"))["role"].alias("last_role"))


def summary(text: Column) -> Column:
    """The first line of over SUMMARY_LEAST characters, clipped; null if there is none."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: stripped(x)), lambda x: F.length(x) > SUMMARY_LEAST)
    return clip(F.get(lines, F.lit(0)), SUMMARY)


def short_label(text: Column) -> Column:
    """The first sentence, clipped."""
    return clip(F.regexp_replace(F.regexp_extract(F.trim(text), r"(?s)^(.*?[.!?])(?:\s|$)|^(.*)$", 0), r"\s+$", ""), LABEL)


def merged(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """`current` with the values of `changes` (one row a key; null leaves a value), and the rows only `changes` has.

    Columns that `changes` lacks stay.  Rows with a null key stay as they are, and such changes are left out.
    """
    known = [c for c in changes.columns if c != key and c in current.columns]
    own, values = (free_name([*current.columns, *changes.columns], n) for n in ("changed_key", "values"))
    new = changes.where(F.col(key).isNotNull()).select(F.col(key).alias(own), F.struct(F.lit(True).alias("there"), *known).alias(values))
    both = current.join(new, F.col(key) == F.col(own), "full")
    value = lambda c: F.coalesce(F.col(own), F.col(c)) if c == key else F.coalesce(F.col(f"{values}.{c}"), F.col(c)) if c in known else F.col(c)
    return both.select(*(value(c).alias(c) for c in current.columns))
