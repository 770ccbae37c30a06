"""Reading rhythm: attention per passage from an event log, a robust baseline, scores, a session's candidates.

A log's order matters within a book, and one book may hold much of the log.  So what an event needs of
its neighbours is found within spans of time, and a second, small pass over the spans of a book, a row
each, carries on what crosses them: the next mark, the last kind, the dead time so far.  Medians are found among
counted values the same way.  Events without a book take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandweave.shared import stored

MIN_ATTENTION, PRIOR, Z, MIN_BASELINE, SURE_BASELINE = 1500.0, 9000.0, 1.0, 3, 8
#: Microseconds of a span of the log.
SPAN = 86_400_000_000
WHOLE = ("book",)
SESSION = ("book", "session")


def _spans(events: DataFrame, by: tuple[str, ...]) -> DataFrame:
    for name in by:
        events = events.where(F.col(name).isNotNull())
    return events.withColumn("span", F.floor(F.col("t") / SPAN))


def _carried(rows: DataFrame, by: tuple[str, ...], summary: dict[str, Column], over: dict[str, tuple]) -> DataFrame:
    """`rows` with columns that a pass over the spans' summaries gives: name to (function of a window, "before" or "after")."""
    order = {"before": Window.partitionBy(*by).orderBy("span"), "after": Window.partitionBy(*by).orderBy(F.desc("span"))}
    spans = rows.groupBy(*by, "span").agg(*(c.alias(n) for n, c in summary.items()))
    # What follows is read backwards: a frame that grows, where one that shrinks would be summed anew for each row.
    carried = spans.select(*by, "span", *(make(order[way].rowsBetween(Window.unboundedPreceding, -1)).alias(n) for n, (make, way) in over.items()))
    return rows.join(carried, [*by, "span"])


def visits(events: DataFrame, by: tuple[str, ...] = WHOLE) -> DataFrame:
    """`by`, passage, start, end (microseconds), event_id: an enter lasts to the next enter or exit of any passage; the last one ends where it starts."""
    own = Window.partitionBy(*by, "span").orderBy("t", "event_id")
    marks = _spans(events.where(F.col("type").isin("enter", "exit")), by).select(*by, "span", "t", "event_id", "passage", "type")
    marks = marks.withColumn("next", F.lead("t").over(own))
    later = _carried(marks, by, {"first": F.min("t")}, {"later": (lambda w: F.min("first").over(w), "after")})
    return later.where("type = 'enter'").select(*by, "passage", F.col("t").alias("start"), F.coalesce("next", "later", "t").alias("end"), "event_id")


def dead_spans(events: DataFrame, opens: str = "idle", closes: str = "active", by: tuple[str, ...] = WHOLE) -> DataFrame:
    """`by`, from, to: first open to first close; an unclosed span is ignored."""
    own = Window.partitionBy(*by, "span").orderBy("t", "event_id")
    ahead = Window.partitionBy(*by, "span").orderBy(F.desc("t"), F.desc("event_id")).rowsBetween(Window.unboundedPreceding, -1)
    closed = F.when(F.col("type") == closes, F.col("t"))
    kinds = _spans(events.where(F.col("type").isin(opens, closes)), by).select(*by, "span", "t", "event_id", "type")
    kinds = kinds.withColumns({"before": F.lag("type").over(own), "to": F.min(closed).over(ahead)})
    kinds = _carried(
        kinds, by, {"last": F.max(F.struct("t", "event_id", "type"))["type"], "first": F.min(closed)},
        {"earlier": (lambda w: F.last("last").over(w), "before"), "later": (lambda w: F.min("first").over(w), "after")},
    )
    before, to = F.coalesce("before", "earlier"), F.coalesce("to", "later")
    first = (F.col("type") == opens) & ~F.coalesce(before == opens, F.lit(False))
    return kinds.where(first & to.isNotNull()).select(*by, F.col("t").alias("from"), to.alias("to"))


def features(events: DataFrame, words: DataFrame, by: tuple[str, ...] = WHOLE) -> DataFrame:
    """`by`, passage, attentive_ms, ms_per_word, revisits, first_pass_ms_per_word, max_dwell_ms, selections, selected_not_highlighted.

    `words` has passage, words.  Overlaps of visits with dead spans are subtracted, of both kinds.
    """
    v = stored(visits(events, by), "visits")
    dead = dead_spans(events, by=by).unionByName(dead_spans(events, "hidden", "visible", by))
    # Dead time up to a moment is moment * (spans open) - (their starts) + (lengths of those closed): one pass over
    # all bounds of a book gives it at each visit's ends, and what a visit loses is the difference.
    none = F.lit(0).cast("long")
    bounds = dead.select(*by, F.explode(F.array(F.struct(F.col("from").alias("t"), F.lit(1).cast("long").alias("a"), (-F.col("from")).alias("b")), F.struct(F.col("to").alias("t"), F.lit(-1).cast("long").alias("a"), F.col("to").alias("b")))).alias("x"))
    bounds = bounds.select(*by, "x.*", F.lit(None).cast("long").alias("event_id"), none.alias("sign"))
    ends = v.select(*by, "event_id", F.explode(F.array(F.struct(F.col("start").alias("t"), F.lit(-1).cast("long").alias("sign")), F.struct(F.col("end").alias("t"), F.lit(1).cast("long").alias("sign")))).alias("x"))
    ends = ends.select(*by, "x.t", none.alias("a"), none.alias("b"), "event_id", "x.sign")
    so_far = Window.partitionBy(*by, "span").orderBy("t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    passed = _spans(bounds.unionByName(ends), by).withColumns({"open": F.sum("a").over(so_far), "held": F.sum("b").over(so_far)})
    passed = _carried(
        passed, by, {"all_a": F.sum("a"), "all_b": F.sum("b")},
        {"open_before": (lambda w: F.sum("all_a").over(w), "before"), "held_before": (lambda w: F.sum("all_b").over(w), "before")},
    )
    total = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    passed = passed.withColumn("dead", F.col("t") * total("open", "open_before") + total("held", "held_before"))
    lost = passed.where("event_id is not null").groupBy("event_id").agg(F.sum(F.col("sign") * F.col("dead")).alias("lost"))
    held = v.join(lost, "event_id", "left").withColumn(
        "ms", F.greatest(F.lit(0.0), (F.col("end") - F.col("start") - F.coalesce("lost", F.lit(0))) / 1000.0)
    )
    per = held.groupBy(*by, "passage").agg(
        F.sum("ms").alias("attentive_ms"), (F.count("*") - 1).alias("revisits"), F.max("ms").alias("max_dwell_ms"),
        F.min(F.struct("start", "event_id", "ms"))["ms"].alias("first_ms"),
    )
    plain = ~F.coalesce("highlighted", F.lit(False)) if "highlighted" in events.columns else F.lit(True)
    selected = events.where("type = 'select'").groupBy(*by, "passage").agg(F.count("*").alias("selections"), F.max(plain).alias("plain"))
    joined = per.join(selected, [*by, "passage"], "left").join(words, "passage", "left")
    n = F.greatest(F.lit(1), F.coalesce("words", F.lit(1)))
    return joined.select(
        *by, "passage", "attentive_ms", (F.col("attentive_ms") / n).alias("ms_per_word"), "revisits", (F.col("first_ms") / n).alias("first_pass_ms_per_word"),
        "max_dwell_ms", F.coalesce("selections", F.lit(0)).alias("selections"), F.coalesce("plain", F.lit(False)).alias("selected_not_highlighted"),
    )


#: Values within a factor of e ** (1 / BUCKETS) share a bucket of `medians`.
BUCKETS = 64


def medians(rows: DataFrame, key: str, value: str, name: str = "med") -> DataFrame:
    """`key`, `name`, n: the exact median of each key's values, which aren't negative, and their number.

    Equal values are counted before they meet.  Buckets' counts tell which one or two hold the middle, and only those are
    ordered: a key of any size is dealt by bucket, and its pass over buckets is a few thousand rows.
    """
    bucket = F.floor(F.log1p(F.col(value)) * BUCKETS).alias("bucket")
    counted = rows.where(F.col(value).isNotNull()).groupBy(key, bucket, F.col(value).alias("x")).agg(F.count("*").alias("c"))
    by_key, so_far = Window.partitionBy(key), Window.partitionBy(key).orderBy("bucket")
    buckets = counted.groupBy(key, "bucket").agg(F.sum("c").alias("c")).withColumns({"upto": F.sum("c").over(so_far), "n": F.sum("c").over(by_key)})
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    middle = buckets.where((F.col("upto") > low) & (F.col("upto") - F.col("c") <= high)).select(key, "bucket", "n", (F.col("upto") - F.col("c")).alias("under"))
    inside = Window.partitionBy(key, "bucket").orderBy("x")
    placed = counted.join(middle, [key, "bucket"]).withColumn("last", F.col("under") + F.sum("c").over(inside))
    holds = lambda rank: F.when((F.col("last") > rank) & (F.col("last") - F.col("c") <= rank), F.col("x"))
    return placed.groupBy(key).agg(((F.min(holds(low)) + F.min(holds(high))) / 2).alias(name), F.first("n").alias("n"))


def baseline(feats: DataFrame) -> DataFrame:
    """book, med, spread, n, have_baseline of books with MIN_BASELINE passages of real attention or more.

    The spread is the median deviation from the median, else the standard deviation, else 1.
    """
    seen = feats.where(F.col("attentive_ms") >= MIN_ATTENTION).select("book", "ms_per_word")
    med = medians(seen, "book", "ms_per_word")
    mad = medians(seen.join(med, "book").select("book", F.abs(F.col("ms_per_word") - F.col("med")).alias("off")), "book", "off", "mad").drop("n")
    std = seen.groupBy("book").agg(F.stddev_pop("ms_per_word").alias("std"))
    spread = F.when(F.col("mad") > 0, F.col("mad")).when(F.col("std") > 0, F.col("std")).otherwise(F.lit(1.0))
    known = med.join(mad, "book").join(std, "book").where(F.col("n") >= MIN_BASELINE)
    return known.select("book", "med", spread.alias("spread"), "n", (F.col("n") >= SURE_BASELINE).alias("have_baseline"))


def against(feats: DataFrame, base: DataFrame) -> DataFrame:
    """Features with z (shrunk towards the book's median), signals and hotspot: two of slow, revisited, selected."""
    w = F.col("attentive_ms") / (F.col("attentive_ms") + PRIOR)
    z = 0.6745 * (w * F.col("ms_per_word") + (1 - w) * F.col("med") - F.col("med")) / F.col("spread")
    out = feats.join(base, "book").withColumn("z", F.round(z, 6))
    slow = (F.col("z") >= Z) & (F.col("attentive_ms") >= MIN_ATTENTION)
    named = (F.when(c, F.lit(n)) for n, c in (("slow", slow), ("revisited", F.col("revisits") > 0), ("selected", F.col("selected_not_highlighted"))))
    return out.withColumn("signals", F.array_compact(F.array(*named))).withColumn("hotspot", F.size("signals") >= 2)


def scores(feats: DataFrame) -> DataFrame:
    """A book's features against its own baseline."""
    feats = stored(feats, "rhythm-features")
    return against(feats, baseline(feats)).select("book", "passage", "attentive_ms", "revisits", "selections", "z", "hotspot")


def candidates(events: DataFrame, words: DataFrame, labels: DataFrame, session: Column | None = None) -> DataFrame:
    """book, session, passage, pos, z, signals, revisits, attentive_ms, have_baseline: hotspots of one session of each book.

    The session, `session` or each book's last by its name, is scored against the book's whole history; passages of
    `labels` are left out.  Books without a baseline have none.
    """
    base = baseline(stored(features(events, words), "rhythm-features")).select("book", "med", "spread", "have_baseline")
    chosen = events.where("book is not null and session is not null").groupBy("book").agg((F.max("session") if session is None else F.first(session)).alias("session"))
    feats = features(events.join(chosen, ["book", "session"], "left_semi"), words, SESSION)
    left = against(feats, base).where("hotspot").join(labels.select("passage").distinct(), "passage", "left_anti")
    place = F.row_number().over(Window.partitionBy("book").orderBy(F.desc("z"), "passage"))
    return left.select("book", "session", "passage", place.alias("pos"), "z", "signals", "revisits", "attentive_ms", "have_baseline")


def heat(feats: DataFrame) -> DataFrame:
    """Attention as a share of the book's most attended passage."""
    most = feats.groupBy("book").agg(F.max("attentive_ms").alias("most"))
    return feats.join(most, "book").select("book", "passage", F.round(F.least(F.lit(1.0), F.col("attentive_ms") / F.greatest(F.lit(1.0), F.col("most"))), 6).alias("heat"))
