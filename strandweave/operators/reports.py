"""Samples, readiness, and reports on engines, vector spaces, retrieval models, the event log and usage."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandweave.operators import engines
from strandweave.shared import free_name, stored

RANGE_ROWS, MOST_RANGES = 1_000_000, 1024


def numbered(df: DataFrame, key: str, name: str = "place") -> DataFrame:
    """`df` with each row's 0-based place by a numeric key (null first; rows of one key in any order).

    Quantiles cut the key into ranges of about RANGE_ROWS rows, at most MOST_RANGES of them.  Each range
    numbers its own rows from the count of those before, so no task sees the whole table.
    """
    ranges = min(MOST_RANGES, df.count() // RANGE_ROWS + 1)
    cuts = sorted(set(df.approxQuantile(key, [i / ranges for i in range(1, ranges)], 0.25 / ranges))) if ranges > 1 else []
    # Cuts ascend, so the number of those reached tells the range.
    reached = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(key))) if cuts else F.lit(0)
    part, mine, before = (free_name([*df.columns, name], n) for n in ("range", "own", "before"))
    ranged = df.withColumn(part, F.when(F.col(key).isNull(), -1).otherwise(reached))
    # One row a range.
    counts = ranged.groupBy(part).agg(F.count("*").alias("n"))
    starts = counts.select(part, F.coalesce(F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before))
    own = F.row_number().over(Window.partitionBy(part).orderBy(F.col(key).asc_nulls_first())) - 1
    return ranged.withColumn(mine, own).join(F.broadcast(starts), part).withColumn(name, F.col(before) + F.col(mine)).drop(part, mine, before)


def systematic_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """At most `n` rows, evenly spaced by `key`; all rows if there are no more."""
    if n <= 0:
        return df.where(F.lit(False))
    step = max(1, df.count() // n)
    place = F.col("__place")
    return numbered(df, key, "__place").where((place % step == 0) & (place < step * n)).drop("__place")


def _any(df: DataFrame) -> DataFrame:
    return df.select(F.lit(1).alias("x")).limit(1).agg((F.count("*") > 0).alias("ready"))


def _none(df: DataFrame) -> DataFrame:
    return df.select(F.lit(1).alias("x")).limit(1).agg((F.count("*") == 0).alias("ready"))


def readiness(vectors: DataFrame, chunks: DataFrame, marks: DataFrame, second: DataFrame, links: DataFrame) -> DataFrame:
    """engine, ready, reason: whether each engine has what it needs; the reason is null if so."""
    known = vectors.select("id")
    usable = marks.where(~F.col("orphaned") & ((F.col("quote") != "") | (F.col("note") != "")))
    vector = ("no vectors", [_any(vectors)])
    needs = {
        **dict.fromkeys(("band", "spread", "plain", "echo", "walk"), vector),
        "lexical": ("no passages", [_any(chunks)]),
        "hybrid": ("no vectors or no passages", [_any(vectors), _any(chunks)]),
        "concept": ("concepts missing or out of date", [_any(links), _none(links.join(chunks.select("id"), "id", "left_anti"))]),
        "marks": ("no mark on a passage", [_any(usable.join(known.withColumnRenamed("id", "target"), "target", "left_semi"))]),
        "structural": ("second vectors missing for some passages", [_any(second), _none(known.join(second.select("id"), "id", "left_anti"))]),
    }
    rows = None
    for engine, (reason, checks) in needs.items():
        every = checks[0]
        for more in checks[1:]:
            every = every.unionByName(more)
        row = every.agg(F.bool_and("ready").alias("ready")).select(F.lit(engine).alias("engine"), "ready", F.when(~F.col("ready"), reason).alias("reason"))
        rows = row if rows is None else rows.unionByName(row)
    return rows


def exact_median(df: DataFrame, group: str, value: str) -> DataFrame:
    """group, median: the middle value or the mean of the two middle ones, from running counts of the values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    run = counts.withColumn("upto", upto)
    total = run.groupBy(group).agg(F.max("upto").alias("total"))
    at = lambda k: F.min(F.when(F.col("upto") >= k, F.col(value)))
    return run.join(total, group).groupBy(group).agg(((at(F.floor((F.col("total") + 1) / 2)) + at(F.floor(F.col("total") / 2) + 1)) / 2).alias("median"))


def engine_report(picks: dict[str, DataFrame], seeds: DataFrame, chunks: DataFrame, noise: dict[str, DataFrame] | None = None, bridges: DataFrame | None = None) -> DataFrame:
    """One row an engine, over all seeds: figures of its picks (seed_id, id, pos, similarity).

    mean_k, empty_rate, mean_rank_pct, median_rank (whole part), ild, book_spread, cross_book_rate; then
    noise_fp_rate, from `noise` (for each engine seed_id and whether it gave picks), and bridge_recall, the
    share of `bridges` (seed_id, id) found.  Figures without rows to tell are null.
    """
    book = chunks.select("id", "book_id")
    asked = seeds.select(F.col("id").alias("seed_id"), F.col("book_id").alias("seed_book"))
    every = ranks = ilds = hits = both = None
    # Each engine's picks are made once, and all engines' are ranked in one pass.
    picks = {name: stored(found.select("seed_id", "id", "pos", "similarity"), f"report-{name}") for name, found in picks.items()}
    for found in picks.values():
        both = found if both is None else both.unionByName(found)
    distinct = both.groupBy("seed_id", "id").agg(F.max("similarity").alias("similarity"))
    ranked = stored(engines.corpus_rank(distinct, seeds, chunks).select("seed_id", "id", "rank", "corpus_size"), "report-ranks")
    for name, found in picks.items():
        tag = lambda df: df.withColumn("engine", F.lit(name))  # noqa: E731, B023
        placed = tag(ranked.join(found.select("seed_id", "id"), ["seed_id", "id"]))
        per = found.join(book, "id").join(asked, "seed_id").groupBy("seed_id").agg(
            F.count("*").alias("k"), F.countDistinct("book_id").alias("books"), F.sum((F.col("book_id") != F.col("seed_book")).cast("int")).alias("crossing")
        )
        one = tag(asked.select("seed_id").join(per, "seed_id", "left"))
        apart = tag(engines.intra_list_diversity(found, chunks).select("ild"))
        every, ranks, ilds = (new if old is None else old.unionByName(new) for old, new in ((every, one), (ranks, placed), (ilds, apart)))
        if bridges is not None:
            hit = tag(bridges.join(found.select("seed_id", "id", F.lit(1).alias("hit")), ["seed_id", "id"], "left").select("hit"))
            hits = hit if hits is None else hits.unionByName(hit)
    figures = every.groupBy("engine").agg(
        F.avg(F.coalesce("k", F.lit(0))).alias("mean_k"), F.avg(F.col("k").isNull().cast("int")).alias("empty_rate"),
        F.avg(F.col("books") / F.col("k")).alias("book_spread"), (F.sum("crossing") / F.sum("k")).alias("cross_book_rate"),
    )
    figures = figures.join(ranks.groupBy("engine").agg(F.avg(100 * F.col("rank") / F.col("corpus_size")).alias("mean_rank_pct")), "engine", "left")
    figures = figures.join(exact_median(ranks, "engine", "rank").select("engine", F.floor("median").alias("median_rank")), "engine", "left")
    figures = figures.join(ilds.groupBy("engine").agg(F.avg("ild").alias("ild")), "engine", "left")
    false_hits = None
    for name, rows in (noise or {}).items():
        part = rows.select(F.lit(name).alias("engine"), F.col("gave").cast("int").alias("gave"))
        false_hits = part if false_hits is None else false_hits.unionByName(part)
    if false_hits is not None:
        figures = figures.join(false_hits.groupBy("engine").agg(F.avg("gave").alias("noise_fp_rate")), "engine", "left")
    if hits is not None:
        figures = figures.join(hits.groupBy("engine").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("bridge_recall")), "engine", "left")
    return figures


def compare_spaces(first: DataFrame, second: DataFrame, k: int = engines.K) -> DataFrame:
    """seed_id, shared, total, jaccard of each passage's nearest `k` in two vector spaces (id, book_id, vec)."""
    near = lambda df, name: engines.plain(df, df, k).groupBy("seed_id").agg(F.collect_set("id").alias(name))
    both = near(first, "a").join(near(second, "b"), "seed_id", "full")
    sets = both.select("seed_id", *(F.coalesce(c, F.array().cast("array<long>")).alias(c) for c in "ab"))
    shared, total = F.size(F.array_intersect("a", "b")), F.size(F.array_union("a", "b"))
    return sets.select("seed_id", shared.alias("shared"), total.alias("total"), F.round(F.when(total > 0, shared / total).otherwise(0.0), 4).alias("jaccard"))


def retrieval_report(found: dict[str, DataFrame], gold: DataFrame, at: Iterable[int] = (1, 3, 5, 10)) -> DataFrame:
    """model, place, queries, recall_*, mrr, mean_rank, median_rank of ranked lists (seed_id, id, pos) against gold (seed_id, id).

    A query counts by its best gold row; ranks are of queries that found one.  Best recall at 5 comes first, then mrr.
    """
    best = None
    for model, rows in found.items():
        each = gold.join(rows.select("seed_id", "id", "pos"), ["seed_id", "id"], "left").groupBy("seed_id").agg(F.min("pos").alias("rank")).select(F.lit(model).alias("model"), "rank")
        best = each if best is None else best.unionByName(each)
    figures = best.groupBy("model").agg(
        F.count("*").alias("queries"), *(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias(f"recall_{k}") for k in at),
        F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"), F.avg("rank").alias("mean_rank"),
    )
    figures = figures.join(exact_median(best, "model", "rank").select("model", F.floor("median").alias("median_rank")), "model", "left")
    # One row a model.
    return figures.withColumn("place", F.row_number().over(Window.orderBy(F.desc("recall_5"), F.desc("mrr"), "model")))


def usage_report(ledger: DataFrame, budget: float, width: int = 10) -> DataFrame:
    """day, requests, tokens, percent of the day's budget, and a bar of `width` signs at most."""
    share = F.col("tokens") / F.lit(float(budget))
    filled = F.least(F.lit(width), F.floor(share * width + 0.5).cast("int"))
    bar = F.concat(F.repeat(F.lit("#"), F.greatest(filled, F.lit(0))), F.repeat(F.lit("."), F.lit(width) - F.greatest(filled, F.lit(0))))
    return ledger.select("day", "requests", "tokens", F.round(100 * share, 1).alias("percent"), bar.alias("bar"))


def logged_summary(events: DataFrame) -> DataFrame:
    """book, total, sessions, by_type: each book's logged events."""
    per = events.groupBy("book", "type").agg(F.count("*").alias("n"))
    kinds = per.where(F.col("type").isNotNull()).groupBy("book").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("by_type"))
    return events.groupBy("book").agg(F.count("*").alias("total"), F.countDistinct("session").alias("sessions")).join(kinds, "book", "left")


def portrait(scored: DataFrame, characters: DataFrame, least: int = 2, limit: float = 0.3) -> DataFrame:
    """character, n, z, pace: how slowly each character of passage (passage, character) is read, of at least `least` visited ones."""
    rows = scored.where(F.col("attentive_ms") >= 1500).join(characters, "passage").groupBy("character").agg(F.count("*").alias("n"), F.avg("z").alias("z"))
    pace = F.when(F.col("z") > limit, "slow").when(F.col("z") < -limit, "skim").otherwise("even")
    return rows.where(F.col("n") >= least).select("character", "n", F.round("z", 6).alias("z"), pace.alias("pace"))
