"""Joins of intervals that touch, without pairing all of a book's intervals.

An interval has a level, the power of two that its length doesn't pass, and lies in one or two bins of that width.  Two
intervals meet in the wider one's bins: the narrower one is also put into its bins of the levels that the other
side has.  A bin is half filled by each of its own intervals, so that the pairs tried grow with the pairs found, and a
book of any size is as many keys as it has bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Intervals shorter than two to this power share its level.
LOWEST = 5


def _level() -> Column:
    return F.greatest(F.lit(LOWEST), F.ceil(F.log2(F.greatest(F.col("b") - F.col("a"), F.lit(1)).cast("double")))).cast("int")


def _binned(side: DataFrame, levels: list[int]) -> DataFrame:
    """(key, a, b, row, own level) with a row for each bin: at its own level, and at the other side's higher `levels`."""
    higher = F.filter(F.array(*map(F.lit, levels)).cast("array<int>"), lambda x: x > F.col("level"))
    at = side.withColumn("at", F.explode(F.concat(F.array("level"), higher)))
    return at.withColumn("bin", F.explode(F.expr("sequence(shiftright(a, at), shiftright(b - 1, at))")))


def touching(left: DataFrame, right: DataFrame, key: str, left_ends: tuple[str, str] = ("start", "end"), right_ends: tuple[str, str] = ("start", "end")) -> DataFrame:
    """`key`, l (a row of `left`), r (a row of `right`) of intervals of one key that share a place; ends are whole numbers, the second is left out.

    Empty intervals and rows without a key or an end touch nothing.  Repeated rows give repeated pairs.
    """

    def side(df: DataFrame, ends: tuple[str, str], name: str) -> DataFrame:
        cut = df.select(F.col(key).alias("key"), F.col(ends[0]).cast("long").alias("a"), F.col(ends[1]).cast("long").alias("b"), F.struct(*df.columns).alias(name))
        return cut.where("key is not null and a < b").withColumn("level", _level())

    sides = [side(left, left_ends, "l"), side(right, right_ends, "r")]
    # At most 60 levels each.
    found = [sorted(r["level"] for r in s.select("level").distinct().collect()) for s in sides]
    one, two = (_binned(s, levels) for s, levels in zip(sides, found[::-1]))
    one = one.select("key", "at", "bin", F.col("a").alias("la"), F.col("b").alias("lb"), F.col("level").alias("ll"), "l")
    two = two.select("key", "at", "bin", F.col("a").alias("ra"), F.col("b").alias("rb"), F.col("level").alias("rl"), "r")
    pairs = one.join(two, ["key", "at", "bin"])
    # A pair meets at the wider one's level only, and counts in the first bin that both have.
    meets = (F.col("at") == F.greatest("ll", "rl")) & (F.col("la") < F.col("rb")) & (F.col("ra") < F.col("lb"))
    return pairs.where(meets & (F.col("bin") == F.expr("shiftright(greatest(la, ra), at)"))).select(F.col("key").alias(key), "l", "r")
