"""What a reader sees of odd spaces."""

from pyspark.sql import functions as F

from strandweave.operators import reader


def test_summaries_lose_no_break_spaces_at_their_ends(spark):
    long = "x" * 278
    rows = [(1, "   " + "a b" * 12 + "  "), (2, "\t" + "c" * 40 + " \t"), (3, " " * 40), (4, long + "  " + "yy"), (5, None)]
    got = {r.id: r.s for r in spark.createDataFrame(rows, "id long, text string").select("id", reader.summary(F.col("text")).alias("s")).collect()}
    assert got == {1: "a b" * 12, 2: "\t" + "c" * 40 + " \t", 3: None, 4: long + "…", 5: None}
