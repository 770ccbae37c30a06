"""Books replaced and rows changed by versions; ids that are unique."""

import random
import re

import pytest
from pyspark.sql import functions as F

from strandweave.shared import shared_folder
from strandweave.sources import versions

SHAPE = "id long, book_id string, note string, version int, place string"


def rows(table, version=None):
    return sorted((tuple(r) for r in table.read(version).collect()), key=str)


def test_a_table_keeps_its_old_version_until_the_new_one_is_whole(spark):
    first = [(1, "a", "x", 1, "p"), (2, "a", None, 2, "q"), (3, "b/ c=%", "y", None, None), (4, None, "z", 4, "r"), (4, None, "z", 4, "r")]
    df = spark.createDataFrame(first, SHAPE)
    table = versions.BookTable(spark, shared_folder(spark, "versions"), df.schema)
    assert rows(table) == [] and table.version() == 0
    table.replace(df)
    assert rows(table) == sorted(first, key=str)

    def fails(x):
        raise ValueError("a lost write")

    with pytest.raises(Exception, match="a lost write"):
        table._write(df.withColumn("note", F.udf(fails)("note")), df.select(F.col("book_id").alias("changed")).distinct())
    with pytest.raises(Exception):  # the data are written, the list is not
        table._write(df.where("id = 1"), df.select("no_such_column"))
    assert rows(table) == sorted(first, key=str) and table.version() == 1
    changes = [(1, None, "new", ["note"]), (2, "b/ c=%", "n", ["book_id"]), (4, None, None, ["note"]), (9, "a", "no such row", ["note"]), (None, "a", "no key", ["note"])]
    table.update(spark.createDataFrame(changes, "id long, book_id string, note string, fields array<string>"), "id")
    second = [(1, "a", "new", 1, "p"), (2, "b/ c=%", None, 2, "q"), (3, "b/ c=%", "y", None, None), (4, None, None, 4, "r"), (4, None, None, 4, "r")]
    assert rows(table) == sorted(second, key=str) and rows(table, 1) == sorted(first, key=str)
    table.delete(spark.createDataFrame([(1,), (4,), (77,)], "id long"), "id")
    assert rows(table) == sorted([second[1], second[2]], key=str)
    table.replace(spark.createDataFrame([(8, "b/ c=%", "only", 0, "s")], SHAPE))
    assert rows(table) == [(8, "b/ c=%", "only", 0, "s")]
    table.delete(spark.createDataFrame([(8,)], "id long"), "id")
    assert rows(table) == [] and rows(table, 1) == sorted(first, key=str)


def test_unique_ids_take_the_first_free_numbers(spark):
    rng = random.Random(3)
    names = ["dir/A Book.pdf", "a-book.epub", "A  book!.v2.mobi", "???", ".hidden", "x.y/z", "b" * 40 + ".pdf", None]
    uploads = [(i, rng.choice(names)) for i in range(160)]
    used = ["a-book", "a-book-2", "a-book-3", "a-book-7", "a-book-02", "book", "a-book-v2-2", "z-5", "hidden", None, "a-book-7", "a-book-x", "z-99999999999999999999"]

    def slug(name):
        stem = re.sub(r"(?<=.)\.[^.]*$", "", name.rpartition("/")[2])
        return re.sub(r"[^a-z0-9]+", "-", stem.lower()).strip("-") or "book"

    known, want = set(used), []
    for i, name in uploads:
        if name is not None:
            own, n = slug(name), 2
            if own in known:
                while f"{own}-{n}" in known:
                    n += 1
                own = f"{own}-{n}"
            known.add(own)
            want.append((i, own))
    got = versions.unique_ids(spark.createDataFrame(uploads, "upload_id long, filename string"), spark.createDataFrame([(u,) for u in used], "book_id string"))
    assert sorted((r.upload_id, r.book_id) for r in got.collect()) == want


def test_ranks_of_a_hot_key(spark):
    df = spark.createDataFrame([("hot" if i % 3 else f"k{i % 7}", (i * 7919) % 1000, "r") for i in range(1000)] + [(None, 1, "r"), (None, 2, "r")], "k string, o long, part string")
    got = versions.ranked_within(df, "k", "o").collect()
    by = {}
    for r in got:
        by.setdefault(r.k, []).append((r.o, r["rank"]))
    assert all([x[1] for x in sorted(v)] == list(range(1, len(v) + 1)) for v in by.values()) and len(got) == 1002
