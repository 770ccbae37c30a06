"""A table whose books are replaced, and whose rows are changed, by writing only the books that change.

Data lie in `data/version=N/book=B`, where a version holds the books that it wrote, and a list of (book, version), written
after them, says which version each book has.  Readers go by the newest list that is complete: a write that fails leaves
the one before as it was, and what it had written is never read.  One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from strandweave.operators.intervals import touching
from strandweave.shared import free_name, stored

#: Lists of at most so many books are broadcast to the scan, which then reads their folders only.
BROADCAST_BOOKS = 1 << 16


class BookTable:
    """Rows of `schema`, which has a column `book`, in `folder`."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, book: str = "book_id"):
        self.spark, self.folder, self.schema, self.book = spark, folder.rstrip("/"), schema, book
        self._version = free_name(schema.fieldNames(), "version")
        self._place = free_name(schema.fieldNames(), "place")

    def _lists(self) -> list[int]:
        """Versions whose list is complete."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/lists/*/_SUCCESS")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path) or []
        return sorted(int(f.getPath().getParent().getName().partition("=")[2]) for f in found)

    def version(self) -> int:
        """The newest version, 0 for a table never written."""
        return max(self._lists(), default=0)

    def _listed(self, version: int) -> DataFrame:
        kind = self.schema[self.book].dataType.simpleString()
        if not version:
            return self.spark.createDataFrame([], f"`{self.book}` {kind}, `{self._version}` int, books long")
        return self.spark.read.parquet(f"{self.folder}/lists/list={version}")

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest if none is told."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], self.schema)
        listed = self._listed(version)
        books = listed.count()
        names = [f"{self.folder}/data/{self._version}={v}" for (v,) in listed.select(self._version).distinct().orderBy(self._version).collect()]
        if not names:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(StructType([*self.schema.fields, StructField(self._version, IntegerType()), StructField(self._place, StringType())])).option("basePath", f"{self.folder}/data").parquet(*names)
        listed = listed.select(F.col(self.book).alias(self._place), self._version).withColumn(self._place, F.coalesce(F.col(self._place).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")))
        rows = rows.withColumn(self._place, F.coalesce(self._place, F.lit("__HIVE_DEFAULT_PARTITION__")))
        return rows.join(F.broadcast(listed) if books <= BROADCAST_BOOKS else listed, [self._place, self._version], "left_semi").select(self.schema.fieldNames())

    def _write(self, rows: DataFrame, books: DataFrame) -> int:
        """A new version in which the `books` (one column) have just `rows`."""
        old = self.version()
        # Numbers of failed writes aren't used again: their data may lie there.
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/data/*")
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path) or []
        new = max([old, *(int(f.getPath().getName().partition("=")[2]) for f in there)]) + 1
        out = rows.select(self.schema.fieldNames()).withColumn(self._place, F.col(self.book).cast("string"))
        # A book's rows go to one file, or to as many as its size asks for.
        out.hint("rebalance", self._place).write.partitionBy(self._place).parquet(f"{self.folder}/data/{self._version}={new}")
        left = self._listed(old).join(books, F.col("changed").eqNullSafe(F.col(self.book)), "left_anti").select(self.book, self._version)
        # A book that has no row any more isn't listed.
        mine = rows.select(self.book).distinct().withColumn(self._version, F.lit(new))
        left.unionByName(mine).write.parquet(f"{self.folder}/lists/list={new}")
        return new

    def replace(self, rows: DataFrame) -> int:
        """Puts `rows` in the place of all rows of their books; gives the new version."""
        rows = stored(rows.select(self.schema.fieldNames()), "replaced")
        return self._write(rows, rows.select(F.col(self.book).alias("changed")).distinct())

    def _touched(self, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
        """(the books that hold a row of the keys, all their rows)."""
        rows = self.read()
        books = stored(rows.join(keys.select(key).distinct(), key, "left_semi").select(F.col(self.book).alias("changed")).distinct(), "touched")
        return books, rows.join(books, F.col(self.book).eqNullSafe(F.col("changed")), "left_semi")

    def update(self, changes: DataFrame, key: str, fields: str = "fields") -> int:
        """Changes rows by `key`: of a change the columns that its array `fields` names are taken, and a null there takes the value out.

        Keys that the table lacks change nothing, and so does a null key.  Of several changes of one key the greatest row counts.  A row may
        change its book.
        """
        names = [c for c in changes.columns if c in self.schema.fieldNames() and c != key]
        change = free_name(self.schema.fieldNames(), "change")
        one = changes.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(fields, *names)).alias(change))
        books, rows = self._touched(one, key)
        both = rows.join(one, key, "left")
        value = lambda c: F.when(F.array_contains(F.col(f"{change}.{fields}"), c), F.col(f"{change}.{c}")).otherwise(F.col(c)) if c in names else F.col(c)
        made = stored(both.select(*(value(c).alias(c) for c in self.schema.fieldNames())), "updated")
        known = books.withColumnRenamed("changed", "known")
        moved = made.select(F.col(self.book).alias("changed")).distinct().join(known, F.col("changed").eqNullSafe(F.col("known")), "left_anti")
        if not moved.isEmpty():
            # A book that a row has come to is written with its own rows.
            moved = stored(moved, "moved")
            made = made.unionByName(self.read().join(moved, F.col(self.book).eqNullSafe(F.col("changed")), "left_semi"))
            books = books.unionByName(moved)
        return self._write(made, books)

    def delete(self, keys: DataFrame, key: str) -> int:
        """Takes out the rows whose `key` is among `keys`."""
        books, rows = self._touched(keys, key)
        return self._write(stored(rows.join(keys.select(key).distinct(), key, "left_anti"), "left"), books)


def ranked_within(rows: DataFrame, key: str, order: str, name: str = "rank") -> DataFrame:
    """`rows` with each one's place, from 1, among those of its key, by `order`; a key of any size is dealt over tasks.

    Rows are put in order by ranges of (key, order); a pass over the ranges' counts, a row for each key in a range, tells where each begins.
    """
    part, own = free_name(rows.columns, "part"), Window.partitionBy(free_name(rows.columns, "part"), key).orderBy(order)
    dealt = stored(rows.repartitionByRange(key, order).withColumn(part, F.spark_partition_id()), "ranges")
    counts = dealt.groupBy(key, part).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col(key).alias(f"{part}_key"), F.col(part).alias(f"{part}_no"), before.alias(f"{part}_before"))
    placed = dealt.withColumn(name, F.row_number().over(own)).join(counts, (F.col(part) == F.col(f"{part}_no")) & F.col(key).eqNullSafe(F.col(f"{part}_key")))
    return placed.withColumn(name, F.col(name) + F.col(f"{part}_before")).select(*rows.columns, name)


def slug_of(filename: Column) -> Column:
    """A file's name in small letters and digits, other runs as one dash; `book` for a name without any."""
    stem = F.regexp_replace(F.regexp_extract(filename, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    slug = F.trim(F.regexp_replace(F.lower(stem), r"[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(slug != "", slug).otherwise(F.lit("book"))


def unique_ids(uploads: DataFrame, existing: DataFrame) -> DataFrame:
    """upload_id, filename, book_id of uploads (upload_id, filename): the slug, or the slug with the first free number from 2.

    `existing` (book_id) are the ids in use.  Uploads of one slug take the free numbers in the order of their ids; null names are
    left out, and upload ids must be distinct.
    """
    asked = uploads.where(F.col("filename").isNotNull()).select("upload_id", "filename", slug_of(F.col("filename")).alias("slug"))
    ranks = ranked_within(asked, "slug", "upload_id")
    # An id in use takes the place of its slug's number; an id may end like one and be another's slug.
    ending = F.regexp_extract("book_id", r"^(.*)-([1-9][0-9]{0,17})$", 2)
    used = existing.where(F.col("book_id").isNotNull()).select(F.explode(F.array(F.struct(F.col("book_id").alias("slug"), F.lit(1).cast("long").alias("number")), F.struct(F.regexp_extract("book_id", r"^(.*)-([1-9][0-9]{0,17})$", 1).alias("slug"), ending.try_cast("long").alias("number")))).alias("u")).select("u.*")
    used = used.where("number = 1 or number >= 2").where(~((F.col("number") == 1) & F.col("slug").isNull())).distinct().join(asked.select("slug").distinct(), "slug", "left_semi")
    w = Window.partitionBy("slug").orderBy("number")
    taken = used.withColumn("k", F.row_number().over(w))
    # Numbers between two in use are free: a run of ranks, and what is added to them.
    after = taken.select("slug", (F.col("number") - F.col("k") + 1).alias("first"), (F.coalesce(F.lead("number").over(w), F.lit(1 << 60)) - F.col("k")).alias("end"), F.col("k").alias("more"))
    none = asked.select("slug").distinct().join(taken.where("k = 1").select("slug", "number"), "slug", "left")
    head = none.select("slug", F.lit(1).cast("long").alias("first"), F.coalesce("number", F.lit(1 << 60)).alias("end"), F.lit(0).alias("more"))
    runs = head.unionByName(after).where(F.col("first") < F.col("end"))
    met = touching(ranks.withColumn("next", F.col("rank") + 1), runs, "slug", ("rank", "next"), ("first", "end"))
    number = F.col("l.rank") + F.col("r.more")
    return met.select(F.col("l.upload_id").alias("upload_id"), F.col("l.filename").alias("filename"), F.when(number == 1, F.col("slug")).otherwise(F.concat_ws("-", "slug", number.cast("string"))).alias("book_id"))
