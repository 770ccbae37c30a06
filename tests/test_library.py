"""Model callables, contexts, notes, reader views and the flat map, by hand and against their SQL twins."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strandweave import registry
from strandweave.operators import library

SF = "/root/testdata/sf0.001"


def show(rows, names):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(str(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize(
    "name", ["enrich_pending", "enrich_cached", "verdicts_kept", "rag_context", "mark_colours", "pinned_orphans", "catalog_titles", "edges_digest"]
)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = registry.QUERIES[name](spark, SF)
    want = con.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    rows = got.collect()
    assert rows and show(rows, got.columns) == show(want.fetchall(), names)


def test_cache_asks_once_for_each_text(spark):
    units = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b")], "id long, text string")
    cache = units.where("id = 5").select(library.content_hash(F.col("text")).alias("hash"), F.lit("old").alias("value"))
    assert sorted(r.text for r in library.pending(units, cache).collect()) == ["", "a"]
    got = {r.id: r.value for r in library.enrich(units, cache, lambda texts: [t + "!" for t in texts]).collect()}
    assert got == {1: "a!", 2: "a!", 3: None, 4: "!", 5: "old"}
    assert library.enrich(units.limit(0), cache.limit(0), lambda texts: texts).count() == 0


def test_verdicts_and_contexts(spark):
    picks = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (1, 13, 4)], "seed_id long, id long, pos int")
    said = [(1, 10, True, "low", 0.5), (1, 11, True, "high", 0.9), (1, 12, False, "low", 0.9), (1, 13, True, "low", 0.5)]
    verdicts = spark.createDataFrame(said, "seed_id long, id long, connected boolean, forced_risk string, confidence double")
    assert [(r.id, r.pos) for r in library.confirmed(picks, verdicts).orderBy("pos").collect()] == [(10, 1), (13, 2)]
    chunks = spark.createDataFrame([(10, "b", "long text"), (11, None, None)], "id long, book_id string, text string")
    assert library.contexts(picks, chunks, 4).first().context == "[1] b\nlong\n\n[2] ?\n"


def test_notes_colours_titles_and_formats(spark):
    notes = spark.createDataFrame([(1, "<sutra>a</sutra> <anch>longer</anch>"), (2, "<action>x</action>\ny(corr)"), (3, None), (4, "(action) z")], "note_id long, text string")
    records = library.note_records(notes)
    assert {(r.note_id, r.text) for r in library.note_seed(records).collect()} == {(1, "longer"), (2, "y"), (4, "z")}
    rgb = spark.createDataFrame([(0.74, 0.84, 0.67), (None, 0.1, 0.1), (0.67, 0.8, 0.9)], "r double, g double, b double")
    assert [r.c for r in rgb.select(library.nearest_colour(F.col("r"), F.col("g"), F.col("b")).alias("c")).collect()] == ["sage", "amber", "sky"]
    files = spark.createDataFrame([("being-and_time", "MOBI"), (None, "txt")], "name string, ext string")
    got = files.select(library.title_of(F.col("name")).alias("t"), library.book_formats(F.col("ext")).alias("f")).collect()
    assert [(r.t, list(r.f)) for r in got] == [("Being And Time", ["epub", "md"]), (None, ["md"])]


def test_pinning(spark):
    orphans = spark.createDataFrame([(1, 7, "cd"), (2, 7, "zz"), (3, 7, None)], "mark_id long, id long, quote string")
    chunks = spark.createDataFrame([(7, 1, 4, 8)], "id long, book_id long, start int, end int")
    got = library.pinned(orphans, chunks, spark.createDataFrame([(1, "cd..abcdef")], "book_id long, text string")).collect()
    assert {(r.mark_id, r.start, r.end, r.approximate) for r in got} == {(1, 6, 8, False), (2, 4, 8, True), (3, 4, 8, True)}


def test_flat_map_is_the_two_main_axes(spark):
    m = np.random.default_rng(4).standard_normal((60, 5)) * [5, 1, 3, 0.5, 0.1]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(99, None)], "id long, vec array<double>")
    got = np.array([(r.x, r.y) for r in library.flat_map(df).orderBy("id").collect()])
    u, s, _ = np.linalg.svd(m - m.mean(axis=0), full_matrices=False)
    assert got.shape == (60, 2) and np.allclose(np.abs(got), np.abs(u[:, :2] * s[:2]))
    assert library.flat_map(df.limit(0)).count() == 0
