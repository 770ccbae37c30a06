"""Samples, reports and reader views, by hand and against their SQL twins."""

import statistics

import duckdb
import pytest

from strandweave import registry
from strandweave.operators import anchors, passages, reader, reports

SF = "/root/testdata/sf0.001"
NAMES = (
    "sample_systematic", "readiness_report", "eval_report", "compare_models", "embed_leaderboard", "usage_budget", "log_summary", "dwell_portrait",
    "concept_counts", "concept_sites", "section_texts", "semantic_passages", "highlight_runs", "session_list", "doc_summaries", "labels_merged",
    "sections_greedy",
)


def show(rows, names):
    at = sorted(range(len(names)), key=lambda i: names[i])
    text = lambda v: f"{v + 0.0:.5f}".replace("-0.00000", "0.00000") if isinstance(v, float) else str(v)
    return sorted(tuple(text(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels", "events", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = registry.QUERIES[name](spark, SF)
    want = con.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    rows = got.collect()
    assert rows and show(rows, got.columns) == show(want.fetchall(), names)


def test_places_over_several_ranges(spark, monkeypatch):
    monkeypatch.setattr(reports, "RANGE_ROWS", 10)
    df = spark.createDataFrame([(k,) for k in [None, *range(0, 300, 3)]], "k long").repartition(4)
    got = {r.place: r.k for r in reports.numbered(df, "k").collect()}
    assert [got[i] for i in range(101)] == [None, *range(0, 300, 3)]
    assert sorted(r.k for r in reports.systematic_sample(df.where("k is not null"), "k", 4).collect()) == [0, 75, 150, 225]
    assert reports.systematic_sample(df, "k", 0).count() == 0 and reports.systematic_sample(df.limit(0), "k", 3).count() == 0


def test_exact_median(spark):
    rows = [("a", x) for x in (5, 1, 9, 9)] + [("b", x) for x in (4, 2, 2)] + [("b", None)]
    got = {r.g: r.median for r in reports.exact_median(spark.createDataFrame(rows, "g string, x long"), "g", "x").collect()}
    assert got == {"a": statistics.median([5, 1, 9, 9]), "b": 2}


def test_readiness_names_what_is_missing(spark):
    v = spark.createDataFrame([(1,)], "id long")
    none = v.limit(0)
    marks = spark.createDataFrame([], "target long, quote string, note string, orphaned boolean")
    got = {r.engine: (r.ready, r.reason) for r in reports.readiness(v, none, marks, none, none).collect()}
    assert got["plain"] == (True, None) and got["lexical"] == (False, "no passages") and not got["hybrid"][0]
    assert not got["marks"][0] and not got["structural"][0] and not got["concept"][0]


def test_sections_stream_over_books(spark):
    units = spark.createDataFrame([(b, i, "w " * n if n else t) for b in ("x", "y") for i, n, t in ((1, 3, ""), (2, 2, ""), (3, 0, None), (4, 9, ""))], "book_id string, id long, text string")
    got = sorted((r.book_id, r.section, r.first_id, r.last_id, r.n_units) for r in passages.sections(units, 4).collect())
    assert got == [(b, *rest) for b in ("x", "y") for rest in ((0, 1, 2, 2), (1, 3, 4, 2))]
    assert passages.sections(units.limit(0)).count() == 0


def test_pages_and_the_tail_after_a_heading():
    para = lambda n, t: ("para", n, t)
    made = passages.accumulate([("page", 0, "<!-- page 4 -->"), para(70, "a"), para(60, "b"), ("page", 0, "<!-- page 5 -->"), ("heading", 1, "# H"), para(30, "c")], 240, 40, 60)
    assert list(made) == [(["a", "b"], None, 4), (["b", "c"], "H", 5)]


def test_runs_cut_at_overlapping_spans(spark):
    runs = spark.createDataFrame([(1, 0, 10), (1, 11, 15), (2, 0, 3), (2, 3, 3)], "book_id long, start long, end long")
    spans = spark.createDataFrame([(1, 7, 2, 6), (1, 5, 4, 12), (1, 9, 6, 6), (3, 1, 0, 9)], "book_id long, span_id long, start long, end long")
    got = sorted((r.book_id, r.start, r.end, r.span_id) for r in reader.highlighted_runs(runs, spans).collect())
    assert got == [(1, 0, 2, None), (1, 2, 4, 7), (1, 4, 6, 5), (1, 6, 10, 5), (1, 11, 12, 5), (1, 12, 15, None), (2, 0, 3, None)]


def test_merging_sessions_and_labels(spark):
    now = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (None, "c", 3)], "k long, x string, y int")
    new = spark.createDataFrame([(1, "z"), (2, None), (9, "n"), (None, "no")], "k long, x string")
    got = {(r.k, r.x, r.y) for r in reader.merged(now, new, "k").collect()}
    assert got == {(1, "z", 1), (2, "b", 2), (None, "c", 3), (9, "n", None)}
    chats = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "q" * 90), (1, 2, "assistant", "x"), (2, 0, "assistant", None)], "target long, n long, role string, content string")
    got = {r.target: (r.title, r.n, r.last_role) for r in reader.sessions(chats).collect()}
    assert got == {1: ("q" * 79 + "…", 3, "assistant"), 2: (None, 1, "assistant")}
    text = spark.createDataFrame([("One here. Two.",), ("no end",), ("",), (None,)], "t string")
    assert [r.x for r in text.select(reader.short_label(text.t).alias("x")).collect()] == ["One here.", "no end", "", None]


def test_sentences_parents_and_touched_passages(spark):
    units = spark.createDataFrame(
        [(1, "a", "One two three four five. Short one. Six seven eight nine ten!", 0, 10), (1, "b", "zzz yyy", 10, 20), (2, "c", None, 0, 5)],
        "book_id long, id string, text string, start long, end long",
    )
    got = [(r.id, r.n, r.text) for r in passages.sentences(units).orderBy("n").collect()]
    assert got == [("a", 0, "One two three four five."), ("a", 1, "Six seven eight nine ten!")]
    parents = spark.createDataFrame([(1, "P0", "one two three"), (1, "P1", "one two three four five six seven"), (1, "P2", "yyy"), (2, "P9", "zzz")], "book_id long, id string, text string")
    got = {r.id: (r.parent_id, round(r.overlap, 3)) for r in passages.link_parents(units, parents).collect()}
    assert got == {"a": ("P1", round(7 / 11, 3)), "b": ("P2", 0.5)}  # "one" repeats: 11 different words
    spans = spark.createDataFrame([("s", 1, 4, 13), ("t", 1, 20, 30), ("u", 2, 4, 9)], "span_id string, book_id long, start long, end long")
    got = sorted((r.span_id, r.pos, r.id, r.overlap) for r in anchors.chunks_for(spans, units).collect())
    assert got == [("s", 1, "a", 6), ("s", 2, "b", 3), ("u", 1, "c", 1)]
