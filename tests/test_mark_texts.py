"""Quotes and notes are joined with picks at the end and do not travel with them before."""

from strandweave.session import ENGINES, Corpus, Session


def test_texts_of_marks_come_last(spark):
    v = spark.createDataFrame([(k, f"b{k % 2}", "a", [float(k), 1.0]) for k in range(4)], "id long, book_id string, author string, vec array<double>")
    rows = [(10 + k, k, "" if k == 3 else f"quote {k}", " note " if k >= 2 else "", False, [1.0, float(k)]) for k in range(4)]
    marks = spark.createDataFrame(rows, "mark_id long, target long, quote string, note string, orphaned boolean, vec array<double>")
    corpus = Corpus(v, marks=marks)
    assert {"quote", "note"}.isdisjoint(ENGINES["marks"].run(corpus, v, 8).columns)
    got = Session(corpus).connect("marks", v, 8)
    assert got.columns[-4:] == ["mark_id", "mark_similarity", "quote", "note"]
    picks = got.collect()
    assert picks and {(r.id, r.mark_id, r.quote, r.note) for r in picks} == {(k, 10 + k, q, n) for _, k, q, n in [(0, 0, "quote 0", ""), (0, 1, "quote 1", ""), (0, 2, "quote 2", " note "), (0, 3, "", " note ")]}
    assert {r.why for r in picks if r.id < 2} == {"your highlight — “quote 0”", "your highlight — “quote 1”"} and all(r.why == "your note — “note”" for r in picks if r.id >= 2)
