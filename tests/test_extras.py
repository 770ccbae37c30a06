"""What engines carry besides their picks: marks' places, fallbacks, headings; edges of notes and of judges; the book of an import."""

import numpy as np

from strandweave.operators import anchors, concepts, engines
from strandweave.session import Corpus, Session


def corpus(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(30, 6))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    rows = [(i, f"b{i % 3}", "a", m[i].tolist(), f"h{i // 5}") for i in range(30)]
    return spark.createDataFrame(rows, "id long, book_id string, author string, vec array<double>, heading string"), m


def test_marks_lie_on_chunk_ids_then_target_then_passage(spark):
    v, m = corpus(spark)
    marks = [
        (1, [99, 7, 8], 5, 6, "q", "", False, m[0].tolist()), (2, None, 9, 6, "q", "n", False, m[0].tolist()), (3, [99], None, 10, "", "n", False, m[0].tolist()),
        (4, None, 99, 98, "q", "", False, m[0].tolist()), (5, [11], None, None, "", "", False, m[0].tolist()), (6, [12], None, None, "q", "", True, m[0].tolist()), (7, [13], None, None, None, "n", False, m[0].tolist()),
    ]
    table = spark.createDataFrame(marks, "mark_id long, chunk_ids array<long>, target long, passage_id long, quote string, note string, orphaned boolean, vec array<double>")
    got = Session(Corpus(v, marks=table)).connect("marks", v.where("id = 0"), k=9).collect()
    assert {r.id for r in got} == {7, 9, 10, 13}


def test_structural_seeds_without_a_second_vector_ask_by_their_own(spark):
    v, m = corpus(spark)
    second = spark.createDataFrame([(i, m[i][::-1].tolist() if i != 4 else [0.0] * 6) for i in range(30) if i != 3], "id long, svec array<double>")
    got = Session(Corpus(v, second=second)).connect("structural", v.where("id in (2, 3, 4)"), k=50, min_sim=0.0).collect()
    why = {r.seed_id: r.why for r in got}
    assert set(why) == {2, 3, 4} and ["by its surface" in why[i] for i in (2, 3, 4)] == [False, True, True]
    best = max((r for r in got if r.seed_id == 3), key=lambda r: r.score)
    others = [i for i in range(30) if i % 3 != 0 and i not in (3, 4)]
    sims = {i: float(m[3] @ m[i][::-1]) for i in others}
    want = max((i for i in others if sims[i] < 0.97), key=sims.get)
    assert best.id == want


def test_echo_gives_headings(spark):
    v, _ = corpus(spark)
    got = engines.echo(v, v, k=3, gap=2, min_sim=-1.0).collect()
    assert got and all(r.heading == f"h{r.id // 5}" for r in got)


def test_ranks_of_lists_of_any_length(spark):
    v, m = corpus(spark)
    picks = engines.plain(v, v, 5).where("not (seed_id = 3 and pos > 1) and seed_id != 4")
    sims = m @ m.T
    for r in engines.corpus_rank(picks, v, v).collect():
        order = sorted(range(30), key=lambda j: (-round(sims[r.seed_id, j], 12), j))
        assert r["rank"] == order.index(r.id) and r.corpus_size == 30
    assert engines.corpus_rank(picks.limit(0), v, v).count() == 0


def test_edges_of_notes_and_judges(spark):
    rows = [(1, 0, "edge", "before any. seed"), (1, 1, "seed", "s" * 90), (1, 2, "voice", "v"), (1, 3, "edge", "One  claim.\nMore of it"), (1, 4, "seed", ""), (1, 5, "edge", ""), (2, 1, "edge", "x" * 100), (1, 6, "seed", None)]
    got = sorted(map(tuple, concepts.note_edges(spark.createDataFrame(rows, "note_id long, n int, role string, text string")).collect()))
    assert got == sorted([
        ("1", "before any.", "correlate", "before any. seed", "1#a000", "note"), ("s" * 80 + "…", "One  claim.", "correlate", "One claim. More of it", "1#a003", "note"),
        ("2", "x" * 79 + "…", "correlate", "x" * 100, "2#a001", "note"),
    ])
    made = spark.createDataFrame([(5, "bk", None, None, "light", " two \n lines", 0.9), (6, "bk", "Ann", "Title", None, None, None)], "id long, book_id string, author string, title string, bridge string, articulation string, confidence double")
    assert [(r.target, r.text, r.provenance) for r in concepts.judged_edges("seed", made).orderBy("id").collect()] == [("Unknown — bk", "two lines", "5"), ("Ann — Title", "", "6")]


def test_the_book_of_an_import_has_most_quotes_then_most_characters(spark):
    books = spark.createDataFrame([(1, "alpha beta gamma. delta"), (2, "Alpha  Beta gamma. x\nlonger passage here"), (3, None), (4, "")], "book_id long, text string")
    quotes = [(1, 1, "ALPHA beta"), (1, 2, "delta"), (1, 3, ""), (2, 4, "alpha\nbeta"), (2, 5, "longer passage HERE"), (3, 6, "nowhere"), (4, 7, "beta  gamma"), (4, 7, None), (5, 8, "delta"), (5, 9, "x longer")]
    got = {r.import_id: (r.book_id, r.hits, r.weight) for r in anchors.detected_books(spark.createDataFrame(quotes, "import_id long, quote_id long, quote string"), books).collect()}
    assert got == {1: (1, 2, 15), 2: (2, 2, 29), 4: (1, 1, 10), 5: (2, 1, 8)}
