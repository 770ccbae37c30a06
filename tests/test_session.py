"""Sessions, annotations, embedding, files and block products, by hand and against their SQL twins."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strandweave import registry
from strandweave.operators import anchors, annotations, blocked, concepts, embedding, engines, passages, rhythm
from strandweave.session import ENGINES, Corpus, Session
from strandweave.sources import files

SF = "/root/testdata/sf0.001"
NAMES = (
    "band_mmr", "spread_dpp", "spread_facility", "echo", "walk", "note_records", "note_seeds", "md_highlights", "hybrid_rrf", "toc", "connect_plain", "connect_band",
    "connect_marks", "connect_lexical", "connect_hybrid", "wander", "engine_list", "theme_embedding", "annotations_listed", "book_annotations", "mark_passages",
    "sparks_labelled", "selection_anchors", "book_payload", "log_cleared", "compare_basis", "doc_graph", "section_heads", "rhythm_features", "marks_best",
    "concept_ppr", "connect_concept", "concept_theme", "passage_graph",
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


def vectors(spark, n=60, seed=3):
    m = np.random.default_rng(seed).standard_normal((n, 8))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    return spark.createDataFrame([(i, f"b{i % 4}", f"a{i % 3}", [float(x) for x in v]) for i, v in enumerate(m)], "id long, book_id string, author string, vec array<double>"), m


def test_block_products_in_files_equal_those_that_travel(spark, monkeypatch):
    v, m = vectors(spark)
    near = {(r.seed_id, r.pos): r.id for r in engines.plain(v, v, 4).collect()}
    monkeypatch.setattr(blocked, "BLOCK_ROWS", 9)
    monkeypatch.setattr(blocked, "FEW_PAIRS", 0)
    assert {(r.seed_id, r.pos): r.id for r in engines.plain(v, v, 4).collect()} == near
    holes = v.unionByName(spark.createDataFrame([(99, "b", "a", None), (98, "b", "a", [None] * 8)], v.schema))
    assert {(r.seed_id, r.pos): r.id for r in engines.plain(holes, holes, 4).collect()} == near
    assert engines.plain(v.limit(0), v, 4).count() == 0 and engines.plain(v, v.limit(0), 4).count() == 0


def test_vectors_of_two_lengths_are_refused(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0])], "id long, vec array<double>").selectExpr("id", "'b' AS book_id", "'a' AS author", "vec")
    with pytest.raises(Exception, match="differ in length"):
        engines.plain(v, v).collect()


def test_marks_keep_the_best_of_each_target(spark, monkeypatch):
    v, m = vectors(spark)
    rows = [(100 + i, i % 7, f"q{i}", "", i == 3, [float(x) for x in m[i + 8]]) for i in range(40)]
    marks = spark.createDataFrame(rows, "mark_id long, target long, quote string, note string, orphaned boolean, vec array<double>")
    monkeypatch.setattr(blocked, "BLOCK_ROWS", 16)
    got = {}
    for r in engines.marks_recall(v, marks, 3, -1.0).orderBy("seed_id", "pos").collect():
        got.setdefault(r.seed_id, []).append((r.id, r.mark_id))
    for s in range(60):
        best = {}
        for mark, target, *_, orphaned, x in rows:
            sim = float(np.dot(m[s], x))
            if not orphaned and target != s and (target not in best or sim > best[target][0]):
                best[target] = (sim, mark)
        order = sorted(best, key=lambda t: (-best[t][0], t))[:3]
        assert got[s] == [(t, best[t][1]) for t in order]


def test_walk_goes_back_to_books_only_when_asked(spark):
    v, m = vectors(spark, 24)
    lost = engines.walk(v, v, 5, 1, -1.0).groupBy("seed_id").count()
    assert {r["count"] for r in lost.collect()} == {3}  # four books
    rows = engines.walk(v, v, 5, 1, -1.0, revisit_books=True).orderBy("seed_id", "hop").collect()
    paths = {}
    for r in rows:
        paths.setdefault(r.seed_id, []).append(r.id)
    for s, ids in paths.items():
        at, books, picked = s, [s % 4], []
        for i in ids:
            sims = m @ m[at]
            order = sorted((j for j in range(24) if sims[j] < 0.97), key=lambda j: (-sims[j], j))
            fresh = [j for j in order if j % 4 not in books]
            if len(fresh) > 1:
                want = fresh[1]
            else:
                after = order[order.index(fresh[0]) + 1 :] if fresh else []
                want = next(j for j in after if j % 4 in books and j % 4 != at % 4 and j not in picked)
            assert i == want
            at, picked = i, [*picked, i]
            books.append(i % 4)


def test_sessions_fall_back_coerce_and_refuse(spark):
    v, _ = vectors(spark)
    session = Session(Corpus(v, floor=0.2))
    assert [e["key"] for e in session.engines()] == list(ENGINES) and session.key("nothing") == "band"
    assert session.params("band", "5", pool="30", exclude_same_book="false", unknown=1)["pool"] == 30
    assert session.params("band", 5, exclude_same_book="false")["exclude_same_book"] is False
    assert session.connect("plain", v, 0).count() == 0
    with pytest.raises(ValueError, match="needs marks"):
        session.connect("marks", v)
    picks = session.connect("unheard of", session.random_passages(3), 4, skip_top=2, min_sim=-1.0)
    assert picks.columns[:9] == ["seed_id", "id", "pos", "similarity", "rank", "corpus_size", "score", "path", "why"]
    assert {r.path for r in picks.collect()} == {"band"} and picks.count() == 12
    sure = lambda picks: picks.where("pos = 2").withColumn("pos", F.lit(1))
    way = session.wander(session.random_passages(2), 2, sure, skip_top=1, min_sim=-1.0).orderBy("seed_id", "step").collect()
    assert len(way) == 4 and way[0].id == way[1].from_id


def test_annotations_by_hand(spark):
    rows = [(1, "b", "b#1", None, "md", False, 5), (2, None, "c#9", "ai", None, None, 1), (3, "c", "c#2", "reader", None, True, 2)]
    marks = spark.createDataFrame(rows, "annotation_id long, book_id string, target string, source string, origin string, orphaned boolean, created long")
    ids = lambda df: sorted(r.annotation_id for r in df.collect())
    assert ids(annotations.listed(marks, source="reader")) == [1, 3] and ids(annotations.listed(marks, orphaned=False)) == [1, 2] and ids(annotations.listed(marks)) == [1, 2, 3]
    assert {(r.annotation_id, r.book_id, r.pos) for r in annotations.of_books(marks).collect()} == {(1, "b", 1), (3, "c", 1), (2, "c", 2)}
    spines = spark.createDataFrame([(1, "one two three four. one two again.")], "book_id long, text string")
    chunks = spark.createDataFrame([(1, 10, 0, 19), (1, 11, 20, 34)], "book_id long, id long, start long, end long")
    pairs = spark.createDataFrame([(1, 1, "three four", ""), (2, 1, "three four", ""), (3, 1, "one two", ""), (4, 1, "again.", "n"), (5, 9, "x", "")], "quote_id long, book_id long, quote string, note string")
    known = annotations.with_hash(pairs.where("quote_id = 4"), -1)
    got = {r.book_id: (r.imported, r.orphaned, r.duplicate, r.total) for r in annotations.import_report(pairs, known, spines, chunks).collect()}
    assert got == {1: (1, 1, 2, 4), 9: (0, 1, 0, 1)}
    old = spark.createDataFrame([(7, None, "1#x", "again.", None, None, None), (8, 1, "1#y", "gone", None, None, None), (9, 1, "t", "three", None, None, 4)], "annotation_id long, book_id long, target string, quote string, prefix string, suffix string, start long")
    got = {r.quote_id: (r.target, r.start, r.orphaned) for r in annotations.migrated(old, spines, chunks).collect()}
    assert got == {7: ("11", 28, False), 8: ("book:1", None, True)}


def test_small_to_big_and_contents(spark):
    units = spark.createDataFrame([(0, 1, "x1"), (0, 2, "c2"), (0, 3, "x3"), (0, 4, "alone")], "seed_id long, pos int, id string")
    up = spark.createDataFrame([("x1", "c1"), ("x3", "c1"), ("c1", "p1"), ("c2", "p1")], "id string, parent_id string")
    parents = spark.createDataFrame([("p1",)], "id string")
    assert [(r.pos, r.id, r.level) for r in passages.parents_of(units, up, parents).orderBy("pos").collect()] == [(1, "p1", "parent"), (2, "alone", "unit")]
    rows = [("h", i, t, None) for i, t in enumerate(["A", "A", "", "A", "B"])] + [("p", i, None, p) for i, p in enumerate([1, 3, 6, 7, 12])] + [("n", i, None, None) for i in range(30)]
    table = spark.createDataFrame(rows, "book_id string, id long, heading string, page int")
    got = {}
    for r in passages.contents(table, page="page").orderBy("book_id", "id").collect():
        got.setdefault(r.book_id, []).append((r.id, r.title))
    assert got == {"h": [(0, "A"), (4, "B")], "p": [(0, "Page 1"), (2, "Page 6"), (4, "Page 12")], "n": [(0, "Passage 1"), (25, "Passage 26")]}


def test_models_prefixes_and_zero_vectors(spark):
    embedding.MODELS.pop("count", None)
    embedding.register("count", embedding.Model(lambda: lambda texts: np.array([[len(t), t.count("a")] for t in texts]), "q: "))
    units = spark.createDataFrame([(1, "aa"), (2, None), (3, "")], "id long, text string")
    got = {r.id: list(r.vec) for r in embedding.embed(units, "count").collect()}
    assert got[2] == [0.0, 0.0] == got[3] and np.allclose(got[1], [0.5**0.5] * 2)
    assert {r.id: list(r.vec) for r in embedding.embed(units, "count", True).collect()}[2] == [1.0, 0.0]
    with pytest.raises(ValueError):
        embedding.register("count", embedding.Model(lambda: embedding.hashed_words))


def test_dead_time_of_both_kinds_is_lost(spark):
    e = [("enter", 0, 1), ("idle", 2, 1), ("hidden", 3, 1), ("active", 5, 1), ("visible", 8, 1), ("exit", 10, 1), ("idle", 11, 1)]
    events = spark.createDataFrame([(1, t * 1_000_000, k, p, i) for i, (k, t, p) in enumerate(e)], "book long, t long, type string, passage long, event_id long")
    words = spark.createDataFrame([(1, 2)], "passage long, words int")
    assert rhythm.features(events, words).first().attentive_ms == 2000.0  # ten less three idle and five hidden
    assert rhythm.features(events.limit(0), words).count() == 0


def test_files_upserts_and_manifests(spark, tmp_path):
    now = spark.createDataFrame([("h1", "q", "old"), ("h2", "r", "same")], "hash string, quote string, note string")
    new = spark.createDataFrame([("h1", "other", "new"), ("h3", "s", "n"), ("h3", "s", "n")], "hash string, quote string, note string")
    assert {tuple(r) for r in files.upsert(now, new, "hash").collect()} == {("h1", "q", "new"), ("h2", "r", "same"), ("h3", "s", "n")}
    path = f"file://{tmp_path}/rows"
    files.write_jsonl(now, path)
    files.write_jsonl(new.limit(1), path, append=True)
    schema = "hash string, quote string, note string"
    assert files.read_jsonl(spark, path, schema).count() == 3
    (tmp_path / "bad.jsonl").write_text('{"hash": "a"}\n\n{broken\n')
    assert files.read_jsonl(spark, f"file://{tmp_path}/bad.jsonl", schema, tolerant=True).count() == 1
    (tmp_path / "doc.json").write_text('{\n "hash": "x"\n}')
    assert files.read_json_document(spark, f"file://{tmp_path}/doc.json", schema).first().hash == "x"
    (tmp_path / "books").mkdir()
    (tmp_path / "books" / "one.md").write_text("---\nsource_file: a.pdf\npages: 3\n---\n# T\n")
    book = files.read_markdown(spark, f"file://{tmp_path}/books").first()
    assert (book.book_id, book.collection, book.source_file, book.text) == ("one", "books", "a.pdf", "# T\n")
    listing = spark.createDataFrame([("a", bytearray(b"1")), ("b", bytearray(b"2"))], "path string, content binary")
    manifest = files.changed_files(listing, spark.createDataFrame([], "path string, sha256 string"))
    assert manifest.count() == 2 and files.changed_files(listing, manifest).count() == 0
    books = spark.createDataFrame([("a", 1), ("b", 2)], "book_id string, n int")
    assert {tuple(r) for r in files.replace_books(books, spark.createDataFrame([("b", 9)], books.schema)).collect()} == {("a", 1), ("b", 9)}


def test_shared_concepts_of_nothing(spark):
    assert concepts.shared_concepts(spark.createDataFrame([], "id long, pos int, label string")).count() == 0


def test_theme_walk_equals_power_iteration(spark):
    links = [(0, "poetic thinking", 1.0), (0, "memory", 2.0), (1, "memory", 1.0), (1, "edge:night river", 1.5), (2, "edge:night river", 1.0), (2, "stone", 1.0), (3, "stone", 2.0)]
    graph = spark.createDataFrame(links, "id long, node string, w double")
    themes = spark.createDataFrame([(7, "On MEMORY, and a river"), (8, "nothing known"), (9, None), (10, "")], "id long, text string")
    nodes = sorted({n for _, n, _ in links})
    w = np.zeros((4, len(nodes)))
    for i, n, x in links:
        w[i, nodes.index(n)] = x
    out, back = w / w.sum(1, keepdims=True), w / w.sum(0)
    e = np.array([n in ("memory", "edge:night river") for n in nodes]) / 2
    c, n = np.zeros(4), e
    for _ in range(concepts.STEPS):
        c, n = 0.85 * back @ n, 0.15 * e + 0.85 * c @ out
    got = concepts.theme_rank(graph, themes).orderBy("pos").collect()
    # Passage 3 is reached, but has none of the theme's nodes.
    assert {r.seed_id for r in got} == {7} and [r.id for r in got] == sorted((0, 1, 2), key=lambda i: -c[i])
    assert all(abs(r.similarity - c[r.id]) < 1e-8 for r in got)
    assert concepts.theme_rank(graph.limit(0), themes).count() == 0 and concepts.theme_rank(graph, themes.limit(0)).count() == 0
    split = graph.where("node NOT LIKE 'edge:%'").select("id", F.col("node").alias("label"))
    bridge = spark.createDataFrame([("x", "night river", 2, "judged")], "source string, target string, provenance long, origin string")
    session = Session(Corpus(vectors(spark), links=split, edges=bridge))
    rows = {r.id: r for r in session.concept_theme(themes).collect()}
    assert set(rows) == {0, 1, 2} and rows[2].why == "theme matches concepts: night river (bridge)" and rows[0].concepts == ["memory"]
    assert session.concept_theme(themes, 0).count() == 0


def test_passage_graphs_by_hand(spark):
    text = "River stone sings. River stone waits! The stone glows? River stone"
    rows = [(1, text, "x"), (2, None, "y"), (3, "", "z"), (4, "alpha", "t")]
    got = {r.id: r for r in concepts.passage_graphs(spark.createDataFrame(rows, "id long, text string, concepts string")).collect()}
    # Pairs of words come first, and "river", "stone" and "sings" are held by those chosen.
    assert got[1].concepts[0] == "river stone" and not any(a != b and a in b for a in got[1].concepts for b in got[1].concepts)
    labels, said = got[1].concepts, ["river stone sings.", "river stone waits!", "the stone glows?", "river stone"]
    both = {(a, b): sum(labels[a] in s and labels[b] in s for s in said) for a in range(len(labels)) for b in range(a + 1, len(labels))}
    assert {(e.a, e.b): e.n for e in got[1].edges} == {k: n for k, n in both.items() if n}
    assert [(got[i].concepts, got[i].edges) for i in (2, 3, 4)] == [([], []), ([], []), (["alpha"], [])]
    assert concepts.passage_graphs(spark.createDataFrame([], "id long, text string")).count() == 0


def test_contained_equals_brute_force(spark):
    texts = {1: "The quick brown fox jumps over the lazy dog, again and again.", 2: "foxes  jump\n\nover fences", 3: "", 4: None, 5: "a b c d e f g h i j a b c d e f g h i j", 6: "x"}
    quotes = ["ox jumps ov", "fox", "ump", "x", "  ", "\n\n", "quick brown fox jumps over the lazy do", "b c d e f g h i", "a", "gain", "never there", "ver fe", "", None, " ", "fox\n", "c d e"]
    spines = spark.createDataFrame([*texts.items()], "book_id long, text string").withColumn("w", F.lit(1))
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(quotes)] + [(1, "fox")], "quote_id long, quote string").withColumn("gram", F.lit(0))
    got = sorted((r.quote_id, r.book_id, r.hits) for r in anchors.contained(rows, spines.select("book_id", "text")).collect())
    assert got == sorted((i, b, t.count(x)) for i, x in enumerate(quotes) if x for b, t in texts.items() if t and x in t)
    plan = anchors.contained(rows, spines)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert anchors.contained(rows.limit(0), spines).count() == 0 and anchors.contained(rows, spines.limit(0)).count() == 0
