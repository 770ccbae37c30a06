"""Engines, text operators and analytics against plain Python on a small corpus, and against their SQL twins."""

import math
import random

import duckdb
import numpy as np
import pytest

from strandweave import registry
from pyspark.sql import functions as F

from strandweave.operators import anchors, concepts, engines, passages, rhythm
from strandweave.sources import files
from strandweave.sources import tables as S

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(21)
    centres = rng.standard_normal((4, 16))
    rows, m = [], []
    for i in range(80):
        b = i % 4
        v = 0.6 * centres[b] + rng.standard_normal(16)
        v /= np.linalg.norm(v)
        m.append(v)
        rows.append((i, f"b{b}", f"a{b % 3}", [float(x) for x in v]))
    return spark.createDataFrame(rows, "id long, book_id string, author string, vec array<double>"), np.array(m)


def picks(df):
    out = {}
    for r in df.orderBy("seed_id", "pos").collect():
        out.setdefault(r.seed_id, []).append(r.id)
    return out


def brute_band(m, s, skip, pool, low=0.0):
    sims = m @ m[s]
    ok = [j for j in range(len(m)) if sims[j] < 0.97 and sims[j] >= low and j % 4 != s % 4]
    return sorted(ok, key=lambda j: (-sims[j], j))[skip : skip + pool], sims


def test_plain_and_band_with_mmr(corpus):
    df, m = corpus
    near = picks(engines.plain(df, df, 5))
    got = picks(engines.band(df, df, k=6, skip_top=2, pool=20, min_sim=-1.0))
    for s in range(80):
        sims = m @ m[s]
        assert near[s] == sorted((j for j in range(80) if j != s), key=lambda j: (-sims[j], j))[:5]
        band, sims = brute_band(m, s, 2, 20, -1.0)
        chosen = []
        while len(chosen) < 6:
            left = [j for j in band if j not in chosen]
            chosen.append(max(left, key=lambda j: 0.4 * sims[j] - (0.6 * max(m[j] @ m[c] for c in chosen) if chosen else 0)))
        assert got[s] == chosen


def test_spread_selects_by_determinant(corpus):
    df, m = corpus
    got = picks(engines.spread(df, df, k=4, skip_top=2, pool=12, min_sim=-1.0))
    for s in range(0, 80, 9):
        band, sims = brute_band(m, s, 2, 12, -1.0)
        q = {j: math.exp(3 * round(float(sims[j]), 4)) for j in band}
        chosen = []
        for _ in range(4):
            def volume(j, chosen=chosen):
                at = [*chosen, j]
                return np.linalg.det(np.array([[q[a] * (m[a] @ m[b]) * q[b] for b in at] for a in at]))

            chosen.append(max((j for j in band if j not in chosen), key=volume))
        assert got[s] == chosen


def test_facility_covers_clusters_first():
    a, b = np.eye(4)[0], np.eye(4)[1]
    vecs = np.array([a, a, a, b, b, np.eye(4)[2]])
    assert [i for i, _ in engines.facility(np.ones(6), vecs, 3)] == [0, 3, 5]
    assert engines.coverage(vecs, [0, 3]).tolist() == [3, 1] and engines.facility(np.ones(0), vecs[:0], 3) == []


def test_walk_and_echo(corpus):
    df, m = corpus
    rows = engines.walk(df, df, hops=3, skip_top=1, min_sim=-1.0).collect()
    by = {}
    for r in sorted(rows, key=lambda r: r.hop):
        by.setdefault(r.seed_id, []).append(r)
    for s in range(80):
        at, books = s, {s % 4}
        for r in by[s]:
            sims = m @ m[at]
            order = sorted((j for j in range(80) if j % 4 not in books and sims[j] < 0.97), key=lambda j: (-sims[j], j))
            assert r.id == order[1] and r.from_id == at and abs(r.similarity - m[s] @ m[r.id]) < 1e-9
            at = r.id
            books.add(at % 4)
    for s, ids in picks(engines.echo(df, df, k=3, gap=5, min_sim=-1.0)).items():
        assert all(j % 4 == s % 4 and abs(j // 4 - s // 4) >= 5 for j in ids) and len(ids) == 3


def test_gate_closes_above_the_best(corpus):
    df, _ = corpus
    best = {r.seed_id: r.best for r in engines.best_match(df, df).collect()}
    floor = sorted(best.values())[40]
    assert {r.id for r in engines.noise_gate(df, df, floor).collect()} == {s for s, b in best.items() if b >= floor}
    assert engines.noise_gate(df, df, None).count() == 80


def test_page_rank_equals_power_iteration(spark):
    rng = random.Random(3)
    links = [(i, f"n{j}", 1.0 + j / 10) for i in range(30) for j in rng.sample(range(8), 3)]
    graph = spark.createDataFrame(links, "id long, node string, w double")
    books = spark.createDataFrame([(i, f"b{i % 5}") for i in range(30)], "id long, book_id string")
    w = np.zeros((30, 8))
    for i, n, x in links:
        w[i, int(n[1:])] = x
    out, back = w / w.sum(1, keepdims=True), w / w.sum(0)
    got = {(r.seed_id, r.id): r.similarity for r in concepts.page_rank(graph, books).collect()}
    for s in range(30):
        e = np.eye(30)[s]
        c, n = e, np.zeros(8)
        for _ in range(concepts.STEPS):
            c, n = 0.15 * e + 0.85 * back @ n, 0.85 * c @ out
        mine = {i: x for (q, i), x in got.items() if q == s}
        assert mine and all(abs(x - c[i]) < 1e-8 for i, x in mine.items())
        able = [i for i in range(30) if i % 5 != s % 5 and (w[i] * w[s]).any() and c[i] >= 1e-6]
        assert len(mine) == min(8, len(able)) and min(mine.values()) >= sorted((c[i] for i in able), reverse=True)[len(mine) - 1] - 1e-8


def test_page_rank_of_an_empty_graph(spark):
    graph = spark.createDataFrame([], "id long, node string, w double")
    assert concepts.page_rank(graph, spark.createDataFrame([(1, "b")], "id long, book_id string")).count() == 0


def test_fused_has_all_four_paths(spark):
    v = S.vec_chunks(spark, SF)
    vec = {r.id: (r.book_id, np.array(r.vec)) for r in v.collect()}
    books = v.select("id", "book_id")
    chunks = S.text_chunks(spark, SF).select("id", "text").join(books, "id")
    bridges = [r for r in S.edges(spark, SF).collect() if r.provenance in vec]
    graph = concepts.graph_weights(concepts.chunk_concepts(chunks), spark.createDataFrame(bridges))
    two = v.join(S.structural_chunks(spark, SF).select("id", F.col("vec").alias("svec")), "id")
    paths = {
        "band": engines.band(v, v, k=12), "concept": concepts.page_rank(graph, books, k=12),
        "marks": engines.marks_recall(v, S.marks(spark, SF), k=12), "structural": engines.structural(two, two, k=12),
    }
    weight = {"marks": 1.5, "structural": 1.2, "concept": 1.1, "band": 1.0}
    parts = {}
    for name, found in paths.items():
        for r in found.collect():
            parts.setdefault((r.seed_id, r.id), {})[name] = weight[name] / (10 + r.pos - 1)
    rows = registry.QUERIES["fused"](spark, SF).collect()
    seen = set()
    for r in rows:
        part, (book, x), (other, y) = parts[r.seed_id, r.id], vec[r.seed_id], vec[r.id]
        assert r.paths.split("+") == sorted(part, key=lambda p: (-part[p], p))
        assert abs(r.score - sum(part.values()) * (1 + 0.25 * (book != other) + 0.5 * (1 - x @ y))) < 2e-6
        seen.add(r.paths)
    assert "concept" in seen and any("concept" in p and "+" in p for p in seen)


def test_passages_cut_with_overlap(spark):
    text = "# One\n\n" + "\n\n".join(f"para{i} " + "word " * 49 for i in range(9)) + "\n\n<!-- page 3 -->\n\n# Two\n\nshort tail"
    books = spark.createDataFrame([(1, text), (2, ""), (3, None)], "book_id long, text string")
    rows = passages.passages(books).orderBy("n").collect()
    assert [(r.heading, r.words) for r in rows] == [("One", 250), ("One", 250)]
    assert all(text[r.start :].startswith(r.text.split("\n\n")[0]) for r in rows)
    kinds = [r.kind for r in passages.blocks(books).where("book_id = 1").orderBy("pos").collect()]
    assert kinds[0] == "heading" and "page" in kinds


def test_anchors_resolve_in_tiers(spark):
    text = "The ﬁrst hyphen-\nated word. It repeats here. It repeats here. A quite singular closing sentence stands at the end."
    assert anchors.resolve(text, "closing sentence")[3] == "exact"
    assert anchors.resolve(text, "It repeats here.") is None
    assert anchors.resolve(text, "It repeats here.", prefix="word. ")[0] == text.index("It repeats")
    assert anchors.resolve(text, "first hyphenated word")[3] == "normalised"
    assert anchors.resolve(text, "A quite singular closing sentense stands at the end.")[3] == "fuzzy"
    assert anchors.resolve(text, "nothing like it in there at all") is None
    quotes = spark.createDataFrame([(1, 1, "closing sentence", None, None), (2, 1, "It repeats here.", None, None), (3, 9, "x", None, None)], "quote_id long, book_id long, quote string, prefix string, suffix string")
    spines = spark.createDataFrame([(1, text)], "book_id long, text string")
    got = {r.quote_id: r for r in anchors.resolve_all(quotes, spines).collect()}
    assert got[1].start == text.index("closing") and got[2].tier == "orphan" and got[3].tier == "orphan"


def test_notes_and_imports():
    notes = list(anchors.parse_note("<sutra>whole <des>why?</des> <rev>lost end</sutra> x\nA line.(corr)\n(ASSERT) open"))
    assert [(n[0], n[1], n[2], n[3], n[4], n[5]) for n in notes] == [
        (0, "sutra", "seed", "whole why? lost end", False, None), (1, "describe", "context", "why?", False, 0),
        (3, "correlate", "edge", "A line.", True, None), (4, "assert", "claim", "open", False, None),
    ]
    assert list(anchors.parse_note("no marks (seed)")) == [] and list(anchors.parse_note("</sutra>")) == []
    md = "a ==hit\nover== b\n\n> quoted\n> on\n— my note\n> bare\n# head"
    assert list(files.markdown_annotations(md)) == [("hit over", ""), ("quoted on", "my note"), ("bare", "")]
    assert list(files.json_annotations('{"highlights": [{"highlightedText": "h", "remark": "m"}, "plain", 3]}')) == [("h", "m"), ("plain", "")]
    assert list(files.json_annotations('{"a": {"body": "q"}, "b": {"note": "n"}}')) == [("q", "")] and list(files.json_annotations('{"x": 1}')) == []
    assert list(files.csv_annotations("Text,Note\nq,n\n")) == [("q", "n")] and list(files.csv_annotations("q,n\nr")) == [("q", "n"), ("r", "")]
    lua = 'return { ["title"] = "T", ["text"] = "no", ["annotations"] = { { ["text"] = "q \\"x\\"", ["note"] = "n" }, { ["text"] = "r" } } }'
    assert files.parsed("a.lua", lua) == ("koreader", [('q "x"', "n"), ("r", "")])
    assert files.parsed("a", '["q"]') == ("json", [("q", "")]) and files.parsed("a.json", "q,n") == ("csv", [("q", "n")])


def test_rhythm_by_hand_and_as_a_stream(spark):
    e = [("enter", 0, 1), ("idle", 1, 1), ("idle", 2, 1), ("active", 3, 1), ("enter", 6, 2), ("select", 7, 2), ("exit", 9, 2), ("enter", 10, 1)]
    rows = [(1, t * 1_000_000, k, p, i) for i, (k, t, p) in enumerate(e)]
    events = spark.createDataFrame(rows, "book long, t long, type string, passage long, event_id long")
    words = spark.createDataFrame([(1, 2)], "passage long, words int")
    got = {r.passage: r for r in rhythm.features(events, words).collect()}
    assert (got[1].attentive_ms, got[1].ms_per_word, got[1].revisits) == (4000.0, 2000.0, 1)
    assert (got[2].attentive_ms, got[2].selections) == (3000.0, 1)


def _norm(rows, names):
    at = sorted(range(len(names)), key=lambda i: names[i])
    show = lambda v: f"{v + 0.0:.5f}".replace("-0.00000", "0.00000") if isinstance(v, float) else str(v)
    return sorted(tuple(show(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", ["plain_topk", "band_pool", "structural_gap", "lexical_theme", "chunk_concepts", "rhythm_scores", "word_counts", "anchor_exact", "sections_greedy", "toc"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "documents", "embeddings", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = registry.QUERIES[name](spark, SF)
    want = con.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert _norm(got.collect(), got.columns) == _norm(want.fetchall(), names)
