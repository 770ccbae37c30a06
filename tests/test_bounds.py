"""Bound-driven cuts give what all pairs give: keywords by terms' bounds, vectors by blocks' balls."""

import random

import numpy as np

from strandweave.operators import engines, lexical, pruned


def test_best_passages_by_term_bounds_equal_all_scores(spark, monkeypatch):
    monkeypatch.setattr(lexical, "FEW_POSTINGS", 0)
    rng = random.Random(3)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)]
    texts = [(i, f"b{i % 3}", " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 30, 80])))) for i in range(220)]
    texts += [(900, "b0", None), (901, "b1", texts[5][2]), (902, "b2", texts[5][2])]
    chunks = spark.createDataFrame(texts, "id long, book_id string, text string")
    index = lexical.LexicalIndex(chunks)
    themes = spark.createDataFrame([(i, t) for i, _, t in texts[:40]] + [(700, "w1 w1 w2 unseen"), (701, ""), (702, None)], "id long, text string")
    asked = lexical.theme_terms(themes).cache()
    every = index.scores(asked).cache()
    for k in (1, 4):
        want = sorted((r.seed_id, r.id, r.pos, r.score, r.n_terms, tuple(r.terms)) for r in engines.ranked(every, k, "score").collect())
        got = sorted((r.seed_id, r.id, r.pos, r.score, r.n_terms, tuple(r.terms)) for r in lexical.lexical(index, asked, k).collect())
        assert got == want and got
    cut = index.scores(asked, 4)
    assert cut.count() < every.count()  # some passages were never scored
    own = lexical.lexical(index, asked, 3, passage_seeds=True)
    assert sorted((r.seed_id, r.id, r.pos) for r in own.collect()) == sorted((r.seed_id, r.id, r.pos) for r in engines.ranked(every.where("seed_id != id"), 3, "score").collect())


def test_an_empty_index_has_no_scores(spark):
    index = lexical.LexicalIndex(spark.createDataFrame([], "id long, text string"))
    assert index.scores(spark.createDataFrame([(1, "a")], "seed_id long, term string"), 3).count() == 0


def vectors(spark, m, first=0):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(m)], "id long, vec array<double>")


def test_blocks_by_bounds_give_the_nearest_of_all(spark, monkeypatch):
    monkeypatch.setattr(pruned, "BLOCK_ROWS", 60)
    monkeypatch.setattr(pruned, "SEED_ROWS", 50)
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(12, 16)) * 3
    m = np.concatenate([middles[i % 12] + 0.1 * rng.normal(size=16) for i in range(900)]).reshape(-1, 16)
    m = np.concatenate([m, m[:5], np.zeros((1, 16)), np.repeat(m[7:8], 150, axis=0)])  # copies, nought, and many of one
    table = vectors(spark, m).unionByName(spark.createDataFrame([(5000, None), (5001, [None] * 16)], "id long, vec array<double>"))
    got = pruned.nearest(table, table, 4).collect()
    sims = m @ m.T
    np.fill_diagonal(sims, -np.inf)
    order = np.lexsort((np.broadcast_to(np.arange(len(m)), sims.shape), -np.round(sims, 9)), axis=1)[:, :4]
    score = {(r.seed_id, r.pos): r.similarity for r in got}
    assert len(got) == 4 * len(m) and all(abs(score[i, p + 1] - sims[i, j]) < 1e-9 for i, own in enumerate(order) for p, j in enumerate(own))
    assert sum(r.multiplied for r in got if r.pos == 1) < 0.5 * len(m) ** 2


def test_few_or_no_vectors(spark):
    one = vectors(spark, np.ones((1, 3)))
    assert pruned.nearest(one, one, 3).collect() == [] and pruned.nearest(one.limit(0), one.limit(0), 3).collect() == []
    assert [(r.seed_id, r.id) for r in pruned.nearest(one, vectors(spark, np.ones((2, 3)), 7), 3).orderBy("pos").collect()] == [(0, 7), (0, 8)]


def test_passages_as_seeds_get_the_best_of_all_scores_and_leave_their_books_out(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_ROWS", 32)
    monkeypatch.setattr(lexical, "SEED_ROWS", 50)
    monkeypatch.setattr(lexical, "SCORED_ROWS", 7)
    scored = []
    monkeypatch.setattr(lexical.LexicalIndex, "scores", lambda self, *a, real=lexical.LexicalIndex.scores: scored.append(a) or real(self, *a))
    rng = random.Random(4)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)]
    texts = [(i, None if i == 9 else f"b{i % 3}", " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 30, 80])))) for i in range(200)]
    chunks = spark.createDataFrame([*texts, (900, "b0", None), (901, "b1", texts[5][2])], "id long, book_id string, text string")
    index = lexical.LexicalIndex(chunks)
    asked = index.distinctive_terms().selectExpr("id AS seed_id", "term").cache()
    book = {r.id: r.book_id for r in chunks.collect()}
    show = lambda df: sorted((r.seed_id, r.id, r.pos, r.score, r.n_terms, tuple(r.terms)) for r in df.collect())
    picks = show(lexical.lexical(index, asked, 3, books=chunks)), show(lexical.lexical(index, asked, 3, passage_seeds=True))
    # No pair of passages that share a term was a row.
    assert not scored
    every = [r for r in index.scores(asked).collect() if r.seed_id != r.id]
    for got, pairs in zip(picks, ([r for r in every if None not in (book[r.seed_id], book[r.id]) and book[r.seed_id] != book[r.id]], every)):
        want = []
        for seed in {r.seed_id for r in pairs}:
            best = sorted((r for r in pairs if r.seed_id == seed), key=lambda r: (-r.score, r.id))[:3]
            want += [(seed, r.id, pos, r.score, r.n_terms, tuple(r.terms)) for pos, r in enumerate(best, 1)]
        assert got == sorted(want) and got
