"""Keywords of all passages: words are counted, terms chosen and pairs scored as one by one, with less looked at."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from strandweave.functions.text import STOP_WORDS, lexical_tokens, lexical_words
from strandweave.operators import blocked, lexical


@pytest.mark.parametrize("part_of,step", [(1, 64), (6, 5), (1 << 30, 3)])
@pytest.mark.parametrize("by_book", [False, True])
def test_a_block_of_seeds_gets_the_best_of_all_pairs(part_of, step, by_book):
    rng = np.random.default_rng(part_of % 7)
    # Terms in a half, a fifth, and few of the passages; the seeds are passages.
    share = np.r_[np.full(6, 0.5), np.full(10, 0.2), np.full(60, 0.02)]
    part = np.where(rng.random((90, len(share))) < share, np.round(rng.random((90, len(share))) * 2 + 0.1, 1), 0.0)
    part[80] = part[81]
    idf, book = np.log1p(1 / share), rng.integers(0, 4, 90)
    own = [sorted(rng.choice(len(share), rng.integers(1, 9), replace=False)) for _ in range(40)]
    entries = [(i, t, idf[t], p) for i, terms in enumerate(own) for p, t in enumerate(terms)]
    seed = dict(zip(("id", "code", "idf", "place"), map(np.array, zip(*entries))))
    if by_book:
        seed["book"] = book[seed["id"]]
    got, looked_at = blocked.Best(seed, 3, "score"), 0
    for low in range(0, 90, 30):
        doc, term = np.nonzero(part[low : low + 30])
        rows = [(t, d + low, part[d + low, t]) for d, t in zip(doc, term)] + [(lexical.BOOK, d, float(book[d])) for d in range(low, low + 30) if by_book and d != 45]
        table = lexical._by_code(pa.table(dict(zip(("id", "doc", "part"), map(np.array, zip(*rows))))))
        block = {c: table[c].to_numpy() for c in table.column_names}
        made = lexical._score_block(3, ["hits0"], by_book, 1 - 2.0**-18, step, part_of)(seed, block)
        looked_at += len(made["id"])
        got.add(made)
    rows = got.rows()
    found = sorted(zip(rows["seed_id"].tolist(), (-rows["score"]).tolist(), rows["id"].tolist(), rows["hits0"].tolist()))
    want = []
    for i, terms in enumerate(own):
        scores = [(-np.floor(sum(idf[t] * part[d, t] for t in terms) * 1e6 + 0.5) / 1e6, d, sum(1 << p for p, t in enumerate(terms) if part[d, t])) for d in range(90) if d != i and not (by_book and (book[d] == book[i] or d == 45))]
        want += [(i, *x) for x in sorted(x for x in scores if x[0] < 0)[:3]]
    assert [(a, round(b, 6), c, d) for a, b, c, d in found] == [(a, round(float(b), 6), c, d) for a, b, c, d in sorted(want)]
    assert looked_at < 40 * 9  # later blocks give less than their best


def test_terms_are_chosen_from_few_postings(spark, monkeypatch):
    monkeypatch.setattr(lexical, "COMMON_TERMS", 12)
    monkeypatch.setattr(lexical, "FREQUENT", 4)
    made, real = {}, lexical.stored

    def keep(df, name):
        made[name] = real(df, name)
        return made[name]

    monkeypatch.setattr(lexical, "stored", keep)
    rng = random.Random(9)
    words = [f"w{int(rng.paretovariate(0.5))}" for _ in range(3000)]
    texts = [(i, f"b{i % 3}", " ".join(rng.choice(words) for _ in range(60))) for i in range(90)]
    odd = "The _a_ __x1_y__ 12 _12_ 3a ½ É_É 日本 x _ 1_2 ÇA ça and_ _THE_ ____ ۱۲ a_b_"
    chunks = spark.createDataFrame([*texts, (900, "b0", odd), (901, "b1", odd), (902, None, None), (903, "b1", "")], "id long, book_id string, text string")
    index = lexical.LexicalIndex(chunks, chunks.where("id != 901"))
    terms = {r.id: Counter(r.t) for r in chunks.select("id", lexical_tokens("text").alias("t")).where("text is not null").collect()}
    assert {(r.id, r.term): (r.tf, r.dl) for r in index.postings.collect()} == {(i, t): (n, sum(c.values())) for i, c in terms.items() for t, n in c.items()}
    raw = chunks.where("id = 900").select(lexical_words("text")).first()[0]
    assert [w for w in raw if len(w) > 1 and not (w.isascii() and w.isdigit()) and w not in STOP_WORDS] == chunks.where("id = 900").select(lexical_tokens("text")).first()[0]
    idf = {r.term: r.idf for r in index.df.collect()}
    want = {(i, t, p) for i, c in terms.items() if i != 901 for p, (_, t) in enumerate(sorted((-round(n * idf[t], 6), t) for t, n in c.items())[:5], 1)}
    assert {(r.id, r.term, r.pos) for r in index.distinctive_terms(5).collect()} == want
    assert index.common.count() <= 12 < index.df.count() and made["heaviest"].count() < index.postings.count()
    asked = index.distinctive_terms(5).selectExpr("id AS seed_id", "term").cache()
    got = [(r.seed_id, r.id, r.score, r.n_terms) for r in lexical.lexical(index, asked, 4, passage_seeds=True).collect()]
    pairs = {}
    for r in index.scores(asked).collect():
        if r.seed_id != r.id:
            pairs.setdefault(r.seed_id, []).append((-r.score, r.id, r.n_terms))
    assert sorted(got) == sorted((s, i, -x, n) for s, found in pairs.items() for x, i, n in sorted(found)[:4])
