"""Rule counts against plain Python, the forest against a walk of its trees, and held-out verdicts."""

import random
import re
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
from strandweave.llm import rules  # noqa: E402

DOCS = "doc_id long, text string, x string, score double, kept int, quality int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    marked = {j for i, w in enumerate(windows) if w in twice for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(marked))


def texts():
    rng = random.Random(2)
    out = [None, "", " \t\n\x0b\x0c\r", "a", "a b", "a b c a b c", "a a a a", "x\n x\nx\nx \n\nx", "é日本\xa0語   \x1c \x85 w", "#*$%&|<> |", "w " * 30_000, "z" * 200_000, "🙂 🙂 🙂 🙂 ǅ ١٢"]
    out += ["".join(rng.choices(["a", "b", "é", " ", "\n", "\t", "#", "\xa0", "1"], k=rng.randint(0, 200))) for _ in range(400)]
    return out


def test_counts_equal_plain_python():
    assert [rules.counts(t)[:5] for t in texts()] == [plain(t) for t in texts()]
    for t in texts():
        v = dict(zip(rules.COUNTS, rules.counts(t)))
        if v["n_words"]:
            words = t.encode().split()
            assert v["n_distinct"] == len(set(words)) and v["n_same"] == sum(a == b for a, b in zip(words, words[1:]))
            assert v["upper"] == sum(c.isupper() or c.istitle() for c in t) and v["longest"] == max(map(len, words))
    assert np.isfinite(rules.features(np.array([rules.counts(t) for t in texts()]))).all()


def test_paths_equal_a_walk_of_each_tree():
    rng = np.random.default_rng(3)
    good = rng.normal(size=(300, 4))
    forest = rules.grow(good, np.concatenate([good, good + 9]), trees=20)
    rows = np.concatenate([good[:40], rng.normal(size=(20, 4)) + 9, np.full((1, 4), -50.0)])

    def walk(tree, x):
        at = 0
        while (f := forest.feature[tree, at]) >= 0:
            at = 2 * at + 1 + (x[f] >= forest.cut[tree, at])
        return forest.length[tree, at]

    want = [np.mean([walk(t, x) for t in range(20)]) for x in rows]
    assert np.allclose(forest.paths(rows), want)
    scores = forest.score(rows)
    assert scores[40:60].min() > scores[:40].max()


def test_threshold_weighs_good_rows_and_takes_the_middle_of_a_gap():
    good, bad = np.zeros(rules.BINS), np.zeros(rules.BINS)
    good[100], bad[300] = 10, 10
    assert 190 <= rules.best_bin(good, bad) <= 210
    good[310], bad[90] = 1, 1
    assert rules.best_bin(good, bad) >= 310  # one good row of eleven weighs more than ten bad ones
    assert rules.best_bin(good, np.zeros(rules.BINS)) >= 310


def corpus(n=600):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("abcdefghilmnoprstu", k=rng.randint(2, 9))) for _ in range(900)]
    rows = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(60, 400))]
        if i % 5 == 0:
            words = [w + rng.choice(["###", "$$$", "|||"]) for w in words]
        rows.append((i, " ".join(words), int(i % 5 != 0)))
    return rows


def test_verdicts_on_rows_without_labels_nulls_and_repeats(spark):
    rows = corpus()
    odd = [(9000, None), (9001, ""), (9002, "few words"), (9003, "same words here " * 50), (None, rows[1][1]), (3, rows[3][1]), (3, "three")]
    docs = spark.createDataFrame([(i, t, "x", 0.5, 7, 1) for i, t, _ in rows] + [(i, t, None, None, None, None) for i, t in odd], DOCS)
    labels = spark.createDataFrame([(i, q, 0, "t") for i, _, q in rows if i % 2] + [(1, None, 0, "t"), (None, 1, 0, "t"), (2, 5, 0, "t"), (7, 1, 0, "t")], "doc_id long, quality int, toxic int, x string")
    stats = rules.statistics(docs)
    model = rules.fit(stats, labels)
    got = rules.judged(stats, model).collect()
    assert sorted((str(r[0]), *r[1:6]) for r in got) == sorted((str(i), *plain(t)) for i, t in [(i, t) for i, t, _ in rows] + odd)
    assert {r["doc_id"] for r in got if r["base_failed"]} == {9000, 9001, 9002, 9003, 3}
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert kept == {i for i, _, q in rows if q} | {None}
    assert not [r for r in got if r["kept"] and r["base_failed"]]
    assert sorted(str(r["doc_id"]) for r in rules.accepted(docs, model).collect()) == sorted(str(r["doc_id"]) for r in got if r["kept"])


def test_without_labels_and_rows(spark):
    docs = spark.createDataFrame([(i, t, "x", 0.5, 7, 1) for i, t, _ in corpus(20)], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int")
    stats = rules.statistics(docs)
    assert all(r["kept"] for r in rules.judged(stats, rules.fit(stats, none)).collect())
    stats = rules.statistics(docs.limit(0))
    assert rules.judged(stats, rules.fit(stats, none)).collect() == []
