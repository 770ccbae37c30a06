"""Concepts by bounds of hashed sums."""

import random
from collections import Counter, defaultdict
from math import log

import pytest
from pyspark.sql import functions as F

from strandweave.operators import blocked, concepts


@pytest.mark.parametrize("buckets", [1 << 18, 64, 1])
def test_the_heaviest_grams_by_bounds_are_those_of_all(spark, monkeypatch, buckets):
    rng = random.Random(buckets)
    words = ["".join(chr(97 + int(c)) * 2 for c in str(k + 100)) for k in range(300)]
    texts = [(i, " ".join(words[min(299, int(rng.paretovariate(0.6)))] for _ in range(rng.choice([0, 2, 40])))) for i in range(150)] + [(998, None), (999, "")]
    texts.append((5, texts[5][1]))  # rows of one id are one passage, whose words count twice
    chunks = spark.createDataFrame(texts, "id long, text string")
    per = defaultdict(Counter)
    for i, text in texts:
        t = (text or "").split()
        per[i].update(t + [f"{a} {b}" for a, b in zip(t, t[1:])])
    df, total, n = Counter(g for c in per.values() for g in c), Counter(), len(texts)
    for c in per.values():
        total.update(c)
    mass = {g: round(total[g] * log(n / d), 6) for g, d in df.items() if 3 <= d <= max(4, int(0.4 * n))}
    want = sorted(mass, key=lambda g: (-mass[g], g))[:12]
    monkeypatch.setattr(concepts, "FEW_GRAMS", 0)
    monkeypatch.setattr(concepts, "BUCKETS", buckets)
    assert [r.gram for r in concepts.vocabulary(chunks, 12).orderBy(F.desc("mass"), "gram").collect()] == want


def test_activations_of_many_blocks_are_those_of_few(spark, monkeypatch):
    rng = random.Random(8)
    links = [(i, f"n{j}") for i in range(90) for j in rng.sample(range(12), rng.choice([1, 3, 5]))]
    graph = concepts.graph_weights(spark.createDataFrame(links, "id long, label string"), spark.createDataFrame([], "provenance long, target string, origin string"))
    books = spark.createDataFrame([(i, f"b{i % 4}") for i in range(90)], "id long, book_id string")
    want = sorted(map(tuple, concepts.page_rank(graph, books, 3).collect()))
    monkeypatch.setattr(blocked, "FEW_PAIRS", 0)
    monkeypatch.setattr(blocked, "BLOCK_ROWS", 10)
    monkeypatch.setattr(concepts, "PRECISE", 3)
    assert sorted(map(tuple, concepts.page_rank(graph, books, 3).collect())) == want and want
