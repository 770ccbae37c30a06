"""Passages by the words they share with a quote, counted within tasks."""

import re

from strandweave.operators import anchors


def test_best_are_those_by_hand_and_no_pair_is_a_row(spark, monkeypatch):
    monkeypatch.setattr(anchors, "TOGETHER", 3)
    texts = [(i, " ".join(f"word{(i * k) % 7}" for k in range(1, 6)) + (" Common!" if i % 2 else "")) for i in range(40)] + [(40, None), (41, "")]
    quotes = [(1, "common word1 WORD2"), (2, "word3 word3"), (3, "no such thing"), (4, "")]
    q = spark.createDataFrame(quotes, "quote_id long, quote string")
    found = anchors.orphan_candidates(q, spark.createDataFrame(texts, "id long, text string").repartition(5), 3)
    # Joined by their words, each passage of a quote was a row before the best were chosen.
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    words = lambda t: set(re.findall("[a-z0-9]{3,}", (t or "").lower()))
    want = set()
    for n, quote in quotes:
        shared = sorted((-len(words(quote) & words(t)), i) for i, t in texts if words(quote) & words(t))
        want |= {(n, i, round(-hits / len(words(quote)), 9), pos) for pos, (hits, i) in enumerate(shared[:3], 1)}
    assert {(r.quote_id, r.id, round(r.overlap, 9), r.pos) for r in found.collect()} == want and want
