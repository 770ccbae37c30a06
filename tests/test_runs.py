"""Greedy runs composed of chunks against reading a book from its start."""

import random

from strandweave.operators import passages


def plain(units, closed):
    out, book, section, held = [], None, 0, 0
    for b, i, w, c in sorted(units, key=lambda u: u[:2]):
        if b != book:
            book, section, held = b, 0, 0
        elif closed(held, c):
            section, held = section + 1, 0
        held += w or 0
        out.append((b, i, section))
    return out


def test_runs_of_chunks_equal_a_plain_walk(spark, monkeypatch):
    monkeypatch.setattr(passages, "CHUNK_UNITS", 7)
    rng = random.Random(11)
    units = [("hot", i, rng.choice([0, 3, 20, 60, 150, 400, None]), rng.choice([None, rng.random()])) for i in range(700)]
    units += [("b", i, 5, 0.1) for i in range(90)] + [("c", 1, None, None), ("d", 5, 5000, 0.0), ("d", 6, 1, 0.0)]
    table = spark.createDataFrame(units, "book_id string, id long, words int, cosine double")
    for least, target in ((1000, 1000), (60, 240), (1, 1), (50, 100_000)):
        got = passages.numbered_runs(table, lambda words, cosine, a=least, b=target: passages.np.where(cosine < 0.5, a, b)).collect()
        want = plain(units, lambda held, c, a=least, b=target: held >= b or (held >= a and c is not None and c < 0.5))
        assert sorted((r.book_id, r.id, r.section) for r in got) == want
    assert passages.numbered_runs(table.limit(0), lambda words, cosine: words + 1.0).count() == 0


def test_one_book_is_many_chunks(spark):
    units = spark.range(40_000).selectExpr("1L book_id", "id", "cast(id % 50 as int) words", "cast(null as double) cosine")
    rows = units.repartitionByRange(8, "book_id", "id").sortWithinPartitions("book_id", "id").mapInArrow(
        passages._chunked(lambda words, cosine: passages.np.full(len(words), 1000.0)),
        "chunk long, ids array<long>, words array<long>, need array<double>, least array<double>, cuts array<long>, after array<long>, book_id long",
    ).collect()
    assert len(rows) >= 10 and len({r.chunk >> 33 for r in rows}) == 8 and max(len(r.least) for r in rows) < 60
