"""Resolution by shared segments against the plain one, and interval joins against all pairs."""

import random
import re

import pyarrow as pa
from strandweave.operators import anchors, intervals, reader


def mangled(rng, text):
    out = list(text)
    for _ in range(rng.randint(0, max(1, len(out) // 25))):
        k = rng.randrange(len(out))
        out[k : k + 1] = rng.choice([[], [rng.choice("xyz ")], [out[k], "q"]])
    return "".join(out)


def test_segments_resolve_as_the_whole_text_does(spark, monkeypatch):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgho", k=rng.randint(1, 8))) for _ in range(60)] + ["naïve", "coöp-", "ﬁne", "well-\nknown", "soft­hyphen", "日本"]
    books = {b: "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\n", " \n\n"]) for _ in range(n)) for b, n in ((1, 700), (2, 60), (3, 3), (4, 400))}
    books[5], books[6], books[7] = "", None, "again and again and again"
    rows = []
    for n in range(130):
        book = rng.choice([1, 1, 1, 2, 3, 4, 4, 9])
        text = books.get(book) or "nothing here"
        at = rng.randrange(len(text))
        quote = text[at : at + rng.randint(1, 160)]
        quote = mangled(rng, quote) if n % 2 else quote
        context = n % 3 == 0
        rows.append((n, book, quote, text[max(0, at - 20) : at] if context else None, text[at + len(quote) :][:20] if context else None))
    rows += [(500, 1, None, None, None), (501, 1, "", "a", "b"), (502, 5, "x", None, None), (503, 6, "x", None, None), (504, None, "x", None, None)]
    rows += [(505, 7, "again", None, None), (506, 7, "again", "and ", None), (507, 7, "again", None, " and"), (508, 1, " ", None, None), (509, 7, "gain and agaim", None, None)]
    quotes = spark.createDataFrame(rows, "quote_id long, book_id long, quote string, prefix string, suffix string")
    spines = spark.createDataFrame(list(books.items()), "book_id long, text string")
    monkeypatch.setattr(anchors, "SEGMENT", 300)
    monkeypatch.setattr(anchors, "PACK", 20)
    want = {i: anchors.resolve(books.get(b) or "", q or "", p, s) or (None, None, None, "orphan") for i, b, q, p, s in rows}
    got = {r.quote_id: (r.start, r.end, r.confidence, r.tier) for r in anchors.resolve_all(quotes, spines).collect()}
    assert {i: (want[i], got[i]) for i in want if want[i] != got[i]} == {}
    assert {t for *_, t in got.values()} == {"exact", "normalised", "fuzzy", "orphan"}


def test_touching_pairs_equal_all_pairs(spark):
    rng = random.Random(6)
    made = lambda n: [(rng.choice([1, 1, 1, 2]), i, (a := rng.randint(-50, 9000)), a + int(rng.choice([0, 1, 3, 40, 400, 5000, -2]) * rng.random() + rng.choice([0, 1]))) for i in range(n)]
    left, right = made(150) + [(None, 900, 0, 5), (1, 901, None, 5), (1, 902, 0, 1 << 40)], made(140) + [(1, 903, -5, 1 << 30), (3, 904, 0, 9)]
    schema = "book long, id long, start long, end long"
    got = intervals.touching(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), "book").select("l.id", "r.id").collect()
    real = lambda x: None not in x and x[2] < x[3]
    want = [(x[1], y[1]) for x in left for y in right if real(x) and real(y) and x[0] == y[0] and x[2] < y[3] and y[2] < x[3]]
    assert sorted(map(tuple, got)) == sorted(want)
    none = spark.createDataFrame([], schema)
    assert intervals.touching(none, spark.createDataFrame(right, schema), "book").count() == 0


def test_pairs_tried_grow_with_the_pairs_found(spark):
    n = 4000
    spans = spark.range(n).selectExpr("1L book", "id", "id * 100 start", "id * 100 + 30 end")
    passages = spark.range(n // 10).selectExpr("1L book", "id", "id * 1000 start", "id * 1000 + 1000 end")
    found = intervals.touching(spans, passages, "book").count()
    levels = [intervals._binned(s.selectExpr("book key", "start a", "end b").withColumn("level", intervals._level()), x) for s, x in ((spans, [10]), (passages, []))]
    tried = levels[0].join(levels[1], ["key", "at", "bin"]).count()
    assert found == n and tried <= 3 * found


def test_runs_are_cut_where_spans_begin_and_end(spark):
    runs = spark.createDataFrame([(1, 0, 10), (1, 10, 30), (1, 10, 30), (1, 5, 5), (2, 0, 4)], "book_id long, start long, end long")
    spans = spark.createDataFrame([(1, 7, 8, 12), (1, 3, 11, 20), (1, 9, 50, 60), (3, 1, 0, 4)], "book_id long, span_id long, start long, end long")
    got = sorted(tuple(r) for r in reader.highlighted_runs(runs, spans).select("book_id", "start", "end", "span_id").collect())
    assert got == [(1, 0, 8, None), (1, 8, 10, 7), (1, 10, 11, 7), (1, 11, 12, 3), (1, 12, 20, 3), (1, 20, 30, None), (2, 0, 4, None)]


def test_keys_of_runs_are_those_of_split_words(monkeypatch):
    rng = random.Random(11)
    gaps = [" ", "  ", "\n", "\t", "\x0b", "\u00a0", "\u2003", "\r\n"]
    texts = ["".join(rng.choice(["a", "b", "é", "ab", "x" * 40]) + rng.choice(gaps) for _ in range(rng.choice([0, 1, 2, 3, 9, 60]))) for _ in range(80)]
    texts += [None, "", "   ", " a b", "c", "a b c", "\x00 \x00 \x00\x00"]
    for hashed in (1 << 20, 50):
        monkeypatch.setattr(anchors, "HASHED", hashed)
        row, key = anchors._run_keys(pa.array(["skipped", *texts])[1:], 3)
        want = []
        for r, text in enumerate(texts):
            w = [x for x in re.split(r"[ \t\n\x0b\f\r]+", text or "") if x]
            want += [(r, tuple(w[i : i + 3])) for i in range(len(w) - 2)]
        assert row.tolist() == [r for r, _ in want]
        # Equal runs have equal keys, others have others.
        assert len(set(key.tolist())) == len({k for _, k in want}) == len({(k, run) for k, (_, run) in zip(key.tolist(), want)})
    assert all(len(x) == 0 for x in anchors._run_keys(pa.array([], pa.string()), 3))
    assert all(len(x) == 0 for x in anchors._run_keys(pa.array(["", None]), 3))


def test_contained_meets_only_runs_that_quotes_have(spark, monkeypatch):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(30)]
    books = [(i, " ".join(rng.choice(words) for _ in range(120))) for i in range(40)] + [(98, ""), (99, None)]
    quotes = [(i, books[i % 40][1][3 : 3 + 20 + 9 * (i % 5)]) for i in range(60)] + [(100, None), (101, ""), (102, "w1 " * 9), (7, books[7][1][:70])]
    q, s = spark.createDataFrame(quotes, "quote_id long, quote string"), spark.createDataFrame(books, "book_id long, text string")
    made, real = [], anchors._keyed
    monkeypatch.setattr(anchors, "_keyed", lambda *a: made.append(real(*a)) or made[-1])
    got = sorted(set((r.quote_id, r.book_id, r.hits) for r in anchors.contained(q, s).collect()))
    assert got == sorted({(a, b, t.count(x)) for a, x in quotes if x for b, t in books if t and x in t})
    # Before, each of a book's runs was a row.
    assert made[1].count() < 40 * 115 / 4


def test_an_import_finds_its_quotes_once(spark, monkeypatch):
    calls, real = [], anchors.contained
    monkeypatch.setattr(anchors, "contained", lambda *a, **k: calls.append(1) or real(*a, **k))
    from strandweave.plans import queries

    df = queries.import_counts(spark, "/root/testdata/sf0.001")
    scans = df._jdf.queryExecution().optimizedPlan().toString()
    assert len(calls) == 1 and "documents" not in scans and df.count()


def test_imports_into_books_of_long_ids_are_told_apart(spark, tmp_path):
    from strandweave.plans import queries

    quote = "the slow river of words that nobody had counted before noon"
    far = [7, 500007, 1000006, 1000007]
    spark.createDataFrame([(i, f"A start {i}. {quote} and an end.") for i in far], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(6, quote), (7, quote + " and an")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    # Of each book one pair for each quote, and its repetition; no book of id 6, so that its pair is an orphan's.
    got = {r.book_id: (r.imported, r.orphaned, r.duplicate, r.total) for r in queries.import_counts(spark, str(tmp_path)).collect()}
    assert got == {6: (0, 0, 2, 2)} | {i: (0, 0, 4, 4) if i % 3 == 0 else (2, 0, 2, 4) for i in far}
    made = [(r.quote_id, r.target, r.orphaned) for r in queries.annotations_created(spark, str(tmp_path)).collect()]
    assert sorted(made) == sorted([(6000006, "book:6", True)] + [(item * 1000000 + i, str(i), False) for item in (6, 7) for i in far])
