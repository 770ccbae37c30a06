"""Rhythm against a plain walk of the log, over spans of time and as a stream whose events come out of order."""

import random
import statistics
from collections import defaultdict

from pyspark.sql import functions as F

from strandweave.functions import text as T
from strandweave.operators import rhythm
from strandweave.shared import shared_folder
from strandweave.streaming import rhythm as stream

SCHEMA = "book long, session string, t long, type string, passage long, event_id long, highlighted boolean"
DAY = 86_400_000_000


def log(n=400):
    rng = random.Random(8)
    kinds = ["enter", "enter", "exit", "idle", "active", "hidden", "visible", "select"]
    rows = []
    for i in range(n):
        book = rng.choice([1, 1, 1, 2, 3])
        # Days without events, several events at one moment, and sessions that lie within each other.
        t = rng.choice([0, 1, 2, 9]) * DAY + rng.randint(0, 40) * (DAY // 37)
        rows.append((book, rng.choice("ab"), t, rng.choice(kinds), rng.randint(0, 5), i, rng.random() < 0.5))
    return rows


def walked(rows, key):
    """(key, passage, start, end, event_id, open) of visits and (key, kind, from, to) of dead spans."""
    visits, dead = [], []
    logs = defaultdict(list)
    for r in rows:
        logs[key(r)].append(r)
    for k, own in logs.items():
        own.sort(key=lambda r: (r[2], r[5]))
        marks = [r for r in own if r[3] in ("enter", "exit")]
        for a, b in zip(marks, [*marks[1:], None]):
            if a[3] == "enter":
                visits.append((k, a[4], a[2], b[2] if b else a[2], a[5], b is None))
        for opens, closes in (("idle", "active"), ("hidden", "visible")):
            start = None
            for r in own:
                if r[3] == opens and start is None:
                    start = r[2]
                elif r[3] == closes and start is not None:
                    dead.append((k, opens, start, r[2]))
                    start = None
    return visits, dead


def test_visits_spans_and_features_equal_a_plain_walk(spark):
    rows = log()
    events = spark.createDataFrame(rows + [(None, "a", 5, "enter", 1, 9999, False)], SCHEMA)
    visits, dead = walked(rows, lambda r: r[0])
    assert sorted(map(tuple, rhythm.visits(events).collect())) == sorted((k, p, a, b, e) for k, p, a, b, e, _ in visits)
    got = [(r[0], kind, *r[1:]) for kind, close in (("idle", "active"), ("hidden", "visible")) for r in rhythm.dead_spans(events, kind, close).collect()]
    assert sorted(got) == sorted(dead)
    words = spark.createDataFrame([(p, 10 * p) for p in range(4)], "passage long, words int")
    want = defaultdict(list)
    for k, p, a, b, e, _ in sorted(visits, key=lambda v: (v[2], v[4])):
        lost = sum(max(0, min(b, d1) - max(a, d0)) for dk, _, d0, d1 in dead if dk == k)
        want[k, p].append(max(0.0, (b - a - lost) / 1000))
    for r in rhythm.features(events, words).collect():
        own, n = want.pop((r.book, r.passage)), max(1, 10 * r.passage if r.passage < 4 else 1)
        chosen = [x[6] for x in rows if x[0] == r.book and x[4] == r.passage and x[3] == "select"]
        assert abs(r.attentive_ms - sum(own)) < 1e-3 and r.revisits == len(own) - 1 and abs(r.first_pass_ms_per_word - own[0] / n) < 1e-6
        assert abs(r.max_dwell_ms - max(own)) < 1e-3 and r.selections == len(chosen) and r.selected_not_highlighted == any(not h for h in chosen)
    assert not want


def test_medians_are_exact(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice([0.0, 1.0, rng.random() * 1e6, rng.random()])) for k in (1, 2, 3) for _ in range(rng.choice([7, 8, 200]))]
    rows += [(4, 2.5), (5, 1.0), (5, 4.0), (6, 3.0), (6, 3.0), (6, 3.0), (7, None)]
    got = {r.key: (r.med, r.n) for r in rhythm.medians(spark.createDataFrame(rows, "key int, v double"), "key", "v").collect()}
    values = {k: [v for x, v in rows if x == k and v is not None] for k in range(1, 7)}
    assert set(got) == set(values) and all(abs(got[k][0] - statistics.median(v)) < 1e-9 and got[k][1] == len(v) for k, v in values.items())


def test_a_session_is_scored_against_the_whole_history(spark):
    rows, n = [], 0

    def visit(session, t, passage, seconds, select=None):
        nonlocal n
        for at, kind, h in ((t, "enter", False), *(((t + 1, "select", select),) if select is not None else ()), (t + seconds, "exit", False)):
            rows.append((1, session, at * 1_000_000, kind, passage, n, h))
            n += 1

    for p in range(10):
        visit("2024-01-01", 100 * p, p, 10 + p % 3)
    visit("2024-01-02", 5000, 3, 90, False)  # slow, selected without a highlight
    visit("2024-01-02", 6000, 4, 11, True)  # selected, but highlighted
    visit("2024-01-02", 7000, 5, 95)  # slow only
    visit("2024-01-02", 8000, 6, 80, False)  # labelled
    words = spark.createDataFrame([(p, 10) for p in range(10)], "passage long, words int")
    events, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(6,)], "passage long")
    got = rhythm.candidates(events, words, labels).collect()
    assert [(r.session, r.passage, r.pos, r.signals, r.revisits, r.have_baseline) for r in got] == [("2024-01-02", 3, 1, ["slow", "selected"], 0, True)]
    assert rhythm.candidates(events, words, labels, F.lit("2024-01-01")).collect() == []
    assert rhythm.candidates(events.where("t < 0"), words, labels).collect() == []


def test_stream_in_waves_gives_the_walk_and_drops_what_is_late(spark):
    rows = log(300)
    rng = random.Random(2)
    delay = 2 * DAY
    waves = defaultdict(list)
    for r in rows:
        waves[(r[2] + rng.randint(0, delay - 1)) // (3 * DAY)].append(r)
    folder = shared_folder(spark, "rhythm-test")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def run(wave):
        spark.createDataFrame(wave, SCHEMA).coalesce(2).write.mode("append").parquet(f"{folder}/in")
        flow = stream.intervals(spark.readStream.schema(SCHEMA).parquet(f"{folder}/in"), "2 days", 30 * DAY // 1000)
        flow.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()

    for wave in sorted(waves):
        run(waves[wave])
    run([(-1, "tick", 100 * DAY, "tick", None, -1, False)])
    run([(1, "a", 5 * DAY, "enter", 1, 7000, False), (1, "a", 5 * DAY + 1, "exit", 1, 7001, False)])  # late: no visit
    run([(-1, "tick", 200 * DAY, "tick", None, -2, False)])
    visits, dead = walked(rows, lambda r: (r[0], r[1]))
    got = spark.read.schema(stream.INTERVALS).parquet(f"{folder}/out").collect()
    assert sorted((r.book, r.session, r.passage, r.start, r.end, r.event_id, r.open) for r in got if r.kind == "visit") == sorted((*k, *v) for k, *v in visits)
    assert sorted((r.book, r.session, r.kind, r.start, r.end) for r in got if r.kind != "visit") == sorted((*k, *v) for k, *v in dead)


def test_fixed_word_lists_have_their_size():
    assert len(T.STOP_WORDS) == len(set(T.STOP_WORDS)) == 104 and "being" not in T.STOP_WORDS
    assert len(T.CONCEPT_STOP_WORDS) == len(set(T.CONCEPT_STOP_WORDS)) == 219 and {"being", "lectures", "london"} <= set(T.CONCEPT_STOP_WORDS)
