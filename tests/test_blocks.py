"""What tasks give of block products: few rows however many blocks, and the same picks as small tables' own path."""

import numpy as np

from strandweave.operators import blocked, engines


def vectors(spark, n=60, seed=3):
    m = np.random.default_rng(seed).standard_normal((n, 8))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    return spark.createDataFrame([(i, f"b{i % 4}", f"a{i % 3}", [float(x) for x in v]) for i, v in enumerate(m)], "id long, book_id string, author string, vec array<double>"), m


def rows(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


def test_rows_that_leave_tasks_do_not_grow_with_the_blocks(spark, monkeypatch):
    v, _ = vectors(spark, 200)
    monkeypatch.setattr(blocked, "FEW_PAIRS", 0)
    out = {}
    pairs = blocked.block_pairs
    monkeypatch.setattr(engines, "block_pairs", lambda *a: out.setdefault("df", pairs(*a)))
    for size in (25, 5):
        monkeypatch.setattr(blocked, "BLOCK_ROWS", size)
        out.clear()
        engines.plain(v, v, 2)
        # Two shares of each of 8 blocks, one of each of 40: without gathering 3,200 rows and 16,000.
        assert out["df"].count() <= 2 * 200 * 2


def test_many_blocks_give_the_picks_of_few(spark, monkeypatch):
    v, _ = vectors(spark)
    two = v.withColumn("svec", v.vec)
    made = {
        "band": lambda: engines.band(v, v, skip_top=2, pool=12, min_sim=-1.0), "spread": lambda: engines.spread(v, v, k=4, skip_top=1, pool=9, min_sim=0.0),
        "echo": lambda: engines.echo(v, v, k=3, gap=2, min_sim=-1.0), "structural": lambda: engines.structural(two, two, 3, -1.0), "walk": lambda: engines.walk(v, v, 3, 2, -1.0),
        "rank": lambda: engines.corpus_rank(engines.plain(v, v, 4), v, v),
    }
    want = {name: rows(f()) for name, f in made.items()}
    for module in (blocked, engines):
        monkeypatch.setattr(module, "FEW_PAIRS", 0)
    monkeypatch.setattr(blocked, "BLOCK_ROWS", 9)
    monkeypatch.setattr(blocked, "MOST_PLACES", 16)
    monkeypatch.setattr(engines, "HELD_BYTES", 2000)
    for name, f in made.items():
        assert rows(f()) == want[name] and want[name], name


def test_places_before_picks_are_counted_as_by_hand():
    rng = np.random.default_rng(5)
    for top in (True, False):
        sims = np.round(rng.standard_normal((150, 400)), 2)  # many equals
        ids = rng.permutation(400)
        at = np.argsort(-sims, axis=1)[:, :3] if top else rng.integers(0, 400, (150, 3))
        reached, picked = np.take_along_axis(sims, at, 1), ids[at]
        reached[7, 1] = np.nan
        got = engines.before(sims, ids, reached, picked)
        for r in range(150):
            for k in range(3):
                if (r, k) != (7, 1):
                    assert got[r, k] == sum(1 for s, i in zip(sims[r], ids) if s > reached[r, k] or (s == reached[r, k] and i < picked[r, k]))
