"""Products in single precision give the same picks and places as those in double."""

import numpy as np
import pytest
from strandweave.operators import blocked, engines, reports


def block(vecs, first=0):
    return {"id": np.arange(first, first + len(vecs)), "vec": vecs, "book_id": np.array([f"b{x % 3}" for x in range(len(vecs))], object)}


def vectors(rng, n, d=16):
    v = rng.standard_normal((n, d))
    v[n // 2 :] = v[: n - n // 2] * (1 + 1e-9 * rng.standard_normal((n - n // 2, 1)))  # alike in single precision
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def test_best_by_single_precision_are_those_by_double():
    rng = np.random.default_rng(3)
    s, c = block(vectors(rng, 90)), block(vectors(rng, 700), 1000)
    sims, ok = s["vec"] @ c["vec"].T, lambda i, j: s["book_id"][i] != c["book_id"][j]
    i, j, value = blocked.best_of(blocked.Products(s, c), c["id"], 5, ok=ok, least=0.1, most=0.8)
    assert np.allclose(value, sims[i, j], atol=1e-13)
    for r in range(90):
        able = [x for x in range(700) if s["book_id"][r] != c["book_id"][x] and 0.1 <= sims[r, x] < 0.8]
        best = np.sort(sims[r, able])[::-1][:5]
        assert np.allclose(np.sort(value[i == r])[::-1], best, atol=1e-13)


@pytest.mark.parametrize("odd", [np.inf, np.nan, 1e200])
def test_odd_vectors_are_multiplied_in_double(odd):
    rng = np.random.default_rng(4)
    s, c = block(vectors(rng, 8)), block(vectors(rng, 20), 100)
    c["vec"][3, 0] = odd
    with np.errstate(all="ignore"):
        sims = s["vec"] @ c["vec"].T
    i, j, value = blocked.best_of(blocked.Products(s, c), c["id"], 3)
    for r in range(8):
        real = sims[r][np.isfinite(sims[r])]
        assert np.allclose(np.sort(value[i == r]), np.sort(real)[-3:])


def test_greatest_products_of_groups():
    rng = np.random.default_rng(5)
    s, c, starts = block(vectors(rng, 30)), block(vectors(rng, 50)), np.array([0, 4, 5, 20, 49])
    sims = np.maximum.reduceat(s["vec"] @ c["vec"].T, starts, axis=1)
    i, j, value = blocked.best_of(blocked.Products(s, c, starts=starts), np.arange(5), 2)
    assert len(i) == 60 and np.allclose(value, sims[i, j], atol=1e-13)
    assert np.allclose(np.sort(value.reshape(30, 2), axis=1), np.sort(sims, axis=1)[:, -2:], atol=1e-13)


def test_places_by_whole_numbers_are_those_by_double():
    rng = np.random.default_rng(6)
    for top in (True, False):
        s, c = block(vectors(rng, 60)), block(vectors(rng, 900))
        sims = s["vec"] @ c["vec"].T
        at = np.argsort(-sims, axis=1)[:, :3] if top else rng.integers(0, 900, (60, 3))
        scores = np.take_along_axis(sims, at, 1)
        scores[7, 1] = np.nan
        got = engines.before(blocked.Products(s, c), c["id"], scores, at)
        gap = sims[:, None, :] - scores[:, :, None]
        want = ((gap > 1e-12) | ((np.abs(gap) <= 1e-12) & (c["id"][None, None, :] < at[:, :, None]))).sum(axis=2)
        assert (np.delete(got.reshape(-1), 22) == np.delete(want.reshape(-1), 22)).all()


def test_whole_numbers_leave_open_only_what_they_cannot_tell():
    """Where fractions are lost, what reaches the upper cut is over, and what misses the lower one is under; no more than two numbers lie between."""
    rng = np.random.default_rng(11)
    x, at = rng.uniform(-40, 40, 200_000), rng.uniform(-40, 40, 200_000)
    high, low = engines._cuts(at + 0.1, at - 0.1)
    number = x.astype(np.int16)
    assert (x[number >= high] > at[number >= high] + 0.1).all() and (x[number < low] < at[number < low] - 0.1).all()
    assert (high - low).max() <= 2 and engines._cuts(np.array([np.nan]), np.array([np.nan]))[0][0] == np.iinfo(np.int16).max


def test_few_passages_are_multiplied_in_double_for_places(monkeypatch):
    rng = np.random.default_rng(12)
    v = rng.standard_normal((1200, 32))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    s, c = block(v[:200]), block(v[200:], 200)
    sims, asked = s["vec"] @ c["vec"].T, []
    at = rng.integers(0, 1000, (200, 6))
    exact = blocked.Products.exact
    monkeypatch.setattr(blocked.Products, "exact", lambda self, i, j: asked.append(len(i)) or exact(self, i, j))
    products = blocked.Products(s, c)
    for _ in range(2):
        # The same products serve again.
        got = engines.before(products, c["id"], np.take_along_axis(sims, at, 1), c["id"][at])
        assert (got == (sims[:, None, :] > np.take_along_axis(sims, at, 1)[:, :, None] + 1e-13).sum(axis=2)).all()
    # Once for all tiles; besides the picks themselves few of the 1,200,000.
    assert len(asked) == 2 and asked[0] - at.size < 100


@pytest.mark.parametrize("tile", [(512, 512), (7, 16), (64, 5)])
def test_after_a_first_block_only_what_reaches_is_looked_at(monkeypatch, tile):
    monkeypatch.setattr(blocked, "TILE", tile)
    rng = np.random.default_rng(8)
    s, every = block(vectors(rng, 70)), [block(vectors(rng, 300), first) for first in (1000, 2000, 3000)]
    got, asked = blocked.Best(s, 4, "similarity"), []
    ok = lambda i, j: asked.append(len(i)) or np.ones(len(i), bool)
    for c in every:
        got.add(blocked.kept(s, c, blocked.Products(s, c), 4, ok, 0.1, 0.9))
        got.rows()
    sims, ids = s["vec"] @ np.concatenate([c["vec"] for c in every]).T, np.concatenate([c["id"] for c in every])
    sims[(sims < 0.1) | (sims >= 0.9)] = -np.inf
    rows = got.rows()
    for r in range(70):
        assert np.allclose(np.sort(rows["similarity"][rows["seed_id"] == r]), np.sort(np.sort(sims[r])[-4:]), atol=1e-13)
    # Places are asked for once a block, not once a slice of rows.
    assert sum(asked[-2:]) < 70 * 300 / 4
    starts = np.array([0, 4, 5, 20, 49, 140])
    c = every[0]
    groups, wide = blocked.Products(s, c, starts=starts), np.maximum.reduceat(s["vec"] @ c["vec"].T, starts, axis=1)
    i, j = blocked.reaching(groups, np.full(70, 0.3), 10**6)
    assert sorted(zip(i, j)) == sorted(zip(*np.nonzero(wide >= 0.3)))
    assert blocked.reaching(groups, np.full(70, -1.0), 10) is None


def test_wide_blocks_of_seeds_read_passages_less_often(spark, monkeypatch):
    monkeypatch.setattr(blocked, "BLOCK_ROWS", 4)
    rows = [(k, f"b{k % 3}", "a", v.tolist()) for k, v in enumerate(vectors(np.random.default_rng(9), 200, 4))]
    v = spark.createDataFrame(rows, "id long, book_id string, author string, vec array<double>").cache()
    calls = spark.sparkContext.accumulator(0)
    show = lambda df: sorted(map(tuple, df.collect()))
    want = show(engines.plain(v, v))
    read = blocked.block_pairs(v, v, lambda s, c: calls.add(1) or blocked.kept(s, c, blocked.Products(s, c), 3), engines.FOUND, blocked.best(3))
    assert read.count() and calls.value < 50 * 50 / 2
    monkeypatch.setattr(blocked, "WIDEST", 1)
    assert show(engines.plain(v, v)) == want


def test_a_report_makes_each_product_once(spark, monkeypatch):
    rows = [(k, f"b{k % 3}", "a", v.tolist()) for k, v in enumerate(vectors(np.random.default_rng(7), 40, 4))]
    v = spark.createDataFrame(rows, "id long, book_id string, author string, vec array<double>").cache()
    calls = spark.sparkContext.accumulator(0)
    of_pairs = blocked.block_pairs

    def counted(seeds, chunks, work, *more, **named):
        return of_pairs(seeds, chunks, lambda s, c: calls.add(1) or work(s, c), *more, **named)

    monkeypatch.setattr(engines, "block_pairs", counted)
    assert reports.engine_report({"plain": engines.plain(v, v), "few": engines.plain(v, v, 2)}, v, v).count() == 2
    # Two engines' picks, and one pass that ranks both.
    assert calls.value == 3


@pytest.mark.parametrize("pool", [8, 120])
def test_a_shorter_band_is_the_longer_one_s_first_rows(spark, pool):
    rows = [(k, f"b{k % 3}", "a", v.tolist()) for k, v in enumerate(vectors(np.random.default_rng(10), 90, 4))]
    v = spark.createDataFrame(rows, "id long, book_id string, author string, vec array<double>").cache()
    show = lambda df: sorted((r.seed_id, r.pos, r.id, round(r.similarity, 12)) for r in df.collect())
    assert show(engines.band_pool(v, v, pool=pool).where("pos <= 16")) == show(engines.band_pool(v, v, pool=8))
