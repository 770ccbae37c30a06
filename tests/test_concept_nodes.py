"""Activations looked for by the nodes that a seed and a passage share are those of all pairs."""

import numpy as np
import pytest
from strandweave.operators import blocked, concepts


def passages(rng, n, nodes, most=5):
    j = np.full((n, most), nodes)
    back = np.zeros((n, most))
    for r in range(n):
        own = rng.choice(nodes, rng.integers(1, most + 1), replace=False, p=np.arange(1, nodes + 1) / (nodes * (nodes + 1) / 2))
        j[r, : len(own)], back[r, : len(own)] = own, 1 / (50 + 40 * own)
    return {"id": np.arange(n), "j": j, "back": back}


def whole(block, column, nodes):
    out = np.zeros((len(block["j"]), nodes + 1))
    out[np.arange(len(out))[:, None], block["j"]] = block[column]
    return out[:, :-1]


@pytest.mark.parametrize("spread", [0.01, 0.5, 3.0])
def test_all_that_reach_a_floor_are_found_and_few_pairs_are_multiplied(spread):
    rng, nodes = np.random.default_rng(2), 60
    s, c = passages(rng, 120, nodes), passages(rng, 400, nodes)
    s["out"] = (whole(s, "back", nodes) > 0).astype(float)
    s["out"] /= s["out"].sum(axis=1, keepdims=True)
    s["mass"] = s["out"] @ (np.eye(nodes) + spread * rng.random((nodes, nodes)) / nodes)
    s["mass32"] = s["mass"].astype(np.float32)
    back = whole(c, "back", nodes)
    act = s["mass"] @ back.T
    shared = (s["out"] > 0).astype(int) @ (back > 0).T.astype(int) > 0
    floor = np.sort(np.where(shared, act, 0), axis=1)[:, -8]
    asked = concepts.Asked(s, back.max(axis=0), c["j"].shape[1])
    i, j, got = concepts.reached(s, c, asked, floor * (1 - concepts.ROUGH) - concepts.ROUNDED)
    assert np.allclose(got, act[i, j], rtol=1e-12) and shared[i, j].all() and len(set(zip(i, j))) == len(i)
    assert set(zip(*np.nonzero(shared & (act >= floor[:, None])))) <= set(zip(i, j))
    multiplied = sum(len(mine) * (back[:, k] > 0).sum() for k, mine in asked.by_node(floor))
    every = sum(len(mine) * (back[:, k] > 0).sum() for k, mine in asked.by_node(np.zeros(120)))
    assert multiplied <= every and (spread > 0.1 or multiplied < 0.6 * every)


def test_an_activation_that_rounds_up_to_the_floor_is_found():
    """Of activations that are alike to nine places that of the smaller id counts, however small they are."""
    s = {"out": np.array([[1.0]]), "mass": np.array([[1.0]]), "mass32": np.array([[1.0]], np.float32)}
    c = {"id": np.array([1]), "j": np.array([[0]]), "back": np.array([[1.9996e-6]])}
    floor = np.maximum(2e-6, concepts.MIN_ACTIVATION) * (1 - concepts.ROUGH) - concepts.ROUNDED
    i, _, act = concepts.reached(s, c, concepts.Asked(s, np.array([2e-6]), 1), np.array([floor]))
    assert len(i) == 1 and np.round(act, 9)[0] == 2e-6


def test_seeds_of_several_blocks_have_the_picks_of_one(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(k, f"n{x:02d}", 1.0 / (2 + x)) for k in range(60) for x in rng.choice(12, rng.integers(1, 5), replace=False).tolist()]
    graph = spark.createDataFrame(rows, "id long, node string, w double").cache()
    books = spark.createDataFrame([(k, f"b{k % 3}") for k in range(60)], "id long, book_id string").cache()
    show = lambda: sorted((r.seed_id, r.pos, r.id, r.similarity) for r in concepts.page_rank(graph, books, 4).collect())
    want = show()
    monkeypatch.setattr(blocked, "BLOCK_ROWS", 8)
    assert show() == want
