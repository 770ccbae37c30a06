"""Layouts against numpy's axes; edges over levels."""

import numpy as np

from strandweave.operators import maps


def axes(m):
    c = m - m.mean(axis=0)
    _, _, v = np.linalg.svd(c, full_matrices=False)
    v = v[:2] * np.sign(v[:2][np.arange(2), np.abs(v[:2]).argmax(axis=1)])[:, None]
    xy = c @ v.T
    xy = xy - xy.min(axis=0)
    return np.round(xy / xy.max(axis=0) * 1000, 1)


def test_levels_share_axes_and_have_edges_within_and_between(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(24, 5)) * [5, 3, 1, 0.5, 0.1]
    rows = [("chunk" if i < 20 else "parent", i, 20 + i % 4 if i < 19 else (77 if i == 19 else None), f"b{i % 2}", m[i].tolist()) for i in range(24)] + [("chunk", 90, 20, "b0", None)]
    units = spark.createDataFrame(rows, "level string, id long, parent_id long, book_id string, vec array<double>")
    nodes, edges = maps.chunk_map(units)
    got = {r.id: (r.x, r.y) for r in nodes.collect()}
    assert np.allclose([got[i] for i in range(24)], axes(m), atol=0.11) and len(got) == 24
    found = {(r.source, r.target, r.kind) for r in edges.collect()}
    sims = m @ m.T
    near = {(i, max((j for j in range(24) if j != i and (j < 20) == (i < 20)), key=lambda j: sims[i, j]), "near") for i in range(24)}
    assert found == near | {(i, 20 + i % 4, "parent") for i in range(19)}
    none, no_edges = maps.chunk_map(units.limit(0))
    assert none.count() == 0 and no_edges.count() == 0


def test_concepts_lie_by_what_they_occur_with(spark):
    rng = np.random.default_rng(2)
    links = {(i, f"c{k}") for i in range(80) for k in rng.choice(7, 3, replace=False, p=[0.3, 0.2, 0.2, 0.1, 0.1, 0.05, 0.05])} | {(200, "alone")}
    chunks = spark.createDataFrame([(i, f"b{i % 3}") for i in range(201)], "id long, book_id string")
    nodes, edges = maps.concept_map(spark.createDataFrame(sorted(links) + [(0, sorted(links)[0][1])], "id long, label string"), chunks)
    labels = sorted({x for _, x in links})
    count = np.zeros((len(labels), len(labels)))
    for i in range(201):
        own = [labels.index(x) for j, x in links if j == i]
        for a in own:
            for b in own:
                count[a, b] += a != b
    got = {r.label: r for r in nodes.collect()}
    assert np.allclose([(got[x].x, got[x].y) for x in labels], axes(count), atol=0.11)
    assert {x: got[x].n for x in labels} == {x: sum(y == x for _, y in links) for x in labels}
    assert all(r.n == count[labels.index(r.a), labels.index(r.b)] for r in edges.collect())
    none, _ = maps.concept_map(spark.createDataFrame([], "id long, label string"), chunks)
    assert none.count() == 0
