"""Connected components: forests inside a task, alternating stars across tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm.common import stored

MAX_ROUNDS = 60


def unite(parent: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Merges the trees of the pairs in `parent` (row to row, roots point at themselves), in place.

    Hooks every larger root to the smallest root it meets, then halves paths, until no pair
    joins two trees.  A root is always the smallest row of its tree.
    """
    while len(left):
        a, b = parent[left], parent[right]
        open_ = a != b
        if not open_.any():
            return
        left, right, a, b = left[open_], right[open_], a[open_], b[open_]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up


def _same(df: DataFrame) -> tuple:
    row = df.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
    return row["n"], row["x"]


def connected(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of `edges` (columns u, v); component is the smallest node reachable.

    Alternating large-star and small-star rounds: every round is a keyed minimum with map-side
    combine and a join back that AQE may split, so a node with very many neighbours is no single
    task.  Each round's edges are a written table.  Edges with a null end and loops are ignored;
    no edges give an empty result.
    """
    e = (
        edges.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
        .where("a < b")
        .distinct()
    )
    e = stored(e, name)
    before = _same(e)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            e.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("x"), F.col("m").alias("y")).distinct()
        low = large.groupBy("x").agg(F.min("y").alias("m"))
        small = (
            large.join(low, "x")
            .select(F.explode(F.array(F.struct("x", "m"), F.struct(F.col("y").alias("x"), "m"))).alias("p"))
            .select(F.col("p.m").alias("a"), F.col("p.x").alias("b"))
            .where("a < b")
            .distinct()
        )
        e = stored(small, name)
        after = _same(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
        e.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    )
