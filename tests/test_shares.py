"""What the walk over concepts and the fusion of paths move."""

import numpy as np
import pytest
from strandweave.operators import concepts
from strandweave.shared import stored


def test_shares_of_all_nodes_are_made_where_they_are_multiplied(spark):
    graph = spark.createDataFrame([(k, f"n{k % 5}", 1.0) for k in range(20)] + [(k, f"n{(k + 1) % 5}", 0.5) for k in range(19)], "id long, node string, w double")
    walk = concepts._walk(graph)
    rows = walk.listed(walk.rows).orderBy("id").collect()
    assert {(len(r.j), len(r.out), len(r.back)) for r in rows} == {(2, 2, 2)}
    block = walk.shares({n: np.array([r[n] for r in rows]) for n in ("j", "out", "back")}, "out", "back")
    assert block["out"].shape == (20, 5) and block["out"].sum(axis=1) == pytest.approx(1)
    assert block["out"][3].tolist() == pytest.approx([0, 0, 0, 2 / 3, 1 / 3]) and (block["back"][19] > 0).tolist() == [False, False, False, False, True]


def test_stored_tables_of_many_rows_are_not_broadcast(spark):
    import __spark_entry__ as entry

    entry._ready(lambda s, d: None)(spark, "")
    # Some files' bytes a hundredth of their rows'.
    many = stored(spark.range(2_000_000).selectExpr("id", "id div 100000 AS k"), "many")
    plan = spark.range(5_000_000).join(many, "id")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
