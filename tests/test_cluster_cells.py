"""The summary of a cluster names its cells."""

from __future__ import annotations

from kinloom.operators import hexgrid as H


def test_cluster_summary_names_the_cells(spark):
    cells = spark.createDataFrame(
        [(1, 7, 2, False), (1, 3, 1, False), (2, 5, 4, False), (None, 9, 0, True)], "cluster int, cell_id int, n_points long, empty boolean"
    )
    got = {r["cluster"]: (r["n_cells"], r["n_points"], r["cell_ids"]) for r in H.cluster_summary(cells).collect()}
    assert got == {1: (2, 3, [3, 7]), 2: (1, 4, [5])}
