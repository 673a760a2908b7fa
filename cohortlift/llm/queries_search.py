"""Registered queries of the search operator."""

from __future__ import annotations

from cohortlift.llm.hnsw import nearest
from cohortlift.llm.registry import query, table


@query("op4_graph_neighbours")
def op4_graph_neighbours(spark, sf_dir):
    """The five nearest rows of every row whose id is divisible by 50."""
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where("vec_id % 50 = 0"))
