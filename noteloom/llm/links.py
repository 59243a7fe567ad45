"""Connected components of links between document ids."""

from __future__ import annotations

from pyspark.sql import DataFrame

from noteloom.operators.components import roots


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(a, b) that is linked to another: root is the smallest node reachable."""
    return roots(edges)
