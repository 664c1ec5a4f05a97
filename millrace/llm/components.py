"""Connected components, as the corpus operators call them."""

from __future__ import annotations

from pyspark.sql import DataFrame

from millrace.operators import graph


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node with an edge reaches. ``edges`` has u and v; loops and repeats may occur."""
    return graph.components(edges, "u", "v", "component")
