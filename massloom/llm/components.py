"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from massloom.operators import graph
from massloom.session import Scratch


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) of every id in ``links`` (a, b); the component is its smallest id.

    The links are written first, so that the search does not make them again each round.
    """
    return graph.components(scratch.keep(links, "links"))
