"""Joins of tables that grow with the mesh."""

from __future__ import annotations

from pyspark.sql import DataFrame


def large(df: DataFrame) -> DataFrame:
    """``df`` as a side of a sort-merge join.

    The optimiser takes an exploded or compressed table for much smaller than it is and
    would gather it on the driver to broadcast it; tables that grow with the mesh or
    with the points are joined by exchanges, whatever the estimate.
    """
    return df.hint("merge")
