"""Connected components as a DataFrame iteration (large-star / small-star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import forget, materialize


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod("a", F.lit(1_000_003)))).first())


def connected_components(edges: DataFrame) -> tuple[DataFrame, list[str]]:
    """(node, root) for each node of ``edges`` (a, b); root is the smallest node reachable.

    Each round joins every node with the smallest of its neighbours, first looking
    up the order and then down it; a round is written to the shared folder, so no
    lineage builds up and a lost executor costs one round at most.  Rounds grow
    with the logarithm of the longest path.  Only three numbers a round reach the
    driver.  Null ends and self loops are ignored; no edges give no rows.
    Also returns the folders still in use, for ``forget``.
    """
    spark = edges.sparkSession
    clean = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current, path = materialize(clean, "components")
    before = _signature(current)
    while before[0]:
        # look-up tables are written first: a join of two plain exchanges is one whose hot hub adaptive execution can split
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low, low_path = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m")), "components-low")
        up, up_path = materialize(current.join(low, F.col("b") == F.col("u")).select("a", F.col("m").alias("b")), "components-up")
        least, least_path = materialize(up.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m"), "components-least")
        down = up.join(least, F.col("a") == F.col("u")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        nxt, nxt_path = materialize(down.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), "components")
        forget(spark, low_path, up_path, least_path)
        forget(spark, path)
        current, path, after = nxt, nxt_path, _signature(nxt)
        if after == before:
            break
        before = after
    found = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found.unionByName(found.select(F.col("root").alias("node"), "root")).distinct(), [path]
