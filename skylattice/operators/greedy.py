"""Greedy choices in an order, without walking through it: a row is taken if no conflicting row before it is taken.

Rows without an earlier conflict are taken at once, rows with a taken earlier conflict are turned away, and the rest waits
for the next round. The number of rounds is that of the longest chain of conflicts, not of the rows; each round is
written to the shared folder, and only whether rows are left reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.session import materialize


def taken(nodes: DataFrame, conflicts: DataFrame) -> DataFrame:
    """node of the rows that are taken. nodes: node (unique), given (taken from the start). conflicts: before, after (nodes,
    one row per pair, the earlier one first)."""
    edges = materialize(conflicts.select("before", "after"), "greedy-conflicts")
    every = nodes.select("node", "given")
    open_ = every.where("not given").join(edges.select(F.col("after").alias("node")).distinct(), "node", "left_semi").select("node")
    kept = every.where("given").select("node").unionByName(every.where("not given").join(edges.select(F.col("after").alias("node")).distinct(), "node", "left_anti").select("node"))
    kept, open_ = materialize(kept, "greedy-kept"), materialize(open_, "greedy-open")
    out = kept
    while not open_.isEmpty():
        lost = edges.join(kept.select(F.col("node").alias("before")), "before", "left_semi").select(F.col("after").alias("node")).distinct()
        rest = materialize(open_.join(lost, "node", "left_anti"), "greedy-rest")
        # conflicts that still count are those between rows that wait
        edges = materialize(edges.join(rest.select(F.col("node").alias("before")), "before", "left_semi").join(rest.select(F.col("node").alias("after")), "after", "left_semi"), "greedy-conflicts")
        waits = edges.select(F.col("after").alias("node")).distinct()
        kept = materialize(rest.join(waits, "node", "left_anti"), "greedy-kept")
        open_ = materialize(rest.join(waits, "node", "left_semi"), "greedy-open")
        out = out.unionByName(kept)
    return out
