"""Connected components of a link table by alternating large and small stars.

Each round links every node's neighbours to the smallest of them, first those
above the node, then those below, until the table no longer changes; it is then
one star per component.  Minimum labels are partial aggregates, so that a node
with very many links costs one row for each task.  Every round is written to
the shared folder, which cuts the lineage, and runs in as many tasks as the
links are worth: no round has more of them than the one before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendlens.sources.writers import in_few_tasks, materialize

MAX_ROUNDS = 60


def _least(edges: DataFrame, rows: int) -> DataFrame:
    return in_few_tasks(edges.groupBy("u").agg(F.min("v").alias("m")), rows)


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    centre = _least(in_few_tasks(both, rows), rows).select("u", F.least("u", "m").alias("m"))
    return in_few_tasks(both.where("v > u").join(centre, "u").select(F.col("v").alias("u"), F.col("m").alias("v")), rows)


def _small_star(edges: DataFrame, rows: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    linked = in_few_tasks(down.join(_least(down, rows), "u"), rows)
    return linked.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v) of long ids to ``node, component``: the smallest node
    reachable.  Nodes without links don't appear."""
    clean = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    clean = materialize(clean, "links")
    rows = clean.count()
    clean = in_few_tasks(clean, rows)
    for _ in range(MAX_ROUNDS):
        moved = _small_star(_large_star(clean, rows), rows).where("u > v").distinct()
        moved = in_few_tasks(materialize(in_few_tasks(moved, rows), "links"), rows)
        # a table is done when no node is both a leaf and a centre, or has two centres
        leaves = in_few_tasks(moved.groupBy("u").agg(F.count("*").alias("n")), rows)
        chained = in_few_tasks(moved.join(leaves.select(F.col("u").alias("v")), "v", "left_semi"), rows)
        open_ = leaves.where("n > 1").limit(1).count() or chained.limit(1).count()
        clean = moved
        if not open_:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    leaves = clean.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(in_few_tasks(clean.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct(), rows))
