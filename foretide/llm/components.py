"""Connected components of a table of links, by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretide.llm.common import materialised, remove_tables, tables_so_far


def _roots(parents: DataFrame) -> DataFrame:
    """node, label: the end of each chain of parents, by pointer jumping."""
    while True:
        of = parents.select(F.col("node").alias("at"), F.col("label").alias("next"))
        jumped = parents.join(of, F.col("label") == F.col("at")).select("node", "next", F.col("label").alias("old"))
        jumped = materialised(jumped)
        parents = jumped.select("node", F.col("next").alias("label"))
        if jumped.filter("next < old").isEmpty():
            return parents


def components(links: DataFrame) -> DataFrame:
    """node, label for each node of links (a, b; one direction is enough): label is the smallest node that is reachable.

    In a round each node hooks to its smallest smaller neighbour (partial minima before the shuffle), chains are followed to
    their ends, and the links between different ends are all that goes on to the next round: at least half of the nodes go each
    time, and the links in total are read little more than once. Rounds are cut off by tables in the shared folder (a checkpoint
    would keep the estimated size of its plan, which doubles its digits with every join), all but the last of which are removed.
    Joins on nodes with very many links are plain ones between stored tables, which adaptive execution splits.
    """
    before = tables_so_far()
    edges = materialised(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    labels = edges.select(F.col("a").alias("node"), F.col("a").alias("label")).limit(0)
    first = True
    while not edges.isEmpty():
        hooks = edges.select(F.col("b").alias("node"), "a").union(edges.select(F.col("a").alias("node"), "a"))
        ends = _roots(materialised(hooks.groupBy("node").agg(F.min("a").alias("label"))))
        if first:
            labels, first = ends, False
        else:
            further = ends.select(F.col("node").alias("at"), F.col("label").alias("next"))
            labels = labels.join(further, F.col("label") == F.col("at"), "left").select("node", F.coalesce("next", "label").alias("label"))
            labels = materialised(labels)
        of_a = ends.select(F.col("node").alias("a"), F.col("label").alias("end_a"))
        of_b = ends.select(F.col("node").alias("b"), F.col("label").alias("end_b"))
        apart = edges.join(of_a, "a").join(of_b, "b").filter("end_a <> end_b")
        edges = materialised(apart.select(F.least("end_a", "end_b").alias("a"), F.greatest("end_a", "end_b").alias("b")).distinct())
    labels = materialised(labels)
    remove_tables(links.sparkSession, [t for t in tables_so_far() if t not in before][:-1])
    return labels
