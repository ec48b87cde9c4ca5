"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railloom.workspace import Workspace


def connected_components(links: DataFrame, workspace: Workspace, name: str = "components") -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the smallest node that it reaches.

    Each round hooks every node to its smallest neighbour, follows two such hooks more, and goes on
    with the links between what the nodes now stand for. Links and nodes stay distributed; only the
    number of links left comes to the driver. A node of many links meets them in partial minima.
    """
    links = workspace.table(links.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}_links_0")
    labels = None
    step = 0
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = workspace.table(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("up")), f"{name}_hooks_{step}")

        def follow(table: DataFrame, column: str) -> DataFrame:
            """``column`` replaced by what it is hooked to."""
            other = hooks.select(F.col("a").alias("__n"), F.col("up").alias("__up"))
            return table.join(other, F.col(column) == F.col("__n"), "left").withColumn(column, F.coalesce("__up", column)).drop("__n", "__up")

        hooks = workspace.table(follow(follow(hooks, "up"), "up"), f"{name}_jumps_{step}")
        moved = hooks.select(F.col("a").alias("node"), F.col("up").alias("component")) if labels is None else follow(labels, "component")
        labels = workspace.table(moved, f"{name}_labels_{step}")
        ends = follow(follow(links, "a"), "b").where(F.col("a") != F.col("b"))
        links = workspace.table(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}_links_{step + 1}")
        for old in (f"{name}_hooks_{step}", f"{name}_links_{step}", *([f"{name}_labels_{step - 1}"] if step else [])):
            workspace.drop(old)
        step += 1
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
